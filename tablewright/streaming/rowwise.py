"""Row-wise operators on streams.

Every row-wise operator of the library (quote stripping, datetime parts, non-finite fixing,
text rules, keywords, a fitted ``PipelineModel``) is a pure column expression, so it applies
to a streaming DataFrame unchanged.  ``run_to_table`` drives a stream with an
``availableNow`` trigger into a parquet table with a checkpoint under the shared checkpoint
folder, so a restarted job resumes exactly where it stopped (no lost or repeated batches).
Operators that need whole-table statistics (profiles, medians, vocabularies) are fitted on
batch data first and applied per micro-batch.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import text_rules as TR
from ..session import scratch_path


def _is_dir(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.getFileStatus(p).isDirectory())


def read_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 64) -> DataFrame:
    """Stream the parquet files under ``path`` with the schema of the current files."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if not _is_dir(spark, path):                   # a single file: stream its folder, filtered
        folder, name = path.rstrip("/").rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def classify_texts(stream: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """TXT1/TXT2 on a stream: task, domain and idea keywords per text."""
    t = F.col(text_col)
    return stream.select(*id_cols, TR.rule_task(t).alias("task_type"), TR.rule_domain(t).alias("domain"),
                         F.array_join(TR.keywords(t, "idea"), ",").alias("keywords"))


def score_stream(stream: DataFrame, model: PipelineModel) -> DataFrame:
    """MOD14 on a stream: a fitted pipeline of expression-only stages scores each batch."""
    return model.transform(stream)


def run_to_table(stream: DataFrame, name: str, out_path: str | None = None,
                 checkpoint: str | None = None) -> str:
    """Run the stream over everything available now into parquet; returns the table path."""
    spark = stream.sparkSession
    out_path = out_path or scratch_path(spark, f"stream-{name}")
    checkpoint = checkpoint or out_path + "-checkpoint"
    q = (stream.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out_path
