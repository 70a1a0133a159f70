"""The corpus pipeline: language, quality, near duplicates, source mix, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; all but
the last return the columns of ``documents``.  ``run`` writes each stage's result as Parquet in
the session's shared folder and reads it again, so a lost executor repeats one stage at most.

Null and empty texts have no letter and go in the first stage; the other cases are those of
the operators.  The near-duplicate stage groups fingerprints, not ids: one row of each group
stays whatever its ``doc_id``, a null one only where the group has no other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import langid, mixture, packing, quality, simhash
from tablewright.llm.components import connected_components
from tablewright.llm.queries import labelled, load, vocabulary
from tablewright.llm.text import held_out
from tablewright.session import checkpoint_dir, scratch_path

LEAST_LANGUAGE = 0.5    # share of letters in the document's language
LEAST_QUALITY = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a language that holds at least half of their letters."""
    model = langid.learn(docs.where(~held_out(F.col("doc_id"))))
    found = langid.identify(docs, model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents the line field scores at ``LEAST_QUALITY`` or more."""
    model = quality.learn(labelled(spark, sf_dir, "quality"))
    return quality.score(docs, model).where(F.col("score") >= LEAST_QUALITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates: the smallest id (null last), of rows that
    share it the smallest hash of text and row."""
    checkpoint_dir(spark)
    keyed = docs.withColumns({"text_hash": F.md5(F.coalesce("text", F.lit("")).cast("binary")),
                              "row_hash": F.xxhash64(F.col("doc_id").isNull(), *docs.columns)})
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "row_hash")
    first = (simhash.fingerprints(keyed.select("doc_id", "text", "text_hash", "row_hash"), words=3)
             .groupBy("code").agg(F.min(order).alias("first")).checkpoint())
    groups = connected_components(simhash.near_codes(first.select(F.col("code").alias("id"), "code"), max_distance=3))
    kept = (first.join(groups.withColumnRenamed("id", "code"), "code", "left")
            .groupBy(F.coalesce("component_id", "code").alias("component")).agg(F.min("first").alias("first"))
            .select("first.text_hash", "first.row_hash"))
    keys = ["text_hash", "row_hash"]
    return keyed.join(kept, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their target weights."""
    return mixture.mix_sources(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids."""
    pieces = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=1)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("language", language), ("quality", good_quality), ("near_duplicates", near_duplicates),
          ("source_mix", source_mix), ("packing", packed)]
#: No stage but the mix can be stated in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
