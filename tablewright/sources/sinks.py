"""Sinks (SNK1-SNK3): pipeline save/load and the training report as a DataFrame."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profile import attach


def save_pipeline(model: PipelineModel, path: str) -> str:
    """SNK1: every stage (datetime parts, cleaning, encoders, selector, estimator) is saved."""
    model.write().overwrite().save(path)
    return path


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def report_frame(spark: SparkSession, sections: dict[str, dict]) -> DataFrame:
    """SNK2/SNK3: a (section, key, value) frame from small driver-side summaries."""
    rows = [(s, str(k), None if v is None else str(v)) for s, kv in sections.items() for k, v in kv.items()]
    return spark.createDataFrame(rows, "section string, key string, value string")


def report_from_frames(frames: dict[str, DataFrame]) -> DataFrame:
    """SNK2: stack one-row (or few-row) result frames into (section, key, value) rows."""
    out = None
    for section, df in frames.items():
        cols = df.columns
        long = df.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in cols])))
        part = long.select(F.lit(section).alias("section"), "key", "value")
        out = part if out is None else out.unionByName(part)
    return out


def training_report(idea: str, profile: DataFrame, leaderboard: DataFrame, files: dict[str, str]) -> DataFrame:
    """SNK2: (section, key, value) rows of a training run: the idea, the one-row profile, the
    ranked metrics (``rank. model`` with one value per metric), the best model with its first
    metric, and the exported files.  ``leaderboard``: rank, model, then metric columns."""
    metrics = [c for c in leaderboard.columns if c not in ("rank", "model")]
    spark = leaderboard.sparkSession
    ranked = leaderboard.select(F.concat_ws(". ", F.col("rank").cast("string"), "model").alias("m"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("value")) for c in metrics])))
    best = leaderboard.where("rank = 1").select(F.lit("best model").alias("section"), F.col("model").alias("key"),
                                                F.col(metrics[0]).cast("string").alias("value"))
    return (report_frame(spark, {"idea": {"text": idea}, "exported files": files})
            .unionByName(report_from_frames({"dataset profile": profile}))
            .unionByName(ranked.select(F.lit("leaderboard").alias("section"), F.concat_ws(": ", "m", "k").alias("key"), "value"))
            .unionByName(best))


def run_record(quality: DataFrame, profile: DataFrame, leaderboard: DataFrame, files: dict[str, str], mode: str,
               dataset: str, task: str, target: str, features: list[str]) -> DataFrame:
    """SNK3: one row that describes a run: best model and its metrics, where the files are,
    quality score, mode, dataset, task, target, rows trained on and feature columns."""
    metrics = [c for c in leaderboard.columns if c not in ("rank", "model")]
    best = leaderboard.where("rank = 1").select(F.col("model").alias("best_model_name"),
                                                F.to_json(F.struct(*metrics)).alias("metrics"))
    row = attach(attach(best, quality.select("quality_score")), profile.select(F.col("num_rows").alias("rows_trained_on")))
    fixed = {"mode_used": mode, "dataset_used": dataset, "task_type": task, "target_column": target, **files}
    return row.withColumns({k: F.lit(v) for k, v in fixed.items()}).withColumn(
        "feature_columns", F.array(*map(F.lit, features)))


def write_report(report: DataFrame, path: str, fmt: str = "json") -> str:
    report.write.mode("overwrite").format(fmt).save(path)
    return path
