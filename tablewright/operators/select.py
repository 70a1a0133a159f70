"""Univariate feature scoring and top-k selection (FEAT9).

ANOVA F (classification) comes from per-class count, sum and sum of squares of every feature,
computed in one ``groupBy(label)`` aggregation (one row per class, map-side combined);
F-regression comes from one global aggregation of the Pearson correlations.  Both need a
single pass over the data; the scoring arithmetic runs on the small per-class frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_FEATURES = 500   # fixed value: selection applies above this many features


def f_classif(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, position, f_score) with the one-way ANOVA F statistic per feature."""
    per_class = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(features)],
        *[F.sum(F.col(c).cast("double") ** 2).alias(f"q{i}") for i, c in enumerate(features)])
    long = per_class.select("n", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(i).alias("position"),
                 F.col(f"s{i}").alias("s"), F.col(f"q{i}").alias("q")) for i, c in enumerate(features)])))
    agg = long.groupBy("feature", "position").agg(
        F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("k"), F.sum("q").alias("ss_all"),
        F.sum("s").alias("s_all"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("sq_args"))
    sstot = F.col("ss_all") - F.col("s_all") * F.col("s_all") / F.col("n_all")
    ssbn = F.col("sq_args") - F.col("s_all") * F.col("s_all") / F.col("n_all")
    sswn = sstot - ssbn
    f = (ssbn / (F.col("k") - 1)) / (sswn / (F.col("n_all") - F.col("k")))
    return agg.select("feature", "position", F.when(sswn != 0, f).alias("f_score"))


def f_regression(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, position, f_score) with F = r^2 / (1 - r^2) * (n - 2)."""
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 *[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(f"r{i}")
                   for i, c in enumerate(features)])
    long = row.select("n", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(i).alias("position"), F.col(f"r{i}").alias("r"))
        for i, c in enumerate(features)])))
    r2 = F.col("r") * F.col("r")
    return long.select("feature", "position", (r2 / (1 - r2) * (F.col("n") - 2)).alias("f_score"))


def select_k_best(scores: DataFrame, k: int = MAX_FEATURES) -> DataFrame:
    """Mark the ``k`` best scores (NULL/NaN lowest; ties go to later positions)."""
    s = F.when(F.isnan("f_score") | F.col("f_score").isNull(), F.lit(float("-inf"))).otherwise(F.col("f_score"))
    w = Window.orderBy(s.desc(), F.col("position").desc())   # one row per feature
    return scores.withColumn("rank", F.row_number().over(w)).withColumn("selected", F.col("rank") <= k)
