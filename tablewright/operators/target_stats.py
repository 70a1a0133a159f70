"""Ordered target statistics of categories (MOD3, the encoding that CatBoost's family uses).

A row's category is replaced by the smoothed mean of the target over the rows of that category
that come *before* it in a seeded permutation, so no row's own target, nor a later one's, enters
its feature: (sum before + smoothing * prior) / (rows before + smoothing).

The rows are range-partitioned by (category, place in the permutation): a hot category spreads
over many partitions, of about ``PART_ROWS`` rows however large the table.  Sums run within a
partition, and each partition's part of a category gets the sum of the parts before it as an
offset - one row for each (partition, category), which travels with the part's rows as its first.

Results: NULL categories are one category; NULL targets add nothing but take a place; repeated
ids are ordered by the target; an empty table gives an empty one.  ``category_means`` are the
statistics of all training rows, for rows that are scored later; unseen categories get the prior.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

PART_ROWS = 250_000     # rows that one task sorts


def place(ids: list[str], seed: int) -> Column:
    """The order key of a row in the permutation of ``seed``."""
    return F.md5(F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in ids], F.lit(str(seed))))


def ordered_target_stats(df: DataFrame, category: str, target: str, ids: list[str], prior: float,
                         smoothing: float = 1.0, seed: int = 42, out: str = "target_stat") -> DataFrame:
    """``df`` with ``out``, the ordered statistic of ``category``; ``ids`` identify a row."""
    checkpoint_dir(df.sparkSession)
    y = F.col(f"`{target}`").cast("double")
    keyed = df.withColumn("__place", place(ids, seed)).withColumn("__c", F.col(f"`{category}`").cast("string"))
    parts_wanted = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // PART_ROWS + 1)
    # the partition of a row must not change between its readers: written once
    ranged = (keyed.repartitionByRange(parts_wanted, "__c", "__place", y).withColumn("__part", F.spark_partition_id())
              .checkpoint())
    parts = ranged.groupBy("__c", "__part").agg(F.sum(y).alias("__s"), F.count(y).alias("__n"))
    before = Window.partitionBy("__c").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("__c", "__part", F.coalesce(F.sum("__s").over(before), F.lit(0.0)).alias("__os"),
                           F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__on"), F.lit(0).alias("__kind"))
    # __kind puts a part's offset before its rows
    rows = ranged.withColumn("__kind", F.lit(1)).unionByName(offsets, allowMissingColumns=True)
    within = (Window.partitionBy("__part", "__c").orderBy("__kind", "__place", y)
              .rowsBetween(Window.unboundedPreceding, -1))
    local = (rows.repartition(parts_wanted, "__part", "__c")
             .withColumn("__ls", F.coalesce(F.sum(y).over(within), F.lit(0.0))).withColumn("__ln", F.count(y).over(within))
             .withColumn("__so", F.first("__os").over(within)).withColumn("__no", F.first("__on").over(within)))
    stat = (F.col("__ls") + F.col("__so") + F.lit(smoothing * prior)) / (F.col("__ln") + F.col("__no") + F.lit(smoothing))
    return local.where(F.col("__kind") == 1).select(*df.columns, stat.alias(out))


def category_means(train: DataFrame, category: str, target: str, prior: float, smoothing: float = 1.0,
                   out: str = "target_stat") -> DataFrame:
    """(category, ``out``): the statistic of each category over all training rows."""
    y = F.col(f"`{target}`").cast("double")
    stat = (F.coalesce(F.sum(y), F.lit(0.0)) + F.lit(smoothing * prior)) / (F.count(y) + F.lit(smoothing))
    return train.groupBy(F.col(f"`{category}`").alias(category)).agg(stat.alias(out))
