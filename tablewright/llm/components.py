"""Connected components by alternating large-star and small-star steps.

Every step is a map-side aggregate and an equi-join on node ids; nothing is collected but one
count and checksum a round.  Lineage is cut with checkpoint() in the session's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def connected_components(links: DataFrame) -> DataFrame:
    """``id`` and ``component_id`` (the smallest id reachable) of every id that has a link in
    the (a, b) rows; ids are long.  Null ends and self links are ignored."""
    checkpoint_dir(links.sparkSession)
    edges = (links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
             .distinct().checkpoint())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least).distinct())
        edges = small.checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(
                edges.select("v", "v").distinct())
        before = now
