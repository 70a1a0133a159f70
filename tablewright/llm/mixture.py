"""Mixing of sources to target weights, with DataFrame functions only.

The tokens of each source are summed (a map-side aggregate, so a source holding a third of
the rows costs each task one row), the targets of the few sources are levelled, and every
document is emitted floor(rate) times plus once more with the fraction as probability, drawn
from a hash of its id: reruns and retried tasks agree.

Targets share ``share`` of all tokens by weight; none passes ``most`` times its source's
tokens, and what is cut is shared again by weight.  That fixed point is one level: with
``most * size / weight`` ascending, the sources below the level stand at their cap and the
others get level * weight, so a running sum over the sources finds it without iterating.

Results: a null or empty text has size 0 and is emitted like any other; null ``source`` is a
source of its own, last in order; rows with one ``doc_id`` (a null one included) share one
draw; columns named like the added ones are replaced; empty tables give empty results; a very
long text is one row of a large size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_BYTES = 32 << 20      # of source names; beyond that the join shuffles (AQE splits hot sources)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from (source, source_size) rows.  One row per
    source: the windows see the sources, not the documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("w", F.get(wheel, (F.row_number().over(order) - 1) % len(weights)))
    full = F.lit(most) * F.col("source_size")
    upto = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (ranked.withColumn("ratio", full / F.col("w"))
             .withColumn("total", F.lit(share) * F.sum("source_size").over(every))
             .withColumn("left", F.col("total") - F.coalesce(F.sum(full).over(upto), F.lit(0.0)))
             .withColumn("open", F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
             .withColumn("try", F.col("left") / F.col("open"))
             .withColumn("level", F.max(F.when(F.col("try") <= F.col("ratio"), F.col("try"))).over(every)))
    target = F.when(F.col("ratio") <= F.coalesce("level", F.lit(float("inf"))), full).otherwise(F.col("level") * F.col("w"))
    return level.select("source", "source_size", target.alias("target"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5,
             most: float = 2.0, seed: str = "mix") -> DataFrame:
    """The documents with ``size``, ``source_size``, ``target``, ``rate`` and ``copies``."""
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    checkpoint_dir(docs.sparkSession)
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size")).checkpoint()
    targets = source_targets(sizes, weights, share, most).withColumnRenamed("source", "of_source")
    # left to itself the join would deal whole documents by source, a third of them to one task
    size = sizes.agg(F.coalesce(F.sum(F.octet_length("source") + 64), F.lit(0)).alias("bytes")).first()["bytes"]
    targets = F.broadcast(targets) if size <= BROADCAST_BYTES else targets
    added = ["source_size", "target", "rate", "copies", "of_source"]
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    draw = F.conv(F.substring(key, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    return (sized.drop(*added).join(targets, F.col("source").eqNullSafe(F.col("of_source")), "inner").drop("of_source")
            .withColumn("rate", rate)
            .withColumn("copies", (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long")))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as often as planned, with its own columns."""
    planned = plan_mix(docs, **options)
    return (planned.where("copies > 0")
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select(*docs.columns))
