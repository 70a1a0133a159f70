"""Training rows as stored blocks of numbers, for fits that sum over all rows many times.

A block is ``(features, labels)`` - two numpy arrays of at most ``BLOCK_BYTES`` of numbers.  Blocks are
checkpointed: a fit is a loop of ``treeAggregate`` jobs over them, and a lost executor's tasks read
them again.  Rows whose features or label are null are left out; no rows at all is a ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir

BLOCK_BYTES = 1 << 20
PARTITION_BYTES = 16 << 20
FLAT_PARTS = 32         # partial sums that the driver adds without a stage between


def as_array(df: DataFrame, features: str) -> Column:
    """The features column as an array of doubles, null where it is null."""
    values = F.col(features)
    return F.when(values.isNotNull(), vector_to_array(values)) if isinstance(df.schema[features].dataType, VectorUDT) else values


def training_rows(df: DataFrame, features: str, label: str) -> tuple[DataFrame, dict]:
    """(features array, label) of the rows that teach, and their count, width and label figures."""
    checkpoint_dir(df.sparkSession)
    rows = (df.select(as_array(df, features).alias("features"), F.col(label).cast("double").alias("label"))
            .where("features IS NOT NULL AND label IS NOT NULL"))
    found = rows.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("width"), F.max("label").alias("top"),
                     F.avg("label").alias("mean"), F.stddev_pop("label").alias("std")).first().asDict()
    if not found["n"]:
        raise ValueError("no rows to learn from")
    return rows, found


def stored_blocks(rows: DataFrame, width: int, count: int, block_rows: int | None = None, mixed: int | None = None):
    """RDD of blocks, of ``block_rows`` rows where given.  ``mixed`` is a seed: rows are dealt
    round-robin and shuffled in each partition, so that a block of a sorted table is no stretch of it."""
    row_bytes = (width + 1) * 8
    block_rows = block_rows or max(1, BLOCK_BYTES // row_bytes)
    parts = max(1, count * row_bytes // PARTITION_BYTES,
                min(rows.sparkSession.sparkContext.defaultParallelism, count // block_rows))
    rows = rows.coalesce(parts) if mixed is None else rows.repartition(parts).sortWithinPartitions(F.rand(mixed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                x = part.column("features").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                y = part.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x, y)], ["x", "y"])

    def block(row):
        return np.frombuffer(row.x).reshape(-1, width), np.frombuffer(row.y)

    return stored(rows.mapInArrow(run, "x binary, y binary").rdd.map(block))


def stored(blocks):
    blocks.checkpoint()
    blocks.count()
    return blocks


def pruned(blocks, wanted: list[int]):
    """The RDD of some partitions of a stored one.  Tasks run on these only: one that runs and reads
    nothing of its partition loses its Python worker, and the next task waits for a new one."""
    jvm = blocks.context._jvm
    kept = jvm.org.apache.spark.rdd.PartitionPruningRDD.create(
        blocks._jrdd.rdd(), jvm.org.apache.spark.api.python.PythonUtils.toSeq(wanted).toSet())
    return RDD(kept.toJavaRDD(), blocks.context, blocks._jrdd_deserializer)


def merge_depth(blocks) -> int:
    """Levels of a tree of sums: one job of one stage where the partitions are few."""
    return 1 if blocks.getNumPartitions() <= FLAT_PARTS else 2


def summed(blocks, part):
    """The sum of ``part(block)`` - a numpy array or a tuple of them - over all blocks; None of none."""
    def both(a, b):
        if a is None or b is None:
            return b if a is None else a
        return tuple(p + q for p, q in zip(a, b)) if isinstance(a, tuple) else a + b

    return blocks.treeAggregate(None, lambda total, block: both(total, part(block)), both, merge_depth(blocks))
