"""Multi-index hashing over 64-bit codes.

A code is cut into segments.  Every code is filed under its own value in each segment's table,
and looks up all values within ``radius`` bits of it.  Two codes that differ in fewer than
``segments * (radius + 1)`` bits meet in at least one table.

A table entry and its look-ups form a bucket, worked in one pass over sorted rows.  Buckets
over ``BLOCK`` rows are cut into blocks by a hash and dealt as pairs of blocks, so no task
holds a large bucket, and a bucket returns links of a spanning forest, never all its pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir

BITS = 64
BLOCK = 1024
GROUP = ["seg", "key", "bi", "bj"]


def masks(width: int, radius: int) -> list[int]:
    """All bit patterns of a segment with at most ``radius`` bits set, the empty one first."""
    return [sum(1 << b for b in bits) for r in range(radius + 1)
            for bits in itertools.combinations(range(width), r)]


def segment(code, seg: int, segments: int):
    """A segment's value of a code column (signed long, bits counted from the low end)."""
    width = BITS // segments
    return F.shiftrightunsigned(code, seg * width).bitwiseAND(F.lit((1 << width) - 1))


def buckets(codes: DataFrame, segments: int, radius: int) -> DataFrame:
    """(id, code) rows dealt to buckets: GROUP columns, ``role`` (0: filed, 1: looking up), id
    and code.  Buckets that hold a single code are left out: they have no pair."""
    checkpoint_dir(codes.sparkSession)
    filed = codes.select("id", "code", F.inline(F.array(*[
        F.struct(F.lit(j).alias("seg"), segment(F.col("code"), j, segments).alias("key")) for j in range(segments)])))
    ball = filed.select("id", "code", "seg", F.posexplode(F.array(*[
        F.col("key").bitwiseXOR(F.lit(m).cast("long")) for m in masks(BITS // segments, radius)])).alias("away", "key"))
    tables = filed.select("seg", "key").distinct()
    hits = ball.join(tables, ["seg", "key"], "left_semi").checkpoint()
    sizes = hits.groupBy("seg", "key").agg(F.count("*").alias("n")).where("n > 1")
    sized = (hits.join(sizes, ["seg", "key"]).withColumn("nb", F.ceil(F.col("n") / BLOCK).cast("int"))
             .withColumn("mine", F.pmod(F.xxhash64("id", "code"), F.col("nb")).cast("int")))
    every = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    left = sized.where("away = 0").select("seg", "key", F.col("mine").alias("bi"), every.alias("bj"), F.lit(0).alias("role"), "id", "code")
    right = sized.select("seg", "key", every.alias("bi"), F.col("mine").alias("bj"), F.lit(1).alias("role"), "id", "code")
    return left.select(*GROUP, "role", "id", "code").union(right.select(*GROUP, "role", "id", "code"))


def per_bucket(rows: DataFrame, work: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray] | None],
               schema: str) -> DataFrame:
    """Apply ``work`` to the numpy columns of each bucket's pair of blocks, left rows first."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, kept = [], 0
        for group in groups(batches, names):
            if (got := work(group)) is not None:
                out.append(got)
                kept += len(next(iter(got.values())))
            if kept >= 50_000:
                yield pa.RecordBatch.from_pydict({k: np.concatenate([g[k] for g in out]) for k in out[0]})
                out, kept = [], 0
        if out:
            yield pa.RecordBatch.from_pydict({k: np.concatenate([g[k] for g in out]) for k in out[0]})

    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "role", "id").mapInArrow(run, schema)


def groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Runs of equal GROUP values in sorted batches; binary columns become matrices of bytes."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = {}
        for name in names:
            column = batch.column(name)
            if pa.types.is_binary(column.type):
                part[name] = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
            else:
                part[name] = column.to_numpy(zero_copy_only=False)
        if held is not None:
            part = {k: np.concatenate([held[k], part[k]]) for k in names}
        new = np.zeros(len(part["key"]) - 1, bool)
        for name in GROUP:
            new |= part[name][1:] != part[name][:-1]
        at = 0
        for to in np.flatnonzero(new) + 1:
            yield {k: v[at:to] for k, v in part.items()}
            at = to
        held = {k: v[at:] for k, v in part.items()}
    if held is not None:
        yield held


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Differing bits of every left and right code of a pair of blocks."""
    return np.bitwise_count(left.view(np.uint64)[:, None] ^ right.view(np.uint64)[None, :])


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id connected to it within the block pair) of the ids whose smallest is
    another; ``linked`` is the left x right link matrix."""
    rows, cols = linked.any(1), linked.any(0)
    part, a, b = linked[np.ix_(rows, cols)], left[rows], right[cols]
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = at[:len(a)], at[len(a):]
    label = np.arange(len(ids))
    far = len(ids)
    while len(ids):
        new = label.copy()
        np.minimum.at(new, ia, np.where(part, label[ib][None, :], far).min(1))
        np.minimum.at(new, ib, np.where(part, new[ia][:, None], far).min(0))
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]
