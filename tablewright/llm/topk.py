"""Exact top-k by inner product: the three-phase uniform threshold algorithm.

A score is the sum of ``LISTS`` partial scores, one for each run of components.  For every
query:

1. each task gathers the ``k`` best entries of each of its local lists and their scores; the
   k-th best score of all that was gathered is a bound no answer lies below;
2. that bound is broadcast; an answer has at least one partial score of the uniform share
   bound / LISTS.  Each task goes through the first list again and collects the entries that
   reach the share, or still can reach the bound: the rest of a score is at most the product of
   the lengths of the rests of both vectors;
3. the missing partials of the collected entries alone are resolved, list by list; whatever can
   no longer reach the bound is dropped before the next list, and entries that reached the share
   in no list, fall below the bound or behind the task's k best are not passed on; the driver
   never sees scores.

Queries are worked in blocks of at most about ``block`` rows, dealt by a hash; a block and its
bounds are all that is broadcast.  Each block reads the vectors once and shuffles at most
k * LISTS rows per task and query.

Results: vectors that are null, hold null or non-finite components, or have another length
than most take no part, nor do null ids; rows with a query's own id are no candidates for it;
repeated candidates count each, repeated queries once (the row first in order of its
components); equal scores rank by smaller id; fewer candidates than k give fewer rows.  Scores
are exact longs: where doubles could round, components are multiplied in two parts.  Only if
length * (largest component)^2 passes the long range is there a ValueError: the ``score``
column could not hold such a score.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

LISTS = 4
ROWS = 2048     # candidates worked at once: the score matrix is ROWS x block
PART = 1 << 16  # of a component of a wide score: the low part
NONE = np.iinfo(np.int64).min


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _product(a: np.ndarray, b: np.ndarray, wide: bool) -> np.ndarray:
    """``a @ b.T`` of whole numbers, as exact longs.  Doubles hold it up to 2 ** 53; a wide one is
    put together from products of high and low parts, each within that."""
    if not wide:
        return (a @ b.T).astype(np.int64)
    (ah, al), (bh, bl) = ((h := np.floor(x / PART), x - h * PART) for x in (a, b))
    exact = [(x @ y.T).astype(np.int64) for x, y in ((ah, bh), (ah, bl), (al, bh), (al, bl))]
    return exact[0] * PART ** 2 + (exact[1] + exact[2]) * PART + exact[3]


def _partials(queries: np.ndarray, rows: np.ndarray, wide: bool) -> list[np.ndarray]:
    """Partial scores (query x row) of each list.  The caller has checked that no score passes
    the long range, or 2 ** 53 unless ``wide``."""
    cuts = np.linspace(0, queries.shape[1], LISTS + 1).astype(int)
    return [_product(queries[:, a:b], rows[:, a:b], wide) for a, b in zip(cuts[:-1], cuts[1:])]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores above ``NONE`` of one row, ties to smaller ids."""
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        at = np.arange(len(scores))
    at = at[scores[at] > NONE]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _parts(batches, dim):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part.column("vec_id").to_numpy(zero_copy_only=False), _matrix(part.column("vec"), dim)


def _out(schema: pa.Schema, lists: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(f.type) for c, f in zip(zip(*lists), schema)], schema=schema)


def resolved(ids: np.ndarray, matrix: np.ndarray, cut: np.ndarray, names: np.ndarray, part: np.ndarray, k: int,
             wide: bool) -> tuple[list[list[np.ndarray]], int]:
    """Phases 2 and 3 over a part of the candidates: the entries of each query that reach its
    cutoff, at most ``k``, and the number of partial scores computed."""
    cuts = np.linspace(0, matrix.shape[1], LISTS + 1).astype(int)
    rest_q, rest_c = ([np.sqrt((x[:, c:] ** 2).sum(1)) * (1 + 1e-9) for c in cuts[1:-1]] for x in (matrix, part))
    bound = np.where(cut == NONE, -np.inf, cut.astype(np.float64))
    bound -= 1 + np.abs(np.where(cut == NONE, 0, bound)) * 1e-12     # what doubles round off
    share = bound / LISTS
    first = _product(matrix[:, :cuts[1]], part[:, :cuts[1]], wide)
    collected = first + rest_q[0][:, None] * rest_c[0][None, :] >= bound[:, None]
    done, lists = first.size, []
    for q in np.flatnonzero(collected.any(1)):
        at = np.flatnonzero(collected[q] & (names != ids[q]))
        total, reached = first[q, at], first[q, at] >= share[q]
        for j in range(1, LISTS):
            run = slice(cuts[j], cuts[j + 1])
            more = _product(matrix[q:q + 1, run], part[at, run], wide)[0]
            done += len(at)
            total, reached = total + more, reached | (more >= share[q])
            if j + 1 < LISTS:
                keep = total + rest_q[j][q] * rest_c[j][at] >= bound[q]
                at, total, reached = at[keep], total[keep], reached[keep]
        keep = reached & (total >= cut[q])
        at, total = at[keep], total[keep]
        top = _best(total, names[at], k)
        if len(top):
            lists.append([np.full(len(top), ids[q]), names[at[top]], total[top]])
    return lists, done


def exact_top_k(vectors: DataFrame, is_query, k: int = 5, block: int = 2048) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of each query's k best candidates.
    ``vectors`` has vec_id and vec (array<double> of whole numbers); ``is_query`` is a
    condition on vec_id."""
    spark = vectors.sparkSession
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.coalesce(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & whole, F.lit(False)))
    facts = (rows.groupBy(F.size("vec").alias("dim")).agg(
        F.count("*").alias("n"), F.count_if(is_query).alias("queries"),
        F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))).alias("top"))
        .orderBy(F.desc("n"), F.desc("dim")).first())
    path = scratch_path(spark, "top-k")
    dim, count = (facts["dim"], facts["queries"]) if facts else (0, 0)
    if not dim or not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most = dim * int(facts["top"]) ** 2
    if most >= 2 ** 63:
        raise ValueError("components are too large for scores within the long range")
    # written once as they are scored: every block reads them twice
    rows.where(F.size("vec") == dim).select("vec_id", "vec").write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    blocks = math.ceil(count / block)
    queries = (rows.where(is_query).withColumn("r", F.row_number().over(Window.partitionBy("vec_id").orderBy("vec")))
               .where("r = 1").withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))))
    for b in range(blocks):
        mine = queries.where(F.col("b") == b).select("vec_id", "vec").sort("vec_id").collect()
        if mine:
            _block(rows, mine, dim, k, most).write.mode("append").parquet(f"{path}/found")
    every = spark.read.parquet(f"{path}/found")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int"), "vec_id", "score"))


def _block(rows: DataFrame, mine: list, dim: int, k: int, most_score: int) -> DataFrame:
    """Entries of one block of queries that hold all answers: at most k per task and query."""
    context = rows.sparkSession.sparkContext
    wide = most_score >= 2 ** 53
    ids = np.array([r.vec_id for r in mine], np.int64)
    matrix = np.array([r.vec for r in mine], np.float64).reshape(len(mine), dim)
    sent = context.broadcast((ids, matrix))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    ddl = "query_id long, vec_id long, score long"

    def gather(batches):
        ids, matrix = sent.value
        for names, part in _parts(batches, dim):
            partials = _partials(matrix, part, wide)
            total = sum(partials)
            lists = []
            for q in range(len(ids)):
                own = names == ids[q]
                at = np.unique(np.concatenate([_best(np.where(own, NONE, p[q]), names, k) for p in partials]))
                lists.append([np.full(len(at), ids[q]), names[at], total[q, at]])
            yield _out(schema, lists)

    first = Window.partitionBy("query_id").orderBy(F.desc("score"))
    bounds = (rows.select("vec_id", "vec").mapInArrow(gather, ddl).withColumn("r", F.row_number().over(first))
              .where(F.col("r") <= k).groupBy("query_id").agg(F.min("score").alias("bound"), F.count("*").alias("n"))
              .where(F.col("n") == k).collect())
    known = {r.query_id: r.bound for r in bounds}
    cutoff = context.broadcast(np.array([known.get(i, NONE) for i in ids.tolist()], np.int64))

    def resolve(batches):
        ids, matrix = sent.value
        for names, part in _parts(batches, dim):
            lists, _ = resolved(ids, matrix, cutoff.value, names, part, k, wide)
            if lists:
                yield _out(schema, lists)

    return rows.select("vec_id", "vec").mapInArrow(resolve, ddl)
