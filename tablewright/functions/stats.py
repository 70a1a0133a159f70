"""Exact statistics that stay distributed: medians and modes.

Spark's exact ``percentile``/``median`` and ``mode`` aggregates hold every distinct value of a
group in one buffer; for a global aggregate that is one task holding a whole column.  These
helpers avoid it:

* ``exact_medians`` takes a narrow range around the middle from approximate quantiles (bounded
  sketches) and counts the rows below it and its own values exactly, so that a column of
  distinct values shuffles a few thousandths of them.  A slice of more than
  ``CANDIDATE_LIMIT`` distinct values is narrowed further before it is ranked.  A range that
  the exact counts show to miss the middle is replaced by the whole column.
* ``column_modes`` counts short keys of ``(column, value)`` with a shuffle (hot values are
  combined map-side) and keeps the highest count, smallest value on ties.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .columns import clean_value

CANDIDATE_LIMIT = 50_000
MIDDLE = (0.499, 0.501)     # shares of the rows that the range around a median lies between
MIDDLE_ACCURACY = 10_000    # of these approximate quantiles: ranks are off by 1 / accuracy of the rows
SKETCHES = 32               # columns whose sketches one job holds
HEAD = 64               # characters of a value that its key shows
_PROBES = 64


def _kth_value(dv: DataFrame, x: str, k: int) -> float:
    """Value at 1-based rank ``k`` of the multiset described by ``dv(x, cnt)``."""
    lo, hi = None, None          # current half-open range [lo, hi)
    below = 0                    # rows strictly below lo
    for _ in range(32):
        cand = dv
        if lo is not None:
            cand = cand.where(F.col(x) >= lo)
        if hi is not None:
            cand = cand.where(F.col(x) < hi)
        if cand.count() <= CANDIDATE_LIMIT:
            break
        probs = [i / _PROBES for i in range(1, _PROBES)]
        bounds = sorted(set(float(b) for b in
                            cand.select(F.percentile_approx(x, probs, 100_000)).first()[0]))
        counts = cand.agg(*[F.sum(F.when(F.col(x) < b, F.col("cnt")).otherwise(0)).alias(f"b{i}")
                            for i, b in enumerate(bounds)]).first()
        edges = [lo] + bounds + [hi]
        cums = [below] + [below + int(counts[f"b{i}"]) for i in range(len(bounds))]
        j = max(i for i in range(len(cums)) if cums[i] < k)
        if (edges[j], edges[j + 1]) == (lo, hi):
            break                # the sketch cannot split further; rank what is left
        lo, hi, below = edges[j], edges[j + 1], cums[j]
    w = Window.orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    ranked = cand.withColumn("cum", F.sum("cnt").over(w) + F.lit(below))
    return float(ranked.where(F.col("cum") >= k).agg(F.min(x)).first()[0])


def exact_median(df: DataFrame, column: str) -> float | None:
    """Exact median (mean of the two middle values for an even count); None if no values."""
    v = df.select(clean_value(column, df.schema[column].dataType).cast("double").alias("x"))
    dv = v.where(F.col("x").isNotNull()).groupBy("x").agg(F.count(F.lit(1)).alias("cnt"))
    dv = dv.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = dv.agg(F.sum("cnt")).first()[0]
        return _median_of(dv, int(n)) if n else None
    finally:
        dv.unpersist()


def _median_of(dv: DataFrame, n: int, below: int = 0) -> float:
    """Median of ``n`` values, the (x, cnt) rows and ``below`` smaller ones."""
    k = (n + 1) // 2 - below
    a = _kth_value(dv, "x", k)
    if n % 2 == 1:
        return a
    upto_a = int(dv.where(F.col("x") <= a).agg(F.sum("cnt")).first()[0])
    b = a if upto_a >= k + 1 else float(dv.where(F.col("x") > a).agg(F.min("x")).first()[0])
    return (a + b) / 2


def exact_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact medians of several columns with shared jobs: sketches of the range around each
    middle, then one unpivot to (column, value) with map-side-combined counts of the values in
    it.  Columns with at most ``CANDIDATE_LIMIT`` distinct values there are ranked in one window
    job (a window partition then holds at most that many rows); the rest use range narrowing.
    """
    if not columns:
        return {}
    types = {f.name: f.dataType for f in df.schema.fields}
    x = {c: clean_value(c, types[c]).cast("double") for c in columns}
    rows, around = {}, {}
    for at in range(0, len(columns), SKETCHES):
        part = columns[at:at + SKETCHES]
        got = df.agg(*[e for i, c in enumerate(part) for e in (
            F.count(x[c]).alias(f"n{i}"),
            F.percentile_approx(x[c], list(MIDDLE), MIDDLE_ACCURACY).alias(f"q{i}"))]).first()
        rows |= {c: got[f"n{i}"] for i, c in enumerate(part)}
        around |= {c: tuple(got[f"q{i}"]) for i, c in enumerate(part) if got[f"n{i}"]}
    out: dict[str, float | None] = {c: None for c in columns}
    missed = _medians_around(df, x, rows, around, out)
    _medians_around(df, x, rows, dict.fromkeys(missed, (float("-inf"), float("nan"))), out)    # NaN: above all
    return out


def _medians_around(df: DataFrame, x: dict, rows: dict, around: dict, out: dict) -> list[str]:
    """Put the medians of the columns of ``around`` = {column: (least, largest value looked at)}
    into ``out``; returns the columns whose middle lies elsewhere."""
    if not around:
        return []
    # a value below the range counts as NULL, which sorts first
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("c"), (x[c] <= hi).alias("in"), F.when(x[c] >= lo, x[c]).alias("x"))
        for c, (lo, hi) in around.items()])))
    dv = (long.where(F.col("in")).groupBy("c", "x").agg(F.count(F.lit(1)).alias("cnt"))
          .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        sizes = {r["c"]: r for r in dv.groupBy("c").agg(
            F.sum("cnt").alias("n"), F.sum(F.when(F.col("x").isNull(), F.col("cnt")).otherwise(0)).alias("below"),
            F.count("x").alias("d")).collect()}

        def held(c):
            return c in sizes and sizes[c]["below"] < (rows[c] + 1) // 2 and sizes[c]["n"] >= rows[c] // 2 + 1

        found = [c for c in around if held(c)]
        small = [c for c in found if sizes[c]["d"] <= CANDIDATE_LIMIT]
        if small:
            w = Window.partitionBy("c").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
            ranked = dv.where(F.col("c").isin(*small)).withColumn("cum", F.sum("cnt").over(w))
            n_col = F.create_map(*[e for c in small for e in (F.lit(c), F.lit(rows[c]))])[F.col("c")]
            lo_k = F.floor((n_col + 1) / 2)          # rank of the lower middle value
            hi_k = F.floor(n_col / 2) + 1            # rank of the upper middle value
            picks = ranked.groupBy("c").agg(
                F.min(F.when(F.col("cum") >= lo_k, F.col("x"))).alias("lo"),
                F.min(F.when(F.col("cum") >= hi_k, F.col("x"))).alias("hi")).collect()
            for r in picks:
                out[r["c"]] = (r["lo"] + r["hi"]) / 2 if rows[r["c"]] % 2 == 0 else r["lo"]
        for c in found:
            if c not in small:
                slice_ = dv.where((F.col("c") == c) & F.col("x").isNotNull()).select("x", "cnt")
                out[c] = _median_of(slice_, rows[c], int(sizes[c]["below"]))
        return [c for c in around if c not in found]
    finally:
        dv.unpersist()


def column_modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: most frequent non-null value (as string), smallest value on ties.

    Returns (column_name, mode, mode_count); a column with no values is absent.  Values are counted
    by their first ``HEAD`` characters, which order as the values do, and the MD5 of longer ones, so
    whole texts are not shuffled.  Only where a longer value wins a second pass reads the values that
    begin like it and have its count, and takes the least.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), clean_value(c, types[c]).cast("string").alias("v"))
        for c in columns]))).where(F.col("v").isNotNull())
    keyed = long.select("column_name", F.left("v", F.lit(HEAD)).alias("head"),
                        F.when(F.length("v") > HEAD, F.md5("v")).alias("digest"), "v")
    counts = keyed.groupBy("column_name", "head", "digest").agg(F.count(F.lit(1)).alias("cnt"))
    best = counts.groupBy("column_name").agg(
        F.min(F.struct((-F.col("cnt")).alias("neg"), "head", "digest")).alias("m")).select("column_name", "m.*").collect()
    modes = {r["column_name"]: r["head"] for r in best}
    cut = {r["column_name"]: (r["head"], -r["neg"]) for r in best if r["digest"] is not None}
    if cut:
        def of(c):
            return (F.col("column_name") == c) & (F.col("head") == cut[c][0]) & F.col("digest").isNotNull()

        like_best = reduce(or_, [of(c) for c in cut])
        tied = counts.where(reduce(or_, [of(c) & (F.col("cnt") == cut[c][1]) for c in cut]))
        least = (keyed.where(like_best).join(tied.select("column_name", "digest"), ["column_name", "digest"], "left_semi")
                 .agg(*[F.min(F.when(F.col("column_name") == c, F.col("v"))).alias(str(i)) for i, c in enumerate(cut)]).first())
        modes.update(zip(cut, least))
    return df.sparkSession.createDataFrame(
        [(r["column_name"], modes[r["column_name"]], -r["neg"]) for r in best], "column_name string, mode string, mode_count long")


def ordered_codes(values: DataFrame, column: str, code: str = "code") -> DataFrame:
    """Dense 0-based codes of the distinct non-null values of ``column`` in ascending order.

    Distributed ranking: distinct values are range-partitioned and sorted; per-partition
    counts (one row per partition) give each partition's offset; a row number inside the
    partition completes the code.  No task sees more than one range partition.
    """
    d = values.select(column).where(F.col(column).isNotNull()).distinct()
    n_parts = max(1, values.sparkSession.sparkContext.defaultParallelism)
    from ..session import checkpoint_dir
    checkpoint_dir(values.sparkSession)
    # Partition ids are used twice (sizes and row numbers); checkpointing fixes them.
    ranged = (d.repartitionByRange(n_parts, column)
              .withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True))
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w_off = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(w_off), F.lit(0)).alias("_off"))
    w = Window.partitionBy("_pid").orderBy(column)
    return (ranged.join(F.broadcast(offsets), "_pid")
            .select(column, (F.col("_off") + F.row_number().over(w) - 1).cast("long").alias(code)))


def join_dictionary(df: DataFrame, dictionary: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Join a (key -> payload) dictionary.  No hint: the planner broadcasts it by its size in
    bytes, known at run time, and shuffles both sides otherwise."""
    return df.join(dictionary, on, how)


def top_k_per_group(df: DataFrame, group_cols: list[str], order_cols: list, k: int,
                    rank_col: str = "_rank", salt_buckets: int = 32) -> DataFrame:
    """The first ``k`` rows of every group in ``order_cols`` order, with their rank.

    Two phases so that a hot group never sorts in one task: rows are first ranked inside
    (group, salt) where salt = hash(row) mod ``salt_buckets``; only the k best of each salt
    survive (at most k x buckets rows per group) and are ranked again per group.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salt_buckets))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order_cols)
    first = (df.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1))
             .where(F.col("_r1") <= k).drop("_r1", "_salt"))
    w2 = Window.partitionBy(*group_cols).orderBy(*order_cols) if group_cols else Window.orderBy(*order_cols)
    return first.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)
