"""Exact, reproducible train/test split (FEAT3) and exact n-row sampling (SRC8).

Rows are ordered by ``md5(key | seed)``.  Exact counts never need a global sort:

1. rows are counted by the first three hex digits of the hash per group (class) - at most
   groups x 4096 counts, of which each group's running sum shows the prefix that straddles
   its quota;
2. a straddling prefix that holds more than ``EDGE_ROWS`` rows is counted again by three more
   digits, and so on: however large the table, the last prefix is small;
3. only its rows are ranked with ``row_number``; every other row compares its hash with its
   group's prefix, without a join.

A class holding a third of all rows therefore costs a sort of ``EDGE_ROWS`` rows, not of a
third of the table.  Per-class quotas follow the largest-remainder allocation of the
training size (ties by class order, where the reference draws at random).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# ---- fixed values -------------------------------------------------------------------------
DEFAULT_TEST_SIZE = 0.2
DEFAULT_SEED = 42
MAX_STRATIFY_CLASSES = 20
HASH_DIGITS = 3                  # 16**3 = 4096 counts per group and round
EDGE_ROWS = 50_000               # rows ranked in one task
NULL_GROUP = "\u0000null"
# -------------------------------------------------------------------------------------------


def row_hash(key_cols: list[str], seed: int = DEFAULT_SEED) -> Column:
    """md5 of the key values joined with '|' and the seed (same string in DuckDB)."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols], F.lit(str(seed))))


def largest_remainder(counts: dict, n_draws: int) -> dict:
    """Allocate ``n_draws`` over classes in proportion to ``counts``; ties by class order."""
    total = sum(counts.values())
    keys = sorted(counts, key=lambda k: (k is None, str(k)))
    cont = {k: counts[k] / total * n_draws for k in keys}
    out = {k: math.floor(cont[k]) for k in keys}
    need = n_draws - sum(out.values())
    order = sorted(keys, key=lambda k: -(cont[k] - out[k]))   # stable: class order on ties
    for k in order[:max(need, 0)]:
        out[k] += 1
    return out


def _lookup(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))]), key)


def _edges(hashed: DataFrame, quotas: dict) -> tuple[dict, dict]:
    """Per group the hash prefix in which its quota ends, and the rows it still takes there."""
    edge, need, size = dict.fromkeys(quotas, ""), dict(quotas), {}
    todo = [g for g in quotas if quotas[g] > 0]
    edge.update({g: "!" for g in quotas if quotas[g] <= 0})       # sorts before every hash
    digits = 0
    while todo and digits < 32:
        digits += HASH_DIGITS
        inside = hashed.where(F.col("_h").startswith(_lookup({g: edge[g] for g in todo}, F.col("_g"))))
        counts = inside.groupBy("_g", F.substring("_h", 1, digits).alias("_p")).count().collect()
        for g in todo:
            edge[g] = "~"                                           # sorts after every hash: all rows fit
            for prefix, n in sorted((r["_p"], r["count"]) for r in counts if r["_g"] == g):
                if n >= need[g]:
                    edge[g], size[g] = prefix, n
                    break
                need[g] -= n
        todo = [g for g in todo if edge[g] != "~" and size[g] > EDGE_ROWS]
    return edge, need


def _first_n_by_hash(df: DataFrame, group: Column, quotas: dict, h: Column, flag: str) -> DataFrame:
    """Mark, per group, the ``quota`` rows with the smallest hash (``flag`` = true)."""
    hashed = df.withColumn("_g", group).withColumn("_h", h)
    edge, need = _edges(hashed, quotas)
    prefix = _lookup(edge, F.col("_g"))
    marked = hashed.withColumn("_e", prefix).withColumn("_p", F.expr("substring(_h, 1, length(_e))"))
    whole = marked.where("_p <> _e").withColumn(flag, F.col("_p") < F.col("_e"))
    rk = F.row_number().over(Window.partitionBy("_g").orderBy("_h", *df.columns))
    last = marked.where("_p = _e").withColumn(flag, rk <= _lookup(need, F.col("_g")))
    return whole.unionByName(last).drop("_g", "_h", "_e", "_p")


def split_plan(df: DataFrame, label: str | None, test_size: float = DEFAULT_TEST_SIZE,
               stratify: bool = True) -> tuple[dict, bool]:
    """Per-group test quotas and whether the split is stratified (one small aggregate)."""
    n = df.count()
    n_test = math.ceil(test_size * n)
    n_train = n - n_test
    if label and stratify:
        classes = (df.groupBy(F.coalesce(F.col(label).cast("string"), F.lit(NULL_GROUP)).alias("g"))
                   .agg(F.count(F.lit(1)).alias("n")).limit(MAX_STRATIFY_CLASSES + 1).collect())
        counts = {r["g"]: r["n"] for r in classes}
        ok = (len(counts) <= MAX_STRATIFY_CLASSES and min(counts.values(), default=0) >= 2
              and n_test >= len(counts) and n_train >= len(counts))
        if ok:
            train = largest_remainder(counts, n_train)
            return {g: counts[g] - train[g] for g in counts}, True
    return {NULL_GROUP: n_test}, False


def train_test_split(df: DataFrame, key_cols: list[str], label: str | None = None,
                     test_size: float = DEFAULT_TEST_SIZE, seed: int = DEFAULT_SEED,
                     stratify: bool = True) -> DataFrame:
    """Add ``split`` ('train' / 'test') with exact sizes: ceil(test_size * n) test rows,
    stratified per class when ``label`` has at most 20 classes with >= 2 rows each."""
    quotas, strat = split_plan(df, label, test_size, stratify)
    group = (F.coalesce(F.col(label).cast("string"), F.lit(NULL_GROUP)) if strat
             else F.lit(NULL_GROUP))
    out = _first_n_by_hash(df, group, quotas, row_hash(key_cols, seed), "_test")
    return out.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def sample_exact(df: DataFrame, n: int, key_cols: list[str], seed: int = DEFAULT_SEED) -> DataFrame:
    """SRC8: exactly ``min(n, rows)`` rows, uniform by hash order, reproducible by seed."""
    out = _first_n_by_hash(df, F.lit(NULL_GROUP), {NULL_GROUP: int(n)}, row_hash(key_cols, seed), "_keep")
    return out.where("_keep").drop("_keep")
