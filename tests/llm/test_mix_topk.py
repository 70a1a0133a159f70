"""Source mixing and exact top-k against plain computations and their SQL."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from tablewright.llm import mixture, topk


def levelled(sizes):
    """Targets by cutting and sharing again until nothing is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 10, "c": 10, None: 5}, {"a": 1, "b": 1000, "c": 3, "d": 90, "e": 1}, {"z": 7}, {"a": 0, "b": 4},
    {"é": 100, "Z": 1, "a": 50, "b": 2000, "c": 1, "d": 1, "e": 30}])
def test_targets_are_levelled(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixture.source_targets(df).collect()}
    want = levelled(sizes)
    assert all(math.isclose(got[s], want[s], rel_tol=1e-12) for s in sizes)


def test_mix_edges_and_copies(spark):
    rows = [(i, "w " * (i % 7), "hot" if i % 3 else f"s{i % 5}") for i in range(600)]
    rows += [(None, None, None), (1, "w ", "hot"), (900, "", None), (901, "x\x1cy\x0bz", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns(
        {"size": F.lit("s"), "rate": F.lit(1), "w": F.lit(2), "target": F.lit(3)})
    plan = mixture.plan_mix(df).collect()
    assert len(plan) == len(rows)
    assert next(r.size for r in plan if r.doc_id == 901) == 2
    taken, target = defaultdict(int), {}
    for r in plan:
        assert r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) and r.copies <= 2
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
    assert abs(taken["hot"] - target["hot"]) <= 0.2 * target["hot"]
    assert plan == mixture.plan_mix(df.repartition(7)).sort(*[F.col(c) for c in plan[0].__fields__]).collect() or \
        sorted(map(str, plan)) == sorted(map(str, mixture.plan_mix(df.repartition(7)).collect()))
    mixed = mixture.mix_sources(df)
    assert mixed.columns == df.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: v for k, v in _copies(plan).items() if v})
    assert mixture.mix_sources(df.where("1 = 0")).count() == 0


def _copies(plan):
    out = Counter()
    for r in plan:
        out[r.doc_id] += r.copies
    return out


@pytest.mark.parametrize("name", ["op4_mix_sources", "op6_exact_topk"])
def test_sql_gives_the_same_rows(spark, duck, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = duck.execute(E.oracle_sql()[name]).df()[list(got.columns)]
    keys = list(got.columns[:2])
    got, want = (p.sort_values(keys).reset_index(drop=True) for p in (got, want))
    assert len(got) == len(want)
    assert np.allclose(got.to_numpy(float), want.to_numpy(float), rtol=1e-12)


def plain_top(rows, k):
    out = []
    usable = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and len(v) == 6
              and None not in v and np.isfinite(v).all()]
    for q, x in sorted({i: v for i, v in reversed(usable) if i % 10 == 0}.items()):
        scored = sorted((-int(x @ y), i) for i, y in usable if i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return out


@pytest.mark.parametrize("block", [2048, 3])
def test_top_k_with_ties_and_odd_rows(spark, block):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(150)]
    rows += [(200, None), (210, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (220, [float("inf")] * 6), (None, [1.0] * 6),
             (230, [1.0]), (5, rows[5][1]), (240, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, vec array<double>").withColumns({"score": F.lit(0), "rank": F.lit(1)})
    got = topk.exact_top_k(df, F.col("vec_id") % 10 == 0, k=5, block=block).collect()
    assert sorted(map(tuple, got)) == plain_top(rows, 5)


def test_top_k_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (10, [-3.0, 0.0])], "vec_id long, vec array<double>")
    got = topk.exact_top_k(df, F.col("vec_id") % 10 == 0, k=5).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 10, -3), (10, 1, 0, -3)]
    assert topk.exact_top_k(df.where("1 = 0"), F.col("vec_id") % 10 == 0).count() == 0
    assert topk.exact_top_k(df.where("vec_id = 0"), F.col("vec_id") % 10 == 0).count() == 0


@pytest.mark.parametrize("block", [2048, 3])
def test_top_k_of_components_beyond_exact_doubles(spark, block):
    rng = np.random.default_rng(4)
    big = rng.integers(-10 ** 9, 10 ** 9, 6)
    rows = [(i, (big + rng.integers(-2, 3, 6) if i % 3 else rng.integers(-10 ** 9, 10 ** 9, 6)).astype(float).tolist())
            for i in range(90)]
    exact = {i: [int(x) for x in v] for i, v in rows}
    want = []
    for q in range(0, 90, 10):
        scored = sorted((-sum(x * y for x, y in zip(exact[q], v)), i) for i, v in exact.items() if i != q)
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:5], 1)]
    assert max(abs(r[3]) for r in want) > 2 ** 53
    df = spark.createDataFrame(rows, "vec_id long, vec array<double>")
    got = topk.exact_top_k(df, F.col("vec_id") % 10 == 0, k=5, block=block).collect()
    assert sorted(map(tuple, got)) == want
    with pytest.raises(ValueError, match="long range"):
        topk.exact_top_k(df.unionByName(spark.createDataFrame([(999, [3e9] * 6)], df.schema)), F.col("vec_id") % 10 == 0)


def test_top_k_resolves_fewer_partial_scores_than_all():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 32)) * 200
    rows = np.floor(centres[rng.integers(0, 12, 3000)] + 10 * rng.normal(size=(3000, 32)))
    queries, ids, names = rows[:40], np.arange(40), np.arange(3000)
    exact = (queries @ rows.T).astype(np.int64)
    exact[np.arange(40), np.arange(40)] = topk.NONE
    cut = np.sort(exact, 1)[:, -5]
    lists, done = topk.resolved(ids, queries, cut, names, rows, 5, False)
    got = {(q, i, s) for a in lists for q, i, s in zip(*(x.tolist() for x in a))}
    want = {(q, int(i), int(exact[q, i])) for q in range(40) for i in topk._best(exact[q], names, 5)}
    assert got == want
    # the first phase computes all partial scores once; both together stay well below twice that
    assert done < 0.5 * topk.LISTS * exact.size
