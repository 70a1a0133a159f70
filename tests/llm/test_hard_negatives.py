"""Hard negatives against all pairs: results, bounds, counts of exact products, odd vectors."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.llm import hard_negatives as H


def brute(rows, positives=5, negatives=10, low=30, high=90, anchor=lambda i: i % 100 == 0):
    """rows: (id, label, whole-number vector)."""
    out = set()
    firsts = {}
    for i, label, vec in rows:
        if anchor(i) and (i not in firsts or (label, vec) < firsts[i]):
            firsts[i] = (label, vec)
    for i, (label, vec) in firsts.items():
        score = [sum(int(a) * int(b) for a, b in zip(vec, v)) for _, _, v in rows]
        order = sorted(range(len(rows)), key=lambda k: (-score[k], rows[k][0]))
        mates = [k for k in order if rows[k][1] == label and rows[k][0] != i][:positives]
        for p in mates:
            found = [k for k in order if rows[k][1] != label and low * score[p] <= 100 * score[k] <= high * score[p]]
            out |= {(i, rows[p][0], r, rows[k][0], score[p], score[k]) for r, k in enumerate(found[:negatives], 1)}
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, vec array<double>")


def drawn(n, dim, groups, spread, seed=1, scale=256):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    vecs = np.floor(scale * (centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))))
    return [(int(i), int(l), v.tolist()) for i, l, v in zip(range(n), rng.integers(0, 4, n), vecs)]


@pytest.mark.parametrize("groups, spread, scale", [(40, 0.1, 256), (3, 0.5, 256), (500, 0.0, 3), (20, 0.3, 10 ** 8)])
def test_equals_all_pairs(spark, groups, spread, scale):
    rows = drawn(1200, 6, groups, spread, scale=scale)
    got = [tuple(r) for r in H.mine_hard_negatives(table(spark, rows).repartition(5), F.col("vec_id") % 100 == 0, block=5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_bounds_hold_and_spare_products():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 16)) * 200
    anchors = np.floor(np.repeat(centres, 25, 0) + rng.normal(size=(200, 16)))
    part = np.floor(np.repeat(centres, 50, 0) + 4 * rng.normal(size=(400, 16)))
    tree = H.AnchorTree(anchors)
    assert sorted(tree.order) == list(range(200))
    place = {a: k for k, a in enumerate(tree.order)}
    assert all(p < 0 or place[p] < place[a] for a, p in enumerate(tree.parent))
    exact = part @ anchors.T
    scorer = H.Scorer(tree, False)
    windows = [(float(np.sort(exact[:, a])[-20]), float(exact[:, a].max())) for a in range(200)]
    seen = 0
    for a, at, scores in scorer.overlaps(part, lambda a: windows[a]):
        assert np.array_equal(scores, exact[at, a].astype(np.int64))
        missed = np.setdiff1d(np.arange(400), at)
        assert (exact[missed, a] < windows[a][0]).all()
        seen += 1
    assert seen == 200 and scorer.scored < 0.35 * 200 * 400


def test_tree_is_least():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(40, 3))
    tree = H.AnchorTree(points)
    every = np.vstack([points, np.zeros(3)])
    far = np.linalg.norm(every[:, None] - every[None], axis=2)
    joined, total = {40}, 0.0
    while len(joined) < 41:
        d, to = min((far[a, b], b) for a in joined for b in range(41) if b not in joined)
        joined.add(to)
        total += d
    assert np.isclose(tree.edge.sum(), total)


def test_odd_vectors_and_empty_table(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [4.0, 0.0]), (0, 1, [3.0, 0.0]), (1, 1, [5.0, 0.0]), (1, 1, [5.0, 0.0]), (2, 2, [3.0, 1.0]), (3, 2, [3.0, 2.0]),
            (100, 3, [0.0, 0.0]), (200, 1, [-4.0, 0.0])]
    odd = [(None, 2, [3.0, 1.0]), (4, None, [3.0, 1.0]), (5, 2, None), (6, 2, [nan, 1.0]), (7, 2, [inf, 1.0]), (8, 2, [None, 1.0]),
           (9, 2, [3.0]), (10, 2, [])]
    df = table(spark, rows + odd).withColumn("score", F.lit("x")).withColumn("rank", F.lit(0))
    got = sorted(tuple(r) for r in H.mine_hard_negatives(df, F.col("vec_id") % 100 == 0).collect())
    pairs = [(0, 1, 1, 2), (0, 1, 2, 3)] * 2       # the repeated positive counts twice
    assert [r[:4] for r in got] == sorted(pairs)
    assert {r[4:] for r in got} == {(15, 9)}
    assert H.mine_hard_negatives(df.where("false"), F.col("vec_id") % 100 == 0).collect() == []
    assert H.mine_hard_negatives(df, F.col("vec_id") == 77).collect() == []
    with pytest.raises(ValueError):
        H.mine_hard_negatives(table(spark, [(0, 1, [1e12, 1.0])]), F.col("vec_id") == 0)


def test_best_keeps_ties_by_id():
    best = H.Best(1, 2)
    best.add(0, np.array([5, 5, 5]), np.array([9, 3, 7]))
    best.add(0, np.array([5, 4]), np.array([1, 0]))
    assert best.ids[0].tolist() == [1, 3] and best.limit(0) == 5
    assert [b.num_rows for b in best.rows(["slot", "vec_id", "score"])] == [2]
    assert isinstance(next(best.rows(["slot", "vec_id", "score"])), pa.RecordBatch)
