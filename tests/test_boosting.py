"""Histogram boosting against a plain loop over rows, its parameters, and odd frames."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablewright.operators import boosting as B


def frame(spark, x, y):
    rows = [(i, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a array<double>, label double")
    return df.select("id", array_to_vector("a").alias("features"), "label").repartition(3)


def plain_boosting(x, y, classes, rounds, depth, step, reg_lambda, min_rows):
    """K trees a round, every split tried at every value, sums by loops over rows."""
    raw = np.zeros((len(x), classes))
    for _ in range(rounds):
        e = np.exp(raw - raw.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        add = np.zeros_like(raw)
        for k in range(classes):
            g, h = p[:, k] - (y == k), p[:, k] * (1 - p[:, k])

            def fit(rows, left):
                value = -sum(g[i] for i in rows) / (sum(h[i] for i in rows) + reg_lambda)
                best = (1e-9, None, None)
                for j in range(x.shape[1]):
                    for cut in sorted({x[i, j] for i in range(len(x))})[:-1]:
                        a, b = [i for i in rows if x[i, j] <= cut], [i for i in rows if x[i, j] > cut]
                        if min(len(a), len(b)) < min_rows:
                            continue
                        gain = sum(sum(g[i] for i in s) ** 2 / (sum(h[i] for i in s) + reg_lambda) for s in (a, b))
                        gain -= sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + reg_lambda)
                        if gain > best[0] + 1e-9:
                            best = (gain, a, b)
                if not left or best[1] is None:
                    add[rows, k] = value
                else:
                    fit(best[1], left - 1)
                    fit(best[2], left - 1)

            fit(list(range(len(x))), depth)
        raw += step * add
    e = np.exp(raw - raw.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def test_softmax_fit_equals_a_plain_loop(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 7, (200, 3)).astype(float)
    y = ((x[:, 0] > 3).astype(int) + (x[:, 1] + rng.normal(size=200) > 3)).astype(float)
    df = frame(spark, x, y)
    model = B.GradientBoosting(maxIter=4, maxDepth=2, stepSize=0.5, minInstancesPerNode=5, minChildWeight=0.0).fit(df)
    want = plain_boosting(x, y, 3, 4, 2, 0.5, 1.0, 5)
    got = {r.id: (r.probability.toArray(), r.prediction) for r in model.transform(df).collect()}
    for i in range(200):
        assert np.allclose(got[i][0], want[i], atol=1e-9)
        assert got[i][1] == want[i].argmax()


class Counting:
    """Sums over one block of rows in the process, and how often they were asked for."""

    def __init__(self, bins, label, outputs, n_bins):
        self.bins, self.label, self.raw = bins, label, np.zeros((len(bins), outputs))
        self.width, self.n_bins, self.asked = bins.shape[1], n_bins, 0

    def sums(self, trees, growing, nodes, p):
        self.asked += 1
        g, h = B.gradients(B.add_rounds(self.raw, self.bins, trees, p["stepSize"]), self.label, p["task"])
        used = np.ones(len(self.bins), bool)
        return B.histograms(self.bins, g, h, used, [t.places(self.bins) for t in growing], nodes, self.n_bins)

    def store(self, trees, p):
        pass


SETTINGS = {"task": "classification", "maxIter": 10, "maxDepth": 4, "stepSize": 0.3, "regLambda": 1.0, "regAlpha": 0.0,
            "minChildWeight": 1e-3, "minInstancesPerNode": 1, "numLeaves": 0, "colsample": 1.0, "seed": 1}


def test_all_classes_share_one_sum_a_level():
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 16, (300, 4)).astype(np.uint8)
    label = (bins[:, 0] // 4).astype(float)
    data = Counting(bins, label, 4, 16)
    trees = B.grow(data, 4, SETTINGS)
    assert data.asked <= SETTINGS["maxIter"] * SETTINGS["maxDepth"]
    assert (B.probabilities(B.add_rounds(data.raw, bins, trees, 0.3)).argmax(1) == label).mean() > 0.99


def test_leaves_penalties_and_shares_bound_the_trees():
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 16, (400, 6)).astype(np.uint8)
    label = ((bins[:, 0] + bins[:, 1]) % 2).astype(float)

    def grown(**changed):
        return B.grow(Counting(bins, label, 1, 16), 1, SETTINGS | changed)

    def leaves(tree):
        return sum(f < 0 for f in tree.feature)

    assert max(leaves(t) for (t,) in grown(numLeaves=5)) == 5
    assert all(len({f for f in t.feature if f >= 0}) <= 3 for (t,) in grown(colsample=0.5))
    assert len({tuple(sorted({f for f in t.feature if f >= 0})) for (t,) in grown(colsample=0.5)}) > 1
    assert max(abs(v) for (t,) in grown(regLambda=1000.0) for v in t.value) < 0.1
    assert all(leaves(t) == 1 for (t,) in grown(regAlpha=1e6))
    smallest = grown(minInstancesPerNode=60)
    for (t,) in smallest:
        assert np.bincount(t.places(bins))[[n for n in np.unique(t.places(bins))]].min() >= 60
    half = B.drawn(np.arange(20000) * 7919, 3, 5, 0.5)
    assert abs(half.mean() - 0.5) < 0.02 and (half != B.drawn(np.arange(20000) * 7919, 3, 6, 0.5)).any()


def test_regression_saves_and_loads_and_stores_scores(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 2))
    y = np.sin(2 * x[:, 0]) + x[:, 1]
    df = frame(spark, x, y)
    model = B.GradientBoosting(task="regression", maxIter=B.STORE_ROUNDS + 4, maxDepth=3, stepSize=0.4).fit(df)
    path = str(tmp_path / "model")
    model.save(path)
    a = {r.id: r.prediction for r in model.transform(df).collect()}
    b = {r.id: r.prediction for r in B.GradientBoostingModel.load(path).transform(df).collect()}
    assert a == b
    error = np.mean([(a[i] - y[i]) ** 2 for i in range(500)])
    assert error < 0.1 * y.var()


def test_odd_frames(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 1.0), (1, None, 1.0), (2, [1.0, 2.0], None), (3, [1.0, 2.0], 1.0)],
                               "id long, features array<double>, label double")
    model = B.GradientBoosting(maxIter=2, maxDepth=2).fit(df)
    got = {r.id: r.prediction for r in model.transform(df.withColumn("extra", F.lit(1))).collect()}
    assert got == {0: 1.0, 1: None, 2: 1.0, 3: 1.0}
    assert model.transform(df.where("false")).collect() == []
    with pytest.raises(ValueError):
        B.GradientBoosting().fit(df.where("false"))


class Nodes(Counting):
    """Also the nodes that were summed."""

    def sums(self, trees, growing, nodes, p):
        self.nodes = getattr(self, "nodes", 0) + len(nodes)
        return super().sums(trees, growing, nodes, p)


def test_one_of_two_siblings_is_summed(monkeypatch):
    rng = np.random.default_rng(7)
    bins, label = rng.integers(0, 16, (600, 4)).astype(np.uint8), rng.integers(0, 3, 600).astype(float)
    p = B.GradientBoosting(maxIter=1, maxDepth=5, minChildWeight=0.0, minInstancesPerNode=3).settings()
    raw = rng.normal(size=(600, 3))     # no two gains are equal
    halved = Nodes(bins, label, 3, 16)
    halved.raw = raw
    trees = B.grow(halved, 3, p)
    monkeypatch.setattr(B, "KEPT_CELLS", 0)     # no parent is kept: both children are summed
    both = Nodes(bins, label, 3, 16)
    both.raw = raw
    again = B.grow(both, 3, p)
    assert 0.5 * both.nodes <= halved.nodes < 0.6 * both.nodes
    for a, b in zip(trees[0], again[0]):
        assert (a.feature, a.bin, a.left) == (b.feature, b.bin, b.left) and np.allclose(a.value, b.value)


def test_partitions_follow_the_slots():
    assert B.partitions(1000, 8) == 1
    assert B.partitions(3 << 20, 8) == 3
    assert B.partitions(250 << 20, 12) == 12
    assert B.partitions(3 << 30, 12) == 48


def test_hessians_of_one_are_counted():
    rng = np.random.default_rng(2)
    bins, g, used = rng.integers(0, 4, (50, 2)).astype(np.uint8), rng.normal(size=(50, 1)), np.arange(50) % 5 > 0
    args = [np.zeros(50, int)], [(0, 0)], 4
    want = B.histograms(bins, g, np.ones((50, 1)), used, *args)
    assert (B.histograms(bins, g, None, used, *args) == want).all() and want[..., 2].sum() == 2 * used.sum()


def test_probabilities_of_several_classes():
    raw = np.array([[1.0, 2.0, 0.5], [800.0, -800.0, 799.0]])
    e = np.exp(raw - raw.max(1, keepdims=True))
    p = B.probabilities(raw)
    assert (p == e / e.sum(1, keepdims=True)).all()
    g, h = B.gradients(raw, np.array([1.0, 2.0]), "classification")
    assert (g == p - np.array([[0, 1, 0], [0, 0, 1]])).all() and (h == p * (1 - p)).all()
