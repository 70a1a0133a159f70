"""Extremely randomised trees against plain loops over rows, their draws, and odd frames."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablewright.operators import models as M
from tablewright.operators import random_trees as R


def frame(spark, x, y):
    rows = [(i, None if r is None else [float(v) for v in r], None if v is None else float(v))
            for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a array<double>, label double")
    vector = F.when(F.col("a").isNotNull(), array_to_vector(F.coalesce("a", F.array(F.lit(0.0)))))
    return df.select("id", vector.alias("features"), "label").repartition(3)


class PlainLoops:
    """Ranges and left sums by loops over rows."""

    def __init__(self, x, y, outputs):
        self.x, self.y, self.outputs = x, y, outputs

    @staticmethod
    def on_thread(run):
        return run

    def node(self, tree, row):
        feature, cut, left = tree
        at = 0
        while feature[at] >= 0:
            at = left[at] + (1 if row[feature[at]] > cut[at] else 0)
        return at

    def ranges(self, trees, nodes):
        low, high = [], []
        for tree, mine in zip(trees, nodes):
            for n in mine:
                rows = [r for r in self.x if self.node(tree, r) == n]
                low.append([min(r[j] for r in rows) for j in range(self.x.shape[1])])
                high.append([max(r[j] for r in rows) for j in range(self.x.shape[1])])
        return np.array(low), np.array(high)

    def left_sums(self, trees, nodes, features, cuts):
        out, i = np.zeros((*features.shape, self.outputs or 3)), 0
        for tree, mine in zip(trees, nodes):
            for n in mine:
                for row, label in zip(self.x, self.y):
                    if self.node(tree, row) == n:
                        for c, (j, cut) in enumerate(zip(features[i], cuts[i])):
                            if row[j] <= cut:
                                if self.outputs:
                                    out[i, c, int(label)] += 1
                                else:
                                    out[i, c] += (1, label, label * label)
                i += 1
        return out


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_fit_equals_plain_loops(spark, monkeypatch, task):
    rng = np.random.default_rng(0)
    x = np.c_[rng.integers(0, 6, (200, 3)), np.ones(200)].astype(float)     # ties and a constant feature
    y = (x[:, 0] > 2).astype(int) + (x[:, 1] > 3) if task == "classification" else x[:, 0] * 3 + x[:, 1]
    y = y.astype(float)
    monkeypatch.setattr(R, "JOB_CELLS", 100)        # a level takes several jobs
    strategy = "sqrt" if task == "classification" else "all"
    model = R.ExtraTrees(task=task, numTrees=3, maxDepth=4, featureSubsetStrategy=strategy, minInstancesPerNode=3).fit(frame(spark, x, y))
    outputs = 3 if task == "classification" else 0
    p = {"minInstancesPerNode": 3, "featureSubsetStrategy": strategy, "seed": 42, "numTrees": 3, "maxDepth": 4}
    want = R.grow(PlainLoops(x, y, outputs), R.label_sums(y, outputs).sum(0), 4, p)
    for got, tree in zip(model.trees(), want):
        assert got["feature"] == tree.feature and got["left"] == tree.left and len(tree.feature) > 5
        assert np.allclose(got["cut"], tree.cut)
        assert np.allclose(got["value"], R.leaf_values(tree, outputs))


def test_cuts_lie_inside_their_nodes_and_differ_between_trees(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(150, 5)), rng.integers(0, 2, 150).astype(float)
    cuts = []
    data = PlainLoops(x, y, 2)
    trees = R.grow(data, R.label_sums(y, 2).sum(0), 5, {"minInstancesPerNode": 1, "featureSubsetStrategy": "sqrt",
                                                      "seed": 3, "numTrees": 4, "maxDepth": 80})
    for tree in trees:
        arrays = tree.arrays()
        cuts.append({(f, c) for f, c in zip(tree.feature, tree.cut) if f >= 0})
        for node, feature in enumerate(tree.feature):
            if feature >= 0:
                reach = [r for r in x if passes(arrays, r, node)]
                values = [r[feature] for r in reach]
                assert min(values) <= tree.cut[node] < max(values)
            else:       # grown to purity
                assert (tree.total[node] > 0).sum() == 1
    for i in range(4):
        for j in range(i):
            assert not cuts[i] & cuts[j]


def passes(tree, row, node):
    feature, cut, left = tree
    at = 0
    while at != node and feature[at] >= 0:
        at = left[at] + (1 if row[feature[at]] > cut[at] else 0)
    return at == node


def test_learns_and_persists(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1200, 4))
    y = ((x[:, 0] ** 2 + x[:, 1] ** 2) > 1.4).astype(float)
    df = frame(spark, x, y)
    train, test = df.where("id < 900"), df.where("id >= 900")
    model = M.make_estimator("ExtraTrees", "classification", trees=40).fit(train)
    scored = model.transform(test)
    assert scored.where("label = prediction").count() / 300 > 0.85
    model.write().overwrite().save(str(tmp_path / "m"))
    again = R.ExtraTreesModel.load(str(tmp_path / "m")).transform(test)
    assert scored.select("id", "prediction", "probability").exceptAll(again.select("id", "prediction", "probability")).count() == 0
    fit = M.make_estimator("ExtraTrees", "regression", trees=20).fit(frame(spark, x, 2 * x[:, 0] + x[:, 1]))
    assert fit.getOrDefault("featureSubsetStrategy") == "all"
    rows = fit.transform(frame(spark, x, 2 * x[:, 0] + x[:, 1])).select("label", "prediction").collect()
    assert np.mean([(r.label - r.prediction) ** 2 for r in rows]) < 0.5


def test_odd_frames(spark):
    with pytest.raises(ValueError, match="no rows"):
        R.ExtraTrees().fit(frame(spark, [], []))
    with pytest.raises(ValueError, match="no rows"):
        R.ExtraTrees().fit(frame(spark, [[1.0], None], [None, 1.0]))
    constant = R.ExtraTrees(numTrees=2).fit(frame(spark, [[1.0], [2.0], None], [1.0, 1.0, 0.0]))
    assert [len(t["feature"]) for t in constant.trees()] == [1, 1]
    got = constant.transform(frame(spark, [[5.0], None], [None, None])).orderBy("id").collect()
    assert got[0].prediction == 1.0 and got[1].prediction is None and got[1].probability is None
    same = R.ExtraTrees(numTrees=2).fit(frame(spark, [[1.0]] * 4, [0.0, 1.0, 1.0, 1.0]))     # no feature differs
    assert same.transform(frame(spark, [[1.0]], [None])).first().probability.toArray().tolist() == [0.25, 0.75]


def test_sums_of_a_level_are_those_of_the_rows(spark):
    """Leaves at several depths, an open node without rows, a label that is no class."""
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(60, 3)), rng.integers(0, 3, 60).astype(float)
    y[5] = 7.0
    tree = R.CutTree(np.ones(3))
    a, b = tree.split(0, 1, 0.2, np.ones(3))
    c, d = tree.split(a, 2, -0.1, np.ones(3))
    e, f = tree.split(b, 0, 99.0, np.ones(3))       # no row is above the cut
    trees, nodes = [tree.arrays(), R.CutTree(np.ones(3)).arrays()], [np.array([c, d, f]), np.array([0])]
    plain = PlainLoops(x, y, 3)
    assert R.places(trees[0], x).tolist() == [plain.node(trees[0], row) for row in x]
    data = R._Blocks(spark.sparkContext.parallelize([(x[:25], y[:25]), (x[25:], y[25:])], 2), 3, lambda run: run)
    features, cuts = np.array([[0, 2], [1, 0], [2, 1], [1, 2]]), rng.normal(size=(4, 2)) / 2
    known = PlainLoops(x[y < 3], y[y < 3], 3)
    assert (data.left_sums(trees, nodes, features, cuts) == known.left_sums(trees, nodes, features, cuts)).all()
    low, high = data.ranges(trees, nodes)
    assert np.isinf(low[2]).all() and np.isinf(high[2]).all()
    want = plain.ranges([trees[0], trees[1]], [np.array([c, d]), np.array([0])])
    assert (low[[0, 1, 3]] == want[0]).all() and (high[[0, 1, 3]] == want[1]).all()


def test_class_sums_sort_no_rows(spark, monkeypatch):
    x, y = np.arange(40.0).reshape(20, 2), np.arange(20.0) % 2
    data = R._Blocks(spark.sparkContext.parallelize([(x, y)], 1), 2, lambda run: run)
    monkeypatch.setattr(R._Blocks, "_rows", lambda *a: 1 / 0)      # a level sorts for its ranges only
    got = data.left_sums([R.CutTree(np.ones(2)).arrays()], [np.array([0])], np.array([[0]]), np.array([[10.0]]))
    assert got.tolist() == [[[3.0, 3.0]]]


def test_label_sums_of_many_rows_sort_none(spark, monkeypatch):
    """Beyond ``SORTED_ROWS`` a regression adds its labels as they come, whether all features are drawn or some."""
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(60, 3)), rng.normal(size=60)
    tree = R.CutTree(np.ones(3))
    a, b = tree.split(0, 1, 0.2, np.ones(3))
    c, d = tree.split(a, 2, -0.1, np.ones(3))
    trees, nodes = [tree.arrays(), R.CutTree(np.ones(3)).arrays()], [np.array([c, d]), np.array([0])]
    blocks = spark.sparkContext.parallelize([(x[:25], y[:25]), (x[25:], y[25:])], 2)
    data = R._Blocks(blocks, 0, lambda run: run, R.SORTED_ROWS + 1)
    sorted_ = R._Blocks(blocks, 0, lambda run: run, R.SORTED_ROWS)
    for features in np.array([[0, 2, 1], [1, 0, 2], [2, 1, 0]]), np.array([[0, 2], [1, 0], [2, 1]]):
        cuts = rng.normal(size=features.shape) / 2
        want = PlainLoops(x, y, 0).left_sums(trees, nodes, features, cuts)
        assert np.allclose(sorted_.left_sums(trees, nodes, features, cuts), want)
        with monkeypatch.context() as m:
            m.setattr(R._Blocks, "_rows", lambda *a: 1 / 0)
            got = data.left_sums(trees, nodes, features, cuts)
        assert np.allclose(got, want) and want[..., 0].any()
