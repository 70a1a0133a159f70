"""Histogram forest: drawn rows, sums and cuts against plain loops, pruning, saved models, odd frames."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tablewright.operators import forest as FO
from tablewright.operators import models as M


def _frame(spark, n=600, parts=3):
    rng = np.random.default_rng(3)
    x = np.c_[rng.normal(size=n), rng.integers(0, 3, n), (np.arange(n) % 50 == 0)].astype(float)
    y = (x[:, 0] + x[:, 1] > 1).astype(int) + (x[:, 2] > 0)
    rows = [(v.tolist(), float(c)) for v, c in zip(x, y)]
    return spark.createDataFrame(rows, "features array<double>, label double").repartition(parts)


def test_many_rows_take_the_histogram_forest(spark):
    made = [M.make_estimator("RandomForest", "classification", n_rows=n, trees=3, forest_depth=4)
            for n in (M.FOREST_ROWS, M.FOREST_ROWS + 1)]
    assert isinstance(made[0], RandomForestClassifier) and isinstance(made[1], FO.HistogramForest)
    assert [(m.getNumTrees(), m.getMaxDepth()) for m in made] == [(3, 4)] * 2


def test_weights_are_those_of_poisson():
    share = np.bincount(FO.poisson_weights()) / FO.DRAWS
    assert abs(share[0] - np.exp(-1)) < 1e-4 and abs(share @ np.arange(len(share)) - 1) < 1e-3


@pytest.mark.parametrize("cells", [1 << 24, 500])
def test_every_split_is_the_best_of_its_node(spark, monkeypatch, cells):
    monkeypatch.setattr(FO, "JOB_CELLS", cells)
    monkeypatch.setattr(FO, "CACHED_ROWS", 7)
    monkeypatch.setattr(FO, "CUT_CELLS", 100)
    rows, p = _frame(spark), {"numTrees": 3, "maxDepth": 4, "minInstancesPerNode": 2, "featureSubsetStrategy": "all", "seed": 5}
    edges = FO.bin_edges(rows, 3)
    assert [len(e) for e in edges] == [31, 3, 2]
    blocks = FO.binned_blocks(rows, edges, 600, 3)
    monkeypatch.setattr(FO.HistogramTree, "pruned", lambda self: self)
    trees = FO.ForestFit(blocks, 600, 3, 3, p).run()
    held = blocks.mapPartitionsWithIndex(lambda k, bs: [(k, i, x, y) for i, (x, y) in enumerate(bs)]).collect()
    assert sum(len(y) for *_, y in held) == 600
    bins, y = np.concatenate([x // 3 for _, _, x, _ in held]), np.concatenate([y for *_, y in held])
    assert (np.concatenate([x % 3 for _, _, x, _ in held]) == y[:, None]).all()

    def gini(w):
        n = w.sum()
        return n - (w * w).sum() / n if n else 0.0

    for t, tree in enumerate(trees):
        weight = np.concatenate([FO.row_weights(5, t, (k, i), len(c)) for k, i, _, c in held]).astype(int)
        assert (tree.feature >= 0).sum() > 3
        inside = {0: np.ones(600, bool)}
        for node in range(len(tree.feature)):
            mine = inside[node]
            assert (tree.total[node] == np.bincount(y[mine], weight[mine], 3)).all()
            if tree.feature[node] < 0:
                continue
            found = {}
            for f in range(3):
                for b in range(31):
                    low = mine & (bins[:, f] <= b)
                    a, c = (np.bincount(y[m], weight[m], 3) for m in (low, mine & ~low))
                    if min(a.sum(), c.sum()) >= 2:
                        found[f, b] = gini(a) + gini(c)
            assert found[tree.feature[node], tree.bin[node]] == pytest.approx(min(found.values()))
            low = bins[:, tree.feature[node]] <= tree.bin[node]
            inside[tree.left[node]], inside[tree.left[node] + 1] = mine & low, mine & ~low


def test_leaves_that_agree_are_one():
    tree = FO.HistogramTree(np.array([6.0, 4.0]))
    a, b = tree.split(np.array([0]), 0, 1, np.array([[5.0, 1.0]]), np.array([[1.0, 3.0]]))
    tree.split(np.array([a]), 1, 0, np.array([[3.0, 1.0]]), np.array([[2.0, 0.0]]))
    tree.split(np.array([b]), 1, 2, np.array([[1.0, 0.0]]), np.array([[0.0, 3.0]]))
    out = tree.pruned()
    assert out.feature.tolist() == [0, -1, 1, -1, -1] and out.left[[0, 2]].tolist() == [1, 3]
    assert out.total.tolist() == [[6, 4], [5, 1], [1, 3], [1, 0], [0, 3]] and out.bin[[0, 2]].tolist() == [1, 2]


def test_learns_and_persists(spark, tmp_path):
    rows = _frame(spark).withColumn("features", array_to_vector("features"))
    model = FO.HistogramForest(numTrees=8, maxDepth=6).fit(rows)
    scored = model.transform(rows)
    assert scored.where("prediction = label").count() > 540
    model.write().overwrite().save(str(tmp_path / "m"))
    again = FO.HistogramForestModel.load(str(tmp_path / "m")).transform(rows)
    assert again.select("probability").collect() == scored.select("probability").collect()
    assert len(model.trees()) == 8


def test_odd_frames(spark):
    schema = "features array<double>, label double"
    with pytest.raises(ValueError):
        FO.HistogramForest(numTrees=2).fit(spark.createDataFrame([], schema))
    rows = spark.createDataFrame([([1.0], 0.0), ([2.0], 0.0), (None, 1.0), ([3.0], None)], schema)
    out = FO.HistogramForest(numTrees=2).fit(rows).transform(rows)
    assert [r[0] for r in out.orderBy(F.col("features")[0].asc_nulls_first()).select("prediction").collect()] == [None, 0.0, 0.0, 0.0]


def test_many_rows_of_a_regression_take_the_histogram_forest(spark):
    made = [M.make_estimator("RandomForest", "regression", n_rows=n, trees=3, forest_depth=4)
            for n in (M.FOREST_ROWS, M.FOREST_ROWS + 1)]
    assert isinstance(made[0], RandomForestRegressor) and isinstance(made[1], FO.HistogramForest)
    assert [(m.getNumTrees(), m.getMaxDepth(), m.getFeatureSubsetStrategy() if m is made[0] else m.getOrDefault(m.featureSubsetStrategy))
            for m in made] == [(3, 4, "all")] * 2


@pytest.mark.parametrize("cells, drawn", [(1 << 24, "all"), (400, "all"), (1 << 24, "log2")])
def test_every_split_of_a_regression_is_the_best_of_its_node(spark, monkeypatch, cells, drawn):
    monkeypatch.setattr(FO, "JOB_CELLS", cells)
    monkeypatch.setattr(FO, "CACHED_ROWS", 7)
    monkeypatch.setattr(FO, "CUT_CELLS", 100)
    rows = _frame(spark).withColumn("label", F.col("label") + F.col("features")[0] * 3 + 1000)
    p = {"numTrees": 2, "maxDepth": 3, "minInstancesPerNode": 2, "featureSubsetStrategy": drawn, "seed": 5}
    _, found = FO.training_rows(rows, "features", "label")
    edges = FO.bin_edges(rows, 3)
    starts = FO.bin_starts(edges)
    assert starts.tolist() == [0, 32, 36, 39]
    blocks = FO.label_blocks(rows, edges, found)
    trees = FO.RegressionFit(blocks, 600, edges, p).run()
    held = blocks.mapPartitionsWithIndex(lambda k, bs: [(k, i, x, y) for i, (x, y) in enumerate(bs)]).collect()
    bins, y = np.concatenate([x.T - starts[:-1] for _, _, x, _ in held]), np.concatenate([y for *_, y in held])
    assert abs(y.mean()) < 1e-9 and y.std() == pytest.approx(1)
    for t, tree in enumerate(trees):
        weight = np.concatenate([FO.row_weights(5, t, (k, i), len(c)) for k, i, _, c in held]).astype(int)
        inside = {0: np.ones(600, bool)}

        def error(m):
            return (weight[m] * (y[m] - np.average(y[m], weights=weight[m])) ** 2).sum()

        assert (tree.feature >= 0).sum() > 3
        for node in range(len(tree.feature)):
            mine = inside[node]
            assert tree.total[node] == pytest.approx([weight[mine].sum(), weight[mine] @ y[mine]], abs=1e-8)
            if tree.feature[node] < 0:
                continue
            found = {}
            for f in range(3):
                for b in range(len(edges[f])):
                    low = mine & (bins[:, f] <= b)
                    if min(weight[low].sum(), weight[mine & ~low].sum()) >= 2:
                        found[f, b] = error(low) + error(mine & ~low)
            here = found[tree.feature[node], tree.bin[node]]
            assert here < error(mine)
            if drawn == "all":
                assert here == pytest.approx(min(found.values()))
            low = bins[:, tree.feature[node]] <= tree.bin[node]
            inside[tree.left[node]], inside[tree.left[node] + 1] = mine & low, mine & ~low


def test_regression_learns_and_persists(spark, tmp_path):
    rows = _frame(spark).withColumn("label", F.col("features")[0] * 3 + 1000).withColumn("features", array_to_vector("features"))
    model = FO.HistogramForest(task="regression", numTrees=8, maxDepth=6, featureSubsetStrategy="all").fit(rows)
    scored = model.transform(rows)
    assert "probability" not in scored.columns
    assert scored.agg(F.sum((F.col("label") - F.col("prediction")) ** 2) / F.count("*") / F.var_pop("label")).first()[0] < 0.05
    model.write().overwrite().save(str(tmp_path / "m"))
    again = FO.HistogramForestModel.load(str(tmp_path / "m")).transform(rows)
    assert again.select("prediction").collect() == scored.select("prediction").collect()
    odd = spark.createDataFrame([([1.0], 7.0), ([2.0], 7.0), (None, 1.0), ([3.0], None)], "features array<double>, label double")
    constant = FO.HistogramForest(task="regression", numTrees=4, featureSubsetStrategy="all").fit(odd).transform(odd)
    assert [r[0] for r in constant.orderBy(F.col("features")[0].asc_nulls_first()).select("prediction").collect()] == [None, 7.0, 7.0, 7.0]
    with pytest.raises(ValueError):
        FO.HistogramForest(task="regression", numTrees=2).fit(odd.where("label > 8"))
