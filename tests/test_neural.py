"""The network's gradient against finite differences, what it learns, and odd frames."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablewright.operators import models as M
from tablewright.operators import neural as N
from tablewright.operators.row_blocks import pruned


def frame(spark, x, y):
    rows = [(i, None if r is None else [float(v) for v in r], None if v is None else float(v))
            for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a array<double>, label double")
    vector = F.when(F.col("a").isNotNull(), array_to_vector(F.coalesce("a", F.array(F.lit(0.0)))))
    return df.select("id", vector.alias("features"), "label").repartition(3)


@pytest.mark.parametrize("task, outputs", [("regression", 1), ("classification", 1), ("classification", 3)])
def test_gradient_equals_finite_differences(task, outputs):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, 3))
    y = rng.normal(size=12) if task == "regression" else rng.integers(0, max(2, outputs), 12).astype(float)
    weights = [w + rng.normal(size=w.shape) * 0.1 for w in N.initial(3, [5, 4], outputs, 1)]
    shapes, at = [w.shape for w in weights], N.flat(weights)
    for dropout in (0.0, 0.3):
        _, grads, _ = N.gradient(weights, x, y, task, dropout, seed=7)
        got, want = N.flat(grads), np.empty(len(at))
        for i in range(len(at)):
            ends = []
            for sign in (1, -1):
                moved = at.copy()
                moved[i] += sign * 1e-5
                ends.append(N.gradient(N.unflat(moved, shapes), x, y, task, dropout, seed=7)[0])
            want[i] = (ends[0] - ends[1]) / 2e-5
        # the error function is an approximation to 1.5e-7, so its differences are coarse
        assert np.abs(got - want).max() < 2e-2 * max(1.0, np.abs(want).max())


def test_gelu_and_block_statistics():
    x = np.linspace(-4, 4, 81)
    want = np.array([v * 0.5 * (1 + math.erf(v / math.sqrt(2))) for v in x])
    assert np.abs(N.gelu(x)[0] - want).max() < 1e-6
    rng = np.random.default_rng(1)
    weights, block = N.initial(2, [3], 1, 0), rng.normal(size=(20, 2))
    _, _, stats = N.gradient(weights, block, np.zeros(20), "regression")
    assert np.allclose(stats[0][0], block.mean(0)) and np.allclose(stats[0][1], block.var(0))
    # with the block's own statistics the running form gives the same outputs
    assert np.allclose(N.forward(weights, block, stats), N.forward(weights, block))


@pytest.mark.parametrize("whole", [False, True])
def test_a_step_sums_its_blocks(spark, monkeypatch, whole):
    if whole:       # a partition for each block: partitions are dealt
        monkeypatch.setattr(N, "PARTS_PER_STEP", 2)
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 2)), rng.normal(size=40)
    blocks = [(i, x[i * 10:i * 10 + 10], y[i * 10:i * 10 + 10]) for i in range(4)]
    p = {"task": "regression", "hidden": [3], "seed": 5, "dropout": 0.2, "holdout": 0.25}
    fit = N.MlpFit(spark.sparkContext.parallelize(blocks, 4), 4, 2, 1, p)
    assert fit.held == 1
    seen = 0
    for step in range(2):
        deals = N.dealt_partitions(4, 0, 5, 2) if whole else [N.dealt(i, 0, 5, 2) for i in range(4)]
        mine = [b for b in blocks[1:] if deals[b[0]] == step]
        found = fit.gradient(0, step, 2)
        seen += len(mine)
        if not mine:
            assert found is None
            continue
        parts = [N.gradient(N.unflat(fit.weights, fit.shapes), bx, by, "regression", 0.2, [5, 0, i]) for i, bx, by in mine]
        assert found[0] == 10 * len(mine) and math.isclose(found[1], sum(q[0] for q in parts))
        assert np.allclose(found[2], sum(N.flat(q[1]) for q in parts))
    assert seen == 3        # each block outside the holdout is in one step


def test_a_turn_is_the_mean_of_the_partitions_steps(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(50, 2)), rng.normal(size=50)
    blocks = [(i, x[i * 10:i * 10 + 10], y[i * 10:i * 10 + 10]) for i in range(5)]
    p = {"task": "regression", "hidden": [3], "seed": 5, "dropout": 0.2, "holdout": 0.2}
    fit = N.MlpFit(spark.sparkContext.parallelize(blocks, 2), 5, 2, 1, p)
    none = np.zeros(len(fit.weights))
    state = start = [fit.weights, fit.running, none, none, np.zeros(1)]
    seen = 0
    for turn in range(2):
        sums, rows = 0, 0
        for part in (blocks[:2], blocks[2:]):
            at, mine = state, 0
            for i, bx, by in part:
                if i >= fit.held and N.dealt(i, 1, 5, 2) == turn:
                    single = [v.astype(np.float32) for v in (at[0], bx, by)]
                    _, grads, stats = N.gradient(N.unflat(single[0], fit.shapes), *single[1:], "regression", 0.2, [5, 1, i])
                    grad, stat = N.flat(grads).astype(float) / 10, N.flat([a for pair in stats for a in pair]).astype(float)
                    at = N.learnt(at, grad, stat, 0.01)
                    mine, seen = mine + 10, seen + 1
            sums, rows = sums + N.flat(at) * mine, rows + mine
        state = fit.turn(1, turn, 2, state, 0.01)
        assert not rows or np.allclose(N.flat(state), sums / rows)
    assert seen == 4 and not np.allclose(state[0], start[0])     # each block outside the holdout, once


def test_jobs_of_an_epoch_do_not_grow_with_its_steps(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.uniform(-2, 2, (4000, 1))
    y = np.sin(2 * x[:, 0])
    jobs = []
    turn = N.MlpFit.turn
    monkeypatch.setattr(N.MlpFit, "turn", lambda self, epoch, *a: jobs.append(epoch) or turn(self, epoch, *a))
    monkeypatch.setattr(N.MlpFit, "gradient", lambda *a: pytest.fail("a job a step"))
    df = frame(spark, x, y)
    model = N.BatchNormMlp(hidden=[16], epochs=6, batchSize=8, stepSize=0.02, dropout=0.0).fit(df)      # 56 steps an epoch
    assert sorted(set(jobs)) == list(range(6)) and len(jobs) == 6
    rows = model.transform(df).select("label", "prediction").collect()
    assert np.mean([(r.label - r.prediction) ** 2 for r in rows]) < 0.2 * y.var()


def test_pruned_partitions_are_those_asked_for(spark):
    blocks = spark.sparkContext.parallelize(range(12), 6).map(lambda v: (v, np.full(2, v)))
    kept = pruned(blocks, [1, 4])
    assert kept.getNumPartitions() == 2 and [v for v, _ in kept.collect()] == [2, 3, 8, 9]
    assert kept.map(lambda b: float(b[1].sum())).collect() == [4.0, 6.0, 16.0, 18.0]


def test_learns_a_curve_and_persists(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.uniform(-2, 2, (800, 2))
    y = 100 * np.sin(2 * x[:, 0]) + 50 * x[:, 1] ** 2 + 1000
    df = frame(spark, x, y)
    made = M.make_estimator("MLP", "regression", hidden=(32, 16), max_iter=30)
    model = made.copy({made.stepSize: 0.02, made.dropout: 0.0}).fit(df)
    rows = model.transform(df).select("label", "prediction").collect()
    assert np.mean([(r.label - r.prediction) ** 2 for r in rows]) < 0.1 * y.var()
    assert min(model.getOrDefault("losses")) < 0.3 * model.getOrDefault("losses")[0]
    model.write().overwrite().save(str(tmp_path / "m"))
    again = N.BatchNormMlpModel.load(str(tmp_path / "m")).transform(df).select("id", "prediction")
    assert again.exceptAll(model.transform(df).select("id", "prediction")).count() == 0


def test_odd_frames(spark):
    with pytest.raises(ValueError, match="no rows"):
        N.BatchNormMlp().fit(frame(spark, [None], [1.0]))
    few = N.BatchNormMlp(hidden=[2], epochs=2).fit(frame(spark, [[1.0], [1.0], None], [4.0, 4.0, 9.0]))
    got = few.transform(frame(spark, [[1.0], None], [0, 0])).orderBy("id").collect()
    assert got[1].prediction is None and math.isfinite(got[0].prediction)
    classes = N.BatchNormMlp(task="classification", hidden=[4], epochs=2).fit(frame(spark, [[0.0], [1.0], [2.0]] * 5, [0, 1, 2] * 5))
    row = classes.transform(frame(spark, [[1.0]], [0])).first()
    assert len(row.probability) == 3 and math.isclose(sum(row.probability), 1.0) and row.prediction in (0.0, 1.0, 2.0)
