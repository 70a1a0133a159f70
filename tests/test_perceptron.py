"""Sigmoid perceptron: gradient by differences, MLlib's start and loss, plateaus, saved models, odd frames."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablewright.operators import kernel as K
from tablewright.operators import models as M
from tablewright.operators import perceptron as P


def _frame(spark, n=500, parts=3):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] * x[:, 0] > 0.3)
    rows = [(v.tolist(), float(c)) for v, c in zip(x, y)]
    return spark.createDataFrame(rows, "features array<double>, label double").repartition(parts).withColumn(
        "features", array_to_vector("features"))


def test_many_rows_take_the_perceptron_over_blocks(spark):
    made = [M.make_estimator("MLP", "classification", n_classes=3, n_features=4, n_rows=n, max_iter=7, hidden=(5, 2))
            for n in (M.MLP_ROWS, M.MLP_ROWS + 1)]
    assert isinstance(made[0], MultilayerPerceptronClassifier) and isinstance(made[1], P.SigmoidMlp)
    assert [(m.getLayers(), m.getMaxIter(), m.getTol(), m.getSeed()) for m in made] == [([4, 5, 2, 3], 7, 1e-6, M.SEED)] * 2


def test_gradient_is_that_of_the_loss():
    rng, layers = np.random.default_rng(1), [3, 4, 2, 3]
    at = rng.normal(size=4 * 4 + 5 * 2 + 3 * 3)
    x, y = rng.normal(size=(9, 3)), rng.integers(0, 3, 9).astype(float)

    def loss(v):
        return P.loss_and_gradient(P.unpacked(v, layers), x, y)[0]

    found = np.concatenate([g.ravel() for g in P.loss_and_gradient(P.unpacked(at, layers), x, y)[1]])
    step = 1e-6 * np.eye(len(at))
    assert found == pytest.approx([(loss(at + s) - loss(at - s)) / 2e-6 for s in step], abs=1e-6)
    huge = [(w * 1e4, b) for w, b in P.unpacked(at, layers)]
    value, grads = P.loss_and_gradient([(w.astype(np.float32), b.astype(np.float32)) for w, b in huge], x.astype(np.float32), y)
    assert np.isfinite(value) and all(np.isfinite(g).all() for g in grads)


def test_starts_and_ends_as_mllib(spark, monkeypatch):
    monkeypatch.setattr(P, "SLICE_ROWS", 64)
    rows, kw = _frame(spark), dict(layers=[3, 8, 4, 3], seed=7)
    start = [e(maxIter=0, **kw).fit(rows).weights.toArray() for e in (P.SigmoidMlp, MultilayerPerceptronClassifier)]
    assert (start[0] == start[1]).all() and start[0].any()
    x, y = (np.array(v) for v in zip(*[(r[0].toArray(), r[1]) for r in rows.select("features", "label").collect()]))
    loss, right = [], []
    for e in (P.SigmoidMlp, MultilayerPerceptronClassifier):
        model = e(maxIter=100, **kw).fit(rows)
        loss.append(P.loss_and_gradient(P.unpacked(model.weights.toArray(), kw["layers"]), x, y)[0] / len(y))
        right.append(model.transform(rows).where("prediction = label").count())
    assert loss[0] < 1.25 * loss[1] + 0.02 and right[0] > 450 and right[1] > 450


def test_a_single_flat_step_ends_nothing():
    """The value stalls for a step and falls again: the descent goes on, as it does in MLlib."""
    seen = []

    def stalls(at):
        seen.append(1)
        return (5.0 if len(seen) <= 2 else 5.0 - len(seen)), np.full(1, 1e-9)

    K.minimise(stalls, np.zeros(1), 20, 1e-6)
    short, seen[:] = len(seen), []
    K.minimise(stalls, np.zeros(1), 20, 1e-6, P.HISTORY)
    assert short == 2 and len(seen) == 21


def test_persists_and_odd_frames(spark, tmp_path):
    rows = _frame(spark, 60)
    odd = rows.unionByName(rows.limit(5).withColumn("label", F.lit(None).cast("double")))
    model = P.SigmoidMlp(layers=[3, 4, 3], maxIter=5).fit(odd)
    assert isinstance(model, MultilayerPerceptronClassificationModel)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = MultilayerPerceptronClassificationModel.load(str(tmp_path / "m"))
    assert again.transform(rows).select("probability").collect() == model.transform(rows).select("probability").collect()
    with pytest.raises(ValueError):
        P.SigmoidMlp(layers=[3, 4, 3]).fit(rows.where("label > 9"))
    with pytest.raises(ValueError):
        P.SigmoidMlp(layers=[3, 4, 2]).fit(rows)
