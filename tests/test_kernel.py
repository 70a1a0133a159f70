"""Random Fourier features against the kernel, the tube loss and its minimiser, odd frames."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablewright.operators import kernel as K
from tablewright.operators import models as M


def frame(spark, x, y):
    rows = [(i, None if r is None else [float(v) for v in r], None if v is None else float(v))
            for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a array<double>, label double")
    vector = F.when(F.col("a").isNotNull(), array_to_vector(F.coalesce("a", F.array(F.lit(0.0)))))
    return df.select("id", vector.alias("features"), "label").repartition(3)


def test_images_estimate_the_kernel(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    model = K.RandomFourier(numFeatures=2048).fit(frame(spark, x, np.zeros(60)))
    gamma = model.getOrDefault("gamma")
    assert math.isclose(gamma, 1 / (5 * x.var()), rel_tol=1e-9)
    z = np.stack([r.fourier.toArray() for r in model.transform(frame(spark, x, np.zeros(60))).orderBy("id").collect()])
    want = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - want).max() < 5 / math.sqrt(2048)       # the deviation is at most 1 / sqrt(D)


def test_circles_need_the_kernel(spark, tmp_path):
    rng = np.random.default_rng(1)
    angle, far = rng.uniform(0, 2 * np.pi, 600), rng.integers(0, 2, 600)
    x = np.c_[np.cos(angle), np.sin(angle)] * (1 + 1.5 * far[:, None]) + rng.normal(size=(600, 2)) * 0.1
    df = frame(spark, x, far)
    train, test = df.where("id < 400"), df.where("id >= 400")

    def right(name):
        model = M.make_estimator(name, "classification", n_classes=2, n_rows=400).fit(train)
        return model, model.transform(test).where("label = prediction").count() / 200

    model, kernel = right("SVM")
    assert kernel > 0.97 and right("LinearSVC")[1] < 0.7
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(test).select("id", "prediction")
    assert again.exceptAll(model.transform(test).select("id", "prediction")).count() == 0


def test_slope_of_the_tube_loss():
    miss = np.linspace(-1, 1, 401) + 1e-4
    loss, slope = K.tube_loss(miss, 0.3, 0.05)
    near = (K.tube_loss(miss + 1e-7, 0.3, 0.05)[0] - K.tube_loss(miss - 1e-7, 0.3, 0.05)[0]) / 2e-7
    assert np.allclose(slope, near, atol=1e-5)
    assert np.abs(loss - np.maximum(np.abs(miss) - 0.3, 0)).max() <= 0.05 / 4 + 1e-12


def test_minimiser_solves_a_quadratic():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(8, 8))
    a, b = a @ a.T + np.eye(8), rng.normal(size=8)
    got = K.minimise(lambda v: (v @ a @ v / 2 - b @ v, a @ v - b), np.zeros(8), 200, 1e-14)
    assert np.allclose(got, np.linalg.solve(a, b), atol=1e-4)


def test_svr_has_the_flattest_line_inside_the_tube(spark, tmp_path):
    x = np.linspace(-1, 1, 81)
    df = frame(spark, x[:, None], 2 * x + 7)
    model = K.LinearSVR(C=1000.0, epsilon=0.5, smooth=1e-4, maxIter=500, tol=1e-12).fit(df)
    w, b = model.getOrDefault("coefficients")
    assert abs(w - 1.5) < 0.01 and abs(b - 7) < 0.01          # |2 x - w x| <= 0.5 at x = 1
    model.write().overwrite().save(str(tmp_path / "m"))
    rows = K.LinearSVRModel.load(str(tmp_path / "m")).transform(frame(spark, [[1.0], None], [0, 0])).orderBy("id").collect()
    assert abs(rows[0].prediction - 8.5) < 0.02 and rows[1].prediction is None


def test_svr_matches_a_plain_descent(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 2))
    y = x @ [1.0, -2.0] + 0.5 + rng.standard_t(2, 120)
    model = K.LinearSVR(C=0.5, epsilon=0.2, smooth=1e-3, tol=1e-12, maxIter=400).fit(frame(spark, x, y))

    def exact(v):
        return v[:2] @ v[:2] / 2 + 0.5 * np.maximum(np.abs(y - x @ v[:2] - v[2]) - 0.2, 0).sum()

    at = best = np.zeros(3)
    for step in range(1, 40001):        # subgradient descent on the loss without rounding
        miss = y - x @ at[:2] - at[2]
        slope = np.sign(miss) * (np.abs(miss) > 0.2)
        at = at - 0.02 / math.sqrt(step) * np.r_[at[:2] - 0.5 * slope @ x, -0.5 * slope.sum()]
        best = min(best, at, key=exact)
    assert exact(np.array(model.getOrDefault("coefficients"))) <= exact(best) * 1.001


def test_kernel_svr_fits_a_curve(spark):
    x = np.linspace(-3, 3, 300)
    df = frame(spark, x[:, None], np.sin(2 * x))
    rows = M.make_estimator("SVR", "regression").fit(df).transform(df).collect()
    assert np.mean([abs(r.label - r.prediction) for r in rows]) < 0.15


def test_odd_frames(spark):
    for estimator in (K.RandomFourier(), K.LinearSVR()):
        with pytest.raises(ValueError, match="no rows"):
            estimator.fit(frame(spark, [None], [1.0]))
    constant = K.RandomFourier(numFeatures=4).fit(frame(spark, [[2.0], [2.0], None], [0, 0, 0]))
    assert constant.getOrDefault("gamma") == 1.0
    got = constant.transform(frame(spark, [[1.0], None], [0, 0])).orderBy("id").collect()
    assert len(got[0].fourier) == 4 and got[1].fourier is None


def test_machines_on_images_store_the_rows_as_they_came(spark, monkeypatch):
    """Images of all rows, copied for each class, passed the executors' memory."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0)
    widths, plain = [], K.stored_blocks
    monkeypatch.setattr(K, "stored_blocks", lambda rows, width, *a: widths.append(width) or plain(rows, width, *a))
    for name, task in (("SVM", "classification"), ("SVR", "regression")):
        df = frame(spark, [*x, None], [*y, 0])
        out = M.make_estimator(name, task, n_classes=3, n_rows=300, max_iter=30).fit(df).transform(df).orderBy("id")
        assert "fourier" not in out.columns
        got = [r.prediction for r in out.collect()]
        assert got[-1] is None and np.mean(np.abs(np.array(got[:-1]) - y)) < 0.3
    assert widths == [3, 3]


def test_kernel_svc_reaches_the_loss_of_one_machine_a_class(spark):
    from pyspark.ml.classification import LinearSVC
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = np.digitize(x[:, 0] * x[:, 1], [-0.3, 0.3])
    df = frame(spark, x, y)
    model = K.KernelSVC(numFeatures=32, maxIter=300, tol=1e-9).fit(df)
    at = np.array(model.getOrDefault("coefficients")).reshape(33, 3)
    z = K.images(x, *model.directions())
    images = frame(spark, z, y)
    for k in range(3):
        side = np.where(y == k, 1, -1)

        def exact(w, b):
            return w @ w / 2 + np.maximum(1 - side * (z @ w + b), 0).sum()

        one = LinearSVC(regParam=1 / 400, standardization=False, maxIter=300).fit(
            images.withColumn("label", (F.col("label") == k).cast("double")))
        assert exact(at[:-1, k], at[-1, k]) <= exact(one.coefficients.toArray(), one.intercept) * 1.01
    got = [r.prediction for r in model.transform(df).orderBy("id").collect()]
    assert (np.array(got) == (z @ at[:-1] + at[-1]).argmax(1)).mean() > 0.99
