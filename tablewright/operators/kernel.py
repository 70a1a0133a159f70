"""Support vector machines with an RBF kernel: random Fourier features and linear machines (MOD5).

``RandomFourier`` maps a vector x to ``sqrt(2 / D) * cos(x W + b)``, W drawn from the normal
distribution with variance ``2 * gamma`` and b uniformly from [0, 2 pi): the inner product of two
images estimates ``exp(-gamma * |x - y|^2)`` with an error of about ``1 / sqrt(D)``.  W and b follow
from (seed, gamma, width), so the fitted stage stores three numbers.  ``gamma`` 0 takes
``1 / (width * variance of all entries)``, from one aggregate.

``LinearSVR`` minimises ``|w|^2 / 2 + C * sum(max(0, |y - w x - b| - epsilon))`` without a penalty
on b.  The corner of the loss is rounded by a parabola over ``smooth`` to either side, as
quasi-Newton steps need a gradient; each step is one ``treeAggregate`` of (loss, gradient) over
stored blocks, and the driver holds the last ``MEMORY`` gradients only.

``KernelSVC`` (one machine a class, all in one descent; ``|w|^2 / 2 + C * sum(max(0, 1 - y f))``
with its corner rounded alike) and ``KernelSVR`` are these machines on images.  Neither kernel
matrices nor images are stored: the blocks hold the rows as they came, and each step makes the
images of ``IMAGE_ROWS`` rows at a time, in single precision - its error is a thousandth of
that of the estimate itself.  Work grows with the rows, memory with one slice of a block.

Results: null features get a null image and a null prediction; rows with null features or label
teach nothing; an empty frame is a ValueError; a constant table has gamma 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (HasFeaturesCol, HasInputCol, HasLabelCol, HasMaxIter, HasOutputCol,
                                     HasPredictionCol, HasRawPredictionCol, HasTol)
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .row_blocks import as_array, stored_blocks, summed, training_rows

FOURIER_FEATURES = 1024
MEMORY = 10             # gradients that the quasi-Newton steps remember
IMAGE_ROWS = 1024       # rows whose images a task holds at a time


# ---- random Fourier features ----------------------------------------------------------------

class _ImageParams(Params):
    numFeatures = Param(Params._dummy(), "numFeatures", "length of an image", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "width of the kernel, 0: from the variance", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of the directions", TypeConverters.toInt)
    width = Param(Params._dummy(), "width", "length of an input", TypeConverters.toInt)

    def directions(self) -> tuple[np.ndarray, np.ndarray]:
        """W and b of a fitted kernel."""
        return directions(*(self.getOrDefault(p) for p in (self.width, self.numFeatures, self.gamma, self.seed)))


class _FourierParams(_ImageParams, HasInputCol, HasOutputCol):
    def _defaults(self) -> None:
        self._setDefault(inputCol="features", outputCol="fourier", numFeatures=FOURIER_FEATURES, gamma=0.0, seed=42)


def directions(width: int, count: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """W (width x count) and b."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(width, count)) * math.sqrt(2 * gamma), rng.uniform(0, 2 * math.pi, count)


def images(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.cos(x @ w + b) * math.sqrt(2 / len(b))


def image_slices(x: np.ndarray, kernel: tuple[np.ndarray, np.ndarray] | None) -> Iterator[tuple[slice, np.ndarray]]:
    """The images of ``IMAGE_ROWS`` rows after the other, in single precision; without a kernel
    all rows as they are."""
    if kernel is None:
        yield slice(None), x
        return
    w, b = (np.asarray(v, np.float32) for v in kernel)
    for at in range(0, len(x), IMAGE_ROWS):
        z = x[at:at + IMAGE_ROWS].astype(np.float32) @ w
        z += b
        np.cos(z, out=z)
        z *= np.float32(math.sqrt(2 / len(b)))
        yield slice(at, at + IMAGE_ROWS), z


def margins(x: np.ndarray, at: np.ndarray, kernel: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Values (rows x machines) of the machines ``at`` (coefficients and, last, intercept by machine)."""
    return np.concatenate([z.astype(float) @ at[:-1] + at[-1] for _, z in image_slices(x, kernel)])


class RandomFourier(Estimator, _FourierParams, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, **params):
        super().__init__()
        self._defaults()
        self._set(**params)

    def _fit(self, dataset: DataFrame) -> "RandomFourierModel":
        values = as_array(dataset, self.getInputCol())
        entries = F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x)
        row = dataset.select(F.size(values).alias("k"), entries[0].alias("s"), entries[1].alias("q")).where("s IS NOT NULL").agg(
            F.max("k").alias("width"), F.sum("k").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).first()
        if not row["n"]:
            raise ValueError("no rows to learn from")
        variance = row["q"] / row["n"] - (row["s"] / row["n"]) ** 2
        gamma = self.getOrDefault(self.gamma) or (1 / (row["width"] * variance) if variance > 1e-12 else 1.0)
        return self._copyValues(RandomFourierModel(gamma=gamma, width=row["width"]), {self.gamma: gamma})


class RandomFourierModel(Model, _FourierParams, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, **params):
        super().__init__()
        self._defaults()
        self._set(**params)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        drawn = _drawn(self)

        @F.pandas_udf("array<double>")
        def map_rows(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
            w, b = drawn()
            for column in columns:
                known = column.notna().to_numpy()
                out = np.empty(len(column), object)
                if known.any():
                    out[np.flatnonzero(known)] = list(images(np.stack(column[known].to_numpy()).astype(float), w, b))
                yield pd.Series(out)

        image = F.col("__image")
        vector = F.when(image.isNotNull(), array_to_vector(F.coalesce(image, F.array(F.lit(0.0)))))
        return (dataset.withColumn("__image", map_rows(as_array(dataset, self.getInputCol())))
                .withColumn(self.getOutputCol(), vector).drop("__image"))


# ---- quasi-Newton steps over an aggregate ------------------------------------------------------

def minimise(value_and_gradient, start: np.ndarray, steps: int, tol: float, over: int = 1) -> np.ndarray:
    """Limited-memory quasi-Newton descent with a halving line search; ends after ``steps`` or
    when the value falls by less than ``tol`` of itself ``over`` as many steps."""
    at, past = start, []
    value, gradient = value_and_gradient(at)
    values = [value]
    for _ in range(steps):
        way = _two_loops(gradient, past)
        if way @ gradient <= 0:
            way, past = gradient, []
        length = 1.0 if past else min(1.0, 1.0 / max(np.abs(gradient).sum(), 1e-12))
        for _ in range(30):
            new = at - length * way
            new_value, new_gradient = value_and_gradient(new)
            if new_value <= value - 1e-4 * length * (way @ gradient):
                break
            length /= 2
        else:
            return at
        moved, turned = new - at, new_gradient - gradient
        if moved @ turned > 1e-12 * (turned @ turned):
            past = [*past, (moved, turned)][-MEMORY:]
        values = [*values, new_value][-over - 1:]
        done = len(values) > over and values[0] - new_value <= tol * max(abs(values[0]), abs(new_value), 1e-12)
        at, value, gradient = new, new_value, new_gradient
        if done:
            return at
    return at


def _two_loops(gradient: np.ndarray, past: list) -> np.ndarray:
    """The gradient times the inverse curvature that past moves imply."""
    way, shares = gradient.copy(), []
    for moved, turned in reversed(past):
        shares.append((moved @ way) / (moved @ turned))
        way -= shares[-1] * turned
    if past:
        moved, turned = past[-1]
        way *= (moved @ turned) / (turned @ turned)
    for (moved, turned), share in zip(past, reversed(shares)):
        way += moved * (share - (turned @ way) / (moved @ turned))
    return way


# ---- epsilon-insensitive regression ------------------------------------------------------------

class _SvrParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasMaxIter, HasTol):
    C = Param(Params._dummy(), "C", "weight of the loss against |w|^2 / 2", TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "half width of the tube without loss", TypeConverters.toFloat)
    smooth = Param(Params._dummy(), "smooth", "rounding of the corner, as a share of the label's deviation", TypeConverters.toFloat)
    coefficients = Param(Params._dummy(), "coefficients", "w, then b", TypeConverters.toListFloat)

    def _defaults(self) -> None:
        self._setDefault(C=1.0, epsilon=0.1, smooth=1e-3, maxIter=200, tol=1e-7, featuresCol="features", labelCol="label",
                         predictionCol="prediction")


def tube_loss(miss: np.ndarray, epsilon: float, smooth: float) -> tuple[np.ndarray, np.ndarray]:
    """Loss and its slope by ``miss`` = label - prediction: 0 inside the tube, then a parabola over
    2 * ``smooth`` that meets the line |miss| - epsilon."""
    over = np.abs(miss) - epsilon + smooth
    inside = np.clip(over, 0, 2 * smooth)
    loss = inside ** 2 / (4 * smooth) + np.maximum(over - 2 * smooth, 0)
    return loss, np.sign(miss) * inside / (2 * smooth)


def hinge_loss(margin: np.ndarray, smooth: float) -> tuple[np.ndarray, np.ndarray]:
    """max(0, 1 - margin) and its slope by 1 - margin, the corner rounded over ``smooth`` to either side."""
    over = 1 - margin + smooth
    inside = np.clip(over, 0, 2 * smooth)
    return inside ** 2 / (4 * smooth) + np.maximum(over - 2 * smooth, 0), inside / (2 * smooth)


def fit_machines(blocks, loss, start: np.ndarray, c: float, kernel, steps: int, tol: float) -> np.ndarray:
    """Coefficients and, last, intercepts (by machine) that minimise |w|^2 / 2 + C * loss, summed over
    machines.  ``loss(values, labels)`` gives (loss, its slope by the values) of rows x machines."""
    shape = start.shape

    def objective(flat):
        at = flat.reshape(shape)
        w = at[:-1] if kernel is None else at[:-1].astype(np.float32)

        def part(block):
            x, y = block
            total, gradient = 0.0, np.zeros(shape)
            for rows, z in image_slices(x, kernel):
                value, slope = loss(z @ w + at[-1], y[rows])
                total += value.sum()
                gradient[:-1] += z.T @ slope.astype(z.dtype)
                gradient[-1] += slope.sum(0)
            return np.r_[total, gradient.ravel()]

        total = c * summed(blocks, part)
        plain = np.r_[at[:-1], np.zeros((1, shape[1]))].ravel()
        return total[0] + plain @ plain / 2, total[1:] + plain

    return minimise(objective, start.ravel(), steps, tol).reshape(shape)


class _Machine(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, **params):
        super().__init__()
        self._defaults()
        self._set(**params)

    def _kernel(self, dataset: DataFrame) -> "RandomFourierModel":
        return RandomFourier(inputCol=self.getFeaturesCol(), **{p: self.getOrDefault(p) for p in (
            "numFeatures", "gamma", "seed")}).fit(dataset)

    def _tube_machine(self, dataset: DataFrame, fourier: "RandomFourierModel | None" = None) -> np.ndarray:
        c, epsilon, smooth = (self.getOrDefault(p) for p in (self.C, self.epsilon, self.smooth))
        rows, found = training_rows(dataset, self.getFeaturesCol(), self.getLabelCol())
        width, rounded = found["width"], max(smooth * (found["std"] or 0.0), 1e-9)

        def loss(values, y):
            value, slope = tube_loss(y[:, None] - values, epsilon, rounded)
            return value, -slope

        start = np.zeros((1 + (width if fourier is None else fourier.getOrDefault("numFeatures")), 1))
        start[-1] = found["mean"]
        return fit_machines(stored_blocks(rows, width, found["n"]), loss, start, c, fourier and fourier.directions(),
                            self.getMaxIter(), self.getTol())


class _MachineModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, **params):
        super().__init__()
        self._defaults()
        self._set(**params)

    def _values(self, dataset: DataFrame, machines: int, kernel) -> Column:
        """The machines' values of each row, null where the features are."""
        at = np.array(self.getOrDefault("coefficients")).reshape(-1, machines)

        @F.pandas_udf("array<double>")
        def values(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
            drawn = kernel()
            for column in columns:
                known = column.notna().to_numpy()
                out = np.empty(len(column), object)
                if known.any():
                    out[np.flatnonzero(known)] = list(margins(np.stack(column[known].to_numpy()).astype(float), at, drawn))
                yield pd.Series(out)

        return values(as_array(dataset, self.getFeaturesCol()))


class LinearSVR(_Machine, _SvrParams):
    def _fit(self, dataset: DataFrame) -> "LinearSVRModel":
        return self._copyValues(LinearSVRModel(coefficients=self._tube_machine(dataset).ravel().tolist()))


class LinearSVRModel(_MachineModel, _SvrParams):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getPredictionCol(), self._values(dataset, 1, lambda: None)[0])


# ---- machines on images -------------------------------------------------------------------------

def _drawn(model):
    """A function that gives W and b in a task, from the stored numbers."""
    fitted = [model.getOrDefault(p) for p in ("width", "numFeatures", "gamma", "seed")]
    return lambda: directions(*fitted)


class _KernelSvrParams(_SvrParams, _ImageParams):
    def _defaults(self) -> None:
        super()._defaults()
        self._setDefault(numFeatures=FOURIER_FEATURES, gamma=0.0, seed=42)


class KernelSVR(_Machine, _KernelSvrParams):
    """``LinearSVR`` on the images of the features."""

    def _fit(self, dataset: DataFrame) -> "KernelSVRModel":
        fourier = self._kernel(dataset)
        found = {p: fourier.getOrDefault(p) for p in ("gamma", "width")}
        model = KernelSVRModel(coefficients=self._tube_machine(dataset, fourier).ravel().tolist(), **found)
        return self._copyValues(model, {self.gamma: found["gamma"]})


class KernelSVRModel(_MachineModel, _KernelSvrParams):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getPredictionCol(), self._values(dataset, 1, _drawn(self))[0])


class _KernelSvcParams(_ImageParams, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasRawPredictionCol, HasMaxIter, HasTol):
    C = Param(Params._dummy(), "C", "weight of the loss against |w|^2 / 2", TypeConverters.toFloat)
    smooth = Param(Params._dummy(), "smooth", "rounding of the corner", TypeConverters.toFloat)
    coefficients = Param(Params._dummy(), "coefficients", "by feature and then machine, intercepts last", TypeConverters.toListFloat)

    def _defaults(self) -> None:
        self._setDefault(C=1.0, smooth=1e-3, maxIter=100, tol=1e-6, numFeatures=FOURIER_FEATURES, gamma=0.0, seed=42,
                         featuresCol="features", labelCol="label", predictionCol="prediction", rawPredictionCol="rawPrediction")


class KernelSVC(_Machine, _KernelSvcParams):
    """One machine against the rest for each class (labels 0..K-1), a single one for two classes."""

    def _fit(self, dataset: DataFrame) -> "KernelSVCModel":
        fourier = self._kernel(dataset)
        rows, found = training_rows(dataset, self.getFeaturesCol(), self.getLabelCol())
        classes = np.arange(int(found["top"]) + 1) if found["top"] > 1 else np.ones(1)
        smooth = self.getOrDefault(self.smooth)

        def loss(values, y):
            side = np.where(y[:, None] == classes, 1.0, -1.0)
            value, slope = hinge_loss(side * values, smooth)
            return value, -side * slope

        at = fit_machines(stored_blocks(rows, found["width"], found["n"]), loss,
                          np.zeros((self.getOrDefault(self.numFeatures) + 1, len(classes))), self.getOrDefault(self.C),
                          fourier.directions(), self.getMaxIter(), self.getTol())
        kernel = {p: fourier.getOrDefault(p) for p in ("gamma", "width")}
        return self._copyValues(KernelSVCModel(coefficients=at.ravel().tolist(), **kernel), {self.gamma: kernel["gamma"]})


class KernelSVCModel(_MachineModel, _KernelSvcParams):
    """The class whose machine gives the most, the first of equal ones."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        machines = len(self.getOrDefault(self.coefficients)) // (self.getOrDefault(self.numFeatures) + 1)
        got = F.col("__values")
        raw = F.array(-got[0], got[0]) if machines == 1 else got
        vector = F.when(got.isNotNull(), array_to_vector(F.coalesce(raw, F.array(F.lit(0.0)))))
        top = F.array_position(raw, F.array_max(raw)) - 1
        return (dataset.withColumn("__values", self._values(dataset, machines, _drawn(self)))
                .withColumn(self.getRawPredictionCol(), vector)
                .withColumn(self.getPredictionCol(), F.when(got.isNotNull(), top.cast("double"))).drop("__values"))
