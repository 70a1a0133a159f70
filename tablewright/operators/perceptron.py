"""Sigmoid perceptron of a classification by quasi-Newton steps over stored blocks (MOD7).

The network, its first weights, loss and steps are those of MLlib's ``MultilayerPerceptronClassifier``:
sigmoid hidden layers, a softmax head, the mean cross entropy of all rows, limited-memory quasi-Newton
steps that end after ``maxIter`` or when the loss falls by less than ``tol`` of itself over
``HISTORY`` steps.  Every step reads all rows: one ``treeAggregate`` of (loss, gradient), in which a task
passes ``SLICE_ROWS`` rows at a time through the network in single precision.  What is held in the driver
and in a task is the weights, the last gradients and one block, whatever the number of rows.

The fitted model is MLlib's, made from the weights found.

Results: rows with a null label or null features teach nothing; an empty frame is a ValueError.
Reruns on the same partitions agree.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Estimator
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasProbabilityCol,
                                     HasRawPredictionCol, HasSeed, HasTol)
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from .kernel import minimise
from .row_blocks import stored_blocks, summed, training_rows

SLICE_ROWS = 1024       # rows whose hidden values a task holds at a time
HISTORY = 10            # steps over which MLlib's optimiser looks for a fall of the loss


def unpacked(weights: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(W, b) of each layer from MLlib's weights: a row of W for each input, then b."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((weights[at:at + a * b].reshape(a, b), weights[at + a * b:at + (a + 1) * b]))
        at += (a + 1) * b
    return out


def loss_and_gradient(weights: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The cross entropy, summed over the rows, and its gradient in the order of the weights."""
    at = [x]
    for w, b in weights[:-1]:
        z = at[-1] @ w
        z += b
        # 1 / (1 + exp(-z)) in place; a value that far below leaves exactly zero
        np.negative(z, out=z)
        np.minimum(z, 80, out=z)
        np.exp(z, out=z)
        z += 1
        at.append(np.reciprocal(z, out=z))
    out = at[-1] @ weights[-1][0] + weights[-1][1]
    out -= out.max(1, keepdims=True)
    rows, label = np.arange(len(y)), y.astype(np.intp)
    logs = out[rows, label]
    np.exp(out, out=out)
    total = out.sum(1, keepdims=True)
    loss = float(np.log(total).sum(dtype=float) - logs.sum(dtype=float))
    out /= total
    out[rows, label] -= 1
    back, ones, found = out, np.ones(len(y), x.dtype), []
    for k in reversed(range(len(weights))):
        found = [at[k].T @ back, ones @ back, *found]
        if k:
            back = back @ weights[k][0].T
            back *= at[k]
            back *= np.subtract(1, at[k], out=at[k])
    return loss, found


class SigmoidMlp(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, HasMaxIter,
                 HasTol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator of the module's network; labels are 0..K-1, K the last of ``layers``."""

    layers = Param(Params._dummy(), "layers", "sizes of the layers, input and output included", TypeConverters.toListInt)

    def __init__(self, **params):
        super().__init__()
        self._setDefault(maxIter=100, tol=1e-6, seed=42, featuresCol="features", labelCol="label", predictionCol="prediction",
                         probabilityCol="probability", rawPredictionCol="rawPrediction")
        self._set(**params)

    def getLayers(self) -> list[int]:
        return self.getOrDefault(self.layers)

    def _made(self, spark, **more) -> MultilayerPerceptronClassificationModel:
        """MLlib's model, with its first weights or those given."""
        row = spark.createDataFrame([(Vectors.dense(np.zeros(self.getLayers()[0])), 0.0)], [self.getFeaturesCol(), self.getLabelCol()])
        return MultilayerPerceptronClassifier(
            layers=self.getLayers(), maxIter=0, seed=self.getSeed(), featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(),
            predictionCol=self.getPredictionCol(), probabilityCol=self.getProbabilityCol(),
            rawPredictionCol=self.getRawPredictionCol(), **more).fit(row)

    def _fit(self, dataset: DataFrame) -> MultilayerPerceptronClassificationModel:
        spark, layers = dataset.sparkSession, self.getLayers()
        rows, found = training_rows(dataset, self.getFeaturesCol(), self.getLabelCol())
        if found["width"] != layers[0] or found["top"] >= layers[-1]:
            raise ValueError(f"rows of {found['width']} features and labels up to {found['top']} do not fit the layers {layers}")
        blocks, count = stored_blocks(rows, found["width"], found["n"]), found["n"]

        def objective(at):
            sent = at.astype(np.float32)

            def part(block):
                x, y = block
                weights, loss, total = unpacked(sent, layers), 0.0, np.zeros(len(sent))
                for first in range(0, len(x), SLICE_ROWS):
                    some = slice(first, first + SLICE_ROWS)
                    more, grads = loss_and_gradient(weights, x[some].astype(np.float32), y[some])
                    loss += more
                    total += np.concatenate([g.ravel() for g in grads])
                return np.r_[loss, total]

            total = summed(blocks, part) / count
            return total[0], total[1:]

        at = minimise(objective, self._made(spark).weights.toArray(), self.getMaxIter(), self.getTol(), HISTORY)
        return self._made(spark, initialWeights=Vectors.dense(at))
