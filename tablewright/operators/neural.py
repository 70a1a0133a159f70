"""Multi-layer perceptron with batch normalisation and GELU, fitted by distributed mini-batches (MOD7).

The network: the input is normalised, then each hidden layer is linear -> batch normalisation ->
GELU -> dropout (while learning), then a linear head.  One output and the squared error for a
regression (the label is centred and scaled for the fit), one output and the logistic loss for two
classes, K outputs and the softmax loss for more.

Rows are dealt round-robin, shuffled and stored as blocks of ``batchSize`` rows.  A step is one
``treeAggregate`` over about ``STEP_BLOCKS`` blocks that a seeded draw deals to it: each block is
normalised by its own statistics, as each replica of a data-parallel fit does, and its gradient is
added to the task's.  The driver takes the sum for a step of Adam with decoupled weight decay, a
clipped gradient and a cosine step size.  Where there are ``PARTS_PER_STEP`` partitions for each
step of an epoch, whole partitions are dealt and a step runs tasks on its own only, so that an epoch
reads the rows once; with fewer - then the blocks are few - each step passes over the blocks of the
others.  A ``holdout`` share of
the blocks is never learnt from; its loss - with the running statistics - ends the fit after
``patience`` epochs without an improvement, and the best epoch's weights are kept.

From more than ``SHARED_STEPS`` steps an epoch on, a job a step would cost more than its sums: the
partitions then learn side by side.  An epoch deals its blocks to turns, one job each; in a turn each
partition starts from the same weights and takes a step of its own for each of its blocks dealt to
it, about ``TURN_STEPS``, in single precision.  Weights, running statistics and Adam's moments go on
as the partitions' means by rows.  Each epoch learns from each block once either way.

What is held in the driver and in a task is the weights and one block, whatever the number of rows.
Jobs of an epoch follow the blocks of a partition, whose bytes are bounded.

Results: null features get a null prediction; rows with null features or label teach nothing; an
empty frame is a ValueError; a constant label is predicted as it is; with fewer than two blocks
there is no holdout and all epochs are run.  Reruns on the same partitions agree.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .row_blocks import as_array, merge_depth, pruned, stored, stored_blocks, training_rows

NORM_EPSILON = 1e-5
NORM_MOMENTUM = 0.1     # share of a step's batch statistics in the running ones
STEP_BLOCKS = 8
SHARED_STEPS = 32       # most steps of an epoch that are a job each
TURN_STEPS = 200        # that a partition takes by itself before the means
PARTS_PER_STEP = 4
CLIP = 1.0
WEIGHT_DECAY = 1e-4
LEAST_GAIN = 1e-4
LAST_STEP_SHARE = 0.01  # the cosine ends at this share of the first step size


class _Settings(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol):
    task = Param(Params._dummy(), "task", "classification or regression", TypeConverters.toString)
    hidden = Param(Params._dummy(), "hidden", "sizes of the hidden layers", TypeConverters.toListInt)
    epochs = Param(Params._dummy(), "epochs", "most passes over the rows", TypeConverters.toInt)
    batchSize = Param(Params._dummy(), "batchSize", "rows normalised together", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "first step size", TypeConverters.toFloat)
    dropout = Param(Params._dummy(), "dropout", "share of hidden values dropped while learning", TypeConverters.toFloat)
    patience = Param(Params._dummy(), "patience", "epochs without a better holdout loss", TypeConverters.toInt)
    holdout = Param(Params._dummy(), "holdout", "share of the blocks that measure the loss", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of weights, order and dropout", TypeConverters.toInt)

    def _defaults(self) -> None:
        self._setDefault(task="regression", hidden=[256, 128, 64], epochs=50, batchSize=64, stepSize=1e-3, dropout=0.3,
                         patience=10, holdout=0.1, seed=42, predictionCol="prediction", probabilityCol="probability")


# ---- the network: plain functions of (weights, block) ------------------------------------------

def initial(width: int, hidden: list[int], outputs: int, seed: int) -> list[np.ndarray]:
    """Weights in order: gain and shift of the input's normalisation, then (W, b, gain, shift) of
    each hidden layer, then (W, b) of the head; linear weights uniform by the sizes they join."""
    rng = np.random.default_rng(seed)

    def linear(a, b):
        reach = math.sqrt(6 / (a + b))
        return [rng.uniform(-reach, reach, (a, b)), np.zeros(b)]

    out, before = [np.ones(width), np.zeros(width)], width
    for size in hidden:
        out += [*linear(before, size), np.ones(size), np.zeros(size)]
        before = size
    return out + linear(before, outputs)


def norm_sizes(width: int, hidden: list[int]) -> list[int]:
    return [width, *hidden]


def _error_function(x: np.ndarray) -> np.ndarray:
    """erf to 1.5e-7 (a rational approximation with fixed coefficients)."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - poly * np.exp(-x * x))


def gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x times the normal distribution function, and its slope."""
    cdf = 0.5 * (1 + _error_function(x / math.sqrt(2)))
    return x * cdf, cdf + x * np.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def _normalised(x, gain, shift, stats):
    """Batch normalisation; ``stats`` (mean, variance) are the block's own where None."""
    mean, var = (x.mean(0), x.var(0)) if stats is None else stats
    scale = 1 / np.sqrt(var + NORM_EPSILON)
    unit = (x - mean) * scale
    return unit * gain + shift, (unit, scale, mean, var)


def _normalised_back(grad, gain, kept):
    unit, scale = kept[:2]
    d_unit = grad * gain
    d_x = scale * (d_unit - d_unit.mean(0) - unit * (d_unit * unit).mean(0))
    return d_x, (grad * unit).sum(0), grad.sum(0)


def loss_of(out: np.ndarray, y: np.ndarray, task: str) -> tuple[float, np.ndarray]:
    """Sum of the rows' losses and its gradient by the outputs."""
    if task == "regression":
        miss = out[:, 0] - y
        return float((miss ** 2).sum()), 2 * miss[:, None]
    if out.shape[1] == 1:
        p = 1 / (1 + np.exp(-np.clip(out[:, 0], -500, 500)))
        return float((np.logaddexp(0, out[:, 0]) - y * out[:, 0]).sum()), (p - y)[:, None]
    top = out - out.max(1, keepdims=True)
    logs = top - np.log(np.exp(top).sum(1, keepdims=True))
    hit = y[:, None] == np.arange(out.shape[1])
    return float(-logs[hit].sum()), np.exp(logs) - hit


def forward(weights: list[np.ndarray], x: np.ndarray, stats=None) -> np.ndarray:
    """Outputs with running statistics (a list of (mean, variance)), nothing dropped."""
    at, _ = _normalised(x, weights[0], weights[1], stats[0] if stats else None)
    for k in range((len(weights) - 4) // 4):
        w, b, gain, shift = weights[2 + 4 * k:6 + 4 * k]
        at = gelu(_normalised(at @ w + b, gain, shift, stats[k + 1] if stats else None)[0])[0]
    return at @ weights[-2] + weights[-1]


def gradient(weights: list[np.ndarray], x: np.ndarray, y: np.ndarray, task: str, dropout: float = 0.0, seed=0):
    """(loss, gradients, batch statistics) of one block, all summed over its rows but the
    statistics; the block is normalised by its own mean and variance."""
    rng = np.random.default_rng(seed)
    layers, kept = (len(weights) - 4) // 4, []
    at, norm = _normalised(x, weights[0], weights[1], None)
    stats = [norm[2:]]
    for k in range(layers):
        w, b, gain, shift = weights[2 + 4 * k:6 + 4 * k]
        before = at
        unit, hidden_norm = _normalised(before @ w + b, gain, shift, None)
        at, slope = gelu(unit)
        mask = ((rng.random(at.shape) >= dropout) / (1 - dropout)).astype(at.dtype) if dropout else None
        at = at * mask if dropout else at
        kept.append((before, hidden_norm, slope, mask))
        stats.append(hidden_norm[2:])
    loss, back = loss_of(at @ weights[-2] + weights[-1], y, task)
    grads = [at.T @ back, back.sum(0)]
    back = back @ weights[-2].T
    for k in reversed(range(layers)):
        before, hidden_norm, slope, mask = kept[k]
        back = (back * mask if dropout else back) * slope
        back, d_gain, d_shift = _normalised_back(back, weights[4 + 4 * k], hidden_norm)
        grads = [before.T @ back, back.sum(0), d_gain, d_shift, *grads]
        back = back @ weights[2 + 4 * k].T
    _, d_gain, d_shift = _normalised_back(back, weights[0], norm)
    return loss, [d_gain, d_shift, *grads], stats


def flat(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([a.ravel() for a in arrays])


def unflat(values: np.ndarray, like: list[tuple[int, ...]]) -> list[np.ndarray]:
    out, at = [], 0
    for shape in like:
        size = math.prod(shape)
        out.append(values[at:at + size].reshape(shape))
        at += size
    return out


# ---- the fit -----------------------------------------------------------------------------------

class _Adam:
    def __init__(self, size: int):
        self.mean, self.square, self.steps = np.zeros(size), np.zeros(size), 0

    def step(self, at: np.ndarray, grad: np.ndarray, size: float) -> np.ndarray:
        length = np.linalg.norm(grad)
        grad = grad * min(1.0, CLIP / length) if length else grad
        self.steps += 1
        self.mean = 0.9 * self.mean + 0.1 * grad
        self.square = 0.999 * self.square + 0.001 * grad ** 2
        way = (self.mean / (1 - 0.9 ** self.steps)) / (np.sqrt(self.square / (1 - 0.999 ** self.steps)) + 1e-8)
        return at - size * (way + WEIGHT_DECAY * at)


def learnt(state: list[np.ndarray], grad: np.ndarray, seen: np.ndarray, size: float) -> list[np.ndarray]:
    """(weights, running statistics, Adam's two moments, [steps]) after a step by the mean gradient
    ``grad`` of rows with the statistics ``seen``."""
    weights, running, mean, square, steps = state
    adam = _Adam(len(weights))
    adam.mean, adam.square, adam.steps = mean, square, int(round(steps[0]))
    weights = adam.step(weights, grad, size)
    # the first step takes its own statistics: the start values mean nothing
    momentum = NORM_MOMENTUM if adam.steps > 1 else 1.0
    return [weights, (1 - momentum) * running + momentum * seen, adam.mean, adam.square, np.array([float(adam.steps)])]


def dealt(block: int, epoch: int, seed: int, steps: int) -> int:
    """The step of an epoch that learns from a block."""
    return int(np.random.default_rng([seed, epoch, block]).integers(steps))


def dealt_partitions(count: int, epoch: int, seed: int, steps: int) -> np.ndarray:
    """The steps of an epoch that learn from each of ``count`` partitions."""
    return np.random.default_rng([seed, epoch]).integers(steps, size=count)


def _added(a, b):
    if a is None or b is None:
        return b if a is None else a
    return tuple(p + q for p, q in zip(a, b))


class MlpFit:
    """The loop over epochs and steps."""

    def __init__(self, blocks, count: int, width: int, outputs: int, p: dict):
        self.blocks, self.count, self.width, self.p = blocks, count, width, p
        start = initial(width, p["hidden"], outputs, p["seed"])
        self.shapes = [w.shape for w in start]
        self.weights = flat(start)
        sizes = norm_sizes(width, p["hidden"])
        self.norms = sizes
        self.running = np.concatenate([np.r_[np.zeros(s), np.ones(s)] for s in sizes])
        held = int(round(p["holdout"] * count)) if count > 1 else 0
        self.held = max(1, held) if count > 1 and p["holdout"] > 0 else 0
        self.losses: list[float] = []

    def statistics(self, running: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for s in self.norms:
            out.append((running[at:at + s], running[at + s:at + 2 * s]))
            at += 2 * s
        return out

    def gradient(self, epoch: int, step: int, steps: int):
        """(rows, loss, gradient, statistics times rows) of the blocks dealt to a step."""
        shapes, held, p = self.shapes, self.held, self.p

        parts_held = self.blocks.getNumPartitions()
        whole = parts_held >= PARTS_PER_STEP * steps
        blocks_read = self.blocks
        if whole:
            wanted = np.flatnonzero(dealt_partitions(parts_held, epoch, p["seed"], steps) == step).tolist()
            if not wanted:
                return None
            blocks_read = pruned(self.blocks, wanted)
        sent = self.blocks.context.broadcast(self.weights)

        def parts(blocks):
            total = None
            for number, x, y in blocks:
                if number >= held and (whole or dealt(number, epoch, p["seed"], steps) == step):
                    weights = unflat(sent.value, shapes)
                    loss, grads, stats = gradient(weights, x, y, p["task"], p["dropout"], [p["seed"], epoch, number])
                    seen = flat([a for pair in stats for a in pair]) * len(x)
                    total = _added(total, (len(x), loss, flat(grads), seen))
            return [total]

        found = blocks_read.mapPartitions(parts).treeReduce(_added, merge_depth(blocks_read))
        sent.destroy()
        return found

    def turn(self, epoch: int, turn: int, turns: int, state: list[np.ndarray], size: float) -> list[np.ndarray]:
        """The mean by rows of the partitions' states, each after a step for each of its blocks
        dealt to the turn; ``state`` is that of ``learnt``."""
        shapes, held, p = self.shapes, self.held, self.p
        like = [a.shape for a in state]
        sent = self.blocks.context.broadcast(flat(state))

        def parts(blocks):
            at, rows = unflat(sent.value, like), 0
            for number, x, y in blocks:
                if number >= held and dealt(number, epoch, p["seed"], turns) == turn:
                    weights = unflat(at[0].astype(np.float32), shapes)
                    _, grads, stats = gradient(weights, x.astype(np.float32), y.astype(np.float32), p["task"], p["dropout"],
                                               [p["seed"], epoch, number])
                    seen = flat([a for pair in stats for a in pair]).astype(float)
                    at, rows = learnt(at, flat(grads).astype(float) / len(x), seen, size), rows + len(x)
            return [(rows, flat(at) * rows) if rows else None]

        found = self.blocks.mapPartitions(parts).treeReduce(_added, merge_depth(self.blocks))
        sent.destroy()
        return state if found is None else unflat(found[1] / found[0], like)

    def learn_in_turns(self, epoch: int, state: list[np.ndarray] | None, size: float) -> list[np.ndarray]:
        """An epoch of turns; sets weights and running statistics, returns the state."""
        if state is None:
            none = np.zeros(len(self.weights))
            state = [self.weights, self.running, none, none, np.zeros(1)]
        turns = max(1, math.ceil((self.count - self.held) / self.blocks.getNumPartitions() / TURN_STEPS))
        for turn in range(turns):
            state = self.turn(epoch, turn, turns, state, size)
        self.weights, self.running = state[:2]
        return state

    def holdout_loss(self) -> float:
        shapes, held, task, weights = self.shapes, self.held, self.p["task"], self.weights
        stats = self.statistics(self.running)

        def parts(blocks):
            total = None
            # read to the end: a task that leaves rows unread loses its Python worker
            for number, x, y in blocks:
                if number < held:
                    total = _added(total, (len(x), loss_of(forward(unflat(weights, shapes), x, stats), y, task)[0]))
            return [total]

        rows, loss = self.blocks.mapPartitions(parts).treeReduce(_added, merge_depth(self.blocks))
        return loss / rows

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights and running statistics of the best epoch."""
        p, adam = self.p, _Adam(len(self.weights))
        steps = max(1, (self.count - self.held) // STEP_BLOCKS)
        best, kept, waited, state = math.inf, (self.weights, self.running), 0, None
        for epoch in range(p["epochs"]):
            share = LAST_STEP_SHARE + (1 - LAST_STEP_SHARE) * (1 + math.cos(math.pi * epoch / p["epochs"])) / 2
            if steps > SHARED_STEPS:
                state = self.learn_in_turns(epoch, state, p["stepSize"] * share)
            for step in range(steps if steps <= SHARED_STEPS else 0):
                found = self.gradient(epoch, step, steps)
                if found is None:       # no block was dealt to this step
                    continue
                rows, _, grad, seen = found
                self.weights = adam.step(self.weights, grad / rows, p["stepSize"] * share)
                # the first step takes its own statistics: the start values mean nothing
                momentum = NORM_MOMENTUM if adam.steps > 1 else 1.0
                self.running = (1 - momentum) * self.running + momentum * seen / rows
            if not self.held:
                kept = self.weights, self.running
                continue
            self.losses.append(self.holdout_loss())
            if self.losses[-1] < best - LEAST_GAIN:
                best, kept, waited = self.losses[-1], (self.weights, self.running), 0
            else:
                waited += 1
                if waited >= p["patience"]:
                    break
        return kept


class BatchNormMlp(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator of the module's network."""

    def __init__(self, **params):
        super().__init__()
        self._defaults()
        self._set(**params)

    def _fit(self, dataset: DataFrame) -> "BatchNormMlpModel":
        p = {q.name: self.getOrDefault(q) for q in self.params if self.isDefined(q)}
        rows, found = training_rows(dataset, p["featuresCol"], p["labelCol"])
        outputs, mean, scale = 1, 0.0, 1.0
        if p["task"] == "regression":
            mean, scale = found["mean"], found["std"] or 1.0
        elif found["top"] > 1:
            outputs = int(found["top"]) + 1
        # numbered from 0 so that a share of the blocks can be held out and steps dealt
        blocks = stored(stored_blocks(rows, found["width"], found["n"], p["batchSize"], mixed=p["seed"])
                        .zipWithIndex().map(lambda b: (b[1], b[0][0], (b[0][1] - mean) / scale)))
        fit = MlpFit(blocks, blocks.count(), found["width"], outputs, p)
        weights, running = fit.run()
        packed = base64.b64encode(np.concatenate([weights, running]).tobytes()).decode()
        model = BatchNormMlpModel(state=packed, width=found["width"], outputs=outputs, mean=mean, scale=scale,
                                  losses=fit.losses)
        return self._copyValues(model)


class BatchNormMlpModel(Model, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted network; adds ``prediction`` and, for classification, ``probability`` in one pass."""

    state = Param(Params._dummy(), "state", "weights and running statistics", TypeConverters.toString)
    width = Param(Params._dummy(), "width", "length of an input", TypeConverters.toInt)
    outputs = Param(Params._dummy(), "outputs", "outputs of the head", TypeConverters.toInt)
    mean = Param(Params._dummy(), "mean", "added to a regression's scaled output", TypeConverters.toFloat)
    scale = Param(Params._dummy(), "scale", "scale of a regression's output", TypeConverters.toFloat)
    losses = Param(Params._dummy(), "losses", "holdout loss of each epoch", TypeConverters.toListFloat)

    def __init__(self, **params):
        super().__init__()
        self._defaults()
        self._set(**params)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        task, hidden, width, outputs = (self.getOrDefault(p) for p in (self.task, self.hidden, self.width, self.outputs))
        mean, scale = self.getOrDefault(self.mean), self.getOrDefault(self.scale)
        prediction, probability = self.getOrDefault(self.predictionCol), self.getOrDefault(self.probabilityCol)
        held = dataset.sparkSession.sparkContext.broadcast(self.getOrDefault(self.state))

        @F.pandas_udf("array<double>")
        def score(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
            shapes = [w.shape for w in initial(width, hidden, outputs, 0)]
            values = np.frombuffer(base64.b64decode(held.value))
            weights = unflat(values, shapes)
            stats, at = [], sum(w.size for w in weights)
            for s in norm_sizes(width, hidden):
                stats.append((values[at:at + s], values[at + s:at + 2 * s]))
                at += 2 * s
            for column in columns:
                known = column.notna().to_numpy()
                out = np.empty(len(column), object)
                if known.any():
                    raw = forward(weights, np.stack(column[known].to_numpy()).astype(float), stats)
                    if task == "regression":
                        raw = raw * scale + mean
                    elif outputs == 1:
                        p = 1 / (1 + np.exp(-np.clip(raw, -500, 500)))
                        raw = np.concatenate([1 - p, p], 1)
                    else:
                        e = np.exp(raw - raw.max(1, keepdims=True))
                        raw = e / e.sum(1, keepdims=True)
                    out[np.flatnonzero(known)] = list(raw)
                yield pd.Series(out)

        scored = dataset.withColumn("__scores", score(as_array(dataset, self.getOrDefault(self.featuresCol))))
        if task == "regression":
            return scored.withColumn(prediction, F.col("__scores")[0]).drop("__scores")
        top = F.array_position("__scores", F.array_max("__scores")) - 1
        vector = array_to_vector(F.coalesce("__scores", F.array(F.lit(0.0))))
        return (scored.withColumn(prediction, top.cast("double"))
                .withColumn(probability, F.when(F.col("__scores").isNotNull(), vector)).drop("__scores"))
