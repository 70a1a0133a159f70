"""Extremely randomised trees, grown level by level over all rows (MOD2).

Every tree sees all rows.  At a node a seeded draw takes ``features`` of the features that are not
constant there and, for each, one cut uniformly between the feature's least and largest value in the
node; the cut that lowers the impurity most (Gini, or the squared error of a regression) is taken.
A node stays a leaf when it is pure, constant in all features, as deep as ``maxDepth`` or a side
would have fewer than ``minInstancesPerNode`` rows.

All trees grow together.  A level takes two ``treeAggregate`` jobs over the stored blocks for each
``JOB_CELLS`` numbers summed, ``JOBS_AT_ONCE`` at a time: least and largest value per (node, feature), then the label sums left
of each drawn cut.  Only these sums reach the driver, where the splits are chosen; nothing is
shuffled but sums.  The fitted nodes live in the driver, at most ``2 ** maxDepth`` leaves a tree.

Results: a class probability is the mean of the trees' leaf shares, a regression the mean of the
leaf means.  Rows with null features get a null prediction; those with a null label or features
teach nothing; an empty frame is a ValueError; a constant label gives trees of one leaf.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .row_blocks import as_array, stored_blocks, training_rows

JOB_CELLS = 1 << 20     # numbers summed by one job
JOBS_AT_ONCE = 8
SORTED_ROWS = 100_000   # most rows of a regression whose labels are added in sorted order, at twice the price


class _Settings(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol):
    task = Param(Params._dummy(), "task", "classification or regression", TypeConverters.toString)
    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits of a tree", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least rows of a child", TypeConverters.toInt)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "features drawn at a node: sqrt, log2 or all",
                                  TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "seed of features and cuts", TypeConverters.toInt)

    def _defaults(self) -> None:
        self._setDefault(task="classification", numTrees=200, maxDepth=12, minInstancesPerNode=1,
                         featureSubsetStrategy="sqrt", seed=42, predictionCol="prediction", probabilityCol="probability")

    def getMaxDepth(self) -> int:
        return self.getOrDefault(self.maxDepth)

    def getNumTrees(self) -> int:
        return self.getOrDefault(self.numTrees)


class CutTree:
    """Splits (rows at or below the cut go to ``left``, others to ``left + 1``) and label sums of
    the nodes; ``-1`` is the feature of a leaf."""

    def __init__(self, total):
        self.feature, self.cut, self.left, self.total = [-1], [0.0], [0], [total]

    def split(self, node: int, feature: int, cut: float, sums_left: np.ndarray) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, at
        self.feature += [-1, -1]
        self.cut += [0.0, 0.0]
        self.left += [0, 0]
        self.total += [sums_left, self.total[node] - sums_left]
        return at, at + 1

    def arrays(self):
        return np.array(self.feature), np.array(self.cut), np.array(self.left)


def places(tree, x: np.ndarray) -> np.ndarray:
    """The node each row ends in, for the arrays (feature, cut, left) of a tree."""
    feature, cut, left = tree
    inner = feature >= 0    # a leaf leads to itself
    feature, cut = np.where(inner, feature, 0), np.where(inner, cut, np.inf)
    left = np.where(inner, left, np.arange(len(left)))
    values, row = x.ravel(), np.arange(len(x)) * x.shape[1]
    at = np.zeros(len(x), np.int64)
    while inner.take(at).any():
        at = left.take(at) + (values.take(feature.take(at) + row) > cut.take(at))
    return at


def label_sums(y: np.ndarray, outputs: int) -> np.ndarray:
    """What a node sums of its rows: a one for the row's class, or (1, y, y * y) where
    ``outputs`` is 0 (a regression)."""
    if not outputs:
        return np.stack([np.ones_like(y), y, y * y], 1)
    return (y[:, None] == np.arange(outputs)).astype(float)


class _Blocks:
    """The sums of a level over stored blocks."""

    def __init__(self, blocks, outputs: int, on_thread, rows: int = 0):
        self.blocks, self.outputs, self.on_thread, self.rows = blocks, outputs, on_thread, rows

    @staticmethod
    def _slots(x, tree, nodes):
        """The place in ``nodes`` of each row's node, -1 for rows in no open node."""
        # short numbers are sorted by their digits
        slot = np.full(len(tree[0]), -1, np.int16 if len(nodes) < 1 << 15 else np.int64)
        slot[nodes] = np.arange(len(nodes))
        return slot.take(places(tree, x))

    @classmethod
    def _rows(cls, x, tree, nodes):
        """Rows in the open nodes of a tree, sorted by node, and the slot of each."""
        of = cls._slots(x, tree, nodes)
        order = np.argsort(of, kind="stable")
        order = order[np.count_nonzero(of < 0):]
        return order, of.take(order).astype(np.int64)

    def ranges(self, trees: list, nodes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest value per (open node, feature); ``nodes[i]`` are those of tree i."""
        rows_of = self._rows
        total = sum(map(len, nodes))

        def part(seen, block):
            x = block[0]
            low, high = seen if seen is not None else (np.full((total, x.shape[1]), np.inf), np.full((total, x.shape[1]), -np.inf))
            first, by_feature = 0, np.ascontiguousarray(x.T)
            for tree, mine in zip(trees, nodes):
                order, of = rows_of(x, tree, mine)
                if len(order):
                    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                    here, values = first + of[starts], by_feature.take(order, 1)
                    low[here] = np.minimum(low[here], np.minimum.reduceat(values, starts, 1).T)
                    high[here] = np.maximum(high[here], np.maximum.reduceat(values, starts, 1).T)
                first += len(mine)
            return low, high

        def both(a, b):
            return b if a is None else a if b is None else (np.minimum(a[0], b[0]), np.maximum(a[1], b[1]))

        return self.blocks.treeAggregate(None, part, both)

    def left_sums(self, trees: list, nodes: list[np.ndarray], features: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Label sums (open node, drawn cut, sum) of the rows at or below each drawn cut."""
        rows_of, slots_of, outputs = self._rows, self._slots, self.outputs
        shape = (*features.shape, outputs or 3)

        def counted(total, block):
            x, y = block
            total = np.zeros(shape) if total is None else total
            of_class, first, values = label_sums(y, outputs), 0, x.ravel()
            known, label = of_class.any(1), of_class.argmax(1)
            for tree, mine in zip(trees, nodes):
                of = slots_of(x, tree, mine)
                rows = np.flatnonzero((of >= 0) & known)
                here = of.take(rows).astype(np.int64)
                cell, row, last = here * outputs + label.take(rows), rows * x.shape[1], first + len(mine)
                for c in range(shape[1]):
                    low = values.take(features[first:last, c].take(here) + row) <= cuts[first:last, c].take(here)
                    total[first:last, c] += np.bincount(cell[low], minlength=len(mine) * outputs).reshape(-1, outputs)
                first = last
            return total

        def part(total, block):
            x, y = block
            total = np.zeros(shape) if total is None else total
            sums, first = label_sums(y, outputs), 0
            for tree, mine in zip(trees, nodes):
                order, of = rows_of(x, tree, mine)
                if len(order):
                    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                    here, values = first + of, sums[order]
                    for c in range(shape[1]):
                        low = x[order, features[here, c]] <= cuts[here, c]
                        total[first + of[starts], c] += np.add.reduceat(values * low[:, None], starts)
                first += len(mine)
            return total

        # where all features are drawn their sums are made in the features' order, from columns
        whole = features.max() < shape[1]
        by_feature = np.take_along_axis(cuts, np.argsort(features, 1), 1) if whole else cuts

        def added(total, block):
            x, y = block
            total = np.zeros(shape) if total is None else total
            values, first, weights = x.T.copy() if whole else x.ravel(), 0, label_sums(y, outputs).T[1:]
            for tree, mine in zip(trees, nodes):
                of, last = slots_of(x, tree, mine), first + len(mine)
                rows = np.flatnonzero(of >= 0)
                here, mine_weights, row = of.take(rows).astype(np.int64), [w.take(rows) for w in weights], rows * x.shape[1]
                for c in range(shape[1]):
                    seen = values[c].take(rows) if whole else values.take(features[first:last, c].take(here) + row)
                    low = np.flatnonzero(seen <= by_feature[first:last, c].take(here))
                    cell = here.take(low)
                    total[first:last, c, 0] += np.bincount(cell, minlength=len(mine))
                    for k, w in enumerate(mine_weights, 1):
                        total[first:last, c, k] += np.bincount(cell, w.take(low), len(mine))
                first = last
            return total

        def both(a, b):
            return b if a is None else a if b is None else a + b

        if outputs or self.rows <= SORTED_ROWS:
            return self.blocks.treeAggregate(None, counted if outputs else part, both)
        found = self.blocks.treeAggregate(None, added, both)
        return np.take_along_axis(found, features[:, :, None], 1) if whole else found


def _counts(sums: np.ndarray, outputs: int) -> np.ndarray:
    return sums.sum(-1) if outputs else sums[..., 0]


def _purity(sums: np.ndarray, outputs: int) -> np.ndarray:
    """Rows times the part of the impurity that a split changes: larger is purer."""
    n = np.maximum(_counts(sums, outputs), 1e-300)
    return ((sums ** 2).sum(-1) if outputs else sums[..., 1] ** 2) / n


def mixed_labels(total: np.ndarray, outputs: int) -> bool:
    """Whether a node's labels differ."""
    if outputs:
        return bool((total > 0).sum() > 1)
    n, s, q = total
    return bool(q - s * s / n > 1e-9 * max(q, 1e-300))


def drawn_cuts(rng, low: np.ndarray, high: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, cuts, usable) of each node: ``count`` features in random order, the constant ones
    last, and a uniform cut in [least, largest) for each; constant features are not usable."""
    order = np.where(low < high, rng.random(low.shape), 2.0)
    features = np.argsort(order, 1, kind="stable")[:, :count]
    at = np.arange(len(low))[:, None]
    a, b = low[at, features], high[at, features]
    cuts = a + rng.random(features.shape) * (b - a)
    return features, np.where(cuts < b, cuts, a), a < b


def grow(data, total: np.ndarray, width: int, p: dict) -> list[CutTree]:
    """All trees.  ``data`` gives ``ranges`` and ``left_sums`` of open nodes and wraps what its
    jobs are started from on other threads (``on_thread``); ``total`` is the label sum of all rows."""
    outputs, least = data.outputs, p["minInstancesPerNode"]
    count = {"sqrt": int(np.sqrt(width)), "log2": int(np.log2(max(width, 2))), "all": width}[p["featureSubsetStrategy"]]
    count = max(1, count)
    trees = [CutTree(total) for _ in range(p["numTrees"])]
    open_ = [(t, 0) for t in range(len(trees))] if mixed_labels(total, outputs) else []
    per_job = max(1, JOB_CELLS // max(2 * width, count * (outputs or 3)))

    def choose(depth, at):
        """(feature, cut, label sums left of it) for the open nodes from ``at``; None for a leaf."""
        part = open_[at:at + per_job]
        which = sorted({t for t, _ in part})
        nodes, arrays = _by_tree(part, which), [trees[t].arrays() for t in which]
        low, high = data.ranges(arrays, nodes)
        features, cuts, usable = drawn_cuts(np.random.default_rng([p["seed"], depth, at]), low, high, count)
        left = data.left_sums(arrays, nodes, features, cuts)
        right = np.stack([trees[t].total[n] for t, n in part])[:, None] - left
        ok = usable & (np.minimum(_counts(left, outputs), _counts(right, outputs)) >= least)
        score = np.where(ok, _purity(left, outputs) + _purity(right, outputs), -np.inf)
        best = score.argmax(1)
        return [(int(features[i, c]), float(cuts[i, c]), left[i, c]) if score[i, c] > -np.inf else None
                for i, c in enumerate(best)]

    with ThreadPoolExecutor(JOBS_AT_ONCE) as pool:
        for depth in range(p["maxDepth"]):
            starts = range(0, len(open_), per_job)
            chosen = list(pool.map(data.on_thread(choose), [depth] * len(starts), starts))
            children = []
            for (t, node), split in zip(open_, itertools.chain.from_iterable(chosen)):
                for child in trees[t].split(node, *split) if split else ():
                    sums = trees[t].total[child]
                    if _counts(sums, outputs) >= 2 * least and mixed_labels(sums, outputs):
                        children.append((t, child))
            open_ = sorted(children)
            if not open_:
                break
    return trees


def _by_tree(part: list[tuple[int, int]], which: list[int]) -> list[np.ndarray]:
    found: dict[int, list[int]] = {t: [] for t in which}
    for t, n in part:
        found[t].append(n)
    return [np.array(found[t]) for t in which]


def leaf_values(tree: CutTree, outputs: int) -> list:
    """Class shares, or the mean, of each node."""
    sums = np.stack(tree.total)
    if outputs:
        return (sums / sums.sum(1, keepdims=True)).tolist()
    return (sums[:, 1:2] / sums[:, :1]).tolist()


class ExtraTrees(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator of the module's trees; ``task`` classification (labels 0..K-1) or regression."""

    def __init__(self, **params):
        super().__init__()
        self._defaults()
        self._set(**params)

    def _fit(self, dataset: DataFrame) -> "ExtraTreesModel":
        p = {q.name: self.getOrDefault(q) for q in self.params if self.isDefined(q)}
        rows, found = training_rows(dataset, p["featuresCol"], p["labelCol"])
        outputs = int(found["top"]) + 1 if p["task"] == "classification" else 0
        blocks = stored_blocks(rows, found["width"], found["n"])
        total = blocks.map(lambda b: label_sums(b[1], outputs).sum(0)).treeReduce(lambda a, b: a + b)
        trees = grow(_Blocks(blocks, outputs, inheritable_thread_target(dataset.sparkSession), found["n"]), total, found["width"], p)
        state = [{"feature": t.feature, "cut": t.cut, "left": t.left, "value": leaf_values(t, outputs)} for t in trees]
        return self._copyValues(ExtraTreesModel(json.dumps(state)))


class ExtraTreesModel(Model, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees; adds ``prediction`` and, for classification, ``probability`` in one pass."""

    state = Param(Params._dummy(), "state", "the trees as JSON", TypeConverters.toString)

    def __init__(self, state: str = ""):
        super().__init__()
        self._defaults()
        if state:
            self._set(state=state)

    def trees(self) -> list[dict]:
        return json.loads(self.getOrDefault("state"))

    @staticmethod
    def unpacked(state: str) -> list:
        """((feature, cut, left), values) of each tree."""
        return [((np.array(t["feature"]), np.array(t["cut"]), np.array(t["left"])), np.array(t["value"]))
                for t in json.loads(state)]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        features, prediction, probability = (self.getOrDefault(c) for c in ("featuresCol", "predictionCol", "probabilityCol"))
        held = dataset.sparkSession.sparkContext.broadcast(self.getOrDefault("state"))
        unpacked = self.unpacked

        @F.pandas_udf("array<double>")
        def score(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
            trees = unpacked(held.value)
            for column in columns:
                known = column.notna().to_numpy()
                out = np.empty(len(column), object)
                if known.any():
                    x = np.stack(column[known].to_numpy()).astype(float)
                    mean = sum(value[places(tree, x)] for tree, value in trees) / len(trees)
                    out[np.flatnonzero(known)] = list(mean)
                yield pd.Series(out)

        scored = dataset.withColumn("__scores", score(as_array(dataset, features)))
        if self.getOrDefault("task") == "regression":
            return scored.withColumn(prediction, F.col("__scores")[0]).drop("__scores")
        top = F.array_position("__scores", F.array_max("__scores")) - 1
        known = F.col("__scores").isNotNull()
        vector = array_to_vector(F.coalesce("__scores", F.array(F.lit(0.0))))
        return (scored.withColumn(prediction, top.cast("double"))
                .withColumn(probability, F.when(known, vector)).drop("__scores"))
