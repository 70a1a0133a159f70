"""Random forest by histograms, grown level by level over binned rows (MOD1).

Every tree draws its rows with replacement (a seeded Poisson weight for each row, as MLlib's bagging) and
at each node ``featureSubsetStrategy`` of the features; of the bins of these the cut that lowers the Gini
impurity most is taken.  A node stays a leaf when it is pure, as deep as ``maxDepth``, no cut
lowers the impurity or a side would have fewer than ``minInstancesPerNode`` drawn rows; two leaves
of one parent that predict the same class are one leaf, as in MLlib.

A regression sums drawn rows and labels over the bins of all features; the cut that lowers the squared
error most is taken, of the drawn features where not all are, and a prediction is the mean of the leaf means.

Features are binned once (``MAX_BINS``: one byte) by approximate quantiles.  All trees grow
together.  A level takes one job for each ``JOB_CELLS`` numbers: a task sums the drawn rows per (node,
drawn feature, bin, class) of its blocks, one tree after the other, the sums are shuffled by tree, and where
they meet the cut of each node is chosen, so that only cuts reach the driver.  Places and weights
follow from the trees and the seed: nothing is kept for a row and a tree.  Partitions are as many
as the task slots, or a multiple of that, so that the sums shuffled do not grow with the rows.

Results: a class probability is the mean of the trees' leaf shares.  Rows with null features get a
null prediction; those with a null label or features teach nothing; an empty frame is a ValueError;
a constant label gives trees of one leaf, a tree that draws no row has no vote.  Reruns on the same partitions agree.
"""

from __future__ import annotations

import base64
import io
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import partitions
from .random_trees import ExtraTreesModel, _Settings
from .row_blocks import stored, training_rows

MAX_BINS = 32           # as MLlib's forests
JOB_CELLS = 1 << 24     # numbers summed by one job
CUT_CELLS = 1 << 18     # numbers that cuts are chosen from at a time
BLOCK_ROWS = 1 << 18    # most binned rows of a block
CACHED_ROWS = 1 << 14   # rows placed at a time, so that their numbers stay in a core's cache
QUANTILES = 256         # read of a feature; as many values or fewer than bins get an edge each
DRAWS = 1 << 16         # Poisson weights are drawn to this resolution


@cache
def poisson_weights() -> np.ndarray:
    """Weights 0, 1, 2, ... in the shares of a Poisson distribution of mean 1, ``DRAWS`` of them."""
    below, term, out, k = 0.0, math.exp(-1), np.zeros(DRAWS, np.uint8), 0
    while round(below * DRAWS) < DRAWS and k < 20:
        out[round(below * DRAWS):] = k
        below, k = below + term, k + 1
        term /= k
    return out


def row_weights(seed: int, tree: int, block: tuple[int, int], rows: int) -> np.ndarray:
    """How often a tree draws each row of a block."""
    return poisson_weights().take(np.random.default_rng([seed, tree, *block]).integers(DRAWS, size=rows, dtype=np.uint16))


def bin_edges(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Ascending inner edges of each feature, fewer than ``MAX_BINS``: all values read where they are
    few, else quantiles.  A value belongs to the number of edges below it."""
    at = F.percentile_approx("x", F.array(*[F.lit(k / QUANTILES) for k in range(QUANTILES)]), F.lit(10 * QUANTILES))
    edges = [np.zeros(0)] * width
    for r in rows.select(F.posexplode("features").alias("j", "x")).groupBy("j").agg(at.alias("q")).collect():
        read = np.array(r["q"], float)
        values, step = np.unique(read), QUANTILES // MAX_BINS
        edges[r["j"]] = values if len(values) < MAX_BINS else np.unique(read[step::step])
    return edges


def binned_blocks(rows: DataFrame, edges: list[np.ndarray], count: int, classes: int):
    """RDD of blocks (bin * classes + class of rows and features, classes of rows), checkpointed."""
    width, kind = len(edges), np.min_scalar_type(MAX_BINS * classes)
    parts = partitions(count * (width + 4), rows.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            y = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int32)
            bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (bins, y)], ["bins", "label"])

    def joined(packs):
        held, size = [], 0
        for pack in packs:
            label = np.frombuffer(pack.label, np.int32)
            held.append(((np.frombuffer(pack.bins, np.uint8).reshape(-1, width) * classes + label[:, None]).astype(kind), label))
            size += len(label)
            if size >= BLOCK_ROWS:
                yield tuple(np.concatenate(v) for v in zip(*held))
                held, size = [], 0
        if held:
            yield tuple(np.concatenate(v) for v in zip(*held))

    return stored(rows.mapInArrow(run, "bins binary, label binary").coalesce(parts).rdd.mapPartitions(joined))


class HistogramTree:
    """Nodes as arrays: rows in bins up to ``bin`` of ``feature`` go to ``left``, others to ``left + 1``;
    ``-1`` is the feature of a leaf; ``total`` has the drawn rows of each class."""

    def __init__(self, total: np.ndarray):
        self.feature, self.bin, self.left = np.full(1, -1, np.int32), np.zeros(1, np.uint8), np.zeros(1, np.int32)
        self.total = total[None, :]

    def split(self, nodes: np.ndarray, feature, bin_, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        """Splits nodes; their children, two of each in order."""
        first = len(self.feature)
        self.feature[nodes], self.bin[nodes], self.left[nodes] = feature, bin_, first + 2 * np.arange(len(nodes))
        more = 2 * len(nodes)
        self.feature = np.r_[self.feature, np.full(more, -1, np.int32)]
        self.bin = np.r_[self.bin, np.zeros(more, np.uint8)]
        self.left = np.r_[self.left, np.zeros(more, np.int32)]
        self.total = np.concatenate([self.total, np.stack([lower, upper], 1).reshape(more, self.total.shape[1])])
        return np.arange(first, first + more)

    def arrays(self):
        return self.feature, self.bin, self.left

    def pruned(self) -> "HistogramTree":
        """Leaves of one parent that predict the same class as one leaf, from the last level up."""
        tree, best = HistogramTree(self.total[0]), self.total.argmax(1)
        feature = self.feature.copy()
        for node in np.flatnonzero(feature >= 0)[::-1]:
            a = self.left[node]
            if feature[a] < 0 and feature[a + 1] < 0 and best[a] == best[a + 1]:
                feature[node] = -1
        level, old = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(level):
            inner = feature[old] >= 0
            level, old = level[inner], old[inner]
            a = self.left[old]
            level = tree.split(level, feature[old], self.bin[old], self.total[a], self.total[a + 1])
            old = np.stack([a, a + 1], 1).ravel()
        return tree


def drawn_features(seed: int, tree: int, level: int, first: int, nodes: int, width: int, count: int) -> np.ndarray:
    """``count`` different features of each of a tree's open nodes from the ``first``."""
    return np.argsort(np.random.default_rng([seed, tree, level, first]).random((nodes, width)), 1)[:, :count]


def best_cuts(sums: np.ndarray, features: np.ndarray, least: int):
    """(feature, bin, class sums up to it, class sums above) of each node for the sums (node, drawn
    feature, bin, class); -1 is the feature of a node that stays a leaf."""
    lower = sums.cumsum(2, dtype=np.int64).astype(float)
    total = lower[:, :, -1:, :]
    lower = lower[:, :, :-1]
    upper = total - lower

    def purity(x):
        return (x * x).sum(-1) / np.maximum(x.sum(-1), 1.0)

    enough = np.minimum(lower.sum(-1), upper.sum(-1)) >= max(1, least)
    gain = np.where(enough, purity(lower) + purity(upper) - purity(total), 0.0).reshape(len(sums), -1)
    best, node = gain.argmax(1), np.arange(len(sums))
    drawn, bin_ = np.divmod(best, lower.shape[2])
    # a gain within rounding of none is none
    split = gain[node, best] > 1e-12 * total[:, 0, 0].sum(-1)
    return np.where(split, features[node, drawn], -1), bin_, lower[node, drawn, bin_], upper[node, drawn, bin_]


class ForestFit:
    """The loop over levels; ``blocks`` are those of ``binned_blocks``."""

    def __init__(self, blocks, count: int, width: int, classes: int, p: dict):
        self.blocks, self.width, self.classes, self.p = blocks, width, classes, p
        drawn = {"sqrt": math.ceil(math.sqrt(width)), "log2": math.ceil(math.log2(max(width, 2))),
                 "all": width}[p["featureSubsetStrategy"]]
        self.drawn = max(1, drawn)
        # sums of drawn rows are near those of the rows
        self.kind = np.int32 if 4 * count < 1 << 31 else np.int64

    def totals(self) -> np.ndarray:
        """Drawn rows of each class, of each tree; in the last row those of all rows."""
        trees, classes, seed = self.p["numTrees"], self.classes, self.p["seed"]

        def part(index, blocks):
            total = np.zeros((trees + 1, classes))
            for i, (_, y) in enumerate(blocks):
                total[trees] += np.bincount(y, minlength=classes)
                for t in range(trees):
                    total[t] += np.bincount(y, row_weights(seed, t, (index, i), len(y)), classes)
            yield total

        return self.blocks.mapPartitionsWithIndex(part).reduce(lambda a, b: a + b)

    def cuts(self, level: int, trees: dict, asked: list[tuple[int, int, np.ndarray]]) -> list:
        """``best_cuts`` of each (tree, first, nodes): the tree's open nodes from the ``first``."""
        width, classes, drawn, kind, p = self.width, self.classes, self.drawn, self.kind, self.p
        sent = self.blocks.context.broadcast(({t: trees[t].arrays() for t, _, _ in asked}, asked))

        def features(t, first, nodes):
            return drawn_features(p["seed"], t, level, first, len(nodes), width, drawn)

        def part(index, blocks):
            blocks, (arrays, wanted) = list(blocks), sent.value
            for key, (t, first, nodes) in enumerate(wanted):
                # rows in no open node are summed in a node after the last
                mine = np.concatenate([features(t, first, nodes), np.zeros((1, drawn), np.int64)])
                tree, of = _walk(arrays[t], classes, blocks), np.full(len(arrays[t][0]), len(nodes))
                of[nodes] = np.arange(len(nodes))
                total = np.zeros((drawn, len(mine) * MAX_BINS * classes))
                for i, (x, y) in enumerate(blocks):
                    weight, values = row_weights(p["seed"], t, (index, i), len(y)), x.ravel()
                    rows = np.flatnonzero(weight)
                    cells = np.empty((drawn, len(rows)), np.int64)
                    for at in range(0, len(rows), CACHED_ROWS):
                        row = rows[at:at + CACHED_ROWS] * width
                        slot = of.take(_places(tree, values, row, level))
                        cell = slot * (MAX_BINS * classes)
                        for c in range(drawn):
                            cells[c, at:at + CACHED_ROWS] = cell + values.take(mine[:, c].take(slot) + row)
                    weight = weight.take(rows).astype(float)
                    for c in range(drawn):
                        total[c] += np.bincount(cells[c], weight, total.shape[1])
                total = total[:, :len(nodes) * MAX_BINS * classes]
                yield key, total.astype(kind)

        def chosen(item):
            key, total = item
            t, first, nodes = sent.value[1][key]
            sums, mine = total.reshape(drawn, len(nodes), MAX_BINS, classes).swapaxes(0, 1), features(t, first, nodes)
            some = max(1, CUT_CELLS * len(nodes) // total.size)
            cuts = [best_cuts(sums[at:at + some], mine[at:at + some], p["minInstancesPerNode"])
                    for at in range(0, len(nodes), some)]
            return key, tuple(np.concatenate(c) for c in zip(*cuts))

        parts = min(len(asked), self.blocks.context.defaultParallelism)
        found = dict(self.blocks.mapPartitionsWithIndex(part).reduceByKey(np.add, parts).map(chosen).collect())
        sent.destroy()
        return [found[key] for key in range(len(asked))]

    def jobs(self, open_: dict[int, np.ndarray]) -> Iterator[list[tuple[int, int, np.ndarray]]]:
        """The open nodes of a level in jobs of at most ``JOB_CELLS`` numbers (or one node)."""
        return self._jobs(open_, max(1, JOB_CELLS // (self.drawn * MAX_BINS * self.classes)))

    @staticmethod
    def _jobs(open_: dict[int, np.ndarray], most: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
        job, size = [], 0
        for t, nodes in open_.items():
            for first in range(0, len(nodes), most):
                some = nodes[first:first + most]
                if size + len(some) > most and job:
                    yield job
                    job, size = [], 0
                job.append((t, first, some))
                size += len(some)
        if job:
            yield job

    def run(self) -> list[HistogramTree]:
        *totals, all_rows = self.totals()
        trees = {t: HistogramTree(total) for t, total in enumerate(totals)}
        open_ = {t: np.zeros(1, np.int64) for t, tree in trees.items() if self.open(tree.total)[0]}
        for level in range(self.p["maxDepth"]):
            children: dict[int, list] = {}
            # jobs of a level read its trees as they were: a split of another node changes no row's node
            for asked in self.jobs(open_):
                for (t, _, nodes), (feature, bin_, lower, upper) in zip(asked, self.cuts(level, trees, asked)):
                    on = feature >= 0
                    made = trees[t].split(nodes[on], feature[on], bin_[on], lower[on], upper[on])
                    children.setdefault(t, []).append(made[self.open(trees[t].total[made])])
            open_ = {t: nodes for t, some in children.items() if len(nodes := np.concatenate(some))}
            if not open_:
                break
        # of very few rows a tree may draw none: it has no vote, as in MLlib
        return [self.grown(tree) for tree in trees.values() if tree.total[0].any()] or [HistogramTree(all_rows)]

    def open(self, totals: np.ndarray) -> np.ndarray:
        """Which nodes with these sums may be split."""
        return (totals > 0).sum(1) > 1

    def grown(self, tree: HistogramTree) -> HistogramTree:
        return tree.pruned()


def _walk(tree, classes: int, blocks: list):
    """A tree's (feature, cut, left) for the numbers of ``binned_blocks``; a leaf leads to itself."""
    feature, bin_, left = tree
    inner, kind = feature >= 0, blocks[0][0].dtype if blocks else np.uint8
    return (np.where(inner, feature, 0).astype(np.int64),
            np.where(inner, (bin_.astype(np.int64) + 1) * classes - 1, np.iinfo(kind).max).astype(kind),
            np.where(inner, left, np.arange(len(left))).astype(np.int64))


def _places(walk, values: np.ndarray, row: np.ndarray, level: int) -> np.ndarray:
    """The node, ``level`` splits down, of the rows that start at ``row`` in ``values``."""
    feature, cut, left = walk
    at = np.zeros(len(row), np.int64)
    for _ in range(level):
        at = left.take(at) + (values.take(feature.take(at) + row) > cut.take(at))
    return at


# ---- regression: sums of drawn rows and of their labels over all bins ----------------------------

def label_blocks(rows: DataFrame, edges: list[np.ndarray], found: dict):
    """RDD of blocks (features x rows: a feature's first bin plus the bin, standardised labels), checkpointed."""
    width, starts = len(edges), bin_starts(edges)
    kind, scale = np.min_scalar_type(int(starts[-1])), found["std"] or 1.0
    parts = partitions(found["n"] * (width * np.dtype(kind).itemsize + 8), rows.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            y = (batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64) - found["mean"]) / scale
            bins = np.stack([starts[j] + np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]).astype(kind)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (bins, y)], ["bins", "label"])

    def joined(packs):
        held, size = [], 0
        for pack in packs:
            label = np.frombuffer(pack.label)
            held.append((np.frombuffer(pack.bins, kind).reshape(width, -1), label))
            size += len(label)
            if size >= BLOCK_ROWS:
                yield tuple(np.concatenate(v, -1) for v in zip(*held))
                held, size = [], 0
        if held:
            yield tuple(np.concatenate(v, -1) for v in zip(*held))

    return stored(rows.mapInArrow(run, "bins binary, label binary").coalesce(parts).rdd.mapPartitions(joined))


def bin_starts(edges: list[np.ndarray]) -> np.ndarray:
    """The number of the first bin of each feature where those of all are counted on; last, all bins."""
    return np.cumsum([0, *(len(e) + 1 for e in edges)])


def best_mean_cuts(sums: np.ndarray, starts: np.ndarray, usable: np.ndarray, least: int):
    """(feature, bin, sums up to it, sums above) of each node for the sums ((rows, labels), node, bin) -
    the cut that lowers the squared error most; -1 is the feature of a node that stays a leaf."""
    node = np.arange(sums.shape[1])
    feature, bin_, below = np.full(len(node), -1), np.zeros(len(node), np.int64), np.zeros((len(node), 2))
    total = sums[:, :, :starts[1]].sum(2)
    n, s = np.maximum(total[0], 1.0), total[1]
    # a gain within rounding of none is none
    best = 1e-12 * (n + s * s / n)
    for c in range(usable.shape[1]):
        lower = sums[:, :, starts[c]:starts[c + 1]].cumsum(2)[:, :, :-1]
        if not lower.shape[2]:
            continue
        upper = total[:, :, None] - lower
        enough = np.minimum(lower[0], upper[0]) >= max(1, least)
        gain = (lower[1] ** 2 / np.maximum(lower[0], 1.0) + upper[1] ** 2 / np.maximum(upper[0], 1.0) - (s * s / n)[:, None])
        gain = np.where(enough & usable[:, c:c + 1], gain, 0.0)
        at = gain.argmax(1)
        on = gain[node, at] > best
        best, feature, bin_ = np.where(on, gain[node, at], best), np.where(on, c, feature), np.where(on, at, bin_)
        below[on] = lower[:, node[on], at[on]].T
    return feature, bin_, below, total.T - below


class RegressionFit(ForestFit):
    """The loop over ``label_blocks``; a node's total is (drawn rows, sum of their labels)."""

    def __init__(self, blocks, count: int, edges: list[np.ndarray], p: dict):
        super().__init__(blocks, count, len(edges), 2, p)
        self.starts = bin_starts(edges)

    def totals(self) -> np.ndarray:
        trees, seed = self.p["numTrees"], self.p["seed"]

        def part(index, blocks):
            total = np.zeros((trees + 1, 2))
            for i, (_, y) in enumerate(blocks):
                total[trees] += len(y), y.sum()
                for t in range(trees):
                    weight = row_weights(seed, t, (index, i), len(y)).astype(float)
                    total[t] += weight.sum(), weight @ y
            yield total

        return self.blocks.mapPartitionsWithIndex(part).reduce(lambda a, b: a + b)

    def open(self, totals: np.ndarray) -> np.ndarray:
        return totals[:, 0] >= 2 * max(1, self.p["minInstancesPerNode"])

    def grown(self, tree: HistogramTree) -> HistogramTree:
        return tree

    def jobs(self, open_: dict[int, np.ndarray]) -> Iterator[list[tuple[int, int, np.ndarray]]]:
        return self._jobs(open_, max(1, JOB_CELLS // (2 * int(self.starts[-1]))))

    def cuts(self, level: int, trees: dict, asked: list[tuple[int, int, np.ndarray]]) -> list:
        width, drawn, starts, p, bins = self.width, self.drawn, self.starts, self.p, int(self.starts[-1])
        sent = self.blocks.context.broadcast(({t: trees[t].arrays() for t, _, _ in asked}, asked))

        def part(index, blocks):
            blocks, (arrays, wanted) = list(blocks), sent.value
            for key, (t, _, nodes) in enumerate(wanted):
                feature, bin_, left = arrays[t]
                inner = feature >= 0
                cut = np.where(inner, starts.take(np.maximum(feature, 0)) + bin_, bins)     # a leaf leads to itself
                left = np.where(inner, left, np.arange(len(left))).astype(np.int64)
                # rows in no open node are summed in a node after the last
                of = np.full(len(feature), len(nodes))
                of[nodes] = np.arange(len(nodes))
                total = np.zeros((2, (len(nodes) + 1) * bins))
                for i, (x, y) in enumerate(blocks):
                    weight = row_weights(p["seed"], t, (index, i), len(y))
                    rows = np.flatnonzero(weight)
                    weight = weight.take(rows).astype(float)
                    label = weight * y.take(rows)
                    walk = np.where(inner, feature, 0).astype(np.int64) * len(y), cut, left
                    first, flat = np.empty(len(rows), np.int64), x.ravel()
                    for at in range(0, len(rows), CACHED_ROWS):
                        some = slice(at, at + CACHED_ROWS)
                        first[some] = of.take(_places(walk, flat, rows[some], level)) * bins
                    for c in range(width):
                        cell = first + x[c].take(rows)
                        total[0] += np.bincount(cell, weight, total.shape[1])
                        total[1] += np.bincount(cell, label, total.shape[1])
                yield key, total[:, :len(nodes) * bins]

        def chosen(item):
            key, total = item
            t, first, nodes = sent.value[1][key]
            sums, usable = total.reshape(2, len(nodes), bins), np.ones((len(nodes), width), bool)
            if drawn < width:
                usable[:] = False
                np.put_along_axis(usable, drawn_features(p["seed"], t, level, first, len(nodes), width, drawn), True, 1)
            some = max(1, CUT_CELLS // (2 * bins))
            cuts = [best_mean_cuts(sums[:, at:at + some], starts, usable[at:at + some], p["minInstancesPerNode"])
                    for at in range(0, len(nodes), some)]
            return key, tuple(np.concatenate(c) for c in zip(*cuts))

        parts = min(len(asked), self.blocks.context.defaultParallelism)
        found = dict(self.blocks.mapPartitionsWithIndex(part).reduceByKey(np.add, parts).map(chosen).collect())
        sent.destroy()
        return [found[key] for key in range(len(asked))]


class HistogramForest(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator of the module's trees; ``task`` classification (labels 0..K-1) or regression."""

    def __init__(self, **params):
        super().__init__()
        self._defaults()
        self._set(**params)

    def _fit(self, dataset: DataFrame) -> "HistogramForestModel":
        p = {q.name: self.getOrDefault(q) for q in self.params if self.isDefined(q)}
        rows, found = training_rows(dataset, p["featuresCol"], p["labelCol"])
        edges = bin_edges(rows, found["width"])
        if p["task"] == "regression":
            trees = RegressionFit(label_blocks(rows, edges, found), found["n"], edges, p).run()
            return self._copyValues(HistogramForestModel(packed(trees, edges, (found["mean"], found["std"] or 1.0))))
        classes = int(found["top"]) + 1
        blocks = binned_blocks(rows, edges, found["n"], classes)
        trees = ForestFit(blocks, found["n"], found["width"], classes, p).run()
        return self._copyValues(HistogramForestModel(packed(trees, edges)))


def packed(trees: list[HistogramTree], edges: list[np.ndarray], label: tuple[float, float] | None = None) -> str:
    """Trees and the edges of their features as text; of the leaves their class sums or, where the mean
    and scale of a regression's ``label`` are given, their means in one column."""
    out = io.BytesIO()

    def leaf(total):
        return total if label is None else label[0] + label[1] * total[:, 1:] / np.maximum(total[:, :1], 1.0)

    np.savez_compressed(
        out, **({} if label is None else {"label": np.array(label)}), nodes=[len(t.feature) for t in trees], edges=np.concatenate(edges), edge_counts=[len(e) for e in edges],
        feature=np.concatenate([t.feature for t in trees]), bin=np.concatenate([t.bin for t in trees]),
        left=np.concatenate([t.left for t in trees]), leaf=np.concatenate([leaf(t.total[t.feature < 0]) for t in trees]))
    return base64.b64encode(out.getvalue()).decode()


class HistogramForestModel(ExtraTreesModel):
    """Fitted trees, kept packed."""

    @staticmethod
    def unpacked(state: str) -> list:
        held = np.load(io.BytesIO(base64.b64decode(state)))
        first = np.cumsum(held["edge_counts"]) - held["edge_counts"]
        feature, inner = held["feature"], held["feature"] >= 0
        cut, value = np.zeros(len(feature)), np.zeros((len(feature), held["leaf"].shape[1]))
        cut[inner] = held["edges"][first[feature[inner]] + held["bin"][inner]]
        # one column: means of a regression, or the shares of a single class, which are one
        means = held["leaf"].shape[1] == 1 and "label" in held
        value[~inner] = held["leaf"] if means else held["leaf"] / held["leaf"].sum(1, keepdims=True)
        ends = np.cumsum(held["nodes"])[:-1]
        return [(tree[:3], tree[3]) for tree in zip(*(np.split(a, ends) for a in (feature, cut, held["left"], value)))]

    def trees(self) -> list[dict]:
        return [{"feature": f.tolist(), "cut": c.tolist(), "left": n.tolist(), "value": v.tolist()}
                for (f, c, n), v in self.unpacked(self.getOrDefault("state"))]
