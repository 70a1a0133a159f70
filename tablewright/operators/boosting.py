"""Histogram gradient boosting: several classes in one model, one aggregate a level (MOD3).

Features are binned once by approximate quantiles.  A round grows one tree for each class (one
tree for two classes or a regression) from the gradients and hessians of the loss - softmax,
logistic or squared error.  All trees of a round grow together: a level needs one Spark job that
sums (gradient, hessian, rows) per (class, node, feature, bin) as a numpy histogram in each task.
Of two sibling nodes only the one with fewer rows is summed, the other is what is left of their
parent; nodes that cannot be split are not summed.  The driver sees sums only - their size is
classes * nodes * features * bins whatever the number of rows - and chooses the splits.  The last
level needs no job: its leaf values follow from the sums of the level before.

Rows stay where they are: each task reads its blocks of binned rows (one byte a feature) and
derives node places from the trees sent with the job, so nothing is shuffled but histograms.
Partitions are as many as the task slots, or a multiple of that, so that the histograms summed do
not grow with the rows.  Raw scores are kept with the blocks: the first job of a round adds the
trees of the one before, and every ``STORE_ROUNDS`` rounds the blocks are checkpointed; a lost
executor's tasks start from there.  The loop is one of jobs over blocks of numbers, hence RDD
functions: a DataFrame plan for each of a thousand levels costs more than the level.

The regularisation is that of the second-order objective: ``reg_lambda`` (L2) and ``reg_alpha``
(L1) on leaf values, ``min_child_weight`` on hessian sums and ``min_rows`` on row counts; each
tree sees a hash-drawn share of the rows (``subsample``) and of the features
(``colsample``).  ``num_leaves`` bounds the leaves of a tree: the splits of a level with the
largest gains are taken until it is reached.

Results: rows whose label or features are null are left out of the fit; non-finite features are
an error of the caller (the preparation makes them finite); a constant label gives a model that
predicts it; an empty frame is a ValueError.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir

MAX_BINS = 255          # a bin is one byte
HISTOGRAM_CELLS = 1 << 20   # of one job; more nodes than fit are summed by further jobs
KEPT_CELLS = 1 << 22        # of parents' histograms that the driver keeps for a level
PACK_ROWS = 1 << 14         # most binned rows in one stored block
PARTITION_BYTES = 1 << 20   # least binned rows of a task
MOST_BYTES = 64 << 20       # most binned rows of a task, which reads them block by block
FLAT_CELLS = 1 << 23        # partial sums that the driver adds without a stage between
STORE_ROUNDS = 20
MIX = 0x9E3779B97F4A7C15


class _Settings(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol):
    """Parameters that estimator and model share."""

    task = Param(Params._dummy(), "task", "classification or regression", TypeConverters.toString)
    maxIter = Param(Params._dummy(), "maxIter", "rounds", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits of a tree", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "share of a tree's leaf values that is added", TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature, at most 255", TypeConverters.toInt)
    regLambda = Param(Params._dummy(), "regLambda", "L2 penalty on leaf values", TypeConverters.toFloat)
    regAlpha = Param(Params._dummy(), "regAlpha", "L1 penalty on leaf values", TypeConverters.toFloat)
    minChildWeight = Param(Params._dummy(), "minChildWeight", "least hessian sum of a child", TypeConverters.toFloat)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least rows of a child", TypeConverters.toInt)
    numLeaves = Param(Params._dummy(), "numLeaves", "most leaves of a tree, 0: as the depth allows", TypeConverters.toInt)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of the rows a round sees", TypeConverters.toFloat)
    colsample = Param(Params._dummy(), "colsample", "share of the features a tree sees", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of rows and features drawn", TypeConverters.toInt)

    def _defaults(self) -> None:
        self._setDefault(task="classification", maxIter=200, maxDepth=6, stepSize=0.1, maxBins=64, regLambda=1.0,
                         regAlpha=0.0, minChildWeight=1e-3, minInstancesPerNode=1, numLeaves=0, subsamplingRate=1.0,
                         colsample=1.0, seed=42, predictionCol="prediction", probabilityCol="probability")


def bin_edges(rows: DataFrame, width: int, bins: int, accuracy: float = 1e-3) -> list[np.ndarray]:
    """Ascending inner edges of each feature (a value belongs to the number of edges below it),
    from approximate quantiles of all rows.  A feature with few values gets an edge for each."""
    probabilities = [k / bins for k in range(1, bins)]
    at = F.percentile_approx(F.col("x"), F.array(*map(F.lit, probabilities)), F.lit(int(1 / accuracy)))
    got = (rows.select(F.posexplode("features").alias("j", "x")).groupBy("j").agg(at.alias("q")).collect())
    edges = [np.zeros(0)] * width
    for r in got:
        edges[r["j"]] = np.unique(np.array(r["q"], float))
    return edges


def _binned(features: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(features.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, features[:, j], side="left")
    return out


def _blocks(rows: DataFrame, edges: list[np.ndarray], base: np.ndarray, count: int):
    """RDD of blocks (bins, labels, keys, raw scores), checkpointed."""
    width = len(edges)
    parts = partitions(count * (width + 16), rows.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACK_ROWS):
                part = batch.slice(at, PACK_ROWS)
                x = part.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v.tobytes()], pa.binary()) for v in (
                        _binned(x, edges), part.column("label").to_numpy(zero_copy_only=False).astype(np.float64),
                        part.column("key").to_numpy(zero_copy_only=False).astype(np.int64))], ["bins", "label", "key"])

    def block(row):
        bins = np.frombuffer(row.bins, np.uint8).reshape(-1, width)
        return bins, np.frombuffer(row.label), np.frombuffer(row.key, np.int64), np.repeat(base[None, :], len(bins), 0)

    packed = rows.mapInArrow(run, "bins binary, label binary, key binary").coalesce(parts)
    return _stored(packed.rdd.map(block))


def partitions(size: int, slots: int) -> int:
    """Partitions of ``size`` bytes: one for each task slot where that gives each enough to do,
    then as many times the slots as keep them below ``MOST_BYTES``."""
    return max(1, min(size // PARTITION_BYTES, slots * -(-size // (slots * MOST_BYTES))))


def _stored(blocks):
    # kept while it is written: a checkpoint by itself makes the rows a second time
    blocks.persist(StorageLevel.MEMORY_AND_DISK)
    blocks.checkpoint()
    blocks.count()
    return blocks


class Tree:
    """Splits and leaf values as arrays; children of node i are ``left[i]`` and ``left[i] + 1``."""

    def __init__(self):
        self.feature, self.bin, self.left, self.value = [-1], [0], [0], [0.0]

    def split(self, node: int, feature: int, bin_: int) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.bin[node], self.left[node] = feature, bin_, at
        self.feature += [-1, -1]
        self.bin += [0, 0]
        self.left += [0, 0]
        self.value += [0.0, 0.0]
        return at, at + 1

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The node each binned row ends in."""
        at = np.zeros(len(bins), np.intp)
        # a leaf leads to itself, so that all rows take every level alike
        feature, cut, left, level = list(self.feature), list(self.bin), list(self.left), [0] * len(self.feature)
        for node, f in enumerate(self.feature):
            if f < 0:
                feature[node], cut[node], left[node] = 0, MAX_BINS, node
            else:
                level[left[node]] = level[left[node] + 1] = level[node] + 1
        feature, cut, left = np.array(feature, np.intp), np.array(cut, np.uint8), np.array(left, np.intp)
        flat, first = np.ascontiguousarray(bins).ravel(), np.arange(len(bins), dtype=np.intp) * bins.shape[1]
        for _ in range(max(level)):
            at = left[at] + (flat[first + feature[at]] > cut[at])
        return at

    def as_dict(self) -> dict:
        return {"feature": self.feature, "bin": self.bin, "left": self.left, "value": self.value}

    @staticmethod
    def of(d: dict) -> "Tree":
        tree = Tree()
        tree.feature, tree.bin, tree.left, tree.value = d["feature"], d["bin"], d["left"], d["value"]
        return tree


def add_rounds(raw: np.ndarray, bins: np.ndarray, trees: list[list[Tree]], step: float) -> np.ndarray:
    """Raw scores (rows x outputs) with the rounds' trees added."""
    out = raw.copy()
    for round_ in trees:
        for k, tree in enumerate(round_):
            out[:, k] += step * np.array(tree.value)[tree.places(bins)]
    return out


def probabilities(raw: np.ndarray) -> np.ndarray:
    """Class probabilities of raw scores: logistic for one output, softmax for several."""
    if raw.shape[1] == 1:
        p = 1 / (1 + np.exp(-raw))
        return np.concatenate([1 - p, p], 1)
    # a column after the other: numpy takes many times as long along a short last axis
    columns = np.ascontiguousarray(raw.T)
    e = np.exp(columns - functools.reduce(np.maximum, columns))
    return (e / functools.reduce(np.add, e)).T


def gradients(raw: np.ndarray, label: np.ndarray, task: str) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by the raw scores (rows x outputs)."""
    if task == "regression":
        return raw - label[:, None], np.ones_like(raw)
    p = probabilities(raw)
    if raw.shape[1] == 1:
        return p[:, 1:] - label[:, None], p[:, 1:] * p[:, :1]
    return (p.T - (label == np.arange(raw.shape[1])[:, None])).T, p * (1 - p)


def drawn(keys: np.ndarray, seed: int, round_: int, share: float) -> np.ndarray:
    """Which rows a round sees: a hash of row, seed and round is below the share."""
    if share >= 1:
        return np.ones(len(keys), bool)
    mixed = (keys.astype(np.uint64) ^ np.uint64((seed * 1_000_003 + round_) * MIX % 2 ** 64)) * np.uint64(MIX)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(11)) < np.uint64(share * 2 ** 53)


def leaf_value(g: float, h: float, p: dict) -> float:
    """The value that minimises the second-order objective of a leaf."""
    return float(-np.sign(g) * max(abs(g) - p["regAlpha"], 0.0) / (h + p["regLambda"] + 1e-12))


def _score(g, h, reg_lambda, reg_alpha):
    return np.maximum(np.abs(g) - reg_alpha, 0) ** 2 / (h + reg_lambda + 1e-12)


def best_split(sums: np.ndarray, usable: np.ndarray, p: dict) -> tuple[float, int, int] | None:
    """(gain, feature, last bin that goes left) of a node's histogram (features x bins x
    (gradient, hessian, rows)), the first of equal gains; None: no split gains anything."""
    left = np.cumsum(sums, 1)[:, :-1]
    total = sums.sum(1, keepdims=True)
    right = total - left
    gain = (_score(left[..., 0], left[..., 1], p["regLambda"], p["regAlpha"])
            + _score(right[..., 0], right[..., 1], p["regLambda"], p["regAlpha"])
            - _score(total[..., 0], total[..., 1], p["regLambda"], p["regAlpha"]))
    ok = usable[:, None] & (np.minimum(left[..., 1], right[..., 1]) >= p["minChildWeight"]) \
        & (np.minimum(left[..., 2], right[..., 2]) >= p["minInstancesPerNode"])
    gain = np.where(ok, gain, -np.inf)
    if not gain.size or gain.max() <= 1e-9:
        return None
    feature, cut = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return float(gain[feature, cut]), int(feature), int(cut)


def histograms(bins, g, h, used, places, nodes: list[tuple[int, int]], n_bins: int) -> np.ndarray:
    """(node, feature, bin, (gradient, hessian, rows)) of the open ``nodes`` = (output, node); ``h`` is
    None where all hessians are one."""
    width = bins.shape[1]
    out = np.zeros((len(nodes), width, n_bins, 3))
    by_feature = np.ascontiguousarray(bins.T)
    for k in {k for k, _ in nodes}:
        mine = [i for i, (output, _) in enumerate(nodes) if output == k]
        slot = np.full(max(places[k].max(initial=0), max(nodes[i][1] for i in mine)) + 1, -1)
        slot[[nodes[i][1] for i in mine]] = np.arange(len(mine))
        of = slot[places[k]]
        rows = np.flatnonzero(used & (of >= 0))
        start, seen = of[rows] * n_bins, by_feature[:, rows]
        weights = [g[:, k].take(rows), None if h is None else h[:, k].take(rows)]
        for j in range(width):
            cell = start + seen[j]
            out[mine, j, :, 2] = np.bincount(cell, minlength=len(mine) * n_bins).reshape(-1, n_bins)
            for c, weight in enumerate(weights):
                out[mine, j, :, c] = (out[mine, j, :, 2] if weight is None else
                                      np.bincount(cell, weight, len(mine) * n_bins).reshape(-1, n_bins))
    return out


class _Data:
    """The blocks of a fit, and the sums over them."""

    def __init__(self, blocks, width: int, n_bins: int):
        self.blocks, self.width, self.n_bins, self.stored, self.before = blocks, width, n_bins, 0, None

    def sums(self, trees, growing, nodes, p: dict) -> np.ndarray:
        """Histograms of the open nodes of the growing trees over all rows, in one job."""
        n_bins, first, shape = self.n_bins, self.stored, (len(nodes), self.width, self.n_bins, 3)
        later = trees[first:]       # a few trees: they go with the function

        def part(blocks):
            total = None
            for bins, label, key, raw in blocks:
                g, h = gradients(add_rounds(raw, bins, later, p["stepSize"]), label, p["task"])
                used = drawn(key, p["seed"], first + len(later), p["subsamplingRate"])
                # a tree's rows are placed only where one of its nodes is asked for
                places = [t.places(bins) if k in asked else None for k, t in enumerate(growing)]
                found = histograms(bins, g, None if p["task"] == "regression" else h, used, places, nodes, n_bins)
                if total is None:
                    total = found
                else:
                    total += found
            return [total]

        def both(a, b):
            return b if a is None else a if b is None else a + b

        asked = {k for k, _ in nodes}
        parts = self.blocks.getNumPartitions()
        total = self.blocks.mapPartitions(part).treeReduce(both, 1 if parts * np.prod(shape) <= FLAT_CELLS else 2)
        if self.before is not None:     # its successor has been made by this job
            self.before.unpersist()
            self.before = None
        return np.zeros(shape) if total is None else total

    def store(self, trees, p: dict) -> None:
        """Keep the raw scores after the rounds so far with the blocks, from the next job on."""
        later, step = trees[self.stored:], p["stepSize"]
        if self.before is not None:     # never read: the round before had no job
            self.blocks.count()
            self.before.unpersist()
        self.before = self.blocks
        self.blocks = self.blocks.map(lambda b: (*b[:3], add_rounds(b[3], b[0], later, step)))
        self.blocks.persist(StorageLevel.MEMORY_AND_DISK)
        if len(trees) % STORE_ROUNDS == 0:
            self.blocks.checkpoint()
        self.stored = len(trees)

    def close(self) -> None:
        for kept in (self.before, self.blocks):
            if kept is not None:
                kept.unpersist()


def rest_of(parent: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The histogram of a node's other child; cells without rows are exactly zero, so that cuts
    between the same rows have the same gain."""
    out = parent - child
    out[out[..., 2] < 0.5] = 0.0
    return out


def grow(data, outputs: int, p: dict) -> list[list[Tree]]:
    """All rounds.  ``data.sums`` gives the histograms of open nodes."""
    rng = np.random.default_rng(p["seed"])
    trees: list[list[Tree]] = []
    cells = data.width * data.n_bins * 3
    per_job = max(1, HISTOGRAM_CELLS // cells)
    # a node below these has no split with both children above the bounds
    least_h, least_rows = 2 * p["minChildWeight"] * (1 - 1e-9), 2 * p["minInstancesPerNode"]
    for _ in range(p["maxIter"]):
        growing = [Tree() for _ in range(outputs)]
        usable = [_columns(rng, data.width, p["colsample"]) for _ in range(outputs)]
        leaves = [1] * outputs
        # nodes to sum; with each, its sibling and their parent's histogram where the sibling follows from them
        asked: list[tuple[int, int, int | None, np.ndarray | None]] = [(k, 0, None, None) for k in range(outputs)]
        for depth in range(p["maxDepth"]):
            found: list[tuple[float, int, int, int, int, np.ndarray, np.ndarray | None]] = []
            room = KEPT_CELLS if depth + 1 < p["maxDepth"] else 0
            for at in range(0, len(asked), per_job):
                mine = asked[at:at + per_job]
                for (k, node, other, parent), sums in zip(mine, data.sums(trees, growing, [a[:2] for a in mine], p)):
                    if not depth:
                        growing[k].value[node] = leaf_value(*sums[0].sum(0)[:2], p)
                    for n, of in [(node, sums)] + ([] if other is None else [(other, rest_of(parent, sums))]):
                        if split := best_split(of, usable[k], p):
                            room -= cells
                            # a copy: a view would keep the whole job's sums
                            kept = of.copy() if room >= 0 else None
                            found.append((split[0], k, n, split[1], split[2], of[split[1]].copy(), kept))
            asked = []
            for gain, k, node, feature, cut, line, kept in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
                if not p["numLeaves"] or leaves[k] < p["numLeaves"]:
                    leaves[k] += 1
                    ends = line[:cut + 1].sum(0), line[cut + 1:].sum(0)
                    children = growing[k].split(node, feature, cut)
                    for child, (g, h, _) in zip(children, ends):
                        growing[k].value[child] = leaf_value(g, h, p)
                    open_ = [c for c, (_, h, n) in zip(children, ends) if h >= least_h and n >= least_rows]
                    small = children[int(ends[1][2] < ends[0][2])]
                    if len(open_) == 2 and kept is not None:
                        asked.append((k, small, sum(children) - small, kept))
                    else:
                        asked += [(k, c, None, None) for c in open_]
            if not asked:
                break
            asked.sort(key=lambda a: a[:2])
        trees.append(growing)
        if len(trees) < p["maxIter"]:
            data.store(trees, p)
    return trees


def _columns(rng, width: int, share: float) -> np.ndarray:
    usable = np.ones(width, bool)
    if share < 1:
        usable[rng.permutation(width)[max(1, round(share * width)):]] = False
    return usable


class GradientBoosting(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator of the module's boosting; ``task`` classification (labels 0..K-1) or regression."""

    def __init__(self, **params):
        super().__init__()
        self._defaults()
        self._set(**params)

    def settings(self) -> dict:
        return {p.name: self.getOrDefault(p) for p in self.params if self.isDefined(p)}

    def _fit(self, dataset: DataFrame) -> "GradientBoostingModel":
        spark, p = dataset.sparkSession, self.settings()
        checkpoint_dir(spark)
        values = F.col(p["featuresCol"])
        if isinstance(dataset.schema[p["featuresCol"]].dataType, VectorUDT):
            values = vector_to_array(values)
        rows = (dataset.select(values.alias("features"), F.col(p["labelCol"]).cast("double").alias("label"))
                .where("features IS NOT NULL AND label IS NOT NULL")
                .withColumn("key", F.xxhash64("features", "label")))
        counts = rows.groupBy().agg(F.count("*").alias("n"), F.max(F.size("features")).alias("width"),
                                    F.max("label").alias("top"), F.avg("label").alias("mean")).first()
        if not counts["n"]:
            raise ValueError("no rows to learn from")
        bins = min(p["maxBins"], MAX_BINS)
        edges = bin_edges(rows, counts["width"], bins)
        if p["task"] == "regression":
            outputs, base = 1, np.array([counts["mean"]])
        else:
            outputs = int(counts["top"]) + 1 if counts["top"] > 1 else 1
            base = np.zeros(outputs)
        blocks = _blocks(rows, edges, base, counts["n"])
        data = _Data(blocks, counts["width"], bins)
        try:
            trees = grow(data, outputs, p)
        finally:
            data.close()
        state = {"edges": [e.tolist() for e in edges], "base": base.tolist(),
                 "trees": [[t.as_dict() for t in round_] for round_ in trees]}
        model = GradientBoostingModel(json.dumps(state))
        return self._copyValues(model)


class GradientBoostingModel(Model, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees; adds ``prediction`` and, for classification, ``probability`` in one pass."""

    state = Param(Params._dummy(), "state", "edges, base scores and trees as JSON", TypeConverters.toString)

    def __init__(self, state: str = ""):
        super().__init__()
        self._defaults()
        if state:
            self._set(state=state)

    def trees(self) -> list[list[Tree]]:
        return [[Tree.of(t) for t in round_] for round_ in json.loads(self.getOrDefault("state"))["trees"]]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        features, prediction, probability = (self.getOrDefault(c) for c in ("featuresCol", "predictionCol", "probabilityCol"))
        task, step, state = self.getOrDefault("task"), self.getOrDefault("stepSize"), self.getOrDefault("state")
        vector = isinstance(dataset.schema[features].dataType, VectorUDT)
        held = dataset.sparkSession.sparkContext.broadcast(state)

        @F.pandas_udf("array<double>")
        def score(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
            fitted = json.loads(held.value)
            edges, base = [np.array(e) for e in fitted["edges"]], np.array(fitted["base"])
            trees = [[Tree.of(t) for t in round_] for round_ in fitted["trees"]]
            for column in columns:
                known = column.notna().to_numpy()
                out = np.empty(len(column), object)
                if known.any():
                    x = np.stack(column[known].to_numpy()).astype(float)
                    raw = add_rounds(np.repeat(base[None, :], len(x), 0), _binned(x, edges), trees, step)
                    scores = raw if task == "regression" else probabilities(raw)
                    out[np.flatnonzero(known)] = list(scores)
                yield pd.Series(out)

        values = vector_to_array(F.col(features)) if vector else F.col(features)
        scored = dataset.withColumn("__scores", score(values))
        if task == "regression":
            return scored.withColumn(prediction, F.col("__scores")[0]).drop("__scores")
        top = F.array_position("__scores", F.array_max("__scores")) - 1
        return (scored.withColumn(prediction, top.cast("double"))
                .withColumn(probability, F.when(F.col("__scores").isNotNull(), array_to_vector(F.coalesce("__scores", F.array(F.lit(0.0))))))
                .drop("__scores"))
