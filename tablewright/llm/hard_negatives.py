"""Hard-negative mining with spanning-tree bounds on inner products.

The anchors of a block and the zero vector are joined by a minimum spanning tree.  For a
candidate c, the score of an anchor differs from that of its parent in the tree by at most
|anchor - parent| * |c|, so from the zero vector (score 0) on, every anchor gets a lower and an
upper bound from its parent's score, or from its parent's bounds where that was not computed.
Only candidates whose bounds overlap the anchor's window of scores are scored again, exactly.

1. Positives: the window of an anchor begins at the k-th best score its task has seen.
2. Negatives: a positive's window is [low %, high %] of its score; it begins higher once the
   task has seen enough entries in it.  The anchor's window spans those of its positives.

Anchors are worked in blocks of about ``block``, dealt by a hash; a block, its tree and its
positives are all that is broadcast or collected.  A task keeps at most the wanted number of
entries for an anchor or a pair, and these alone are shuffled.  The vectors are written once, in
the form in which they are scored; every block reads them twice.

Results: rows with a null id, label or vector, with null or non-finite components, or of another
length than most take no part.  Equal scores rank by smaller id.  A row with the anchor's id is
not its positive; of repeated anchors the row first by (label, vector) counts, repeated
candidates count each.  Negative positive scores have an empty window; fewer rows than wanted
give fewer; an empty table, or one without anchors, gives no rows; other columns are ignored.
Scores are exact; if length * (largest component)^2 passes the long range there is a ValueError.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

ROWS = 4096         # candidates worked at once
NONE = np.iinfo(np.int64).min


class AnchorTree:
    """Minimum spanning tree over the rows of ``points`` and the zero vector, as the order in
    which to visit them (a parent before its children, depth first)."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.points = points
        self.parent = np.full(n, -1)
        self.edge = np.sqrt((points * points).sum(1))       # to the zero vector, so far
        near, open_ = self.edge.copy(), np.ones(n, bool)
        for _ in range(n):
            at = int(np.argmin(np.where(open_, near, np.inf)))
            open_[at] = False
            apart = points - points[at]
            far = np.sqrt(np.einsum("ij,ij->i", apart, apart))
            closer = open_ & (far < near)
            near[closer], self.edge[closer], self.parent[closer] = far[closer], far[closer], at
        children: list[list[int]] = [[] for _ in range(n + 1)]
        for i, p in enumerate(self.parent):
            children[p].append(i)                            # -1: the last list, of the zero vector
        self.children = np.array([len(c) for c in children[:n]])
        self.order, stack = [], children[n][::-1]
        while stack:
            self.order.append(stack.pop())
            stack += children[self.order[-1]][::-1]


class Scorer:
    """Bounds and exact scores of a batch of candidates against all anchors of a tree."""

    def __init__(self, tree: AnchorTree, wide: bool):
        self.tree, self.wide = tree, wide
        self.exact = tree.points.astype(np.int64) if wide else tree.points
        self.scored = 0     # exact products made

    def overlaps(self, part: np.ndarray, window, wanted=None):
        """(anchor, places in ``part``, exact scores) of the candidates whose bounds overlap
        ``window(anchor)`` = (low, high) - None: an empty one - and for which ``wanted(anchor)`` holds."""
        size = np.sqrt(np.einsum("ij,ij->i", part, part))
        whole = part.astype(np.int64) if self.wide else part
        zero = np.zeros(len(part))
        bounds = {-1: (zero, zero)}
        left = self.tree.children.copy()
        for a in self.tree.order:
            p = int(self.tree.parent[a])
            # the reach is rounded up: sums of squares and products lose a little
            reach = self.tree.edge[a] * size * (1 + 1e-9) + 1e-3
            low, high = bounds[p][0] - reach, bounds[p][1] + reach
            if p >= 0:
                left[p] -= 1
                if not left[p]:
                    del bounds[p]
            ask = window(a)
            if ask:
                # doubles may round a wide score or limit
                slack = 1.0 + max(abs(ask[0]), abs(ask[1])) * 1e-12 if self.wide else 0.0
                mask = (high >= ask[0] - slack) & (low <= ask[1] + slack)
                if wanted is not None:
                    mask &= wanted(a)
                at = np.flatnonzero(mask)
                if len(at):
                    scores = whole[at] @ self.exact[a] if 2 * len(at) < len(part) else (whole @ self.exact[a])[at]
                    self.scored += len(at)
                    near = scores.astype(np.float64)
                    gap = np.abs(near) * 1e-12 if self.wide else 0.0
                    low[at], high[at] = near - gap, near + gap
                    yield a, at, scores.astype(np.int64)
            if left[a]:
                bounds[a] = (low, high)


class Best:
    """The k highest scores of each slot, ties to smaller ids."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.scores = [np.zeros(0, np.int64)] * slots
        self.ids = [np.zeros(0, np.int64)] * slots

    def limit(self, slot: int) -> int | None:
        """The score an entry needs to be among the best, None while there are fewer than k."""
        return int(self.scores[slot][-1]) if len(self.scores[slot]) == self.k else None

    def add(self, slot: int, scores: np.ndarray, ids: np.ndarray) -> None:
        limit = self.limit(slot)
        if limit is not None:
            keep = scores >= limit
            scores, ids = scores[keep], ids[keep]
        if len(scores):
            scores, ids = np.concatenate([self.scores[slot], scores]), np.concatenate([self.ids[slot], ids])
            order = np.lexsort((ids, -scores))[:self.k]
            self.scores[slot], self.ids[slot] = scores[order], ids[order]

    def rows(self, names: list[str], batch: int = 4096):
        for at in range(0, len(self.scores), batch):
            part = range(at, min(at + batch, len(self.scores)))
            sizes = [len(self.scores[s]) for s in part]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.array(part, np.int64), sizes)), pa.array(np.concatenate([self.ids[s] for s in part])),
                    pa.array(np.concatenate([self.scores[s] for s in part]))], names)


def _parts(batches, dim):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield (part.column("vec_id").to_numpy(zero_copy_only=False), part.column("label").to_numpy(zero_copy_only=False),
                   part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def positives_of(scorer: Scorer, ids, labels, parts, k: int) -> Best:
    """The k best candidates of each anchor's label among the batches of a task."""
    best = Best(len(ids), k)

    def window(a):
        limit = best.limit(a)
        return (-math.inf if limit is None else limit), math.inf

    for names, marks, part in parts:
        for a, at, scores in scorer.overlaps(part, window, lambda a: (marks == labels[a]) & (names != ids[a])):
            best.add(a, scores, names[at])
    return best


def negatives_of(scorer: Scorer, labels, parts, pairs: list[list[tuple[int, int, int]]], slots: int, k: int) -> Best:
    """The k best candidates of another label in the window of each pair.  ``pairs`` has for each
    anchor the (slot, low, high) of its positives."""
    best = Best(slots, k)

    def lowest(slot, low):
        limit = best.limit(slot)
        return low if limit is None else max(low, limit)

    def window(a):
        if pairs[a]:
            return min(lowest(s, low) for s, low, _ in pairs[a]), max(high for _, _, high in pairs[a])

    for names, marks, part in parts:
        for a, at, scores in scorer.overlaps(part, window, lambda a: marks != labels[a]):
            for slot, low, high in pairs[a]:
                inside = (scores >= lowest(slot, low)) & (scores <= high)
                if inside.any():
                    best.add(slot, scores[inside], names[at[inside]])
    return best


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine_hard_negatives(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 10,
                        low: int = 30, high: int = 90, block: int = 4096) -> DataFrame:
    """For each anchor (rows of ``vectors`` that fulfil ``is_anchor``) and each of its best
    ``positives`` of the same label, the best ``negatives`` of other labels that score from
    ``low`` to ``high`` percent of the positive.  ``vectors`` has vec_id, label and vec
    (array<double> of whole numbers)."""
    spark = vectors.sparkSession
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & whole)
    path = scratch_path(spark, "hard-negatives")
    (vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "vec").where(F.coalesce(valid, F.lit(False)))
     .write.parquet(f"{path}/rows"))
    rows = spark.read.parquet(f"{path}/rows")
    facts = (rows.groupBy(F.size("vec").alias("dim")).agg(
        F.count("*").alias("n"), F.count_if(is_anchor).alias("anchors"),
        F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))).alias("top"))
        .orderBy(F.desc("n"), F.desc("dim")).first())
    dim, count = (facts["dim"], facts["anchors"]) if facts else (0, 0)
    if not dim or not count:
        return spark.createDataFrame([], OUT)
    most = dim * int(facts["top"]) ** 2
    if most >= 2 ** 63:
        raise ValueError("components are too large for scores within the long range")
    rows = rows.where(F.size("vec") == dim)
    blocks = math.ceil(count / block)
    one = Window.partitionBy("vec_id").orderBy("label", "vec")
    anchors = (rows.where(is_anchor).withColumn("r", F.row_number().over(one)).where("r = 1")
               .withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))))
    for b in range(blocks):
        mine = anchors.where(F.col("b") == b).select("vec_id", "label", "vec").sort("vec_id").collect()
        if mine:
            _block(rows, mine, dim, most >= 2 ** 53, positives, negatives, low, high).write.mode("append").parquet(f"{path}/found")
    return spark.read.parquet(f"{path}/found")


def _first(entries: DataFrame, slot: str, k: int) -> DataFrame:
    """The k best entries of each slot over all tasks, with their rank."""
    order = Window.partitionBy(slot).orderBy(F.desc("score"), "vec_id")
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(rows: DataFrame, mine: list, dim: int, wide: bool, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = rows.sparkSession
    ids = np.array([r.vec_id for r in mine], np.int64)
    labels = np.array([r.label for r in mine], np.int64)
    sent = spark.sparkContext.broadcast((ids, labels, AnchorTree(np.array([r.vec for r in mine], np.float64).reshape(len(mine), dim))))
    ddl = "slot long, vec_id long, score long"
    names = [c.split()[0] for c in ddl.split(", ")]

    def gather(batches):
        ids, labels, tree = sent.value
        yield from positives_of(Scorer(tree, wide), ids, labels, _parts(batches, dim), positives).rows(names)

    found = _first(rows.mapInArrow(gather, ddl), "slot", positives).select("slot", "vec_id", "score", "rank").collect()
    pairs: list[list[tuple[int, int, int]]] = [[] for _ in mine]
    wanted = []     # (slot, anchor, positive, score) of the pairs that have a window
    for r in sorted(found, key=lambda r: (r.slot, r.rank)):
        at_least, at_most = -(-low * r.score // 100), high * r.score // 100
        if at_least <= at_most:
            pairs[r.slot].append((len(wanted), at_least, at_most))
            wanted.append((len(wanted), int(ids[r.slot]), r.vec_id, r.score))
    windows = spark.sparkContext.broadcast((pairs, len(wanted)))

    def mine_batches(batches):
        _, labels, tree = sent.value
        pairs, slots = windows.value
        yield from negatives_of(Scorer(tree, wide), labels, _parts(batches, dim), pairs, slots, negatives).rows(names)

    pair = spark.createDataFrame(wanted, "slot long, anchor_id long, positive_id long, positive_score long")
    best = _first(rows.mapInArrow(mine_batches, ddl), "slot", negatives)
    # the pairs of a block: at most block * positives rows
    return best.join(F.broadcast(pair), "slot").select(
        "anchor_id", "positive_id", F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
