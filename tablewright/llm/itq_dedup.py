"""Embedding near-duplicates: iterative quantisation codes, multi-index tables, exact rerank.

A rotation of the principal axes is learnt on a bounded sample so that the signs of the
rotated vectors give balanced 64-bit codes.  Equal vectors are one node.  Codes meet in four
tables of 16 bits with look-ups within one bit; pairs within ``code_distance`` bits bring
their vectors to the bucket, where exact cosines decide.  A pair is counted only in the first
segment in which it meets, so link counts need no list of pairs, and each bucket returns the
links of a spanning forest.

Results: one row per input row.  Vectors that are null, zero, hold null or non-finite
components, or have another length than most link with nothing: 0 links, component their own
id.  Equal vectors link with each other; a repeated row counts as another vector; rows with a
null ``vec_id`` are returned with null component and are no one's link; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .components import connected_components
from .hamming import BITS, GROUP, buckets, distances, forest, per_bucket
from .text import bounded_sample

SEGMENTS, RADIUS = 4, 1


def learn_rotation(sample: np.ndarray, rounds: int = 50, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(centre, projection to 64 signs) of unit vectors: principal axes, turned round by round
    to the rotation that best meets its own signs.  Shorter vectors get random further axes.
    The centre is the mean where the vectors spread round it; a mean longer than 0.5 is left
    in, for taking it out would widen the angles between near vectors and lose links."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    mean = sample.mean(0)
    mean = mean * (np.linalg.norm(mean) <= 0.5)
    axes = np.linalg.eigh((sample - mean).T @ (sample - mean))[1][:, ::-1][:, :BITS]
    turn = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))[0]
    flat = (sample - mean) @ axes
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(flat.T @ np.where(flat @ turn >= 0, 1.0, -1.0))
        turn = u @ vt
    return mean, np.hstack([axes @ turn, rng.normal(size=(dim, BITS - axes.shape[1]))])


def _units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.95, code_distance: int = 14,
                         sample: int = 4096) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row."""
    checkpoint_dir(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vec"))
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec").isNotNull() & whole & F.exists("vec", lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False)) & F.col("vec_id").isNotNull()
    common = rows.where(usable).groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dim = common["n"] if common else 0
    usable = usable & (F.size("vec") == dim)
    nodes = (rows.where(usable).groupBy("vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
             .checkpoint())
    drawn = bounded_sample(nodes.select("id", "vec"), sample, "id").sort("id").collect()
    if len(drawn) < 2:
        links = nodes.select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("root"))
    else:
        links = _near(nodes, learn_rotation(_units(np.array([r.vec for r in drawn]))), threshold, code_distance)
    links = links.checkpoint()
    counts = links.groupBy("id").agg(F.sum("n").alias("n"))
    members = connected_components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    labelled = (nodes.join(counts, "id", "left").join(members, "id", "left")
                .select("vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                        F.coalesce("component_id", "id").alias("component_id")))
    linked = rows.where(usable).join(labelled, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _near(nodes: DataFrame, rotation: tuple[np.ndarray, np.ndarray], threshold: float, code_distance: int) -> DataFrame:
    """(id, n, root) rows: links counted in one bucket, and a smaller id it connects to."""
    mean, turn = rotation

    def encode(batches):
        for batch in batches:
            unit = _units(np.array(batch.column("vec").to_pylist()))
            signs = np.packbits((unit - mean) @ turn >= 0, axis=1, bitorder="little").view("<i8").ravel()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("copies"), pa.array(signs),
                 pa.array([u.tobytes() for u in unit], pa.binary())], ["id", "copies", "code", "unit"])

    def meet(group):
        right = group["role"] == 1
        left = ~right
        near = distances(group["code"][left], group["code"][right]) <= code_distance
        near &= group["id"][left][:, None] != group["id"][right][None, :]
        keep = np.concatenate([near.any(1), near.any(0)])
        if not keep.any():
            return None
        return {k: group[k][keep] for k in (*GROUP, "role", "id")}

    def rerank(group):
        right = group["role"] == 1
        left = ~right
        unit = group["unit"].view(np.float64)
        a, b = group["id"][left], group["id"][right]
        linked = (unit[left] @ unit[right].T >= threshold) & (a[:, None] != b[None, :])
        apart = group["code"][left].view(np.uint64)[:, None] ^ group["code"][right].view(np.uint64)[None, :]
        width = BITS // SEGMENTS
        for j in range(group["seg"][0]):     # pairs that an earlier segment has counted
            part = (apart >> np.uint64(j * width)) & np.uint64((1 << width) - 1)
            linked &= np.bitwise_count(part) > RADIUS
        if not linked.any():
            return None
        n = linked @ group["copies"][right]
        some = n > 0
        ids, roots = forest(linked, a, b)
        return {"id": np.concatenate([a[some], ids]), "n": np.concatenate([n[some], np.zeros(len(ids), np.int64)]),
                "root": np.concatenate([a[some], roots])}

    coded = nodes.mapInArrow(encode, "id long, copies long, code long, unit binary").checkpoint()
    keys = ", ".join(f"{k} {t}" for k, t in zip(GROUP, ("int", "long", "int", "int")))
    met = per_bucket(buckets(coded.select("id", "code"), SEGMENTS, RADIUS), meet, f"{keys}, role int, id long")
    return per_bucket(met.join(coded, "id"), rerank, "id long, n long, root long")
