"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features: lower-case words, pairs of neighbours and pairs with one word between, hashed to
``1 << BITS`` buckets, present or absent.  Each coordinate has its own rate; the L1 term
keeps most weights at zero, so the model sent with the scoring task holds the non-zero
weights only (at most ``1 << BITS``).

Model: fitted on at most about ``sample`` labelled documents, half of either class, chosen by
a hash (a documented bound); Spark hashes their words, the driver gets their bucket numbers and runs the sequential fit.

Results: null and empty texts score as the bias says; without labels every score is 0;
repeated rows repeat; other columns (a null ``doc_id`` too) are kept, one named ``score`` is
replaced; an empty table gives an empty one; a very long text is a slice of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import add_columns, bounded_sample, slices, split_words

BITS = 20


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word, neighbour pair and skip pair, repeats included."""
    import xxhash
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    counts, words, order = split_words(pc.replace_substring_regex(low, r"[^\p{L}\p{N}']+", " "))
    each = np.fromiter((xxhash.xxh64_intdigest(w.encode()) if w else 0 for w in words), np.uint64, len(words))[order]
    row = np.repeat(np.arange(len(counts)), counts)
    row, each = row[each != 0], each[each != 0]
    rows, keys = [row], [each]
    for gap, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = row[gap:] == row[:-gap]
        rows.append(row[gap:][same])
        keys.append((each[:-gap][same] * np.uint64(factor)) ^ each[gap:][same])
    mixed = np.concatenate(keys) * np.uint64(0xD6E8FEB86659FD93)
    return np.concatenate(rows), (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def ftrl(rows: list[np.ndarray], labels: list[int], epochs: int = 15, alpha: float = 1.0, beta: float = 1.0,
         l1: float = 5.0, l2: float = 0.0, seed: int = 1) -> tuple[np.ndarray, float]:
    """(weights, bias) after ``epochs`` passes over sparse rows of bucket numbers."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(at):
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    bias, bias_n = 0.0, 0.0
    for epoch in range(epochs):
        for k in np.random.default_rng(seed + epoch).permutation(len(rows)):
            at = rows[k]
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - labels[k]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
            bias_n += g * g
            bias -= alpha * g / (beta + np.sqrt(bias_n))
    return weights(np.arange(1 << BITS)), bias


def learn(labelled: DataFrame, sample: int = 6000) -> dict | None:
    """Model from (doc_id, text, label) rows; rows with a null label teach nothing.  Half of the
    sample comes from either class, so a rare class is seen as often as the other."""
    rows = labelled.where("label IN (0, 1)").select("doc_id", "text", F.col("label").cast("int").alias("label"))
    drawn = [bounded_sample(rows.where(F.col("label") == k), sample // 2, "doc_id") for k in (0, 1)]

    def hashed(batches):
        for part in slices(batches):
            row, bucket = features(part.column("text"))
            pair = np.unique((row << BITS) | bucket)
            cut = np.searchsorted(pair, np.arange(1, part.num_rows) << BITS)
            packed = [p.astype("<u4").tobytes() for p in np.split(pair & ((1 << BITS) - 1), cut)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(packed, pa.binary())],
                                             ["doc_id", "label", "at"])

    taught = drawn[0].unionByName(drawn[1]).mapInArrow(hashed, "doc_id long, label int, at binary").collect()
    taught.sort(key=lambda r: (r.doc_id is None, r.doc_id, r.label, r.at))
    if not taught:
        return None
    weights, bias = ftrl([np.frombuffer(r.at, "<u4") for r in taught], [r.label for r in taught])
    at = np.flatnonzero(weights)
    return {"at": at.astype(np.int32), "weights": weights[at].astype(np.float32), "bias": float(bias)}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """The documents with ``score`` (0 to 1, higher: more likely toxic) of their whole texts."""
    if model is None:
        return docs.withColumn("score", F.lit(0.0))

    def run(texts):
        weights = np.zeros(1 << BITS)
        weights[model["at"]] = model["weights"]
        row, bucket = features(texts)
        known = weights[bucket] != 0
        pair = np.unique((row[known] << BITS) | bucket[known])
        total = model["bias"] + np.bincount(pair >> BITS, weights[pair & ((1 << BITS) - 1)], len(texts))
        return [pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))]

    return add_columns(docs, "score double", run)
