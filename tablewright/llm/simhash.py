"""SimHash near-duplicates: fingerprints of word shingles, linked through multi-index hashing.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of ``words`` words with
repeats (a shorter text: its whole word sequence; no word: fingerprint zero), each hashed by
XXH64 (UTF-8, seed 42); a bit is set if it is set in over half the hashes.

Links: equal fingerprints are one node, so copies cost one row each.  Distinct fingerprints
link at ``max_distance`` or fewer differing bits: two segments of 32 bits, look-ups within
``max_distance // 2`` bits of each, complete distances verified in every bucket; whatever the
distance, one of the two segments must lie that near, so no link is lost.

Results: null text is an empty text; fingerprint zero links like any other; a null ``doc_id``
gets a fingerprint and its component but links nothing by itself (null component if nothing
else has its fingerprint); repeated rows are repeated; other columns are ignored; an empty
table gives an empty result; a very long text is a slice of its own.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .components import connected_components
from .hamming import BITS, buckets, distances, forest, per_bucket
from .text import add_columns

SEGMENTS = 2


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Signed 64-bit fingerprint of one text."""
    import xxhash
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    size = min(words, len(found))
    shingles = map(b" ".join, zip(*(found[i:] for i in range(size))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(found) - size + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """The documents with ``code``, the fingerprint as a signed long."""
    def run(texts):
        return [pa.array([fingerprint(t.as_py(), words, seed) for t in texts], pa.int64())]

    return add_columns(docs, "code long", run)


def near_codes(codes: DataFrame, max_distance: int = 3) -> DataFrame:
    """Links (a, b) that span the components of distinct (id, code) rows."""
    def work(group):
        right = group["role"] == 1
        linked = distances(group["code"][~right], group["code"][right]) <= max_distance
        a, b = forest(linked, group["id"][~right], group["id"][right])
        return {"a": a, "b": b} if len(a) else None

    return per_bucket(buckets(codes, SEGMENTS, max_distance // SEGMENTS), work, "a long, b long")


def simhash_duplicates(docs: DataFrame, words: int = 3, max_distance: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest doc_id
    reachable) of every document."""
    checkpoint_dir(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    marked = fingerprints(rows, words, seed).select("doc_id", "code").checkpoint()
    nodes = marked.groupBy("code").agg(F.min("doc_id").alias("id"))
    members = connected_components(near_codes(nodes.where("id IS NOT NULL"), max_distance))
    labelled = nodes.join(members, "id", "left").select("code", F.coalesce("component_id", "id").alias("component_id"))
    return marked.join(labelled, "code").select(
        "doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")
