"""Packing of token sequences: first-fit decreasing within randomised groups of documents.

A hash of ``doc_id`` and ids deals the documents into groups of about ``group_docs``.  In each group a
document gives whole sequences of ``seq_len`` ids and one rest; the rests go, longest first,
into the first bin with room, found in a tournament tree of the bins' free places.  Documents
may be cut freely, so the emptiest bins are then taken apart to fill the places left in the
others: a group leaves at most one sequence unfilled.

A group is closed early at ``4 * group_docs`` documents or ``GROUP_IDS`` ids, so a task holds
a bounded part even if one id repeats without end; the rest of the key is a further group.

Results: null and empty texts are the end id alone; repeated rows are packed each; a null
``doc_id`` is kept; other columns are ignored; an empty table gives no pieces; a very long text
is cut into whole sequences and a rest, and closes its group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import encoded, word_ids

GROUP_IDS = 32 << 20
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class FreePlaces:
    """Tournament tree over bins: each node holds the most free places below it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.most = [room] * (2 * self.leaves)

    def first(self, need: int) -> int:
        """The first bin with ``need`` places; they are taken."""
        most, at = self.most, 1
        while at < self.leaves:
            at *= 2
            if most[at] < need:
                at += 1
        found = at - self.leaves
        most[at] -= need
        while at > 1:
            at //= 2
            most[at] = max(most[2 * at], most[2 * at + 1])
        return found


def first_fit_decreasing(sizes: list[int], room: int) -> list[list[int]]:
    """Positions of the sizes in each bin; longest first, ties in the given order."""
    tree = FreePlaces(max(1, len(sizes)), room)
    bins: list[list[int]] = []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = tree.first(sizes[k])
        if at == len(bins):
            bins.append([])
        bins[at].append(k)
    return bins


def pack_group(lengths: list[int], seq_len: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length)."""
    full = [[(d, at, seq_len)] for d, n in enumerate(lengths) for at in range(0, n - seq_len + 1, seq_len)]
    rests = [(d, n - n % seq_len, n % seq_len) for d, n in enumerate(lengths) if n % seq_len]
    bins = [[rests[k] for k in b] for b in first_fit_decreasing([r[2] for r in rests], seq_len)]
    bins.sort(key=lambda b: -sum(p[2] for p in b))
    into, out = 0, len(bins) - 1
    room = seq_len - sum(p[2] for p in bins[0]) if bins else 0
    while into < out:
        if not room:
            into += 1
            room = seq_len - sum(p[2] for p in bins[into])
            continue
        d, start, n = bins[out].pop()
        take = min(n, room)
        bins[into].append((d, start, take))
        room -= take
        if take < n:
            bins[out].append((d, start + take, n - take))
        elif not bins[out]:
            bins.pop()
            out -= 1
    return full + bins


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, seq_len: int = 2048,
                   group_docs: int = 2048, seed: int = 29) -> DataFrame:
    """Pieces of documents (``ids``: little-endian unsigned 32-bit) and their sequences."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    groups = max(1, math.ceil(rows.count() / group_docs))

    def encode(batches):
        for part, arrays in encoded(batches, tokenizer, end_id):
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([a.tobytes() for a in arrays], pa.binary())], ["doc_id", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = None
        key, held, size, sequence = None, [], 0, 0

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            arrays = [np.frombuffer(ids, width) for _, ids in held]
            out, count = [], 0
            for pieces in pack_group([len(a) for a in arrays], seq_len):
                offset = 0
                for d, start, n in pieces:
                    out.append((held[d][0], start, n, arrays[d][start:start + n].astype("<u4").tobytes(),
                                len(arrays[d]), (key << 32) + sequence, offset))
                    offset += n
                    count += n
                sequence += 1
                if count >= 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
                    out, count = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)

        names = [c.split()[0] for c in PIECES.split(", ")]
        for batch in batches:
            width = width or word_ids(tokenizer).width
            for grp, doc_id, ids in zip(*(batch.column(c).to_pylist() for c in ("grp", "doc_id", "ids"))):
                if held and (grp != key or len(held) >= 4 * group_docs or size >= GROUP_IDS):
                    yield from closed()
                    held, size = [], 0
                if grp != key:
                    key, sequence = grp, 0
                held.append((doc_id, ids))
                size += len(ids) // width.itemsize
        if held:
            yield from closed()

    tokens = rows.mapInArrow(encode, "doc_id long, ids binary")
    dealt = tokens.withColumn("grp", F.pmod(F.xxhash64("doc_id", "ids", F.lit(seed)), F.lit(groups)))
    return (dealt.repartition("grp").sortWithinPartitions("grp", "doc_id", F.xxhash64("ids"))
            .mapInArrow(_typed(pack), PIECES))


def _typed(pack):
    """Batches with the declared types, also where a column of a batch is all null."""
    schema = pa.schema([(n, pa.binary() if t == "binary" else pa.int64()) for n, t in
                        (c.split() for c in PIECES.split(", "))])

    def run(batches):
        for out in pack(batches):
            yield out.cast(schema)
    return run
