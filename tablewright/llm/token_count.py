"""Token counts without identifiers: byte-pair merging with a heap and a linked list.

For SentencePiece BPE models with byte fallback and the identity normaliser.  A text becomes
its characters with white space marked; the adjacent pair whose union is the vocabulary piece
of lowest rank is merged first (leftmost on ties), again and again.  The count is the initial
symbols minus the merges; a character the vocabulary lacks counts as its UTF-8 bytes.

No piece holds a space mark after another character, a line feed beside anything, or a letter
before the closing marks in ``ends``, so no merge crosses such places (checked when the model
is loaded): texts are cut there, and each distinct chunk is merged once.

Results: null and empty texts have 0 bytes and 0 tokens; repeated rows give repeated results;
other columns (a null ``doc_id`` too) are kept, ones named
like the added are replaced; an empty table gives an empty result; a very long text is a slice
of its own.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .text import CACHE_BYTES, WORD_COST, add_columns, row_sums, split_words

MARK = "\u2581"


class MergeCounter:
    """Counts the tokens of chunks with the piece ranks of one model."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = model.SentencePiece
        spec, trained = model.normalizer_spec, model.trainer_spec
        if trained.model_type != trained.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with byte fallback is needed")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("a model with the identity normaliser and a leading space is needed")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        normal = sorted((p for p in model.pieces if p.type == kinds.NORMAL), key=lambda p: -p.score)
        self.rank = {p.piece: i for i, p in enumerate(normal)}
        if any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1) for p in self.rank):
            raise ValueError("a piece crosses a space or a line feed")
        self.ends = "".join(c for c in ",.;:!?" if not any(
            p[i].isalpha() and p[i + 1] == c for p in self.rank for i in range(len(p) - 1)))
        self.known: dict[str, int] = {}
        self.size = 0

    def merge_count(self, chunk: str) -> int:
        """Initial symbols minus merges of one chunk."""
        rank = self.rank
        symbols = list(chunk)
        n = len(symbols)
        count = sum(1 if c in rank else len(c.encode()) for c in symbols)
        right = list(range(1, n)) + [-1]
        left = list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = right[i]
            if j < 0 or not symbols[i] or len(symbols[i]) + len(symbols[j]) != size:
                continue        # one of the two has been merged meanwhile
            for k in (i, j):    # a merged pair is one known piece, even of unknown characters
                if len(symbols[k]) == 1 and symbols[k] not in rank:
                    count -= len(symbols[k].encode()) - 1
            symbols[i] += symbols[j]
            symbols[j] = ""
            count -= 1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            right[j] = -1
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (r := rank.get(symbols[a] + symbols[b])) is not None:
                    heapq.heappush(heap, (r, a, len(symbols[a]) + len(symbols[b])))
        return count

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lines = pc.count_substring(texts, "\n").to_numpy(zero_copy_only=False)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        nothing, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        marked = pc.replace_substring(pc.binary_join_element_wise(nothing, texts, space), MARK, " ")
        cut = pc.replace_substring_regex(marked, r"([^ ]) ", "\\1\n ")
        if self.ends:
            cut = pc.replace_substring_regex(cut, f"([a-zA-Z])([{self.ends}])", "\\1\n\\2")
        pieces, chunks, order = split_words(cut, "\n")
        if self.size > CACHE_BYTES:
            self.known.clear()
            self.size = 0
        for c in chunks:
            if c not in self.known:
                self.known[c] = self.merge_count(c.replace(" ", MARK))
                self.size += WORD_COST + 2 * len(c)
        each = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        return np.where(empty, 0, row_sums(each[order], pieces) + lines)


@functools.lru_cache(maxsize=2)
def merge_counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """The documents with ``n_bytes`` (UTF-8) and ``n_tokens`` of their whole texts."""
    def count(texts):
        size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
        return [size, pa.array(merge_counter(model).counts(texts), pa.int64())]

    return add_columns(docs, "n_bytes long, n_tokens long", count)
