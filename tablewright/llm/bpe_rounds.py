"""Byte-pair encoding and decoding in batched numpy merge rounds.

The distinct words of a slice of texts are put into one flat array of symbols.  Each round looks
all adjacent pairs up at once by binary search over the sorted pair keys
(``left * symbols + right``), takes the lowest rank of every word, merges that pair wherever it
stands in the word (left to right, without overlaps) and takes words without a known pair out of
the array.  Merging all places of a pair in one round equals merging them one by one, unless the
merged symbol belongs to a pair of lower rank; such ranks are found when the file is read, and
of them only the leftmost place is merged in a round.

The vocabulary file gives normalizer, word pattern, special tokens, merges and ids; the library
``tokenizers`` is used for the first two alone.  The word pattern never joins what white space
divides, so texts are cut into words first and each distinct word is encoded once in a worker
(``text.WordCache``, bounded in bytes).

Results: a null text is an empty one; special strings in a text become their ids, as is the
library's default; without a decoder in the file, a decoded text is the ids' strings joined by
one space, and ids that the vocabulary lacks are left out; null ids decode to a null text.  Rows
are independent: repeated rows give repeated results, an empty table gives an empty one, other
columns are passed on (those with a new column's name are replaced).  A very long text is a slice
of its own; one very long unbroken word costs its length times its number of rounds.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .text import WordCache, add_columns

DECODE_IDS = 1 << 20        # ids decoded at once
NO_RANK = np.iinfo(np.int32).max


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 ones for themselves, the others
    in turn from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in plain)
    table = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [table[b] for b in range(256)]


class MergeTable:
    """Ids, merges and word rules of a byte-level ``tokenizers`` BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("continuing_subword_prefix") \
                or model.get("ignore_merges") or spec.get("post_processor") or spec.get("decoder"):
            raise ValueError(f"{path}: only plain byte-level BPE files without a decoder are read")
        vocab, ending = model["vocab"], model.get("end_of_word_suffix") or ""
        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.splitter = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # a run of ASCII letters is one piece, in lower case
        self.plain = self._rules("aZq") == ["azq"]
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

        characters = byte_characters()
        self.inner = np.array([vocab[c] for c in characters], np.int64)
        self.last = np.array([vocab[c + ending] for c in characters], np.int64)

        of_id = {i: name for name, i in (vocab | self.special).items()}
        self.symbols = max(of_id) + 1
        self.strings = pa.array([of_id.get(i) for i in range(self.symbols)], pa.large_string())

        pairs = {tuple(m.split(" ") if isinstance(m, str) else m): rank for rank, m in enumerate(model["merges"])}
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        rank = np.fromiter(pairs.values(), np.int64, len(pairs))
        into = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(left * self.symbols + right)
        self.keys = (left * self.symbols + right)[order]
        self.ranks, self.into = rank[order].astype(np.int32), into[order]

        # a rank is safe to merge everywhere at once if its product starts no pair of lower rank
        first_use = np.full(self.symbols, NO_RANK, np.int64)
        np.minimum.at(first_use, left, rank)
        np.minimum.at(first_use, right, rank)
        self.safe = np.zeros(len(model["merges"]) + 1, bool)
        self.safe[rank] = first_use[into] > rank

    def pieces(self, word: str) -> list[str | int]:
        """The parts of a word that are merged by themselves (as byte characters), and ids of
        special strings."""
        if self.plain and word.isascii() and word.isalpha():
            return [word.lower()]
        out = []
        for part in self.special_pattern.split(word) if self.special_pattern else [word]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self._rules(part)
        return out

    def _rules(self, text: str) -> list[str]:
        plain = self.normalizer.normalize_str(text) if self.normalizer else text
        return [p for p, _ in self.splitter.pre_tokenize_str(plain)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids one after the other)."""
        parts = [self.pieces(w) for w in words]
        of_word = np.repeat(np.arange(len(words)), np.fromiter(map(len, parts), np.int64, len(words)))
        flat = [p for ps in parts for p in ps]
        sizes = np.array([1 if isinstance(p, int) else len(p) for p in flat], np.int64)
        text = "".join("\0" if isinstance(p, int) else p for p in flat)
        points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        symbols = self.inner[_bytes(points)]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[_bytes(points[ends])]
        whole = np.array([isinstance(p, int) for p in flat], bool)
        symbols[ends[whole]] = [p for p in flat if isinstance(p, int)]
        counts, ids = self.merge(symbols, sizes)
        return np.bincount(of_word, counts, len(words)).astype(np.int64), ids

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All merge rounds over the symbols of many words (``sizes`` > 0 symbols each)."""
        word = np.repeat(np.arange(len(sizes)), sizes)
        done = []
        while len(symbols):
            rank, at = self._ranks(symbols, word)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            here = np.repeat(lowest, np.diff(np.r_[starts, len(word)]))
            open_ = here < NO_RANK
            if not open_.all():
                done.append((word[~open_], symbols[~open_]))
                symbols, word, rank, at, here = (x[open_] for x in (symbols, word, rank, at, here))
                if not len(symbols):
                    break
            pick = self._places(rank == here, word, here)
            symbols[pick] = self.into[at[pick]]
            stay = np.ones(len(symbols), bool)
            stay[pick + 1] = False
            symbols, word = symbols[stay], word[stay]
        if not done:
            return np.zeros(len(sizes), np.int64), np.zeros(0, np.int64)
        word = np.concatenate([w for w, _ in done])
        order = np.argsort(word, kind="stable")
        return np.bincount(word, minlength=len(sizes)), np.concatenate([s for _, s in done])[order]

    def _ranks(self, symbols, word):
        """Rank of the pair that starts at each symbol, and its place among the sorted keys."""
        rank = np.full(len(symbols), NO_RANK, np.int32)
        at = np.zeros(len(symbols), np.int64)
        pair = np.flatnonzero(word[1:] == word[:-1])
        if len(pair) and len(self.keys):
            key = symbols[pair] * self.symbols + symbols[pair + 1]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[found] == key
            rank[pair[hit]] = self.ranks[found[hit]]
            at[pair] = found
        return rank, at

    def _places(self, lowest, word, rank) -> np.ndarray:
        """Where to merge: every place of a word's lowest pair, of overlapping ones each second
        from the left on; only the leftmost place where the rank is not safe."""
        pick = np.flatnonzero(lowest)
        joined = np.r_[False, (np.diff(pick) == 1) & (word[pick[1:]] == word[pick[:-1]])]
        run = np.maximum.accumulate(np.where(joined, 0, np.arange(len(pick))))
        first = np.r_[True, word[pick[1:]] != word[pick[:-1]]]
        return pick[((np.arange(len(pick)) - run) % 2 == 0) & (self.safe[rank[pick]] | first)]


_BYTE_OF_POINT = np.zeros(512, np.int64)
_BYTE_OF_POINT[[ord(c) for c in byte_characters()]] = np.arange(256)


def _bytes(points: np.ndarray) -> np.ndarray:
    """The byte each character stands for (the filler NUL of a special string: any)."""
    return _BYTE_OF_POINT[points]


@functools.lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    """One table in each Python worker."""
    return MergeTable(path)


@functools.lru_cache(maxsize=2)
def word_cache(path: str) -> WordCache:
    """The words met so far in each Python worker."""
    return WordCache(merge_table(path).encode_words, np.dtype(np.int32))


def _lists(counts: np.ndarray, ids: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids, pa.int32()))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Every row of ``docs`` with ``ids`` (array<int>): the token ids of its whole ``text``."""
    return add_columns(docs, "ids array<int>", lambda texts: [_lists(*word_cache(path).encode(texts))])


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Every row of ``docs`` with ``ids`` and ``decoded``, the text that the ids decode to, in
    one pass over the texts."""
    def both(texts):
        ids = _lists(*word_cache(path).encode(texts))
        return [ids, decode_lists(ids, merge_table(path).strings)]

    return add_columns(docs, "ids array<int>, decoded string", both)


def decode_documents(encoded: DataFrame, path: str, column: str = "decoded") -> DataFrame:
    """Every row of ``encoded`` with ``column``: the text its ``ids`` decode to."""
    added = StructType.fromDDL(f"`{column}` string")
    kept = encoded.drop(column).withColumn("ids", F.col("ids").cast("array<int>"))

    def run(batches):
        names = merge_table(path).strings
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False)
            ends, at = np.cumsum(lengths.astype(np.int64)), 0
            while at < batch.num_rows:
                done = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + DECODE_IDS, side="right")))
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*part.columns, decode_lists(part.column("ids"), names)],
                                                 [*part.schema.names, column])
                at = to

    return kept.mapInArrow(run, StructType([*kept.schema.fields, *added.fields]))


def decode_lists(ids: pa.Array, names: pa.Array) -> pa.Array:
    """The text of each list of ids; ids outside the vocabulary are left out."""
    flat = ids.flatten()
    known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(names)))
    words = names.take(pc.if_else(pc.fill_null(known, False), flat, None))
    counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if words.null_count:
        of_list = np.repeat(np.arange(len(counts)), counts)[words.is_valid().to_numpy(zero_copy_only=False)]
        words, counts = words.drop_null(), np.bincount(of_list, minlength=len(counts))
    lists = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int64()), words)
    joined = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
    return pc.if_else(ids.is_valid(), joined, None).cast(pa.string())
