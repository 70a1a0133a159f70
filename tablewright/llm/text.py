"""Shared helpers of the text operators: bounded Arrow slices, word dictionaries, samples.

Nothing here holds more than one slice of texts; a slice ends at ``SLICE_BYTES`` bytes of
text (a longer single text is a slice of its own).
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICE_BYTES = 2 << 20
CACHE_BYTES = 96 << 20      # of the words a worker keeps, with WORD_COST bytes of bookkeeping each
WORD_COST = 160
# letters whose lower case is one letter (not U+0130) and which do not combine with another
PLAIN_WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+").fullmatch


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of one slice take at most ``limit`` bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at, done = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            done, at = int(ends[to - 1]), to


def add_columns(docs: DataFrame, schema: str, compute: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """Every row of ``docs`` with all its columns and new ones computed from ``text``, slice by
    slice; columns that have a new one's name are replaced."""
    added = StructType.fromDDL(schema)
    kept = docs.drop(*added.names).withColumn("text", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, *compute(part.column("text"))],
                                             [*part.schema.names, *added.names])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, *added.fields]))


def split_words(texts: pa.Array, separator: str = " ") -> tuple[np.ndarray, list[str], np.ndarray]:
    """Split on one separator: (word count of each text, distinct words, word codes in order)."""
    lists = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), separator)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return counts, coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)


def row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum consecutive runs of ``values`` with the given lengths (zero lengths give zero)."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every run, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def bounded_sample(df: DataFrame, n: int, *key: str, seed: int = 11) -> DataFrame:
    """About ``n`` rows (never over ``2 n``) chosen by a hash of ``key``; all rows when there
    are at most ``n``.  For fitting models and dictionaries only."""
    total = df.count()
    if total <= n:
        return df
    share = F.pmod(F.xxhash64(*[F.col(k) for k in key], F.lit(seed)), F.lit(1 << 40))
    return df.where(share < F.lit(int((1 << 40) * n / total))).limit(2 * n)


def held_out(doc_id) -> F.Column:
    """The contract's held-out rows: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class WordCache:
    """Ids of white-space separated words, each distinct word encoded once.

    For tokenizers that drop white space and none of whose steps (normal form, lower case,
    pattern, special tokens) looks across a space or line feed: the ids of a text are then those
    of its words.  Their pattern also has to end a run of letters before a closing mark; words
    are cut there too.  Words past ``CACHE_BYTES`` push out those met in one slice only.
    """

    def __init__(self, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], width: np.dtype):
        self.encode_words, self.width = encode_words, width
        self._keep([], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, width))

    def _keep(self, words: list[str], lengths: np.ndarray, starts: np.ndarray, pool: np.ndarray) -> None:
        self.words, self.lengths, self.starts, self.pool = words, lengths, starts, pool
        self.codes = dict(zip(words, range(len(words))))
        self.uses = np.zeros(len(words), np.int32)
        self.size = sum(map(len, words)) * 2 + WORD_COST * len(words)

    def _trim(self) -> None:
        """Keep the words met in several slices since the last time, at most half of all."""
        often = np.flatnonzero(self.uses > 1)
        if 2 * len(often) > len(self.words):
            often = np.sort(often[np.argsort(-self.uses[often], kind="stable")[:len(self.words) // 2]])
        lengths = self.lengths[often]
        pool = self.pool[spans(self.starts[often], lengths)]
        self._keep([self.words[k] for k in often], lengths, np.cumsum(lengths) - lengths, pool)

    def _codes(self, words: list[str]) -> np.ndarray:
        codes = np.fromiter(map(self.codes.get, words, itertools.repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            new = [words[k] for k in missing]
            cost = sum(map(len, new)) * 2 + WORD_COST * len(new)
            if self.size + cost > CACHE_BYTES and self.words:
                self._trim()
                if self.size + cost > CACHE_BYTES:
                    self._keep([], self.lengths[:0], self.starts[:0], self.pool[:0])
                return self._codes(words)
            sizes, ids = self.encode_words(new)
            codes[missing] = len(self.words) + np.arange(len(new))
            self.codes.update(zip(new, codes[missing].tolist()))
            self.words += new
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
            self.lengths = np.concatenate([self.lengths, sizes])
            self.pool = np.concatenate([self.pool, ids.astype(self.width)])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int32)])
            self.size += cost
        self.uses[codes] += 1
        return codes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids one after the other)."""
        spaced = pc.replace_substring(texts.cast(pa.large_string()), "\n", " ")
        counts, words, order = split_words(pc.replace_substring_regex(spaced, "([a-zA-Z])([,.;:!?])", r"\1 \2"))
        codes = self._codes(words)[order]
        lengths = self.lengths[codes]
        return row_sums(lengths, counts), self.pool[spans(self.starts[codes], lengths)]


class WordIds(WordCache):
    """Word ids from a ``tokenizers`` file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        ending = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.ends = np.zeros(size, bool)    # ids that end a word, where the vocabulary marks them
        if ending:
            self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith(ending)]] = True
        super().__init__(self._encode_words, np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4"))

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters alone give one marked end each, so many are encoded as one text."""
        plain = [k for k, w in enumerate(words) if PLAIN_WORD(w)] if self.ends.any() else []
        ids = self._ids([" ".join([words[k] for k in plain[at:at + 2000]]) for at in range(0, len(plain), 2000)])
        joined = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        stops = np.flatnonzero(self.ends[joined]) + 1
        if len(stops) != len(plain):
            plain, joined, stops = [], joined[:0], stops[:0]
        others = np.setdiff1d(np.arange(len(words)), plain)
        single = self._ids([words[k] for k in others])
        sizes = np.zeros(len(words), np.int64)
        sizes[plain] = np.diff(stops, prepend=0)
        sizes[others] = [len(x) for x in single]
        starts = np.zeros(len(words), np.int64)
        starts[plain] = stops - sizes[plain]
        starts[others] = len(joined) + np.cumsum(sizes[others]) - sizes[others]
        return sizes, np.concatenate([joined, *single])[spans(starts, sizes)]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One encoder (and its word cache) in each Python worker."""
    return WordIds(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the input with the id array of each row, ``end_id`` appended."""
    coder = word_ids(path)
    for part in slices(batches):
        counts, ids = coder.encode(part.column("text"))
        ends = np.cumsum(counts)
        end = np.array([end_id], coder.width)
        yield part, [np.concatenate([ids[b - n:b], end]) for b, n in zip(ends, counts)]
