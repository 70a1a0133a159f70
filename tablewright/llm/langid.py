"""Language identification of mixed-language text: scripts, word scores, Viterbi spans.

Learnt per language: hashed letter trigrams of words (with their edges) and the scripts its
words use.  A word is scored by its trigrams for the languages that use its script; Viterbi
with a switching penalty labels every word, equal neighbours form spans, and the language
with most letters is the document's.

Model: trigram counts are summed by Spark over about ``per_lang`` documents of each language,
chosen by a hash; only (language, bucket) counts, at most languages * BUCKETS, reach the
driver and are sent with the scoring task.

Results: null text and text without a letter give ``und`` with score 0 and no spans, and so
does every text if nothing can be learnt; repeated rows repeat; a null ``doc_id`` is kept;
other columns are ignored; ties go to the language first in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chains import viterbi
from .text import add_columns, row_sums, slices, split_words

BUCKETS = 1 << 16
MAX_LANGUAGES = 250     # of the model's dense table: BUCKETS doubles for each
UNKNOWN = "und"
# ---- fixed values: first code point, last code point, script -------------------------------
SCRIPT_RANGES = [
    (0x0041, 0x024F, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"), (0x0600, 0x077F, "arabic"),
    (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"), (0x0B80, 0x0BFF, "tamil"),
    (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"), (0x1E00, 0x1EFF, "latin"),
    (0x1F00, 0x1FFF, "greek"), (0x3040, 0x30FF, "kana"), (0x3400, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"),
]
# --------------------------------------------------------------------------------------------
SCRIPTS = ["other", *dict.fromkeys(name for _, _, name in SCRIPT_RANGES)]
SCRIPT_SHARE = 0.01     # a language uses a script that one in a hundred of its words has
STRANGE = -20.0         # word score of a language that doesn't use the word's script


def letter_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(word count of each text, distinct words, word codes): lower-case runs of letters."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    spaced = pc.utf8_trim(pc.replace_substring_regex(low, r"[^\p{L}\p{M}]+", " "), " ")
    counts, words, order = split_words(spaced)
    # no words: what an empty text splits into, and marks without a letter
    lettered = pc.match_substring_regex(pa.array(words, pa.large_string()), r"\p{L}").to_numpy(zero_copy_only=False)[order]
    return row_sums(lettered.astype(np.int64), counts), words, order[lettered]


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram buckets, letters of each word, script of each word)."""
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), "<u4").astype(np.uint64)
    at = np.flatnonzero(points != 32)
    mixed = (points[at - 1] * np.uint64(0x9E3779B1) + points[at] * np.uint64(0x85EBCA77)
             + points[at + 1] * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    heads = np.fromiter((ord(w[0]) if w else 0 for w in words), np.int64, len(words))
    script = np.zeros(len(words), np.int64)
    for low, high, name in SCRIPT_RANGES:
        script[(heads >= low) & (heads <= high)] = SCRIPTS.index(name)
    return (mixed >> np.uint64(48)).astype(np.int64), sizes, script


def learn(docs: DataFrame, per_lang: int = 1500, seed: int = 3) -> dict | None:
    """Model from (doc_id, text, lang) rows; rows without text or language teach nothing."""
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    found = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages: the model would not fit a worker")
    # at most MAX_LANGUAGES rows: without the hint all texts would be dealt by language, most to one task
    sizes = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], r["n"]) for r in found], "lang string, n long"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    taught = rows.join(sizes, "lang").where(place < F.lit(float(per_lang)) / F.col("n")).select("text", "lang")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for part in slices(batches):
            langs = np.array(part.column("lang").to_pylist(), object)
            counts, words, order = letter_words(part.column("text"))
            grams, sizes, script = trigrams(words)
            of = np.repeat(langs, counts)
            for lang in set(langs):
                seen = np.bincount(order[of == lang], minlength=len(words))
                into = sums.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                into[:BUCKETS] += np.bincount(grams, np.repeat(seen, sizes), BUCKETS).astype(np.int64)
                into[BUCKETS:] += np.bincount(script, seen, len(SCRIPTS)).astype(np.int64)
        for lang, into in sums.items():
            at = np.flatnonzero(into)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()),
                                              "at": pa.array(at), "n": pa.array(into[at])})

    sums = taught.mapInArrow(count, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    if not len(sums):
        return None
    langs = sorted(sums["lang"].unique())
    table = np.zeros((BUCKETS + len(SCRIPTS), len(langs)))
    table[sums["at"].to_numpy(), np.searchsorted(langs, sums["lang"].to_numpy(str))] = sums["n"]
    grams, scripts = table[:BUCKETS] + 0.5, table[BUCKETS:]
    uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
    return {"langs": langs, "log": np.log(grams / grams.sum(0)).astype(np.float32), "uses": uses & (scripts > 0)}


def word_scores(model: dict, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(score of each word for each language, its letters); scripts narrow the languages."""
    grams, sizes, script = trigrams(words)
    scores = np.stack([row_sums(model["log"][grams, k].astype(np.float64), sizes) for k in range(len(model["langs"]))], 1)
    uses = model["uses"][script]
    scores -= scores.max(1, keepdims=True, initial=-np.inf, where=uses | ~uses.any(1, keepdims=True))
    scores = np.where(uses, scores, STRANGE)
    scores[~uses.any(1)] = 0.0
    return scores, sizes


SPANS = "array<struct<lang:string,first_word:int,words:int>>"


def identify(docs: DataFrame, model: dict | None, penalty: float = 12.0) -> DataFrame:
    """The documents with ``lang_pred``, ``score`` (share of the letters in that language's
    spans) and ``spans`` of their whole texts."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "spans": F.array().cast(SPANS)})
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("words", pa.int32())]))

    def label(texts):
        langs = model["langs"]
        counts, words, order = letter_words(texts)
        scores, letters = word_scores(model, words)
        labels = viterbi(scores[order], counts, penalty)
        weight = letters[order].astype(float)
        share = np.stack([row_sums(np.where(labels == k, weight, 0.0), counts) for k in range(len(langs))], 1)
        found, score, spans = [], [], []
        for k, (to, n) in enumerate(zip(np.cumsum(counts), counts)):
            if not n:
                found.append(UNKNOWN), score.append(0.0), spans.append([])
                continue
            top = int(share[k].argmax())
            found.append(langs[top])
            score.append(float(share[k, top] / share[k].sum()))
            mine = labels[to - n:to]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(mine)) + 1, [n]])
            spans.append([{"lang": langs[mine[a]], "first_word": int(a), "words": int(b - a)}
                          for a, b in zip(cuts[:-1], cuts[1:])])
        return [pa.array(found, pa.string()), pa.array(score, pa.float64()), pa.array(spans, span_type)]

    return add_columns(docs, f"lang_pred string, score double, spans {SPANS}", label)
