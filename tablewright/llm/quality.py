"""Document quality: a linear-chain conditional random field over lines.

Every line is labelled good or bad.  Its evidence is its own measures (letters, capitals,
digits, symbols, word lengths, repeats, endings), each cut into bins at training quantiles,
and the same measures of the line before and after it; two-by-two move weights tie neighbours
together.  A document's quality is the mean of its lines' forward-backward marginals weighted
by line length, brought to a probability by a logistic curve.

Model: fitted on about ``sample`` labelled documents chosen by a hash (a documented bound).
Documents, not lines, are labelled: all lines of a document first take its label, and after a
first fit the lines of bad documents that look good beyond doubt are taken as good.  Spark
measures the lines; the driver gets one byte per line and measure and runs the fit.

Results: null text is an empty text; an empty text is one empty line; without labels of both
kinds every score is 0.5; repeated rows repeat; other columns (a null ``doc_id`` too) are
kept, ones named like the added are replaced; an empty table gives an empty result; the lines of
a very long text are one chain, in a slice of its own.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chains import marginals
from .text import add_columns, bounded_sample, row_sums, slices, split_words

MEASURES = ["letters", "capitals", "digits", "symbols", "marked_words", "bare_marks", "word_length",
            "repeats", "distinct", "words", "chars", "full_stop"]
BINS = 8
LOWER, UPPER, DIGIT, SPACE, SYMBOL, PLAIN = range(6)    # PLAIN: marks of ordinary prose
PROSE_MARKS = ".,;:?'\"()-"


def _classes() -> np.ndarray:
    """Class of every code point of the basic plane; the rest counts as lower-case letters."""
    kinds = np.full(1 << 16, SYMBOL, np.uint8)
    for point in range(1 << 16):
        kind = unicodedata.category(chr(point))
        if kind[0] in "LM":
            kinds[point] = UPPER if kind in ("Lu", "Lt") else LOWER
        elif kind[0] == "N":
            kinds[point] = DIGIT
        elif kind[0] == "Z" or point in range(9, 14):
            kinds[point] = SPACE
    kinds[[ord(c) for c in PROSE_MARKS]] = PLAIN
    return kinds


CLASS_OF: list[np.ndarray] = []     # filled once in each worker


def line_measures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines of each text, measures of every line, characters of every line)."""
    if not CLASS_OF:
        CLASS_OF.append(_classes())
    lists = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    lines = lists.flatten()
    of_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(lines.to_pylist()).encode("utf-32-le"), "<u4")
    kinds = np.where(points < 1 << 16, CLASS_OF[0][np.minimum(points, (1 << 16) - 1)], LOWER)
    n = [row_sums((kinds == k).astype(np.int64), chars) for k in range(6)]
    letters = n[LOWER] + n[UPPER]

    words, known, order = split_words(lines, " ")
    line = np.repeat(np.arange(len(words)), words)
    size = np.fromiter(map(len, known), np.int64, len(known))
    last = np.frombuffer("".join(w[-1:] or " " for w in known).encode("utf-32-le"), "<u4")
    ends = np.where(last < 1 << 16, CLASS_OF[0][np.minimum(last, (1 << 16) - 1)], LOWER) == SYMBOL
    bare = np.fromiter((not any(map(str.isalnum, w)) for w in known), bool, len(known))
    real = size[order] > 0
    line, order = line[real], order[real]
    words = np.bincount(line, minlength=len(chars))
    per = np.maximum(words, 1)
    again = np.zeros(len(order), bool)
    again[1:] = (order[1:] == order[:-1]) & (line[1:] == line[:-1])
    kinds_of = np.bincount(np.unique(line * len(known) + order) // max(1, len(known)), minlength=len(chars))
    per_char = np.maximum(chars, 1)
    stop = pc.match_substring_regex(lines, r"[.?!:]\s*$").to_numpy(zero_copy_only=False)
    add = lambda values: np.bincount(line, values[order], len(chars))
    table = np.stack([
        letters / per_char, n[UPPER] / np.maximum(letters, 1), n[DIGIT] / per_char, n[SYMBOL] / per_char,
        add(ends) / per, add(bare) / per, add(size) / per, np.bincount(line, again, len(chars)) / per,
        kinds_of / per, np.log1p(words), np.log1p(chars), stop.astype(float)], 1)
    return of_text, table, chars


def binned(table: np.ndarray, of_text: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Feature numbers of every line: its own bins, those of the line before and after (a bin of
    their own at the edges of a text)."""
    own = np.stack([np.searchsorted(cuts[m], table[:, m], side="right") for m in range(len(MEASURES))], 1)
    last = np.cumsum(of_text) - 1
    before = np.vstack([np.full((1, own.shape[1]), BINS), own[:-1]])
    before[last - of_text + 1] = BINS
    after = np.vstack([own[1:], np.full((1, own.shape[1]), BINS)])
    after[last] = BINS
    place = np.arange(3 * len(MEASURES)) * (BINS + 1)
    return np.hstack([own, before, after]) + place


def _scores(weights: np.ndarray, marks: np.ndarray) -> np.ndarray:
    good = weights[marks].sum(1) / 2
    return np.stack([-good, good], 1)


def fit_field(marks: np.ndarray, counts: np.ndarray, good: np.ndarray, rounds: int = 120, rate: float = 0.1,
              l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(feature weights, move weights) by gradient steps on the conditional log likelihood of
    the line labels ``good`` (0 or 1)."""
    weights, moves = np.zeros(3 * len(MEASURES) * (BINS + 1)), np.zeros((2, 2))
    inside = np.ones(len(marks), bool)
    inside[np.cumsum(counts) - counts] = False
    at = np.flatnonzero(inside)
    seen = np.bincount(2 * good[at - 1] + good[at], minlength=4).reshape(2, 2)
    m = [np.zeros_like(weights), np.zeros_like(moves)]
    v = [np.zeros_like(weights), np.zeros_like(moves)]
    for step in range(1, rounds + 1):
        share, expected, _ = marginals(_scores(weights, marks), moves, counts)
        miss = np.repeat(good - share[:, 1], marks.shape[1])
        slopes = [np.bincount(marks.ravel(), miss, len(weights)) / len(marks) - l2 * weights,
                  (seen - expected) / len(marks) - l2 * moves]
        for k, (value, slope) in enumerate(zip((weights, moves), slopes)):
            m[k] = 0.9 * m[k] + 0.1 * slope
            v[k] = 0.99 * v[k] + 0.01 * slope ** 2
            value += rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
    return weights, moves


def document_evidence(share: np.ndarray, counts: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Mean good marginal of each document's lines, weighted by their length."""
    weight = chars + 1.0
    return row_sums(share[:, 1] * weight, counts) / row_sums(weight, counts)


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps (with a weak pull to zero)."""
    a = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -35, 35)))
        slope = design.T @ (y - p) - 0.01 * a
        bend = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        a += np.clip(np.linalg.solve(bend, slope), -3, 3)
    return float(a[0]), float(a[1])


def learn(labelled: DataFrame, sample: int = 5000) -> dict | None:
    """Model from (doc_id, text, label) rows, label 1 for good; null labels teach nothing."""
    rows = labelled.where("label IS NOT NULL").select("doc_id", "text", F.col("label").cast("int").alias("label"))

    def measure(batches):
        for part in slices(batches):
            of_text, table, chars = line_measures(part.column("text"))
            cut = np.cumsum(of_text)[:-1]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("label"),
                 pa.array([t.astype("<f4").tobytes() for t in np.split(table, cut)], pa.binary()),
                 pa.array([c.astype("<i8").tobytes() for c in np.split(chars, cut)], pa.binary())],
                ["doc_id", "label", "lines", "chars"])

    taught = (bounded_sample(rows, sample, "doc_id")
              .mapInArrow(measure, "doc_id long, label int, lines binary, chars binary").collect())
    taught.sort(key=lambda r: (r.doc_id is None, r.doc_id, r.label, r.lines))
    labels = np.array([r.label for r in taught], np.int64)
    if len(set(labels.tolist())) < 2:
        return None
    tables = [np.frombuffer(r.lines, "<f4").reshape(-1, len(MEASURES)) for r in taught]
    counts = np.array([len(t) for t in tables])
    table = np.concatenate(tables).astype(float)
    chars = np.concatenate([np.frombuffer(r.chars, "<i8") for r in taught])
    cuts = np.quantile(table, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.copy()
    marks = binned(table, counts, cuts)
    good = np.repeat(labels, counts)
    weights, moves = fit_field(marks, counts, good)
    share, _, _ = marginals(_scores(weights, marks), moves, counts)
    good = np.where((good == 0) & (share[:, 1] > 0.8), 1, good)
    weights, moves = fit_field(marks, counts, good)
    share, _, _ = marginals(_scores(weights, marks), moves, counts)
    slope, offset = fit_curve(document_evidence(share, counts, chars), labels.astype(float))
    return {"cuts": cuts, "weights": weights, "moves": moves, "slope": slope, "offset": offset}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """The documents with ``score`` (0 to 1, higher is better) and ``good_lines`` (a label for
    each line, 1 for good) of their whole texts."""
    if model is None:
        return docs.withColumns({"score": F.lit(0.5), "good_lines": F.array().cast("array<int>")})

    def run(texts):
        of_text, table, chars = line_measures(texts)
        marks = binned(table.astype("<f4").astype(float), of_text, model["cuts"])
        share, _, _ = marginals(_scores(model["weights"], marks), model["moves"], of_text)
        total = model["slope"] * document_evidence(share, of_text, chars) + model["offset"]
        labels = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(of_text)]).astype(np.int32),
                                          pa.array((share[:, 1] > 0.5).astype(np.int32)))
        return [pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35)))), labels]

    return add_columns(docs, "score double, good_lines array<int>", run)
