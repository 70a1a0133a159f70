"""Chains against enumeration; classifiers on held-out rows and hard cases."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tablewright.llm import chains, langid, quality, toxicity

SF = "/root/testdata/sf0.01"
COUNTS = np.array([3, 0, 5, 1, 4])


def each_chain(scores):
    ends = np.cumsum(COUNTS)
    return [scores[b - n:b] for b, n in zip(ends, COUNTS)]


def test_viterbi_is_the_best_labelling():
    scores = np.random.default_rng(0).normal(size=(COUNTS.sum(), 3))
    got = chains.viterbi(scores, COUNTS, 0.7)
    want = []
    for part in each_chain(scores):
        def value(labels):
            return sum(part[i, s] for i, s in enumerate(labels)) - 0.7 * sum(a != b for a, b in zip(labels, labels[1:]))
        want += max(itertools.product(range(3), repeat=len(part)), key=value)
    assert got.tolist() == want


def test_marginals_sum_over_all_labellings():
    rng = np.random.default_rng(1)
    scores, moves = rng.normal(size=(COUNTS.sum(), 2)), rng.normal(size=(2, 2))
    share, expected, total = chains.marginals(scores, moves, COUNTS)
    want, want_moves, want_total = [], np.zeros((2, 2)), 0.0
    for part in each_chain(scores):
        if not len(part):
            continue
        every = list(itertools.product(range(2), repeat=len(part)))
        p = np.array([np.exp(sum(part[i, s] for i, s in enumerate(y)) + sum(moves[a, b] for a, b in zip(y, y[1:]))) for y in every])
        want_total += np.log(p.sum())
        p /= p.sum()
        for i in range(len(part)):
            want.append([sum(q for q, y in zip(p, every) if y[i] == s) for s in (0, 1)])
        for q, y in zip(p, every):
            for a, b in zip(y, y[1:]):
                want_moves[a, b] += q
    assert np.allclose(share, want) and np.allclose(expected, want_moves) and np.isclose(total, want_total)


def held(spark, name, label):
    got = E.queries()[name](spark, SF).where("held_out").toPandas()
    marks = spark.read.parquet(f"{SF}/{label[0]}.parquet").select("doc_id", label[1]).toPandas()
    return got.merge(marks, on="doc_id")


def test_language_of_held_out_documents(spark):
    got = held(spark, "op7_language_id", ("documents", "lang"))
    assert (got.lang_pred == got.lang).mean() >= 0.98


def test_quality_of_held_out_documents(spark):
    got = held(spark, "op5_quality_classifier", ("labels", "quality"))
    assert (got.predicted == got.quality).mean() >= 0.95


def test_toxicity_of_held_out_documents(spark):
    got = held(spark, "op8_toxicity", ("labels", "toxic"))
    assert got[got.toxic == 0].predicted.mean() <= 0.02
    assert got[got.toxic == 1].score.mean() > 3 * got[got.toxic == 0].score.mean()


EN, DE = "the house and this garden with those", "der Garten und dieses Häuschen für jenes"


def lang_model(spark):
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de") for i in range(40)]
    rows += [(100 + i, "Это дом и сад", "ru") for i in range(10)] + [(200, None, "xx"), (201, EN, None)]
    return langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_mixed_language_spans(spark):
    model = lang_model(spark)
    assert model["langs"] == ["de", "en", "ru"]
    rows = [(1, f"{EN}. {DE}"), (2, "дом сад"), (3, None), (4, "12 ;-) 34"), (5, ""), (None, EN), (6, "漢字"), (7, EN * 5000), (7, EN * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang_pred": F.lit(1), "score": F.lit("x")})
    got = langid.identify(df, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[None].lang_pred == "en" and by[2].lang_pred == "ru" and by[7].lang_pred == "en"
    assert [(s.lang, s.first_word, s.words) for s in by[1].spans] == [("en", 0, 7), ("de", 7, 7)]
    assert all((by[k].lang_pred, by[k].score, by[k].spans) == ("und", 0.0, []) for k in (3, 4, 5))
    assert by[6].lang_pred in model["langs"] and all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, label int")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert langid.learn(empty) is None and quality.learn(empty) is None and toxicity.learn(empty) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert quality.learn(docs.withColumn("label", F.lit(1))) is None


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_of_hard_texts(spark, module):
    bad = "SHOUT!! SHOUT!! idiot!! NOISE!!"
    rows = [(i, bad if i % 3 == 0 else f"A calm line of plain prose {i}.\nAnd one more line.", int((i % 3 == 0) == (module is toxicity)))
            for i in range(90)]
    model = module.learn(spark.createDataFrame(rows + [(91, None, 1), (92, "x", None), (None, "y", 0)], "doc_id long, text string, label int"))
    texts = [(1, None), (2, ""), (3, "\n\n"), (4, bad), (5, "A calm line of plain prose 7.\nAnd one more line."), (None, bad), (6, (bad + "\n") * 5000), (6, "é 😀\x00")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"score": F.lit("s"), "label": F.lit(0)})
    got = module.score(df, model).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got)
    of = {r.doc_id: r.score for r in got}
    assert (of[4] - of[5] > 0.5) if module is toxicity else (of[5] - of[4] > 0.5)
    assert module.score(df.where("1 = 0"), model).count() == 0


def test_line_measures_see_only_their_line():
    lines = ["Plain words here.", "", "LOUD!! LOUD!!", "one one one two | 12"]
    whole = quality.line_measures(pa.array(["\n".join(lines), None]))
    assert whole[0].tolist() == [4, 1] and whole[2].tolist() == [17, 0, 13, 20, 0]
    for k, line in enumerate(lines):
        assert np.allclose(whole[1][k], quality.line_measures(pa.array([line]))[1][0])
    repeats = whole[1][:, quality.MEASURES.index("repeats")]
    assert np.isclose(repeats[3], 2 / 6) and np.isclose(repeats[2], 0.5)


def plain_features(text):
    """Distinct buckets of words, neighbour pairs and skip pairs, in plain loops."""
    import regex
    import xxhash
    words = [xxhash.xxh64_intdigest(w.encode()) for w in regex.sub(r"[^\p{L}\p{N}']+", " ", text.lower()).split(" ") if w]
    keys = list(words)
    for gap, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        keys += [(a * factor % 2 ** 64) ^ b for a, b in zip(words, words[gap:])]
    return sorted({(key * 0xD6E8FEB86659FD93 % 2 ** 64) >> (64 - toxicity.BITS) for key in keys})


def test_toxicity_features_and_fit_equal_plain_loops():
    import math
    import pyarrow as pa
    texts = ["A b, c! a b", "", None, "d", "You're  so-so  it's\n42", "x y z x y z " * 50]
    row, bucket = toxicity.features(pa.array(texts))
    got = [sorted(set(bucket[row == k].tolist())) for k in range(len(texts))]
    assert got == [plain_features(t or "") for t in texts]

    draw = np.random.default_rng(4)
    rows = [np.unique(draw.integers(0, 30, 6)) for _ in range(60)]
    labels = [int(0 in r or 1 in r) for r in rows]
    weights, bias = toxicity.ftrl(rows, labels, epochs=3, l1=0.3)
    z, n, b, bn = {}, {}, 0.0, 0.0
    for epoch in range(3):
        for k in np.random.default_rng(1 + epoch).permutation(60):
            w = {}
            for i in rows[k]:
                zi, ni = z.get(i, 0.0), n.get(i, 0.0)
                w[i] = 0.0 if abs(zi) <= 0.3 else -(zi - math.copysign(0.3, zi)) / (1 + math.sqrt(ni))
            g = 1 / (1 + math.exp(-(b + sum(w.values())))) - labels[k]
            for i in rows[k]:
                ni = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(ni + g * g) - math.sqrt(ni)) * w[i]
                n[i] = ni + g * g
            bn += g * g
            b -= g / (1 + math.sqrt(bn))
    assert math.isclose(b, bias, rel_tol=1e-9)
    for i in range(30):
        zi = z.get(i, 0.0)
        want = 0.0 if abs(zi) <= 0.3 else -(zi - math.copysign(0.3, zi)) / (1 + math.sqrt(n[i]))
        assert math.isclose(weights[i], want, rel_tol=1e-9, abs_tol=1e-12)


def test_marks_without_a_letter_are_und(spark):
    from tablewright.llm import langid
    taught = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(
        [("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)], "doc_id long, text string, lang string")
    model = langid.learn(taught)
    rows = spark.createDataFrame([(1, "\u0301 \u0301\u0300"), (2, "the dog \u0301"), (3, "1 2"), (4, "the cat " * 400000)],
                                 "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(rows, model).collect()}
    assert got[1] == got[3] == ("und", 0.0) and got[2][0] == got[4][0] == "en"
    assert langid.identify(rows.where("false"), model).collect() == []
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError):
        langid.learn(many)
