"""The pipeline's stages, each on what its predecessor kept, against plain computations."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_SMALL
from tablewright.llm import langid, quality
from tablewright.llm.queries import load
from test_duplicates import plain_fingerprint, smallest_reachable


def test_stages(spark):
    docs = load(spark, SF_SMALL, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", None, 0), (9002, "1 2 3", "en", "s", 5)], docs.schema)
    docs = docs.union(odd).union(docs.where("doc_id < 3")).cache()
    kept = docs
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "quality", "near_duplicates", "source_mix", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF_SMALL).cache()
        assert kept.columns == docs.columns
        was, now = before.collect(), kept.collect()
        assert set(now) <= set(was)
        if name == "language":
            assert 9001 not in {r.doc_id for r in now} and 9002 not in {r.doc_id for r in now}
            assert len(now) >= 0.95 * (len(was) - 3)
        if name == "quality":
            good = {r.doc_id for r in load(spark, SF_SMALL, "labels").where("quality = 1").collect()}
            assert len([r for r in now if r.doc_id in good]) >= 0.97 * len([r for r in was if r.doc_id in good])
        if name == "near_duplicates":
            ids = sorted({r.doc_id for r in was})
            text = {r.doc_id: r.text for r in was}
            codes = np.array([plain_fingerprint(text[i]) for i in ids], np.uint64)
            label = smallest_reachable(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3)
            assert Counter(r.doc_id for r in now) == Counter(i for k, i in enumerate(ids) if label[k] == k)
        if name == "source_mix":
            assert max(Counter(r.doc_id for r in now).values()) <= 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, SF_SMALL)
    ids = Counter(r.doc_id for r in kept.collect())
    total = {r.doc_id: r.n for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    whole = {r.doc_id: r.doc_tokens for r in pieces.select("doc_id", "doc_tokens").distinct().collect()}
    assert total == {d: n * whole[d] for d, n in ids.items()}


def test_stages_on_an_empty_table(spark):
    docs = load(spark, SF_SMALL, "documents").where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL)
    assert docs.count() == 0


def test_thresholds_of_the_filters(spark):
    docs = load(spark, SF_SMALL, "documents")
    found = langid.identify(docs, langid.learn(docs)).collect()
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, SF_SMALL).collect()}
    assert {r.doc_id for r in found if r.score >= 0.55} <= kept
    assert quality.BINS == 8


def test_near_duplicates_keep_a_row_of_each_group_whatever_its_ids(spark):
    schema = load(spark, SF_SMALL, "documents").schema
    words = [" ".join(f"{w}{i}" for i in range(30)) for w in ("apple", "birch", "cedar", "daisy")]
    texts = [(5, words[0]), (7, words[0]),          # copies
             (5, words[1]),                         # another text under the same id
             (None, words[2]), (None, words[2]),    # copies without an id
             (None, words[3]), (9, words[3])]       # a null id gives way
    fixed = {"doc_id": 0, "text": 1}
    rows = [tuple(t[fixed[f.name]] if f.name in fixed else None for f in schema) for t in texts]
    want = Counter([(5, words[0]), (5, words[1]), (None, words[2]), (9, words[3])])
    for order in (rows, rows[::-1]):
        kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(order, schema), SF_SMALL)
        assert Counter((r.doc_id, r.text) for r in kept.collect()) == want
