"""Hard rejects (QUAL8), idea-vs-data keyword check (QUAL10), curated lookup (CAT2) and the
knowledge-base intent (CAT1) against rows worked by hand; and the scale rewrites (input spreading, one-pass cleaning decisions) against the plain forms."""

from __future__ import annotations

import pytest


# (text, best key, score, links) worked by hand: one point for each word of the key among the
# text's space-separated words, two more if the key stands in the text as a phrase
LOOKUPS = [
    ("Predict HEART disease from records", "heart disease", 4, 2),      # 2 words + phrase; "heart" has 1 + 2
    ("heart\u00a0disease", "heart", 3, 2),             # a no-break space divides words and breaks the phrase
    ("house prices in boston", "house prices", 4, 2),
    ("parkinsons voice data", "parkinsons", 3, 1),
    ("the customer, churn", "churn", 3, 1),            # "customer," is no word, so "customer churn" has 1
    ("nothing to see here", None, 0, 0),
    ("", None, 0, 0),
    (None, None, 0, 0),
    ("iris flower petals iris", "iris", 3, 2),         # a repeated word counts once
    ("telecom churn customer churn", "customer churn", 4, 1),
]


def test_verified_lookup_of_worked_texts(spark):
    from tablewright.operators.verified import VERIFIED_CATALOG, verified_lookup
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(LOOKUPS)], "id long, text string")
    got = sorted((r["id"], r["dataset_key"], r["match_score"], r["link_rank"], r["url"])
                 for r in verified_lookup(df, ["id"], "text").collect())
    urls = dict(VERIFIED_CATALOG)
    assert got == [(i, key, score, at + 1, urls[key][at])
                   for i, (_, key, score, links) in enumerate(LOOKUPS) for at in range(links)]


def test_verified_lookup_fields(spark):
    from tablewright.operators.verified import verified_lookup
    df = spark.createDataFrame([(1, "wine tasting")], "id long, text string")
    r = verified_lookup(df, ["id"], "text").first()
    assert r["title"] == "Verified: wine"
    assert r["snippet"] == "Verified working dataset for 'wine'"
    assert r["score"] == pytest.approx(0.60)


def _signals(spark, schemas, sample=""):
    from tablewright.operators.relevance import attach, schema_signals
    out = None
    for name, cols, n in schemas:
        df = spark.createDataFrame([tuple(f"v{i}" for i in range(len(cols)))] * n,
                                   ", ".join(f"`{c}` string" for c in cols))
        row = schema_signals(df, name, with_sample=False)
        row = attach(row, spark.range(1).selectExpr(f"'{sample}' AS sample_text"))
        out = row if out is None else out.unionByName(row)
    return out


def test_hard_rejects(spark):
    from tablewright.operators.relevance import hard_rejects
    sig = _signals(spark, [
        ("catalog", ["Package", "Item", "Title", "Rows", "Cols", "n_binary"], 30),
        ("ufo", ["datetime", "city", "shape reported", "colors reported"], 30),
        ("geo", ["longitude", "latitude", "elevation"], 30),
        ("tiny", ["a", "b"], 19),
        ("narrow", ["a"], 25),
        ("ok", ["age", "income", "label"], 20),
    ])
    got = {r["table_name"]: r for r in hard_rejects(sig).collect()}
    assert got["catalog"]["reject_reason"] == "junk: R dataset catalog" and got["catalog"]["catalog_file"]
    assert got["ufo"]["reject_reason"] == "junk: UFO sightings"      # spaces become underscores
    assert got["ufo"]["wrong_pattern"] and not got["ufo"]["catalog_file"]
    assert got["geo"]["wrong_pattern"] and not got["geo"]["rejected"]
    assert got["tiny"]["reject_reason"] == "too small"
    assert got["narrow"]["reject_reason"] == "too few columns"
    assert not got["ok"]["rejected"]


def test_keyword_match(spark):
    from tablewright.operators.relevance import keyword_match
    sig = _signals(spark, [
        ("weather", ["temperature", "humidity", "wind_speed", "station"], 30),
        ("catalog", ["name", "rows", "columns", "source"], 30),
        ("knees", ["knee_angle", "pain"], 30),
        ("values", ["a", "b"], 30),
    ], sample="x stars y")
    idea = "Predict knee pain from stars data"
    got = {r["table_name"]: r for r in keyword_match(sig, idea).collect()}
    assert got["knees"]["idea_words"] == "knee pain stars"
    assert got["knees"]["verdict"] == "keyword in columns" and got["knees"]["is_relevant"]
    assert got["catalog"]["verdict"] == "catalog file" and not got["catalog"]["is_relevant"]
    # the sample holds "stars": accepted through the values
    assert got["values"]["verdict"] == "keyword in values"
    sig2 = _signals(spark, [("weather", ["temperature", "humidity", "wind_speed", "station"], 30)], sample="")
    w = keyword_match(sig2, "predict knee pain").first()
    assert (w["is_relevant"], w["warning"]) == (False, "looks like a weather dataset")
    w = keyword_match(sig2, "predict weather knee pain").first()
    assert w["warning"] == "no idea keyword in columns"
    assert keyword_match(sig2, "predict the model").first()["verdict"] == "no idea keywords"


# (idea, key, score, queries after the key's own) worked by hand: a trigger found in the idea
# gives 1 (a mere 5-letter stem 0.5), 0.5 more if it has several words; each word of the idea
# gives 0.3 for every trigger that holds it
INTENTS = [
    # "heart disease" 1.5, stem "heart" 0.5; "heart" in 2 triggers and "disease" in 1: 0.9
    ("predict heart disease from patient records", "heart_disease", 2.9,
     ["heart disease patient dataset csv", "heart disease classification dataset"]),
    # nothing but "text" (stem of "text sentiment" is "text ": 1.0) and its word 0.3
    ("a text about nothing in particular", "imdb_sentiment", 1.3,
     ["text about nothing dataset csv", "text about classification dataset"]),
    ("", "generic_tabular", 0.0, []),
    (None, "generic_tabular", 0.0, []),
]


def test_semantic_intent_of_worked_ideas(spark):
    from tablewright.operators.semantic import KNOWLEDGE_BASE, semantic_intent
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(INTENTS)], "id long, text string")
    got = {r["id"]: r for r in semantic_intent(df, ["id"], "text").collect()}
    for i, (_, key, score, added) in enumerate(INTENTS):
        entry, r = KNOWLEDGE_BASE[key], got[i]
        assert (r["dataset_key"], round(r["score"], 9), r["task"]) == (key, score, entry["task"])
        assert r["search_queries"] == "|".join([*entry["queries"], *added])
        assert (r["direct_urls"], r["expected_cols"]) == ("|".join(entry["urls"]), ",".join(entry["columns"]))


def test_semantic_index_places_and_owners():
    from tablewright.operators.semantic import index_rows
    rows = {term: (at, key, w) for at, term, key, w in index_rows()}
    assert rows["parkinson"] == (0, "parkinson_disease", 1.0) and rows["parki"] == (1, "parkinson_disease", 0.5)
    assert rows["heart disease"][1:] == ("heart_disease", 1.5) and rows["text "][1:] == ("imdb_sentiment", 1.0)
    assert rows["churn"][1:] == ("customer_churn", 1.0)         # a trigger, though it is also a stem


def test_semantic_match_needs_no_join(spark, capsys):
    from tablewright.operators.semantic import semantic_match
    semantic_match(spark.createDataFrame([(1, "x")], "id long, text string"), ["id"], "text").explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and "Exchange" not in plan


def test_spread_follows_the_bytes_of_a_table(spark):
    from conftest import SF_ORACLE, SF_SMALL
    from tablewright.sources.readers import spread
    small = spark.read.parquet(f"{SF_SMALL}/region.parquet")
    assert spread(small).rdd.getNumPartitions() == small.rdd.getNumPartitions()
    large = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").coalesce(1)
    out = spread(large)
    assert 1 < out.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert out.exceptAll(large).isEmpty() and large.exceptAll(out).isEmpty()


def test_missing_decisions_match_profile(spark):
    from tablewright.operators import clean as C
    from tablewright.operators.profile import column_profile
    from tablewright.plans.derived import dirty_orders, table
    from conftest import SF_SMALL
    df = dirty_orders(table(spark, SF_SMALL, "orders"))
    got = {r["column_name"]: (r["n_non_null"], r["keep"]) for r in C.missing_decisions(df).collect()}
    cp = column_profile(df, text_stats=False).collect()
    want = {r["column_name"]: (r["n_non_null"], r["n_non_null"] >= int(r["n_rows"] * (1 - 0.6))) for r in cp}
    assert got == want


def test_clean_dataset_equals_step_by_step(spark):
    """The fused decisions give the same table as running the helpers one after another."""
    from tablewright.operators import clean as C
    from tablewright.plans.derived import dirty_orders, table
    from conftest import SF_SMALL
    df = dirty_orders(table(spark, SF_SMALL, "orders"))
    fused = C.clean_dataset(df)
    step = C.dedup_rows(C.drop_high_missing(C.strip_quotes_all(df)))
    step = C.fill_mode(C.fill_median(C.coerce_numeric(step)))
    assert fused.columns == step.columns
    assert [f.dataType for f in fused.schema.fields] == [f.dataType for f in step.schema.fields]
    assert sorted(map(tuple, fused.collect())) == sorted(map(tuple, step.collect()))


def test_pipeline_tfidf_stage_matches_relational(spark):
    """The pipeline's TF-IDF stage (vector per row) equals the relational TF-IDF weights."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    from tablewright.operators import tfidf as TF
    from tablewright.operators.ml_stages import SmoothTfidf
    texts = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "Émile's café is open",
             "", None, "cat cat cat dog"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = SmoothTfidf(inputCol="text", outputCol="v").fit(docs)
    vocab = model.getOrDefault(model.vocabulary)
    got = {}
    for r in model.transform(docs).select("doc_id", vector_to_array("v").alias("a")).collect():
        for i, w in enumerate(r["a"]):
            if w != 0:
                got[(r["doc_id"], vocab[i])] = round(w, 9)
    rel = TF.tfidf(docs, "doc_id", "text").select("doc_id", "term", F.round("weight", 9).alias("w")).collect()
    assert got == {(r["doc_id"], r["term"]): r["w"] for r in rel}
