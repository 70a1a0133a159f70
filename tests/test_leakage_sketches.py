"""Leakage, ordered target statistics, sketches, and the mended edges of ranking, metrics and ARFF."""

import random

import pytest
from pyspark.sql import functions as F

from tablewright.operators import catalog as CA
from tablewright.operators import evaluate as EV
from tablewright.operators import leakage as LK
from tablewright.operators import sketches as SK
from tablewright.operators import target_stats as TS
from tablewright.sources import readers as R


def test_leaked_rows_with_nulls_and_equal_texts(spark):
    schema = "k int, a string, b string"
    train = spark.createDataFrame([(1, "x", None), (2, "1", "23"), (3, "n", "v"), (3, "n", "v")], schema)
    test = spark.createDataFrame([(1, "x", None), (2, "x", "n"), (3, "12", "3"), (4, "n", "v"), (4, "n", "v"), (5, None, "v")], schema)
    got = sorted((r.k, r.in_train) for r in LK.leaked_rows(train, test, ["a", "b"]).collect())
    assert got == [(1, True), (2, False), (3, False), (4, True), (4, True), (5, False)]
    assert not any(r.in_train for r in LK.leaked_rows(train.where("false"), test, ["a", "b"]).collect())
    assert LK.leaked_rows(train, test.where("false"), ["a", "b"]).collect() == []


def test_bitmap_lets_every_member_pass_and_few_others(spark):
    rows = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("h"), "id")
    bits = LK.bitmap(rows.where("id < 1000"), "h")
    kept = {r.id for r in LK.maybe_in(rows, "h", bits).collect()}
    assert set(range(1000)) <= kept and len(kept) < 1010


def test_unseen_categories(spark):
    train = spark.createDataFrame([("a", 1), ("b", None)], "s string, n int")
    test = spark.createDataFrame([("a", 2), ("c", 2), (None, 1)], "s string, n int")
    got = {(r.column_name, r.value, r.n) for r in LK.unseen_categories(train, test, ["s", "n"]).collect()}
    assert got == {("s", "c", 1), ("n", "2", 2)}


def test_ordered_stats_of_a_hot_category(spark):
    import hashlib
    draw = random.Random(2)
    rows = [(k, draw.choice(["hot"] * 8 + ["cold", None]), draw.choice([None, 1.0, 2.0, 5.0])) for k in range(800)]
    df = spark.createDataFrame(rows, "id int, c string, y double").repartition(6)
    got = {r.id: r.stat for r in TS.ordered_target_stats(df, "c", "y", ["id"], prior=2.0, smoothing=3.0, out="stat").collect()}
    seen = {}
    for k, c, y in sorted(rows, key=lambda r: hashlib.md5(f"{r[0]}|42".encode()).hexdigest()):
        total, n = seen.get(c, (0.0, 0))
        assert abs(got[k] - (total + 6.0) / (n + 3.0)) < 1e-9
        seen[c] = (total + (y or 0.0), n + (y is not None))
    means = {r.c: r.target_stat for r in TS.category_means(df, "c", "y", 2.0, 3.0).collect()}
    assert all(abs(means[c] - (t + 6.0) / (n + 3.0)) < 1e-9 for c, (t, n) in seen.items())


def test_sketches_unite(spark):
    df = spark.range(20000).select((F.col("id") % 7000).alias("a"), F.when(F.col("id") % 3 == 0, F.col("id").cast("double")).alias("b"),
                                   (F.col("id") % 2).alias("half"))
    parts = SK.distinct_sketches(df, ["a", "b"], by=["half"])
    assert parts.count() == 4
    got = {r.column_name: r.n_distinct for r in SK.estimates(SK.united(parts)).collect()}
    whole = {r.column_name: r.n_distinct for r in SK.estimates(SK.distinct_sketches(df, ["a", "b"])).collect()}
    for c, exact in (("a", 7000), ("b", 6667)):
        assert abs(got[c] - exact) <= SK.error_bound() * exact and abs(whole[c] - exact) <= SK.error_bound() * exact
    empty = {r.n_distinct for r in SK.estimates(SK.distinct_sketches(df.where("false"), ["a", "b"])).collect()}
    assert empty == {0}


def test_a_group_of_junk_alone_is_kept(spark):
    junk = CA.RANKER_JUNK_SIGNALS[0]
    rows = [("x", 0, f"http://a.org/{junk}/1", "t", 0.5), ("x", 1, "http://b.org/d.csv", "t", 0.4),
            ("y", 2, f"http://c.org/{junk}/2", "t", 0.3), (None, 3, f"http://e.org/{junk}/3", "t", 0.2)]
    df = spark.createDataFrame(rows, "lang string, pos int, url string, title string, score double")
    assert sorted(r.pos for r in CA.rank_diverse(df, group_cols=["lang"]).collect()) == [1, 2, 3]
    assert [r.pos for r in CA.rank_diverse(df).collect()] == [1]
    assert len(CA.rank_diverse(df.where(F.col("pos") != 1)).collect()) == 3


def test_metrics_leave_rows_without_both_values_out(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0), (100.0, None), (None, 7.0)], "y double, p double")
    full = EV.regression_metrics(df.where("y IS NOT NULL AND p IS NOT NULL"), "y", "p").first()
    assert EV.regression_metrics(df, "y", "p").first() == full
    many = spark.range(1100).select(F.col("id").cast("string").alias("a"), F.col("id").cast("string").alias("b"))
    with pytest.raises(ValueError):
        EV.confusion_matrix(many, "a", "b")


def test_arff_rows_that_repeat_header_lines_are_data(spark, tmp_path):
    text = "free\n@relation r\n@attribute a string\n@attribute b string\n@DATA\n@relation r\nx,y\n@data\nfree\n% no\n\nz,?\n"
    (tmp_path / "t.arff").write_text(text)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    for size in ("128m", "16"):
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = [tuple(r) for r in R.read_arff(spark, str(tmp_path / "t.arff")).collect()]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
            spark.conf.set("spark.sql.files.openCostInBytes", was[1])
        assert sorted(got) == [("@data", None), ("@relation r", None), ("free", None), ("x", "y"), ("z", None)]
