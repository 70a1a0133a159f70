"""Threshold edges on tiny literal frames (SURVEY section 5 (1))."""

import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.functions import stats as ST
from tablewright.operators import clean as C
from tablewright.operators import coltypes as TY
from tablewright.operators import profile as P
from tablewright.operators import quality as Q


def _types(df, target=None):
    return {r["column_name"]: (r["col_type"], r["encoder"]) for r in TY.classify_columns(df, target).collect()}


def test_missing_over_90_percent_is_dropped(spark):
    rows = [(i, None if i < 91 else 1.0, None if i < 90 else 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, a double, b double")
    t = _types(df)
    assert t["a"][0] == "drop"          # 91 % missing
    assert t["b"][0] == "numeric"       # exactly 90 % is kept


def test_ohe_vs_ordinal_at_50_categories(spark):
    rows = [(i, f"c{i % 50}", f"d{i % 51}") for i in range(2000)]
    t = _types(spark.createDataFrame(rows, "k int, a string, b string"))
    assert t["a"] == ("categorical", "ohe")
    assert t["b"] == ("categorical", "ordinal")


def test_id_ratio_boundary(spark):
    # 95 distinct of 100 -> ratio 0.95 is not > 0.95; 96 distinct is
    a = [f"v{min(i, 94)}" for i in range(100)]
    b = [f"v{min(i, 95)}" for i in range(100)]
    t = _types(spark.createDataFrame(list(zip(range(100), a, b)), "k int, a string, b string"))
    assert t["a"][0] == "categorical"
    assert t["b"][0] == "id"


def test_task_from_target_20_vs_21(spark):
    df20 = spark.createDataFrame([(i % 20,) for i in range(100)], "y int")
    df21 = spark.createDataFrame([(i % 21,) for i in range(100)], "y int")
    assert TY.detect_task(df20, "y").first()["task_type"] == "classification"
    assert TY.detect_task(df21, "y").first()["task_type"] == "regression"


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "c string")
    out = C.fill_mode(df).collect()
    assert [r[0] for r in out].count("a") == 3


def test_skew_needs_three_values_and_constant_is_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "a double, b double")
    sk = {r["column_name"]: r["skew"] for r in P.skewed_columns(df).collect()}
    assert sk["a"] is None and sk["b"] is None
    df3 = spark.createDataFrame([(5.0,), (5.0,), (5.0,)], "b double")
    assert P.skewed_columns(df3).first()["skew"] == 0.0


def test_nan_counts_as_missing_and_nonfinite_to_zero(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (float("inf"),), (None,)], "x double")
    cp = P.column_profile(df).first()
    assert cp["n_null"] == 2 and cp["n_unique"] == 2
    vals = sorted(r[0] for r in C.nonfinite_zero_all(df).where(F.col("x").isNotNull()).collect())
    assert vals == [0.0, 0.0, 1.0]


def test_quality_small_table_issues(spark):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    r = Q.quality_report(df, "v").first()
    assert "too_few_rows" in r["issues"] and "target_single_value" in r["issues"]
    assert not r["is_valid"]
    with pytest.raises(RuntimeError):
        Q.validate(df, "v")


def test_zero_row_frame(spark):
    df = spark.createDataFrame([], "k int, v string")
    r = Q.quality_report(df).first()
    assert r["num_rows"] == 0 and "empty" in r["issues"]


def test_quality_score_formula(spark):
    row = spark.range(1).select(Q.score_expr(F.lit(2000), F.lit(0.1), F.lit(0.05), F.lit(1), F.lit(4),
                                             F.lit(5.0)).alias("s")).first()
    expect = 100 - min(0.1 * 60, 30) - min(0.05 * 40, 20) - min(1 / 4 * 30, 15) - min(5.0 / 50 * 15, 15) - 10
    assert row["s"] == round(max(expect, 0.0), 1)


def test_numeric_strings_guard(spark):
    df = spark.createDataFrame([("1.0d",), ("1_000",), ("nan",), (" 3 ",), ("1e5",), ("-.5",)], "s string")
    out = [r[0] for r in C.coerce_numeric(df, ["s"]).collect()]
    assert out[:3] == [None, None, None] and out[3:] == [3.0, 1e5, -0.5]


def test_date_strings_and_parts(spark):
    from tablewright.operators import features as FE
    df = spark.createDataFrame([("2024-01-05",), ("01/02/2024",), ("2013",), ("x",)], "d string")
    out = FE.datetime_parts(df, ["d"]).collect()
    assert (out[0]["d_year"], out[0]["d_month"], out[0]["d_day"]) == (2024, 1, 5)
    assert (out[1]["d_year"], out[1]["d_month"], out[1]["d_day"]) == (2024, 1, 2)
    assert out[2]["d_year"] == 0 and out[3]["d_year"] == 0


def test_detect_target_on_reference_schemas(spark):
    schemas = {
        "titanic": (["survived", "pclass", "name", "sex", "age", "sibsp", "parch", "fare", "cabin", "embarked"], "survived"),
        "iris": (["sepal_length", "sepal_width", "petal_length", "petal_width", "species"], "species"),
        "fraud": (["time", "v1", "v2", "v3", "amount", "class"], "class"),
        "diabetes": (["pregnancies", "glucose", "bloodpressure", "skinthickness", "insulin", "bmi",
                      "diabetespedigreefunction", "age", "outcome"], "outcome"),
    }
    for _, (cols, want) in schemas.items():
        df = spark.createDataFrame([tuple(f"{i}" for i in range(len(cols)))], ", ".join(f"{c} string" for c in cols))
        r = TY.detect_target(df).first()
        assert (r["target"], r["confidence"]) == (want, "high")


def test_junk_schema_rejects_catalog_file(spark):
    from tablewright.operators.catalog import junk_schema
    df = spark.createDataFrame([(["package", "item", "title", "rows", "cols", "n_binary"],), (["age", "fare"],)],
                               "columns array<string>")
    flags = [r["is_junk"] for r in junk_schema(df).collect()]
    assert flags == [True, False]


def test_value_summary_orders_whole_values_that_share_a_long_beginning(spark):
    from tablewright.operators.profile import value_summary
    long = ["x" * 40 + f"{i:02d}" for i in range(14)]
    rows = [(v, f"s{i % 3}", None) for i, v in enumerate(long * 2)] + [("a", "s0", None), (None, None, None)]
    df = spark.createDataFrame(rows, "t string, s string, n string").repartition(4)
    got = {r["column_name"]: r for r in value_summary(df).collect()}
    assert got["t"]["options"] is None and got["t"]["examples"] == "|".join(["a", *long[:4]])
    assert got["s"]["options"] == "s0|s1|s2" and not got["n"]["options"] and got["n"]["examples"] is None
    few = {r["column_name"]: r for r in value_summary(df.where("t is null or t < 'xx' or t like '%05'")).collect()}
    assert few["t"]["options"] == "a|" + long[5]


def _modes_by_loop(rows, columns):
    out = {}
    for i, c in enumerate(columns):
        counts = Counter(r[i] for r in rows if r[i] is not None)
        if counts:
            out[c] = min(counts.items(), key=lambda e: (-e[1], e[0].encode()))
    return out


def test_modes_of_long_values(spark):
    same = "x" * ST.HEAD                                # a beginning that many values share
    rows = [(same + f"{i:03}" * 50, same + "b" if i % 3 else same + "a" * 300, same, None, f"{i % 4}") for i in range(60)]
    rows += [(None, same + "a" * 300, same[:-1], None, None)] * 25
    rows += [("\u00e9" * 200, "", same + "!", None, "\U0001f600" * ST.HEAD)] * 1
    columns = ["ties", "long_wins", "exactly_head", "nothing", "short"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)).repartition(4)
    got = {r["column_name"]: (r["mode"], r["mode_count"]) for r in ST.column_modes(df, columns).collect()}
    assert got == _modes_by_loop(rows, columns)
    assert got["ties"] == (same + "000" * 50, 1) and got["long_wins"][0] == same + "a" * 300 and "nothing" not in got


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(*[st.one_of(st.none(), st.text("ab", max_size=5))] * 2), max_size=25))
def test_modes_equal_a_loop(spark, rows):
    tried, head = [(r[0] and r[0] * 2, r[1]) for r in rows], ST.HEAD
    ST.HEAD = 2                                         # most values are longer than their key
    try:
        df = spark.createDataFrame(tried, "a string, b string")
        got = {r["column_name"]: (r["mode"], r["mode_count"]) for r in ST.column_modes(df, ["a", "b"]).collect()}
    finally:
        ST.HEAD = head
    assert got == _modes_by_loop(tried, ["a", "b"])


def test_medians_count_a_slice_around_the_middle_only(spark, monkeypatch):
    """Every distinct value of a column was shuffled and kept before."""
    import statistics

    from tablewright.functions import stats as ST
    rng = random.Random(7)
    values = [(rng.gauss(0, 1), float(rng.randint(0, 3)), None if i % 3 else rng.random(), None, float("nan") if i % 2 else float(i))
              for i in range(20_000)]
    df = spark.createDataFrame(values, "a double, b double, c double, d double, e double")
    want = [statistics.median(x for x in column if x is not None and x == x) if any(x is not None for x in column) else None
            for column in zip(*values)]
    seen, plain = [], ST._medians_around
    monkeypatch.setattr(ST, "_medians_around", lambda df, x, rows, around, out: seen.append(around) or plain(df, x, rows, around, out))
    assert list(ST.exact_medians(df, df.columns).values()) == want
    lo, hi = seen[0]["a"]
    assert sum(lo <= v[0] <= hi for v in values) < 200 and not seen[1]
    monkeypatch.setattr(ST, "CANDIDATE_LIMIT", 5)
    assert list(ST.exact_medians(df, df.columns).values()) == want
    monkeypatch.setattr(ST, "MIDDLE", (0.8, 0.9))       # a range that misses the middle
    assert list(ST.exact_medians(df, df.columns).values()) == want and "a" in seen[-1]


def test_target_stats_parts_grow_in_number_with_the_rows(spark, monkeypatch):
    from tablewright.operators import target_stats as TS
    monkeypatch.setattr(TS, "PART_ROWS", 20)
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", None]), None if i % 5 == 0 else float(i % 13)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, c string, y double")
    out = TS.ordered_target_stats(df, "c", "y", ["id"], prior=2.0)
    assert out.rdd.getNumPartitions() >= 400 // 20
    order = {r.id: r.p for r in df.select("id", TS.place(["id"], 42).alias("p")).collect()}
    for id_, c, _, got in out.collect():
        past = [y for i, k, y in rows if k == c and order[i] < order[id_] and y is not None]
        assert abs(got - (sum(past) + 2.0) / (len(past) + 1)) < 1e-9


def test_tfidf_counts_bigrams_of_frequent_words_only(spark, monkeypatch):
    from tablewright.functions.text import bigrams_of, tokens, with_bigrams
    from tablewright.operators import tfidf as TF
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=40)) for _ in range(80)] + [None, "", "w1 w1 w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    toks = tokens(F.col("t"))
    got = docs.select(bigrams_of(toks, ["w0", "w1"]).alias("b"), with_bigrams(toks).alias("all")).collect()
    for r in got:
        assert r.b == [x for x in r["all"] if " " in x and set(x.split()) <= {"w0", "w1"}]
    totals = {}
    for r in got:
        for x in r["all"]:
            totals[x] = totals.get(x, 0) + 1
    for k in (1, 20, 60, 5000):
        want = sorted(totals, key=lambda x: (-totals[x], x))[:k]
        assert sorted(r.term for r in TF.top_terms(docs, "id", "t", k).collect()) == sorted(want)
    asked = []
    monkeypatch.setattr(TF, "bigrams_of", lambda toks, of: asked.append(len(of)) or bigrams_of(toks, of))
    TF.tfidf(docs, "id", "t", 20).collect()
    assert asked and max(asked) < 40
