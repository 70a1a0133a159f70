"""Properties of the distributed algorithms, checked against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions import stats as ST
from tablewright.operators import features as FE
from tablewright.operators import split as SP


def test_split_exact_disjoint_and_stratified(spark):
    rows = [(i, "a" if i % 3 else ("b" if i % 2 else "c")) for i in range(1001)]
    df = spark.createDataFrame(rows, "k long, y string")
    s = SP.train_test_split(df, ["k"], label="y").cache()
    assert s.count() == 1001 and s.select("k").distinct().count() == 1001
    n_test = s.where("split = 'test'").count()
    assert n_test == 201   # ceil(0.2 * 1001)
    counts = {r["y"]: r["count"] for r in s.where("split = 'train'").groupBy("y").count().collect()}
    total = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
    want = SP.largest_remainder(total, 1001 - 201)
    assert counts == want
    # independent of the input partitioning
    s2 = SP.train_test_split(df.repartition(7), ["k"], label="y")
    assert sorted(r[0] for r in s.where("split='test'").select("k").collect()) == \
        sorted(r[0] for r in s2.where("split='test'").select("k").collect())


def test_sample_exact_count(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    assert SP.sample_exact(df, 777, ["k"]).count() == 777
    assert SP.sample_exact(df, 9999, ["k"]).count() == 5000


@pytest.mark.parametrize("limit", [ST.CANDIDATE_LIMIT, 50])
def test_exact_median_matches_numpy(spark, monkeypatch, limit):
    monkeypatch.setattr(ST, "CANDIDATE_LIMIT", limit)
    rng = np.random.default_rng(0)
    for n in (999, 1000):
        x = np.round(rng.lognormal(size=n), 3)
        df = spark.createDataFrame(pd.DataFrame({"x": x}))
        assert ST.exact_median(df, "x") == pytest.approx(float(np.median(x)))
        assert ST.exact_medians(df, ["x"])["x"] == pytest.approx(float(np.median(x)))


def test_ordered_codes_dense_and_sorted(spark):
    vals = [f"v{i:04d}" for i in range(0, 3000, 3)] * 2
    df = spark.createDataFrame([(v,) for v in vals], "c string")
    codes = ST.ordered_codes(df, "c").orderBy("code").collect()
    assert [r["code"] for r in codes] == list(range(1000))
    assert [r["c"] for r in codes] == sorted(set(vals))


def test_rank_within_matches_row_number_with_hot_key(spark):
    rows = [(0 if i % 3 == 0 else i % 50, i) for i in range(3000)]   # entity 0 holds a third
    df = spark.createDataFrame(rows, "e int, t int")
    got = FE.rank_within(df, "e", ["t"]).select("e", "t", "_rn")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("e").orderBy("t")))
    assert got.join(want, ["e", "t"]).where("_rn != rn").count() == 0
    assert got.count() == 3000


def test_sequence_windows_brute_force_with_halo(spark):
    rows = [(0 if i % 3 == 0 else i % 5, i, float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "e int, t int, v double")
    got = FE.sequence_windows(df, "e", ["t"], ["v"], "v", window=4, chunk=7)
    got = {(r["e"], r["position"]): ([s["v"] for s in r["seq"]], r["target"]) for r in got.collect()}
    pdf = pd.DataFrame(rows, columns=["e", "t", "v"]).sort_values(["e", "t"])
    want = {}
    for e, g in pdf.groupby("e"):
        vs = g["v"].tolist()
        for i in range(4, len(vs)):
            want[(e, i + 1)] = (vs[i - 4:i], vs[i])
    assert got == want


def test_top_k_per_group_brute_force(spark):
    rows = [(0 if i % 2 else i % 9, float((i * 37) % 101), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, s double, p int")
    got = ST.top_k_per_group(df, ["g"], [F.col("s").desc(), F.col("p")], 3, "r")
    got = sorted((r["g"], r["r"], r["p"]) for r in got.collect())
    pdf = pd.DataFrame(rows, columns=["g", "s", "p"]).sort_values(["g", "s", "p"], ascending=[True, False, True])
    want = sorted((g, i + 1, p) for g, grp in pdf.groupby("g") for i, p in enumerate(grp["p"].head(3)))
    assert got == want


def test_scaler_fit_on_train_only(spark):
    train = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "x double")
    test = spark.createDataFrame([(100.0,)], "x double")
    fit = FE.fit_standard_scaler(train, ["x"])
    out = [r[0] for r in FE.apply_standard_scaler(train, fit).collect()]
    assert np.mean(out) == pytest.approx(0.0) and np.std(out) == pytest.approx(1.0)
    assert fit.medians["x"] == 2.0
    t = FE.apply_standard_scaler(test, fit).first()[0]
    assert t == pytest.approx((100.0 - fit.means["x"]) / fit.stds["x"])


def test_encode_decode_identity(spark):
    df = spark.createDataFrame([(i, ["'x'", "y", "z "][i % 3]) for i in range(30)], "k int, t string")
    codes = FE.target_codes(df, "t")
    enc = FE.encode_target(df, "t", "classification", codes=codes)
    dec = FE.decode_target(enc, codes, col="y").orderBy("k").collect()
    assert [r["label"] for r in dec] == [["x", "y", "z"][i % 3] for i in range(30)]
    assert sorted({r["y"] for r in enc.collect()}) == [0.0, 1.0, 2.0]


def test_ordinal_unknown_is_minus_one(spark):
    train = spark.createDataFrame([("a",), ("b",)], "c string")
    test = spark.createDataFrame([("b",), ("zz",)], "c string")
    out = [r[0] for r in FE.ordinal(test, "c", FE.fit_ordinal(train, "c")).collect()]
    assert sorted(out) == [-1.0, 1.0]


def test_split_narrows_large_edges(spark, monkeypatch):
    df = spark.range(5000).withColumn("y", F.when(F.col("id") % 10 == 0, "a").otherwise("b"))
    want = sorted(map(tuple, SP.train_test_split(df, ["id"], label="y").collect()))
    monkeypatch.setattr(SP, "HASH_DIGITS", 1)
    monkeypatch.setattr(SP, "EDGE_ROWS", 3)
    assert sorted(map(tuple, SP.train_test_split(df, ["id"], label="y").collect())) == want
    assert SP.sample_exact(df, 0, ["id"]).count() == 0 and SP.sample_exact(df, 9999, ["id"]).count() == 5000
    same = spark.createDataFrame([(1,)] * 40, "k int")          # equal hashes: one prefix to the end
    assert SP.sample_exact(same, 7, ["k"]).count() == 7
