"""Sources, sinks, streaming and model round-trips."""

import os
import tempfile

from pyspark.sql import functions as F

from tablewright.sources import readers as R


def _tmp():
    return tempfile.mkdtemp(prefix="tw-test-", dir="/tmp")


def test_csv_separators_and_json_array(spark):
    d = _tmp()
    for sep, name in [(",", "a.csv"), (";", "b.csv"), ("|", "c.csv"), ("\t", "d.csv")]:
        with open(os.path.join(d, name), "w") as f:
            f.write(f"x{sep}y\n1{sep}u\n2{sep}v\n")
        df = R.read_any(spark, os.path.join(d, name))
        assert df.columns == ["x", "y"] and df.count() == 2
    p = os.path.join(d, "r.json")
    with open(p, "w") as f:
        f.write('[{"a": 1, "b": "x"},\n {"a": 2, "b": "y"}]')
    assert sorted(r["a"] for r in R.read_any(spark, p).collect()) == [1, 2]


def test_csv_line_break_past_the_sniffed_bytes(spark):
    d, n = _tmp(), 6000
    p = os.path.join(d, "late.csv")
    with open(p, "w") as f:
        f.write("k,name,v\n" + "".join(f'{i},"a ""plain"", row",{i}\n' for i in range(n)))
        assert f.tell() > R.SNIFF_BYTES
        f.write(f'{n},"first ""x""\nsecond, line",{n}\n{n + 1},last,{n + 1}\n')
    df = R.read_any(spark, p)
    rows = {r["k"]: r for r in df.collect()}
    assert df.count() == len(rows) == n + 2 and dict(df.dtypes)["k"] == "int"
    assert rows[n]["name"] == 'first "x"\nsecond, line' and all(r["v"] == k for k, r in rows.items())
    os.makedirs(os.path.join(d, "parts.csv"))
    for name, text in (("a", "k,name\n1,x\n"), ("b", 'k,name\n2,"y\nz"\n')):
        with open(os.path.join(d, "parts.csv", name + ".csv"), "w") as f:
            f.write(text)
    assert sorted(map(tuple, R.read_any(spark, os.path.join(d, "parts.csv")).collect())) == [(1, "x"), (2, "y\nz")]


def test_arff_by_content_with_csv_suffix(spark):
    d = _tmp()
    p = os.path.join(d, "weka.csv")
    with open(p, "w") as f:
        f.write("% comment\n@relation w\n@attribute 'a' numeric\n@attribute b string\n\n@data\n"
                "1,'x'\n?,y\n% trailing comment\n3,N/A\n")
    df = R.read_any(spark, p)
    rows = df.collect()
    assert df.columns == ["a", "b"]
    assert [r["a"] for r in rows] == [1.0, None, 3.0] and [r["b"] for r in rows] == ["x", "y", None]


def test_arff_header_longer_than_the_sniffed_bytes(spark):
    import pytest
    d, n = _tmp(), 400
    p = os.path.join(d, "wide.arff")
    with open(p, "w") as f:
        f.write("@relation wide\n" + "% a long preamble, \u00e4\n" * 6000)
        f.write("".join(f"@attribute 'attribute number {i}' numeric\n" for i in range(n)))
        assert f.tell() > 2 * R.SNIFF_BYTES
        f.write("@data\n" + "\n".join(",".join(str(i + r) for i in range(n)) for r in range(3)) + "\n")
    df = R.read_any(spark, p)
    assert df.columns == [f"attribute number {i}" for i in range(n)]
    assert sorted((r[0], r[n - 1]) for r in df.collect()) == [(float(r), float(r + n - 1)) for r in range(3)]
    p = os.path.join(d, "cut.arff")
    with open(p, "w") as f:
        f.write("@relation cut\n@attribute a numeric\n")
    with pytest.raises(ValueError, match="@data"):
        R.read_any(spark, p)


def test_headerless_whitespace_data(spark):
    d = _tmp()
    p = os.path.join(d, "w.data")
    with open(p, "w") as f:
        f.write("1 2 3\n4 5 6\n")
    df = R.read_any(spark, p)
    assert df.columns == ["0", "1", "2"] and df.count() == 2


def test_unknown_suffix_raises(spark):
    import pytest
    d = _tmp()
    p = os.path.join(d, "x.bin")
    with open(p, "w") as f:
        f.write("a,b\n1,2\n")
    with pytest.raises(ValueError):
        R.read_any(spark, p)


def test_streaming_matches_batch(spark):
    from tablewright.operators import text_rules as TR
    from tablewright.streaming import rowwise as SW
    from conftest import SF_SMALL
    stream = SW.read_stream(spark, f"{SF_SMALL}/benchmark.parquet")
    path = SW.run_to_table(SW.classify_texts(stream, ["item_id"], "text"), "test")
    got = spark.read.parquet(path).orderBy("item_id").collect()
    batch = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select(
        "item_id", TR.rule_task(F.col("text")).alias("task_type")).orderBy("item_id").collect()
    assert [r["task_type"] for r in got] == [r["task_type"] for r in batch]


def test_pipeline_save_load_same_predictions(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    out = E.queries()["snk_pipeline_roundtrip"](spark, SF_SMALL)
    assert out.count() > 0 and out.where(~F.col("same")).count() == 0
