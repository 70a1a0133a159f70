"""CSV records split by split against Python's csv module and Spark's own reader."""

import csv
import io
import random

import numpy as np
import pyarrow as pa
import pytest

from tablewright.sources import csv_records as C
from tablewright.sources import readers as R


def simple_states(lines, sep, begin):
    """Character by character: the state after each line."""
    out, state = [], "quoted" if begin else "start"
    for line in lines:
        k = 0
        while k < len(line):
            c = line[k]
            if state == "quoted":
                if c == '"':
                    if line[k + 1:k + 2] == '"':
                        k += 1
                    else:
                        state = "text"
            elif c == sep:
                state = "start"
            elif c == '"' and state == "start":
                state = "quoted"
            else:
                state = "text"
            k += 1
        if state != "quoted":
            state = "start"
        out.append(int(state == "quoted"))
    return out


@pytest.mark.parametrize("sep", [",", "|", "\t"])
def test_line_steps_equal_a_scan_by_characters(sep):
    draw = random.Random(sep)
    lines = ["".join(draw.choice(['"', '"', sep, "a", " "]) for _ in range(draw.randint(0, 9))) for _ in range(4000)]
    f = C.steps(pa.array(lines), C.step_patterns(sep))
    for line, step in zip(lines, f.tolist()):
        ends = tuple(simple_states([line], sep, s)[0] for s in (0, 1))
        assert ends == {C.STAY: (0, 1), C.SWAP: (1, 0), C.OUTSIDE: (0, 0), C.INSIDE: (1, 1)}[step], line
    for begin in (0, 1):
        assert C.states(f, begin).tolist() == simple_states(lines, sep, begin)


def dirty(n, seed):
    draw = random.Random(seed)
    words = ["plain", 'say ""hi""', "two\nlines", "a,b", '5"" pipe', "", "x\n\ny", "é" * 40, "\n", '""']
    return [(k, draw.choice(words).replace('""', '"'), draw.choice(words).replace('""', '"'), k / 4) for k in range(n)]


def write(path, rows, header=True, newline="\n"):
    out = io.StringIO()
    w = csv.writer(out, quoting=csv.QUOTE_MINIMAL, lineterminator=newline)
    if header:
        w.writerow(["id", "first, name", "second", "amount"])
    w.writerows(rows)
    path.write_text(out.getvalue(), newline="")


def got(df):
    return sorted((r[0], r[1] or "", r[2] or "", r[3]) for r in df.collect())


def test_breaks_across_splits_equal_the_csv_module(spark, tmp_path):
    rows = dirty(3000, 1)
    (tmp_path / "d").mkdir()
    write(tmp_path / "d" / "a.csv", rows[:2000])
    write(tmp_path / "d" / "b.csv", rows[2000:], newline="\r\n")
    long = [(9000 + k, "line\n" * 3000, "end", 0.5) for k in range(3)]      # records longer than several splits
    write(tmp_path / "d" / "c.csv", long)
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        path = str(tmp_path / "d")
        inside, open_ = C.inside_splits(C.lines_of(spark, path), ",")
        assert open_ and len(inside) > 5
        df = R.read_csv(spark, path)
        assert C.lines_of(spark, path).rdd.getNumPartitions() > 20
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert df.columns == ["id", "first, name", "second", "amount"]
    assert [t for _, t in df.dtypes] == ["int", "string", "string", "double"]
    # the plain reader trims and nulls alike, in one task a file
    assert got(df) == got(R.read_csv(spark, path, multi_line=True))
    kept = {r[0]: r for r in df.collect()}
    assert all(kept[k][1] == a and (kept[k][2] or "") == b for k, a, b, _ in long)
    assert len(kept) == 3003


def test_lone_quotes_break_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,5" pipe\n2,3" pipe\n3,"x ""y"""\n')
    inside, open_ = C.inside_splits(C.lines_of(spark, str(tmp_path / "a.csv")), ",")
    assert len(inside) == 0 and not open_
    assert [tuple(r) for r in R.read_csv(spark, str(tmp_path / "a.csv")).orderBy("k").collect()] == [
        (1, '5" pipe'), (2, '3" pipe'), (3, 'x "y"')]


def test_odd_files(spark, tmp_path, monkeypatch):
    def read(text, **kw):
        path = tmp_path / f"{abs(hash((text, str(kw))))}.csv"
        path.write_bytes(text.encode())
        return C.read_records(spark, str(path), ",", **({"header": True} | kw))

    assert read('a,b\n1,"x\ny"\n\n  \n2,z').orderBy("a").collect() == [(1, "x\ny"), (2, "z")]
    assert read('﻿"a",b\r\n1,"x\r\ny"\r\n').collect()[0]["a"] == 1
    assert read('1,"x\ny"\n', header=False).collect() == [(1, "x\ny")]
    assert read('a,b\n1,"never closed\n2,z\n').count() == 1
    assert read("a,b\n").collect() == [] and read("a,b\n").columns == ["a", "b"]
    assert read("a,b,c\n1,\"x\ny\"\n").collect() == [(1, "x\ny", None)]
    monkeypatch.setattr(C, "MAX_RECORD", 10)
    lines = pa.array(['1,"' + "x" * 20, "y"])
    with pytest.raises(ValueError):
        C._Joiner(0, 0, False, C.step_patterns(",")).add(lines)
    assert np.array_equal(C.states(np.zeros(0, np.int8), 0), [])
