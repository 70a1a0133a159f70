"""Conversation repair against exhaustive enumeration of edits, and the query against plain code."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from tablewright.llm import conversation_repair as C
from tablewright.llm import queries as Q

WHOLE, PREFIX = re.compile(r"(s?(ua)+)?"), re.compile(r"s?(ua)*u?")


def enumerate_edits(codes):
    """Cheapest (cost, audit, roles) over all edits; at most three inserts in a row."""
    best = None

    def go(i, out, cost, audit, inserts):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(codes) and WHOLE.fullmatch(out) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit)
        if inserts < 3:
            for r in "ua":
                if PREFIX.fullmatch(out + r):
                    go(i, out + r, cost + 2, audit + "I", inserts + 1)
        if i < len(codes):
            go(i + 1, out, cost + 3, audit + "D", 0)
            if codes[i] != "d":
                late = int(codes[i].isupper())
                for r, letter, price in ((codes[i].lower(), "K", 0), ("u", "R", 2), ("a", "R", 2)):
                    if PREFIX.fullmatch(out + r):
                        go(i + 1, out + r, cost + price + late, audit + letter, 0)

    go(0, "", 0, "", 0)
    return best


def test_search_equals_enumeration():
    draw = random.Random(3)
    words = ["".join(c) for n in range(3) for c in itertools.product("dsuaxSUAX", repeat=n)]
    words += ["".join(draw.choice("dsuaxSUAX") for _ in range(draw.randint(3, 5))) for _ in range(150)]
    for codes in words:
        assert C.cheapest(codes, 0, C.FINAL, True) == enumerate_edits(codes), codes


def test_joined_chunks_equal_one_search():
    draw = random.Random(4)
    for _ in range(200):
        codes = "".join(draw.choice("uauauadsUAx") for _ in range(draw.randint(2, 40)))
        size = draw.randint(1, 9)
        joined = C._Joined()
        for at in range(0, len(codes), size):
            last = at + size >= len(codes)
            ways = []
            for s in (C.NEXT if at else (0,)):
                for e in ((-1,) if last else C.NEXT):
                    way = C.cheapest(codes[at:at + size], s, C.FINAL if last else (e,), last)
                    if way:
                        ways.append({"start": s, "end": e, "cost": way[0], "audit": way[1]})
            joined.add(ways)
        assert joined.result() == C.cheapest(codes, 0, C.FINAL, True)


SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_s, turn_s = (" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{conv_s}:{turn_s}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_repair(rows):
    """Everything of the contract for the (damaged) rows of one conversation."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
    seen, codes, faults = set(), "", []
    for _, _, role, text in rows:
        bare = text.rstrip(SPACE)
        fault = ("blank" if not bare.strip(SPACE) else "duplicate" if (role, text) in seen
                 else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
        kind = role[:1] if role[:1] in ("s", "u", "a") and role else "x"
        codes += "d" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
        faults.append(fault)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = C.cheapest(codes, 0, C.FINAL, True)
    if len(codes) <= 6:
        assert (cost, audit) == enumerate_edits(codes)
    left, out, state = iter(rows), [], ""
    for letter in audit:
        supplied = "assistant" if state == "u" else "user"
        role, text = ("", "") if letter == "I" else next(left)[2:]
        if letter == "D":
            continue
        role = role if letter == "K" else supplied
        state = role[0]
        out.append(f"{role}:{text}")
    assert WHOLE.fullmatch("".join(m[0] for m in out))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def plain_query(rows):
    groups = {r[0]: [] for r in rows}
    for r in plain_damage(rows):
        groups[r[0]].append(r)
    return {c: plain_repair(g) for c, g in groups.items()}


def as_dict(df):
    got = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}
    assert len(out) == len(got)
    return out


def test_query_equals_plain_code(spark):
    import duckdb
    rows = duckdb.execute(f"SELECT conv_id, turn, role, text FROM '{SF_SMALL}/conversations.parquet'").fetchall()
    assert as_dict(E.queries()["op11_conversation_repair"](spark, SF_SMALL)) == plain_query(rows)


@pytest.fixture
def odd_rows():
    draw = random.Random(6)
    texts = ["Fine.", "Cut", "", " \t", "Why?\n ", None, "..", " ", "Long. " * 50000]
    roles = ["user", "assistant", "system", None, "tool", "", "admin", "USER"]
    rows = [(draw.choice([None, *range(40)]), draw.choice([None, *range(9)]), draw.choice(roles), draw.choice(texts[:8]))
            for _ in range(400)]
    # one conversation of several chunks, one very long text
    rows += [(99, t, "user" if t % 2 == 0 else "assistant", f"Line {t % 300}{'.' if t % 7 else ''}") for t in range(700)]
    return rows + [(50, 0, "user", texts[8]), (50, 1, "assistant", "Yes.")]


def test_odd_rows_equal_plain_code(spark, odd_rows, tmp_path):
    df = spark.createDataFrame([(*r, "kept", r[1]) for r in odd_rows],
                               "conv_id long, turn long, role string, text string, audit string, position long")
    df.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got = as_dict(Q.op11_conversation_repair(spark, str(tmp_path)))
    want = plain_query(odd_rows)
    assert set(got) == set(want)
    # equal turns are ordered by role and digest in either
    assert {c: got[c] for c in got if got[c] != want[c]} == {}


def test_repaired_rows_and_empty_table(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "user", "U."), (1, 2, "user", "U."), (2, 0, "system", "S.")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    plans = C.plan_repairs(df)
    assert {r.conv_id: (r.cost, r.audit) for r in plans.collect()} == {1: (7, "KIKKDI"), 2: (3, "D")}
    got = C.apply_repairs(df, plans).orderBy("conv_id", "position").collect()
    assert [(r.edit, r.role, r.text) for r in got] == [
        ("K", "system", "S."), ("I", "user", ""), ("K", "assistant", "A."), ("K", "user", "U."), ("I", "assistant", "")]
    none = df.where("false")
    assert C.plan_repairs(none).collect() == [] and C.apply_repairs(none, C.plan_repairs(none)).collect() == []
