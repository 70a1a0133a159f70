"""Merge rounds against the tokenizers library: ids, decoded texts, digests, edge rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from tablewright.llm import bpe_rounds as B
from tablewright.llm import queries as Q
from tablewright.llm import text
from tablewright.llm.text import WordCache


@pytest.fixture(scope="module")
def path():
    return Q.vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


EDGES = ["", " ", "hello World", "aaaaaaaaaaaaa aaa aa a", "It's don't we'LL 'sa x's,  tab\tsep\r\nß ÉCOLE é ́a",
         "<|endoftext|> a<|startoftext|>b<|endoftext|", "日本語 テスト 123 ４５ ½ ²", "İstanbul ΣΑΣ ς", " x y\u0085z",
         "!!!???...,,,a!b,c.", "a\x00b \x1c\x1f", "🙂🙂👨‍👩‍👧", "ſs 'ſ ''s", "ba" * 300, "x" * 30000]


def noise(n):
    draw = random.Random(1)
    letters = "abcdeé ,.!'’stm\n\t 0189ÀÉßΣİ́ͅａ日あ🙂<|>endoftext ​\x1c"
    return (["".join(draw.choice(letters) for _ in range(draw.randint(1, 60))) for _ in range(n)]
            + ["".join(draw.choice("ab") for _ in range(draw.randint(1, 200))) for _ in range(n // 10)])


def test_ids_and_decoded_texts_equal_the_library(path, library):
    texts = EDGES + noise(3000)
    table = B.MergeTable(path)
    counts, ids = WordCache(table.encode_words, np.dtype(np.int32)).encode(pa.array(texts))
    decoded = B.decode_lists(B._lists(counts, ids), table.strings).to_pylist()
    ends = np.cumsum(counts)
    for k, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[ends[k] - counts[k]:ends[k]].tolist() == e.ids, repr(texts[k])
        assert decoded[k] == library.decode(e.ids, skip_special_tokens=False)


@pytest.mark.parametrize("limit", [2000, 100_000])
def test_cache_that_is_cut_changes_nothing(path, library, monkeypatch, limit):
    texts = pa.array(noise(300) + ["the same words in every slice"] * 40)
    table = B.MergeTable(path)
    want = WordCache(table.encode_words, np.dtype(np.int32)).encode(texts)
    monkeypatch.setattr(text, "CACHE_BYTES", limit)
    for small in (WordCache(table.encode_words, np.dtype(np.int32)), text.WordIds(path)):
        parts = [small.encode(texts.slice(k, 20)) for k in range(0, len(texts), 20)]
        assert np.array_equal(np.concatenate([c for c, _ in parts]), want[0])
        assert np.array_equal(np.concatenate([i for _, i in parts]), want[1])
        assert small.size <= limit or limit == 2000      # a slice alone may pass a small limit


def plain_merge(symbols, pairs):
    """Pop the lowest pair, leftmost first, one at a time."""
    symbols = list(symbols)
    while True:
        found = [(pairs[p][0], k) for k, p in enumerate(zip(symbols, symbols[1:])) if p in pairs]
        if not found:
            return symbols
        _, k = min(found)
        symbols[k:k + 2] = [pairs[tuple(symbols[k:k + 2])][1]]


def test_rounds_equal_single_merges_also_where_ranks_are_not_safe():
    draw = random.Random(5)
    for trial in range(60):
        # products that belong to pairs of lower rank: the order of the merges matters
        pairs = {}
        for rank in draw.sample(range(40), 24):
            pairs[draw.randrange(6), draw.randrange(6)] = (rank, draw.randrange(6))
        table = B.MergeTable.__new__(B.MergeTable)
        table.symbols = 6
        keys = sorted(pairs)
        table.keys = np.array([a * 6 + b for a, b in keys])
        table.ranks = np.array([pairs[k][0] for k in keys], np.int32)
        table.into = np.array([pairs[k][1] for k in keys])
        use = [min([pairs[k][0] for k in keys if s in k] or [99]) for s in range(6)]
        table.safe = np.zeros(41, bool)
        for k in keys:
            table.safe[pairs[k][0]] = use[pairs[k][1]] > pairs[k][0]
        words = [[draw.randrange(6) for _ in range(draw.randint(1, 12))] for _ in range(40)]
        counts, ids = table.merge(np.array(sum(words, [])), np.array([len(w) for w in words]))
        want = [plain_merge(w, pairs) for w in words]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == sum(want, [])


def test_documents_nulls_clashing_columns_and_empty_table(spark, path, library):
    schema = "doc_id long, text string, ids string, decoded int"
    df = spark.createDataFrame([(1, None, "x", 1), (2, "", "x", 1), (None, "The cat", "x", 1), (2, "The cat", None, None),
                                (3, "long " * 300000, None, None)], schema)
    got = B.decode_documents(B.encode_documents(df, path), path).collect()
    once = B.round_trip(df, path).collect()
    assert len(got) == len(once) == 5
    for r in got + once:
        e = library.encode(r.text or "", add_special_tokens=False)
        assert r.ids == e.ids and r.decoded == library.decode(e.ids, skip_special_tokens=False)
    assert B.decode_documents(B.encode_documents(df.where("false"), path), path).collect() == []
    odd = spark.createDataFrame([(1, None), (2, [0, -5, 1, 10 ** 6]), (3, [])], "k int, ids array<int>")
    assert {r.k: r.decoded for r in B.decode_documents(odd, path).collect()} == {1: None, 2: "! \"", 3: ""}


def test_query_equals_the_library(spark, library):
    import duckdb
    texts = dict(duckdb.execute(f"SELECT doc_id, text FROM '{SF_SMALL}/documents.parquet'").fetchall())
    rows = E.queries()["op13_bpe_rounds"](spark, SF_SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
