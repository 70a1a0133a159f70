"""Token operators against the tokenizer libraries on whole texts and hard cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tablewright.llm import packing, token_count, token_store
from tablewright.llm.queries import vocabulary
from tablewright.session import scratch_path

WORDS, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"
LONG = "ab, cd\n" * 20_000


def hard_texts(n):
    rng = random.Random(4)
    bits = list("abcdeéñ  \n\t▁<>日本語😀\x00ſßİΣ.,\"'-0123") + [
        "  ", "the ", "ing", "'s", "'re ", "<|endoftext|>", "<s>", "<0x0A>", "́", " ", "\xa0", "ﬁ"]
    return ["".join(rng.choices(bits, k=rng.randint(1, 50))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, t) for i, t in enumerate(["", " ", "\n", None, LONG, "a b", "a b"] + hard_texts(300))]
    rows += [(None, "no id"), (6, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"ids": F.lit(1), "n_tokens": F.lit("x"), "grp": F.lit(2), "file": F.lit(3)})
    return rows, df


def word_ids(texts, end):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(vocabulary(WORDS))
    return [e.ids + [end] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def stored(spark, df):
    path = scratch_path(spark, "store")
    token_store.write_store(df, path, vocabulary(WORDS), 2)
    return path, token_store.read_store(spark, path)


def test_store_round_trip(spark, corpus):
    rows, df = corpus
    path, back = stored(spark, df)
    got = sorted(back.collect(), key=lambda r: r.start)
    want = {}
    for (doc_id, _), ids in zip(rows, word_ids([t for _, t in rows], 2)):
        want.setdefault(doc_id, []).append(ids)
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda x: (x is not None, x or 0))
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids in want[r.doc_id] and len(ids) == r.n_tokens


def test_store_reads_one_document_and_checks_its_dictionary(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    path, _ = stored(spark, docs)
    where, folder = token_store.filesystem(path)
    name = spark.read.parquet(f"{path}/manifest").sort("shard").first()["file"]
    with where.open_input_stream(f"{folder}/dictionary.zdict") as f:
        dictionary = f.read()
    assert dictionary
    shard = token_store.Shard(where, folder, name, dictionary)
    text = docs.where(F.col("doc_id") == int(shard.index["doc_id"][1])).first()["text"]
    assert shard.document(1).tolist() == word_ids([text], 2)[0]
    with pytest.raises(ValueError):
        token_store.Shard(where, folder, name, b"")


def test_store_of_an_empty_table(spark):
    assert stored(spark, spark.createDataFrame([], "doc_id long, text string"))[1].count() == 0


def test_token_counts_match_the_library(spark, corpus):
    import sentencepiece
    rows, df = corpus
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))
    got = token_count.token_counts(df.drop("ids"), vocabulary(PIECES)).select("doc_id", "n_bytes", "n_tokens").collect()
    want = [(d, len((t or "").encode()), len(model.encode(t or "", num_threads=1))) for d, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_count.token_counts(empty, vocabulary(PIECES)).count() == 0


def check_packing(rows, pieces, seq_len):
    want = {}
    for (doc_id, _), ids in zip(rows, word_ids([t for _, t in rows], 1)):
        want.setdefault(doc_id, []).append(ids)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length > 0
        assert any(w[p.start:p.start + p.length] == ids and len(w) == p.doc_tokens for w in want[p.doc_id])
    for held in sequences.values():
        held.sort(key=lambda p: p.offset)
        assert [p.offset for p in held] == list(np.cumsum([0] + [p.length for p in held])[:-1])
        assert sum(p.length for p in held) <= seq_len
    for doc_id, all_ids in want.items():
        covered = sorted((p.start, p.length) for p in pieces if p.doc_id == doc_id)
        assert sum(n for _, n in covered) == sum(map(len, all_ids))
    return sequences


def test_packing_covers_every_id_once(spark, corpus):
    rows, df = corpus
    pieces = packing.pack_documents(df, vocabulary(WORDS), seq_len=64, group_docs=50).collect()
    sequences = check_packing(rows, pieces, 64)
    unfilled = [s for s in sequences.values() if sum(p.length for p in s) < 64]
    assert len(unfilled) <= 7        # at most one for each group
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), vocabulary(WORDS)).count() == 0


def test_a_repeated_id_closes_its_group_early(spark):
    rows = [(7, f"w{i} x") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = packing.pack_documents(df, vocabulary(WORDS), seq_len=16, group_docs=5).collect()
    check_packing(rows, pieces, 16)


def test_first_fit_decreasing_takes_the_first_bin_with_room():
    rng = random.Random(8)
    sizes = [rng.randint(1, 100) for _ in range(300)]
    bins = []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = next((i for i, b in enumerate(bins) if sum(sizes[j] for j in b) + sizes[k] <= 100), None)
        bins.append([k]) if at is None else bins[at].append(k)
    assert packing.first_fit_decreasing(sizes, 100) == bins
    assert packing.first_fit_decreasing([], 100) == []
