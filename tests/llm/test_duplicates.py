"""Near-duplicate operators against brute force over all pairs."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tablewright.llm import components, hamming, itq_dedup, simhash


def smallest_reachable(linked):
    label = np.arange(len(linked))
    while True:
        new = np.where(linked | np.eye(len(linked), dtype=bool), label[None, :], len(linked)).min(1)
        if (new == label).all():
            return label
        label = new


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0


def check_simhash(rows, got):
    ids = sorted({d for d, _ in rows if d is not None})
    codes = [(d, plain_fingerprint(t)) for d, t in rows]
    linked = np.zeros((len(ids), len(ids)), bool)
    for a, x in codes:
        for b, y in codes:
            if a is not None and b is not None and (x ^ y).bit_count() <= 3:
                linked[ids.index(a), ids.index(b)] = True
    label = smallest_reachable(linked)
    want = sorted((d, f"{c:016x}", ids[label[ids.index(d)]]) for d, c in codes if d is not None)
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == want


def test_simhash_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_simhash(rows, simhash.simhash_duplicates(docs).collect())


EDGES = [(0, ""), (1, None), (2, " \n\t"), (3, "One"), (4, "one"), (5, "É two"), (6, "é two"), (7, "a b c"),
         (7, "a b c"), (8, "A  b\x0bC"), (9, "x\x1fy z w q"), (None, "a b c"), (None, None),
         (10, "w " * 30_000), (11, "w " * 29_999)]


def test_simhash_edges(spark):
    df = spark.createDataFrame(EDGES, "doc_id long, text string").withColumns(
        {"code": F.lit("c"), "id": F.lit(1), "component_id": F.lit(2)})
    got = simhash.simhash_duplicates(df).collect()
    check_simhash(EDGES, got)
    assert sorted(r.component_id for r in got if r.doc_id is None) == [0, 7]
    assert simhash.simhash_duplicates(df.where("1 = 0")).count() == 0


def test_near_codes_find_every_distance_and_split_large_buckets(spark, monkeypatch):
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    dense = codes[0] ^ (np.uint64(1) << rng.integers(0, 12, 120).astype(np.uint64)) ^ (
        np.uint64(1) << rng.integers(0, 64, 120).astype(np.uint64))
    far = [codes[1] ^ sum(np.uint64(1) << np.uint64(b) for b in rng.choice(64, d, replace=False)) for d in (1, 2, 3, 4, 5)]
    every = np.unique(np.concatenate([codes, dense, np.array(far, np.uint64)]))
    linked = np.bitwise_count(every[:, None] ^ every[None, :]) <= 3
    want = smallest_reachable(linked)
    df = spark.createDataFrame([(i, int(c)) for i, c in enumerate(every.view(np.int64))], "id long, code long")
    for block in (hamming.BLOCK, 16):
        monkeypatch.setattr(hamming, "BLOCK", block)
        links = simhash.near_codes(df).collect()
        assert all(linked[r.a, r.b] or want[r.a] == want[r.b] for r in links)
        found = {r.id: r.component_id for r in components.connected_components(
            spark.createDataFrame([(r.a, r.b) for r in links], "a long, b long")).collect()}
        assert [found.get(i, i) for i in range(len(every))] == want.tolist()


def test_components_of_a_long_path(spark):
    rng = np.random.default_rng(0)
    names = rng.permutation(300)
    path = [(int(a), int(b)) for a, b in zip(names[:-1], names[1:])] + [(5, 5), (None, 3)]
    got = components.connected_components(spark.createDataFrame(path, "a long, b long")).collect()
    assert sorted((r.id, r.component_id) for r in got) == [(i, 0) for i in range(300)]


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(300, 24))
    near = base[:60].repeat(3, 0) + 0.12 * rng.normal(size=(180, 24))
    dense = base[0] + 0.1 * rng.normal(size=(150, 24))
    return np.vstack([base, near, dense, base[:20], 3 * base[20:30]])


@pytest.mark.parametrize("block", [1024, 40])
def test_embedding_links_match_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(hamming, "BLOCK", block)
    x = vectors()
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(9001, None), (9002, [0.0] * 24), (9003, [1.0, None] + [0.0] * 22), (9004, [float("nan")] * 24),
           (9005, [float("inf")] + [0.0] * 23), (9006, [1.0]), (9007, []), (None, x[0].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns(
        {"vec": F.lit(1), "n": F.lit(2), "copies": F.lit("a")})
    got = {r.vec_id: r for r in itq_dedup.embedding_duplicates(df).collect()}
    assert len(got) == len(rows) + len(odd)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    links = np.array([got[i].n_links for i in range(len(x))])
    assert (links <= linked.sum(1)).all() and links.sum() >= 0.9 * linked.sum()
    label = smallest_reachable(linked)
    assert np.mean([got[i].component_id == label[i] for i in range(len(x))]) >= 0.95
    assert all(got[i].kept == (got[i].component_id == i) for i in range(len(x)))
    for name, _ in odd[:-1]:
        assert (got[name].n_links, got[name].component_id, got[name].kept) == (0, name, True)
    assert got[None].component_id is None


def test_embeddings_empty_and_tiny(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert itq_dedup.embedding_duplicates(df).count() == 0
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.n_links, r.component_id) for r in itq_dedup.embedding_duplicates(two).collect()] == [(1, 1), (1, 1)]
    three = two.union(spark.createDataFrame([(3, [1.0, 0.01])], two.schema))
    assert {r.n_links for r in itq_dedup.embedding_duplicates(three).collect()} == {2}
