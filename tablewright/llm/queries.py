"""The registered queries of the training-data operators: whole tables, production settings."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Builder
from ..session import scratch_path
from . import bpe_rounds, conversation_repair, hard_negatives, itq_dedup, langid, mixture, packing, quality, simhash, token_count, token_store, topk, toxicity
from .text import held_out

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def query(fn: Builder) -> Builder:
    QUERIES[fn.__name__] = fn
    return fn


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@functools.cache
def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq_dedup.embedding_duplicates(load(spark, sf_dir, "embeddings"))


@query
def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-store")
    token_store.write_store(load(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=2)
    return token_store.read_store(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_duplicates(load(spark, sf_dir, "documents"))


@query
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.plan_mix(load(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE["op4_mix_sources"] = r"""
WITH d AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
    FROM documents),
s AS (
    SELECT source, CAST(sum(size) AS DOUBLE) AS source_size,
           [5.0, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)] AS w
    FROM d GROUP BY source),
r AS (
    SELECT *, 2.0 * source_size / w AS ratio, 1.5 * sum(source_size) OVER () AS total,
           sum(w) OVER () AS all_w FROM s),
t AS (
    SELECT *, (total - coalesce(sum(2.0 * source_size) OVER before, 0)) / (all_w - coalesce(sum(w) OVER before, 0)) AS try
    FROM r WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, max(CASE WHEN try <= ratio THEN try END) OVER () AS level FROM t),
g AS (
    SELECT source, CAST(source_size AS BIGINT) AS source_size,
           CASE WHEN ratio <= coalesce(level, 'infinity'::DOUBLE) THEN 2.0 * source_size ELSE level * w END AS target
    FROM l),
c AS (
    SELECT d.doc_id, d.size, g.source_size, g.target,
           CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 1.0 END AS rate,
           CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':mix'), 1, 13) AS BIGINT) / 4503599627370496.0 AS draw
    FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c"""


def labelled(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """The rows a classifier may learn from: (doc_id, text, label), none held out."""
    marks = load(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label"))
    return texts(spark, sf_dir).join(marks, "doc_id").where(~held_out(F.col("doc_id")))


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = quality.learn(labelled(spark, sf_dir, "quality"))
    scored = quality.score(texts(spark, sf_dir), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long"),
        F.transform(F.col("embedding").cast("array<double>"), _scaled).alias("vec"))
    return topk.exact_top_k(scaled, F.col("vec_id") % 50 == 0, k=5)


def _scaled(x):
    """floor(256 x), and a non-finite component as it is (floor is a whole number)."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.floor(x * 256).cast("double"))


ORACLE["op6_exact_topk"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM s QUALIFY rank <= 5"""


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.learn(load(spark, sf_dir, "documents").where(~held_out(F.col("doc_id"))))
    return langid.identify(texts(spark, sf_dir), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity.learn(labelled(spark, sf_dir, "toxic"))
    scored = toxicity.score(texts(spark, sf_dir), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_count.token_counts(texts(spark, sf_dir), vocabulary("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(load(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage: by crc32 of ``conv_id:turn`` a row is dropped, emptied, stripped of
    its closing marks, repeated or given to the user.  Nulls are one space."""
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    copies = F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(copies).alias("copy")).drop("copy")


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    left = damaged(rows)
    path = scratch_path(spark, "repair-plans")
    conversation_repair.plan_repairs(left).write.parquet(path)
    plans = spark.read.parquet(path)
    digests = conversation_repair.conversation_digests(conversation_repair.apply_repairs(left, plans))
    same = [F.col(f"a.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) for b in ("p", "d")]
    out = (rows.select("conv_id").distinct().alias("a").join(plans.alias("p"), same[0], "left")
           .join(digests.alias("d"), same[1], "left"))
    counts = [F.coalesce(F.col(f"p.{c}"), F.lit(0).cast("long")).alias(c)
              for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("a.conv_id", *counts, F.coalesce("p.audit", F.lit("")).alias("audit"),
                      F.coalesce("d.sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@query
def op13_bpe_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe_rounds.round_trip(texts(spark, sf_dir), vocabulary("word_bpe_49k.json"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long"), label.alias("label"),
        F.transform(F.col("embedding").cast("array<double>"), _scaled).alias("vec"))
    return hard_negatives.mine_hard_negatives(scaled, F.col("vec_id") % 100 == 0)


ORACLE["op12_hard_negatives"] = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, a.vec_id = c.vec_id AS own,
           CAST(list_dot_product(a.x, c.x) AS BIGINT) AS score
    FROM v a CROSS JOIN v c WHERE a.vec_id % 100 = 0),
p AS (
    SELECT anchor_id, vec_id, score FROM s WHERE same AND NOT own
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same
     AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10"""
