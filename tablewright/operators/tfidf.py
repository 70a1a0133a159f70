"""TF-IDF with a corpus-frequency vocabulary (FEAT7), as relational Spark jobs.

Semantics kept: lower-case, accents stripped, tokens of two or more word characters,
unigrams and bigrams, vocabulary = the ``max_features`` terms with the highest total count in
the fitting corpus (ties by term), idf = ln((1 + n_docs) / (1 + df)) + 1, raw term counts,
rows L2-normalised.  Output is sparse: one row per (document, vocabulary term present).

Three passes over the text, each a map-side-combined aggregation:

1. total count per word; the ``max_features``-th largest of them is the least count of any term
   of the vocabulary;
2. total count per bigram of words that reach this count - no other bigram can: of the many
   bigrams of a corpus, those of a few hundred words are counted.  Where ties make the words
   more than ``FREQUENT_WORDS`` times ``max_features``, or few words occur at all, all bigrams
   are counted;
3. other terms are dropped *before* they are exploded, so only vocabulary terms are shuffled for
   the per-(doc, term) counts; document frequencies and idf come from that small result, and
   per-document norms from a window over at most ``max_features`` rows of one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import bigrams_of, tokens, with_bigrams
from .profile import attach

MAX_FEATURES = 200   # fixed value: terms kept per text column
FREQUENT_WORDS = 4   # times as many words may reach the least count of the vocabulary


def _terms(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(doc_id, F.explode(with_bigrams(tokens(F.col(text)))).alias("term"))


def term_counts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, term, tf) for every unigram and bigram of every document."""
    return _terms(docs, doc_id, text).groupBy(doc_id, "term").agg(F.count(F.lit(1)).alias("tf"))


def top_terms(docs: DataFrame, doc_id: str, text: str, max_features: int = MAX_FEATURES) -> DataFrame:
    """Passes 1 and 2: the ``max_features`` terms with the highest total count (ties by term)."""
    def totals(terms):
        return docs.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("ttf"))

    toks = tokens(F.col(text))
    best = F.col("ttf").desc(), F.col("term")
    first = totals(toks).orderBy(*best).limit(FREQUENT_WORDS * max_features + 1).collect()
    words = [r["term"] for r in first if r["ttf"] >= first[max_features - 1]["ttf"]] if len(first) >= max_features > 0 else []
    if words and len(words) <= FREQUENT_WORDS * max_features:
        counted = docs.sparkSession.createDataFrame([(r["term"], r["ttf"]) for r in first], "term string, ttf long")
        ttf = counted.unionByName(totals(bigrams_of(toks, words)))
    else:
        ttf = totals(with_bigrams(toks))
    return ttf.orderBy(*best).limit(max_features).select("term")


def vocab_counts(docs: DataFrame, doc_id: str, text: str, terms: list[str]) -> DataFrame:
    """Pass 3: (doc_id, term, tf) for the bounded vocabulary only."""
    words, pairs = [t for t in terms if " " not in t], [t for t in terms if " " in t]
    toks = F.col("__tokens")            # a column of its own: the text is split once
    kept = F.filter(toks, lambda t: t.isin(*words))
    if pairs:
        of = sorted({w for p in pairs for w in p.split(" ")})
        kept = F.concat(kept, F.filter(bigrams_of(toks, of), lambda t: t.isin(*pairs)))
    split = docs.select(doc_id, tokens(F.col(text)).alias("__tokens"))
    return split.select(doc_id, F.explode(kept).alias("term")).groupBy(doc_id, "term").agg(F.count(F.lit(1)).alias("tf"))


def _idf(counts: DataFrame, terms: DataFrame, n_docs: DataFrame) -> DataFrame:
    df_ = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    v = attach(terms.join(df_, "term", "left").fillna(0, ["df"]), n_docs)
    idx = F.row_number().over(Window.orderBy("term")) - 1        # at most max_features rows
    return v.select("term", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"),
                    idx.alias("term_index"))


def _vocabulary(docs: DataFrame, doc_id: str, text: str, max_features: int) -> tuple[list[str], DataFrame]:
    """The vocabulary is a top-k of at most ``max_features`` rows: collected once and reused as
    literals and as a frame, instead of re-running the term totals for every consumer."""
    rows = [r[0] for r in top_terms(docs, doc_id, text, max_features).collect()]
    return rows, docs.sparkSession.createDataFrame([(t,) for t in rows], "term string")


def fit_vocabulary(docs: DataFrame, doc_id: str, text: str, max_features: int = MAX_FEATURES) -> DataFrame:
    """(term, idf, term_index) for the ``max_features`` most frequent terms."""
    listed, terms = _vocabulary(docs, doc_id, text, max_features)
    n_docs = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    return _idf(vocab_counts(docs, doc_id, text, listed), terms, n_docs)


def _weights(counts: DataFrame, doc_id: str, vocabulary: DataFrame) -> DataFrame:
    x = counts.join(F.broadcast(vocabulary), "term").withColumn("x", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(doc_id)))
    return x.select(doc_id, "term", "term_index", (F.col("x") / norm).alias("weight"))


def transform(docs: DataFrame, doc_id: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, term, term_index, weight) - L2-normalised tf-idf of vocabulary terms."""
    listed = [r[0] for r in vocabulary.select("term").collect()]      # at most max_features
    return _weights(vocab_counts(docs, doc_id, text, listed), doc_id, vocabulary)


def tfidf(docs: DataFrame, doc_id: str, text: str, max_features: int = MAX_FEATURES,
          fit_on: DataFrame | None = None) -> DataFrame:
    """Fit the vocabulary on ``fit_on`` (default: ``docs``) and transform ``docs``.

    On one corpus the vocabulary counts of pass 2 serve both the idf and the weights."""
    if fit_on is not None:
        return transform(docs, doc_id, text, fit_vocabulary(fit_on, doc_id, text, max_features))
    # three tokenisations: the exploded corpus is never stored, only the counts of the bounded
    # vocabulary are (read for the idf and for the weights)
    from ..session import checkpoint_dir
    checkpoint_dir(docs.sparkSession)
    listed, terms = _vocabulary(docs, doc_id, text, max_features)
    counts = vocab_counts(docs, doc_id, text, listed).checkpoint()
    vocab = _idf(counts, terms, docs.agg(F.count(F.lit(1)).alias("n_docs")))
    return _weights(counts, doc_id, vocab)


def to_vectors(weights: DataFrame, doc_id: str, size: int = MAX_FEATURES, out: str = "tfidf") -> DataFrame:
    """Pack (doc, term_index, weight) rows into one sparse vector per document."""
    from pyspark.ml.linalg import VectorUDT
    grouped = weights.groupBy(doc_id).agg(F.array_sort(F.collect_list(F.struct("term_index", "weight"))).alias("e"))
    vec = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"),
                   F.transform("e", lambda s: s["term_index"].cast("int")).alias("indices"),
                   F.transform("e", lambda s: s["weight"].cast("double")).alias("values"))
    return grouped.select(doc_id, vec.cast(VectorUDT.sqlType()).alias(out))
