"""Rule-based text understanding over whole tables of texts (TXT1, TXT2, TXT3, PROF-slug).

The reference applies these rules to one idea string; here every rule is a column
expression, so it runs on a ``documents`` / ``conversations`` table row by row inside
whole-stage codegen.  Rule tables are small literals; no join, no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------
# Task triggers, ordered; the first rule with any trigger contained in the text wins.
TASK_RULES = [
    ("time_series", ["time series", "forecast", "temporal", "arima", "lstm", "sequence", "trend"]),
    ("computer_vision", ["image", "vision", "cnn", "resnet", "object detect", "segmentation", "photo"]),
    ("nlp", ["text", "nlp", "sentiment", "translation", "language", "bert", "gpt", "ner"]),
    ("clustering", ["cluster", "segment", "group", "unsupervised", "kmeans", "dbscan"]),
    ("regression", ["predict price", "estimate", "forecast value", "regression", "house price",
                    "salary", "revenue", "amount", "continuous"]),
    ("classification", ["classify", "classification", "detect", "diagnose", "predict whether",
                        "churn", "fraud", "spam", "survive", "default", "binary"]),
]

# Domain triggers, ordered; first match wins, default "general".
DOMAIN_RULES = [
    ("healthcare", ["disease", "medical", "patient", "hospital", "cancer", "diagnosis", "health"]),
    ("finance", ["stock", "price", "fraud", "loan", "bank", "credit", "financial", "revenue"]),
    ("ecommerce", ["product", "sales", "customer", "churn", "retail", "order", "cart"]),
    ("nlp", ["text", "sentiment", "review", "language", "document", "tweet"]),
    ("climate", ["weather", "climate", "temperature", "rain", "flood", "sensor"]),
    ("transport", ["taxi", "flight", "traffic", "vehicle", "uber", "delivery"]),
    ("sports", ["football", "cricket", "nba", "sports", "player", "game"]),
]

# Stop words of the keyword variants.
IDEA_STOP_WORDS = [
    "a", "an", "the", "and", "or", "of", "to", "in", "for",
    "with", "using", "on", "by", "i", "want", "build", "create",
    "make", "develop", "model", "predict", "that", "my", "me",
    "can", "will", "is", "are", "this", "based",
]
PIPELINE_VERBS = [
    "predict", "classify", "detect", "build", "create", "make",
    "develop", "train", "model", "analyse", "analyze", "generate",
    "using", "based", "whether", "that", "will", "from", "with",
    "help", "want", "need", "find", "show", "give", "also", "like",
    "just", "some", "into", "this", "when", "what", "how", "why",
]
CONCEPT_VERBS = [
    "predict", "classify", "detect", "build", "create", "make",
    "develop", "train", "analyze", "analyse", "generate", "using",
    "based", "whether", "from", "with", "help", "find", "show",
    "give", "want", "need", "like", "also", "just", "into",
    "will", "that", "this", "when", "what", "how", "why",
]
EXPANSION_STOP_WORDS = [
    "data", "dataset", "patient", "patients", "people", "person",
    "predict", "classify", "model", "system", "analysis", "problem",
    "using", "based", "with", "from", "that", "this", "which",
]
SEMANTIC_STOP_WORDS = [
    "predict", "classify", "detect", "build", "create", "model",
    "system", "using", "with", "from", "that", "will", "based",
    "whether", "the", "and", "for", "this", "make", "train",
]
ENTITY_STOP_WORDS = [
    "predict", "classify", "detect", "build", "create", "model",
    "system", "analysis", "analyse", "analyze", "make", "using",
    "with", "from", "that", "will", "based", "help", "want",
    "need", "find", "show", "give", "also", "like", "just",
    "data", "dataset", "machine", "learning", "deep", "neural",
]

# (triggers, task, domain, data_type, use_case); the rule with most trigger hits wins, the
# earlier rule on ties; no hit keeps the defaults.
PROBLEM_RULES = [
    (["sentiment", "opinion", "emotion", "feeling", "positive", "negative"],
     "classification", "sentiment", "text", "sentiment_analysis"),
    (["review", "rating", "feedback", "comment"],
     "classification", "sentiment", "text", "sentiment_analysis"),
    (["text classif", "text categor", "document classif"],
     "classification", "nlp", "text", "text_classification"),
    (["fake news", "misinformation", "spam", "phishing"],
     "classification", "nlp", "text", "text_classification"),
    (["mental health", "depression", "anxiety", "stress", "ptsd",
      "bipolar", "schizophrenia", "psychiatric", "psychology", "therapy"],
     "classification", "mental_health", "tabular_or_text", "diagnosis"),
    (["suicide", "self harm", "mental illness"],
     "classification", "mental_health", "text", "risk_detection"),
    (["diabetes", "glucose", "insulin", "diabetic"],
     "classification", "diabetes", "tabular", "prediction"),
    (["heart", "cardiac", "cardiovascular", "coronary", "ecg"],
     "classification", "heart_disease", "tabular", "prediction"),
    (["cancer", "tumor", "tumour", "malignant", "biopsy", "oncology"],
     "classification", "cancer", "tabular", "diagnosis"),
    (["parkinson", "tremor", "dopamine", "motor", "neurodegenerative"],
     "classification", "parkinson", "tabular", "diagnosis"),
    (["patient", "hospital", "clinical", "medical", "disease", "symptom",
      "diagnosis", "health condition"],
     "classification", "medical", "tabular", "prediction"),
    (["churn", "customer retention", "attrition", "subscription cancel"],
     "classification", "churn", "tabular", "prediction"),
    (["fraud", "scam", "anomaly detection", "suspicious transaction"],
     "classification", "fraud", "tabular", "detection"),
    (["loan", "credit", "mortgage", "default", "creditworthiness"],
     "classification", "loan", "tabular", "prediction"),
    (["house price", "home price", "real estate", "property value", "rent"],
     "regression", "house_price", "tabular", "price_prediction"),
    (["salary", "wage", "income", "compensation", "pay prediction"],
     "regression", "salary", "tabular", "price_prediction"),
]
PROBLEM_DEFAULTS = ("classification", "general", "tabular", "prediction")
QUERY_ENTITIES = 4

# A word run: letters, digits, underscore (Python's Unicode \w without marks).
WORD_RUN = r"[\p{L}\p{N}_]+"
ASCII_WORD3 = r"^[a-zA-Z]{3,}$"
# A whole word run made of >= 3 ASCII letters (Unicode word boundaries on both sides).
ASCII_WORD_IN_TEXT = r"(?<![\p{L}\p{N}_])[a-zA-Z]{3,}(?![\p{L}\p{N}_])"
# -------------------------------------------------------------------------------------------

# keyword variants: (lower-case first, stop words, cap or None, distinct)
KEYWORD_VARIANTS = {
    "idea": (False, IDEA_STOP_WORDS, 5, True),
    "concept": (True, CONCEPT_VERBS + EXPANSION_STOP_WORDS, 6, True),
    "core": (True, PIPELINE_VERBS, None, True),
    "semantic": (True, SEMANTIC_STOP_WORDS, 6, True),
    "entities": (True, ENTITY_STOP_WORDS, None, False),
}


def _any_contains(text: Column, triggers: list[str]) -> Column:
    cond = F.lit(False)
    for t in triggers:
        cond = cond | text.contains(t)
    return cond


def rule_task(text: Column) -> Column:
    """TXT1: task type of a text by the ordered trigger rules (default classification)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("classification")
    for task, triggers in reversed(TASK_RULES):
        out = F.when(_any_contains(low, triggers), F.lit(task)).otherwise(out)
    return out


def rule_domain(text: Column) -> Column:
    """TXT1: domain of a text by the ordered trigger rules (default general)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("general")
    for dom, triggers in reversed(DOMAIN_RULES):
        out = F.when(_any_contains(low, triggers), F.lit(dom)).otherwise(out)
    return out


def ascii_words(text: Column, lower_first: bool) -> Column:
    """Whole word runs made only of >= 3 ASCII letters, lower-cased, in text order."""
    src = F.coalesce(text, F.lit(""))
    if lower_first:
        return F.regexp_extract_all(F.lower(src), F.lit(ASCII_WORD_IN_TEXT), 0)
    words = F.regexp_extract_all(src, F.lit(ASCII_WORD_IN_TEXT), 0)
    # lower-case the words without a per-element lambda: join, lower, split
    return F.when(F.size(words) == 0, words).otherwise(F.split(F.lower(F.array_join(words, " ")), " "))


def keywords(text: Column, variant: str = "idea") -> Column:
    """TXT2: keyword list of a text (order of first appearance, stop words removed, capped)."""
    lower_first, stops, cap, distinct = KEYWORD_VARIANTS[variant]
    return _drop_stops(ascii_words(text, lower_first), stops, cap, distinct)


def _drop_stops(words: Column, stops: list[str], cap: int | None, distinct: bool) -> Column:
    stop_arr = F.array(*[F.lit(s) for s in stops])
    if distinct:   # array_except keeps first occurrences in order and drops duplicates
        kept = F.array_except(words, stop_arr)
    else:
        kept = F.filter(words, lambda w: ~F.array_contains(stop_arr, w))
    if cap is not None:
        kept = F.slice(kept, 1, cap)
    return kept


def keyword_columns(df, text_col: str, variants: list[str], keep: list[str]):
    """Several keyword variants of one text column, extracting the word runs only once per
    casing (a staged projection keeps the shared arrays from being recomputed per variant)."""
    t = F.col(text_col)
    need_raw = any(not KEYWORD_VARIANTS[v][0] for v in variants)
    staged = df.select(*keep, ascii_words(t, True).alias("__w_low"),
                       *( [ascii_words(t, False).alias("__w_raw")] if need_raw else []))
    cols = []
    for v in variants:
        lower_first, stops, cap, distinct = KEYWORD_VARIANTS[v]
        words = F.col("__w_low") if lower_first else F.col("__w_raw")
        cols.append(_drop_stops(words, stops, cap, distinct).alias(v))
    return staged.select(*keep, *cols)


def _best_rule(low: Column) -> Column:
    """struct(hits, neg_rule) of the rule with most trigger hits (earliest on ties)."""
    scored = []
    for i, (triggers, *_rest) in enumerate(PROBLEM_RULES):
        hits = sum((F.when(low.contains(t), 1).otherwise(0) for t in triggers), F.lit(0))
        scored.append(F.struct(hits.alias("hits"), F.lit(-i).alias("neg_rule")))
    return F.greatest(*scored)


def _rule_fields(best: Column) -> list[Column]:
    idx = -best["neg_rule"] + 1
    hit = best["hits"] > 0
    out = []
    for j, name in enumerate(["task_type", "domain", "data_type", "use_case"]):
        values = F.array(*[F.lit(r[j + 1]) for r in PROBLEM_RULES])
        out.append(F.when(hit, F.element_at(values, idx)).otherwise(F.lit(PROBLEM_DEFAULTS[j])).alias(name))
    out.append(F.when(hit, best["hits"]).otherwise(F.lit(0)).alias("n_hits"))
    return out


def problem_table(df, text_col: str, keep: list[str]):
    """TXT3 over a table.  Staged projections: the text is lower-cased once, all rules are
    scored into one struct column, and the rule's fields are looked up by index - so no
    trigger scan runs more than once per row."""
    low = df.select(*keep, F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("__low"))
    best = low.select(*keep, _best_rule(F.col("__low")).alias("__best"))
    return best.select(*keep, *_rule_fields(F.col("__best")))


def problem_understanding(text: Column) -> Column:
    """TXT3 as one column: struct(task_type, domain, data_type, use_case, n_hits)."""
    best = _best_rule(F.lower(F.coalesce(text, F.lit(""))))
    return F.struct(*_rule_fields(best))


def expected_columns(domain: Column) -> Column:
    """TXT3: the column names a problem of ``domain`` is expected to have (signature columns,
    then target patterns); empty for a domain without a signature."""
    from .relevance import DOMAIN_COLUMNS
    m = F.create_map(*[x for d, names in DOMAIN_COLUMNS.items()
                       for x in (F.lit(d), F.array(*[F.lit(c) for c in names["columns"] + names["targets"]]))])
    return F.coalesce(F.try_element_at(m, domain), F.array().cast("array<string>"))


def search_queries(entities: Column, task: Column, domain: Column, data_type: Column, use_case: Column) -> Column:
    """TXT3: the distinct search queries of a problem, in generation order: entities (first
    four) with task; domain with task; a data-type or use-case specific one; a kaggle one."""
    ents = F.array_join(F.slice(entities, 1, QUERY_ENTITIES), " ")
    specific = (F.when(data_type == "text", F.concat(ents, F.lit(" text dataset nlp")))
                .when(use_case == "diagnosis", F.concat(ents, F.lit(" clinical dataset diagnosis")))
                .when(use_case == "price_prediction", F.concat(ents, F.lit(" regression dataset csv"))))
    qs = F.array(F.concat(ents, F.lit(" dataset "), task, F.lit(" csv")),
                 F.concat(F.regexp_replace(domain, "_", " "), F.lit(" "), task, F.lit(" dataset csv")),
                 specific, F.concat(ents, F.lit(" kaggle dataset")))
    return F.array_distinct(F.filter(qs, lambda q: q.isNotNull()))


def problem_queries(df, text_col: str, keep: list[str]):
    """TXT3 complete: rule fields, key entities (count), expected columns and search queries
    of every text; one staged projection (text lower-cased once, rules scored once)."""
    low = df.select(*keep, F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("__low"))
    best = low.select(*keep, _best_rule(F.col("__low")).alias("__best"),
                      keywords(F.col("__low"), "entities").alias("__ents"))
    pu = best.select(*keep, *_rule_fields(F.col("__best")), "__ents")
    c = F.col
    return pu.select(*keep, "task_type", "domain", "data_type", "use_case", "n_hits",
                     F.size("__ents").cast("long").alias("n_entities"),
                     F.array_join(expected_columns(c("domain")), ",").alias("relevant_columns"),
                     F.array_join(search_queries(c("__ents"), c("task_type"), c("domain"), c("data_type"),
                                                 c("use_case")), "|").alias("search_queries"))


def slug(text: Column, max_len: int = 40) -> Column:
    """Text slug: lower-case, keep [a-z0-9] and whitespace, trim, whitespace runs to '_',
    first ``max_len`` characters, then '_' and the first 6 hex digits of md5(text)."""
    src = F.coalesce(text, F.lit(""))
    s = F.regexp_replace(F.lower(src), r"[^a-zA-Z0-9\s]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"^\s+|\s+$", ""), r"\s+", "_")
    return F.concat(F.substring(s, 1, max_len), F.lit("_"), F.substring(F.md5(src), 1, 6))


# ---- TXT5: structural term expansion --------------------------------------------------------

# ---- fixed values -------------------------------------------------------------------------
# (suffix, replacement) tried in order; the first suffix that fits decides the stem.
EXPANSION_SUFFIXES = [("tion", ""), ("sion", ""), ("ment", ""), ("ness", ""), ("ity", ""),
                      ("ing", ""), ("ance", "ant")]
TASK_SUFFIX_WORDS = {
    "classification": ["measurement", "feature"], "regression": ["measurement", "feature"],
    "time_series": ["signal", "sensor"], "nlp": ["text", "review"],
}
EXPANSION_TERMS_USED = 4
MAX_EXPANDED = 8
MAX_VARIATIONS = 6
# -------------------------------------------------------------------------------------------


def _stem(t: Column) -> Column:
    out = F.lit(None).cast("string")
    for suffix, rep in reversed(EXPANSION_SUFFIXES):
        cond = t.endswith(suffix) & (F.length(t) > len(suffix) + 2)
        stem = F.concat(F.substring(t, F.lit(1), F.length(t) - len(suffix)), F.lit(rep))
        out = F.when(cond, stem).otherwise(out)
    stops = F.array(*[F.lit(s) for s in EXPANSION_STOP_WORDS])
    return F.when((F.length(out) > 2) & ~F.array_contains(stops, out), out)


def expand_terms(core: Column, task_type: Column) -> Column:
    """TXT5: struct(expanded, variations) from core terms and a task type (structural rules:
    suffix stems and task phrases of the first 4 core terms; cleaned, capped at 8 / 6)."""
    first = F.slice(core, 1, EXPANSION_TERMS_USED)

    def per_term(t):
        a, b = F.lit(""), F.lit("")
        for task, (w1, w2) in TASK_SUFFIX_WORDS.items():
            a = F.when(task_type == task, F.concat(t, F.lit(" " + w1))).otherwise(a)
            b = F.when(task_type == task, F.concat(t, F.lit(" " + w2))).otherwise(b)
        return F.array(_stem(t), F.when(a != "", a), F.when(b != "", b))

    raw = F.array_compact(F.flatten(F.transform(first, per_term)))
    structural = F.slice(F.array_except(raw, core), 1, MAX_EXPANDED)
    stops = F.array(*[F.lit(s) for s in EXPANSION_STOP_WORDS])
    cleaned = F.filter(F.array_except(F.transform(structural, lambda x: F.lower(strip_text(x))),
                                      F.array_union(core, stops)), lambda x: F.length(x) > 2)
    expanded = F.slice(cleaned, 1, MAX_EXPANDED)
    concept = F.array_join(F.slice(core, 1, 3), " ")
    has_core = F.size(core) > 0
    has_exp = F.size(expanded) > 0
    parts = F.array(
        F.when(has_core, F.concat(concept, F.lit(" dataset csv"))),
        F.when(has_core, F.concat(concept, F.lit(" data"))),
        *[F.when(F.size(expanded) > i, F.concat(F.element_at(expanded, i + 1), F.lit(" dataset csv")))
          for i in range(3)],
        F.when(has_core & has_exp, F.concat(F.element_at(core, 1), F.lit(" "), F.element_at(expanded, 1),
                                            F.lit(" dataset"))),
        *[F.when(F.size(expanded) > i, F.concat(F.element_at(expanded, i + 1), F.lit(" data records")))
          for i in range(2)])
    variations = F.slice(F.array_distinct(F.array_compact(parts)), 1, MAX_VARIATIONS)
    return F.struct(expanded.alias("expanded"), variations.alias("variations"))


def strip_text(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")
