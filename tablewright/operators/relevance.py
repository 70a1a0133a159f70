"""Candidate-table relevance (QUAL9) and best-candidate pick (QUAL11).

A candidate table is scored against a problem understanding (domain, data type, key
entities of an idea, from ``text_rules``).  The table-side inputs are a handful of
aggregates - rows, columns, mean missing share, duplicate share, text-like columns - and a
5-row sample ordered by the first column (a bounded top-k), so each table costs a few small
jobs regardless of its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import JUNK_SCHEMA_PATTERNS
from ..functions.columns import base_family, clean_value
from .profile import attach, duplicate_stats

# ---- fixed values -------------------------------------------------------------------------
# One entry per domain: its column names, and the name patterns of its target columns (together
# the columns a problem of the domain is expected to have).
DOMAIN_COLUMNS = {
    "sentiment": dict(
        columns=["text", "review", "comment", "tweet", "message", "content", "sentence", "description", "post",
                 "body"],
        targets=["sentiment", "label", "class", "rating", "positive", "negative", "score"]),
    "nlp": dict(
        columns=["text", "review", "comment", "tweet", "message", "content", "sentence", "description", "post"],
        targets=["label", "class", "category", "sentiment", "tag"]),
    "text_classification": dict(
        columns=["text", "review", "content", "message", "tweet"],
        targets=["label", "class", "category", "spam", "ham"]),
    "mental_health": dict(
        columns=["mental", "depression", "anxiety", "stress", "treatment", "disorder", "therapy", "psychiatric",
                 "symptom", "diagnosis", "age", "gender", "family_history", "work_interfere", "benefits",
                 "statement", "status"],
        targets=["depression", "anxiety", "treatment", "diagnosis", "label", "class", "status", "condition"]),
    "diabetes": dict(
        columns=["glucose", "insulin", "bmi", "bloodpressure", "blood_pressure", "pregnancies", "age",
                 "skinthickness", "diabetespedigree"],
        targets=["outcome", "diabetes", "class", "label"]),
    "heart_disease": dict(
        columns=["age", "sex", "cp", "trestbps", "chol", "fbs", "restecg", "thalach", "exang", "oldpeak",
                 "cholesterol", "blood_pressure", "heart_rate"],
        targets=["target", "output", "heart", "disease", "label"]),
    "cancer": dict(
        columns=["radius", "texture", "perimeter", "area", "smoothness", "concavity", "symmetry", "tumor",
                 "malignant", "benign", "mass"],
        targets=["diagnosis", "label", "class", "target"]),
    "parkinson": dict(
        columns=["mdvp", "jitter", "shimmer", "nhr", "hnr", "rpde", "dfa", "spread", "d2", "ppe", "vocal", "tremor",
                 "frequency"],
        targets=["status", "label", "class", "diagnosis"]),
    "medical": dict(
        columns=["age", "gender", "symptoms", "diagnosis", "treatment", "patient", "hospital", "doctor", "blood",
                 "pressure", "weight", "height"],
        targets=["diagnosis", "outcome", "label", "disease", "status"]),
    "churn": dict(
        columns=["customerid", "tenure", "monthlycharges", "totalcharges", "contract", "paymentmethod", "customer",
                 "subscription", "account"],
        targets=["churn", "exited", "label", "target", "left"]),
    "fraud": dict(
        columns=["amount", "v1", "v2", "time", "transaction", "merchant", "category", "balance"],
        targets=["class", "fraud", "is_fraud", "label", "target"]),
    "loan": dict(
        columns=["income", "loan", "credit", "employment", "property", "coapplicant", "loanamount", "education",
                 "dependents", "self_employed"],
        targets=["loan_status", "status", "approved", "label"]),
    "house_price": dict(
        columns=["bedrooms", "bathrooms", "sqft", "sqfeet", "rooms", "floors", "area", "location", "zipcode",
                 "price", "lat", "long"],
        targets=["price", "saleprice", "value", "cost"]),
    "salary": dict(
        columns=["experience", "education", "age", "job", "role", "department", "company", "skill",
                 "years_experience", "senior"],
        targets=["salary", "wage", "income", "compensation", "pay"]),
}
MIN_ROWS = 20
MIN_COLUMNS = 2
ACCEPT_SCORE = 0.70
SAMPLE_ROWS = 5
TEXT_MEAN_LENGTH = 20
MAX_ENTITIES = 6
# -------------------------------------------------------------------------------------------


def column_text(columns: list[str]) -> str:
    return " ".join(c.lower().replace(" ", "_").replace("/", "_") for c in columns)


def table_signals(df: DataFrame, name: str) -> DataFrame:
    """One row of the table-side inputs of the relevance score."""
    # one aggregate: non-null count per column and mean length per string column (no
    # distinct counts are needed here, so no per-value shuffle)
    fields = df.schema.fields
    strs = [f.name for f in fields if base_family(f.dataType) == "string"]
    one = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count(clean_value(f.name, f.dataType)).alias(f"nn{i}") for i, f in enumerate(fields)],
                 *[F.avg(F.length(c)).alias(f"len{j}") for j, c in enumerate(strs)])
    n = F.col("__n")
    missing = [F.when(n > 0, (n - F.col(f"nn{i}")) / n).otherwise(F.lit(0.0)) for i in range(len(fields))]
    per_col = one.select(
        (sum(missing, F.lit(0.0)) / len(fields) if fields else F.lit(None).cast("double")).alias("missing"),
        sum((F.when(F.col(f"len{j}") > TEXT_MEAN_LENGTH, 1).otherwise(0) for j in range(len(strs))),
            F.lit(0)).alias("n_text_cols"))
    dup = duplicate_stats(df).select("n_rows", "duplicate_ratio")
    return attach(attach(attach(df.sparkSession.range(1).select(
        F.lit(name).alias("table_name"), F.lit(len(df.columns)).alias("n_cols"),
        F.lit(column_text(df.columns)).alias("col_text")), per_col), dup), sample_text(df))


def sample_text(df: DataFrame) -> DataFrame:
    """One row: the values of the first rows in a deterministic order (all columns, left to
    right), space-joined and lower-cased.  ``orderBy(...).limit`` plans as a top-k: one pass,
    a bounded buffer per task."""
    row_txt = F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns])
    return (df.orderBy(*df.columns).limit(SAMPLE_ROWS)
            .select(F.struct(*df.columns).alias("__k"), row_txt.alias("t"))
            .agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__k", "t"))),
                                                  lambda s: s["t"]), " ")).alias("sample_text")))


def _count_in(col, needles):
    return sum((F.when(col.contains(n), 1).otherwise(0) for n in needles), F.lit(0))


def relevance(signals: DataFrame, domain: str, data_type: str, entities: list[str]) -> DataFrame:
    """QUAL9: (table, is_relevant, score, reason) for rows of ``table_signals``."""
    ct = F.col("col_text")
    junk = F.lit(None).cast("string")
    for pats, why in reversed(JUNK_SCHEMA_PATTERNS):
        junk = F.when(_count_in(ct, pats) >= 2, F.lit(why)).otherwise(junk)
    n = F.col("n_rows")
    s = F.lit(0.50)
    s = s + (F.when(n >= 50000, 0.20).when(n >= 10000, 0.15).when(n >= 1000, 0.10)
             .when(n >= 100, 0.05).otherwise(-0.10))
    s = s - F.least(F.lit(0.25), F.coalesce("missing", F.lit(0.0)) * 1.5)
    s = s - F.least(F.lit(0.15), F.col("duplicate_ratio"))
    sig = DOMAIN_COLUMNS.get(domain, {"columns": []})["columns"]
    if sig:
        m = _count_in(ct, sig)
        s = s + F.when(m > 0, F.least(F.lit(0.20), 0.05 * m)).otherwise(0.0)
    ents = entities[:MAX_ENTITIES]
    if ents:
        total = _count_in(ct, ents) + _count_in(F.coalesce("sample_text", F.lit("")), ents)
        s = s + F.when(total >= 2, 0.15).when(total == 1, 0.05).otherwise(0.0)
    if data_type == "text":
        s = s + F.when(F.col("n_text_cols") > 0, 0.15).otherwise(-0.20)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.bround(s, 3)))
    rejected = junk.isNotNull() | (n < MIN_ROWS) | (F.col("n_cols") < MIN_COLUMNS)
    reason = (F.when(junk.isNotNull(), F.concat(F.lit("junk: "), junk))
              .when(n < MIN_ROWS, F.lit("too small")).when(F.col("n_cols") < MIN_COLUMNS, F.lit("too few columns"))
              .otherwise(F.lit("scored")))
    passthrough = [c for c in ("candidate_order",) if c in signals.columns]
    return signals.select("table_name", (~rejected).alias("is_relevant"),
                          F.when(rejected, F.lit(0.0)).otherwise(score).alias("score"), reason.alias("reason"),
                          *passthrough)


def pick_best(scored: DataFrame, order_col: str = "candidate_order") -> DataFrame:
    """QUAL11: the first candidate (in candidate order) scoring >= 0.70, else the best score
    (earliest on ties).  One global aggregate over the candidate rows."""
    ok = F.col("is_relevant") & (F.col("score") > 0)
    key = F.struct(F.when(F.col("score") >= ACCEPT_SCORE, 0).otherwise(1).alias("tier"),
                   F.when(F.col("score") >= ACCEPT_SCORE, F.col(order_col).cast("double"))
                    .otherwise(-F.col("score")).alias("k"),
                   F.col(order_col).alias("o"), F.col("table_name").alias("t"), F.col("score").alias("s"))
    return scored.where(ok).agg(F.min(key).alias("b")).select(
        F.col("b.t").alias("table_name"), F.col("b.s").alias("score"), (F.col("b.tier") == 0).alias("early_accept"))


# ---- QUAL8 / QUAL10: hard rejects and idea-vs-data keyword check -------------------------

# ---- fixed values -------------------------------------------------------------------------
# catalog/index files: >= 3 of one set among the exact (lower-cased, stripped) column names
CATALOG_SIGNAL_SETS = [
    ["rows", "cols", "package"],
    ["rows", "cols", "n_binary"],
    ["package", "item", "title"],
    ["dataset", "rows", "variables"],
    ["name", "rows", "columns", "source"],
    ["dataset_name", "num_rows", "num_cols"],
]
CATALOG_SIGNAL_MIN = 3
# known wrong datasets: >= 2 of one pattern as substrings of the joined lower-case names
WRONG_COLUMN_PATTERNS = [
    ["hallucination", "appropriateness", "prompt category"],
    ["hallucination/accuracy", "bias", "interesting?"],
    ["shape reported", "colors reported"],
    ["longitude", "latitude", "elevation"],
]
WRONG_PATTERN_MIN = 2
IDEA_MATCH_STOP_WORDS = [
    "predict", "classify", "detect", "build", "create", "make",
    "model", "system", "that", "will", "from", "with", "using",
    "based", "whether", "data", "dataset", "machine", "learning",
    "train", "test", "deep", "neural", "want", "need", "help",
    "find", "show", "give", "make", "also", "like", "just",
]
IDEA_WORD_MIN_CHARS = 4
# warnings for an irrelevant table: a topic whose flag columns (>= 2) appear in the names
# while the idea does not mention the topic; else no idea word in the names (>= 2 words)
RED_FLAG_COLUMNS = [
    ("ufo", ["city", "shape reported", "colors reported", "duration"]),
    ("weather", ["temperature", "humidity", "wind_speed", "precipitation"]),
    ("earthquake", ["magnitude", "depth", "latitude", "longitude"]),
    ("covid", ["confirmed", "deaths", "recovered", "province"]),
]
RED_FLAG_MIN = 2
WARN_STOP_WORDS = [
    "predict", "classify", "detect", "build", "create",
    "make", "model", "system", "that", "will", "from",
    "with", "using", "based", "whether", "patient", "data",
]
WARN_MIN_WORDS = 2
# -------------------------------------------------------------------------------------------


def schema_signals(df: DataFrame, name: str, with_sample: bool = True) -> DataFrame:
    """One row per table: name, row count, column count, the column names as given and
    (optionally) the lower-cased text of its first rows (``sample_text``)."""
    out = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_cols"),
        F.array(*[F.lit(c) for c in df.columns]).cast("array<string>").alias("col_names"))
    return attach(out, sample_text(df)) if with_sample else out


def _idea_words(idea: Column, stops: list[str]) -> Column:
    from .verified import PY_WHITESPACE
    return F.filter(F.split(F.lower(idea), PY_WHITESPACE),
                    lambda w: (F.length(w) >= IDEA_WORD_MIN_CHARS)
                    & ~F.array_contains(F.array(*[F.lit(x) for x in stops]), w))


def _catalog_and_wrong(names: Column) -> tuple[Column, Column]:
    """(catalog file, wrong-dataset pattern) flags of an array of column names."""
    col_set = F.transform(names, lambda c: F.trim(F.lower(c)))
    col_text = F.lower(F.array_join(names, " "))
    catalog = F.lit(False)
    for sig in CATALOG_SIGNAL_SETS:
        hits = sum((F.array_contains(col_set, x).cast("int") for x in sig), F.lit(0))
        catalog = catalog | (hits >= CATALOG_SIGNAL_MIN)
    wrong = F.lit(False)
    for pats in WRONG_COLUMN_PATTERNS:
        wrong = wrong | (_count_in(col_text, pats) >= WRONG_PATTERN_MIN)
    return catalog, wrong


def hard_rejects(signals: DataFrame) -> DataFrame:
    """QUAL8 over ``schema_signals`` rows: the scorer's junk patterns (then < 20 rows, < 2
    columns) and the main pipeline's catalog signal sets and wrong-dataset patterns."""
    from .catalog import junk_schema
    catalog, wrong = _catalog_and_wrong(F.col("col_names"))
    j = junk_schema(signals, "col_names")
    reason = (F.when(F.col("is_junk"), F.concat(F.lit("junk: "), F.col("junk_reason")))
              .when(F.col("n_rows") < MIN_ROWS, F.lit("too small"))
              .when(F.col("n_cols") < MIN_COLUMNS, F.lit("too few columns")))
    return j.select("table_name", "n_rows", "n_cols", "is_junk", "junk_reason",
                    catalog.alias("catalog_file"), wrong.alias("wrong_pattern"),
                    reason.isNotNull().alias("rejected"), reason.alias("reject_reason"))


def keyword_match(signals: DataFrame, idea: str) -> DataFrame:
    """QUAL10 over ``schema_signals`` rows (with sample): is the table relevant to ``idea``?
    Catalog files and wrong-dataset patterns are rejected; otherwise any idea word (> 3
    characters, not a pipeline word) in the joined names or in the sample values accepts, and
    an idea with no such word accepts.  Irrelevant tables carry the warning the pipeline
    would log: a red-flag topic, or that no idea word names a column."""
    idea_c = F.lit(idea)
    names = F.col("col_names")
    col_text = F.lower(F.array_join(names, " "))
    sample = F.coalesce(F.col("sample_text"), F.lit(""))
    words = _idea_words(idea_c, IDEA_MATCH_STOP_WORDS)
    catalog, wrong = _catalog_and_wrong(names)
    in_cols = F.exists(words, lambda w: col_text.contains(w))
    in_vals = F.exists(words, lambda w: sample.contains(w))
    verdict = (F.when((F.length(idea_c) == 0) | (F.col("n_cols") == 0), F.lit("no idea or columns"))
               .when(catalog, F.lit("catalog file")).when(wrong, F.lit("wrong dataset pattern"))
               .when(F.size(words) == 0, F.lit("no idea keywords"))
               .when(in_cols, F.lit("keyword in columns")).when(in_vals, F.lit("keyword in values"))
               .otherwise(F.lit("no keyword match")))
    relevant = ~verdict.isin("catalog file", "wrong dataset pattern", "no keyword match")
    idea_low = F.lower(idea_c)
    flag = F.lit(None).cast("string")
    for topic, cols in reversed(RED_FLAG_COLUMNS):
        flag = F.when((_count_in(col_text, cols) >= RED_FLAG_MIN) & ~idea_low.contains(topic),
                      F.lit(topic)).otherwise(flag)
    warn_words = _idea_words(idea_c, WARN_STOP_WORDS)
    no_kw = ((F.size(warn_words) >= WARN_MIN_WORDS)
             & ~F.exists(warn_words, lambda w: col_text.contains(w)))
    warning = (F.when(relevant, F.lit(None))
               .when(flag.isNotNull(), F.concat(F.lit("looks like a "), flag, F.lit(" dataset")))
               .when(no_kw, F.lit("no idea keyword in columns")))
    return signals.select("table_name", F.array_join(words, " ").alias("idea_words"),
                          catalog.alias("catalog_file"), wrong.alias("wrong_pattern"),
                          in_cols.alias("in_columns"), in_vals.alias("in_values"),
                          relevant.alias("is_relevant"), verdict.alias("verdict"), warning.alias("warning"))
