"""Column typing and task detection (TYP1-TYP6).

All rule inputs come from one column profile (two jobs); the rules are ordered ``when``
chains over that one-row-per-column frame.  Target detection joins the column names with a
broadcast hint table (fixed, tiny).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import column_profile

# ---- fixed values -------------------------------------------------------------------------
MAX_OHE_CATEGORIES = 50
MAX_TEXT_WORDS = 5
MAX_TEXT_LENGTH = 100
ID_UNIQUE_RATIO = 0.95
HIGH_MISSING_DROP = 0.90
DATETIME_STRING_SHARE = 0.7
NUMERIC_STRING_SHARE = 0.85
MIN_UNIQUE_FOR_DATETIME = 5
REGRESSION_MIN_UNIQUE = 20      # numeric target with more distinct values -> regression

# Target-name hints, in priority order (a repeated entry is kept as listed).
TARGET_NAME_HINTS = [
    "target", "label", "class", "output", "result",
    "y", "outcome", "prediction", "response",
    "survived", "diagnosis", "fraud", "churn",
    "price", "salary", "score", "rating", "default",
    "status", "disease", "cancer", "death", "income",
    "species", "category", "type", "grade", "quality",
    "approved", "admit", "admitted", "pass", "fail",
    "buy", "sold", "purchased", "converted", "clicked",
    "spam", "ham", "sentiment", "positive", "negative",
    "win", "loss", "won", "nowin", "result",
]

TASKS = ["classification", "regression", "time_series", "nlp", "computer_vision", "clustering"]
# -------------------------------------------------------------------------------------------


def classify_columns(df: DataFrame, target: str | None = None) -> DataFrame:
    """TYP1: one row per non-target column with col_type, encoder, n_unique, missing_frac.

    col_type is drop / numeric / datetime / id / text / categorical; encoder is "ohe" or
    "ordinal" for categorical columns.  Boolean storage counts as numeric (as the reference,
    whose bool rule is unreachable).  Date/number-likeness is measured on all non-null values
    instead of the reference's first 50/100.
    """
    cp = column_profile(df)
    if target:
        cp = cp.where(F.col("column_name") != target)
    nn = F.col("n_non_null")
    date_share = F.col("n_date") / nn
    num_share = F.col("n_numeric_like") / nn
    uniq_ratio = F.col("n_unique") / F.greatest(F.col("n_rows"), F.lit(1))
    is_str = F.col("base").isin("string", "nested", "other")
    t = (F.when(F.col("missing_frac") > HIGH_MISSING_DROP, "drop")
         .when(F.col("base").isin("numeric", "boolean"), "numeric")
         .when(F.col("base") == "datetime", "datetime")
         .when(is_str & (F.col("n_unique") > MIN_UNIQUE_FOR_DATETIME)
               & (F.coalesce(date_share, F.lit(0.0)) > DATETIME_STRING_SHARE), "datetime")
         .when(is_str & (F.coalesce(num_share, F.lit(0.0)) > NUMERIC_STRING_SHARE), "numeric")
         .when(uniq_ratio > ID_UNIQUE_RATIO, "id")
         .when((F.coalesce(F.col("avg_words"), F.lit(0.0)) > MAX_TEXT_WORDS)
               | (F.coalesce(F.col("avg_len"), F.lit(0.0)) > MAX_TEXT_LENGTH), "text")
         .otherwise("categorical"))
    return cp.select(
        "pos", "column_name", "base", t.alias("col_type"),
        F.when(t == "categorical",
               F.when(F.col("n_unique") <= MAX_OHE_CATEGORIES, "ohe").otherwise("ordinal")).alias("encoder"),
        "n_unique", "missing_frac")


def task_from_target(cp_target_base: Column, n_unique: Column) -> Column:
    """TYP4: datetime -> time_series; numeric with > 20 distinct -> regression; else classification."""
    return (F.when(cp_target_base == "datetime", "time_series")
            .when(cp_target_base.isin("numeric", "boolean") & (n_unique > REGRESSION_MIN_UNIQUE), "regression")
            .otherwise("classification"))


def detect_task(df: DataFrame, target: str) -> DataFrame:
    """TYP4 on one table: (target, base, n_unique, task_type)."""
    cp = column_profile(df, [target], text_stats=False)
    return cp.select(F.col("column_name").alias("target"), "base", "n_unique",
                     task_from_target(F.col("base"), F.col("n_unique")).alias("task_type"))


def refine_task(initial: Column, target_unique: Column, has_datetime: Column,
                has_text: Column, has_image: Column) -> Column:
    """TYP5: evidence overrides of an initial task guess."""
    cls_or_reg = initial.isin("classification", "regression")
    return (F.when(has_image, "computer_vision")
            .when(has_text & ~cls_or_reg, "nlp")
            .when(has_datetime & ~cls_or_reg, "time_series")
            .when(target_unique.isNotNull() & (target_unique <= 20) & (initial == "regression"), "classification")
            .when(target_unique.isNotNull() & (target_unique > 20) & (initial == "classification"), "regression")
            .when(initial.isin(*TASKS), initial)
            .otherwise("classification"))


def detect_target(df: DataFrame, task_hint: str = "classification") -> DataFrame:
    """TYP6: one row (target, confidence, candidates).

    1. exact lower-case name equal to a hint (hint order) -> high;
    2. name containing a hint (hint order, then column order) -> high;
    3. last column: <= 20 distinct for classification, numeric for regression -> medium;
    4. lowest-cardinality string/boolean column -> low (top-3 as candidates);
    5. lowest-cardinality numeric column -> low; else no target.
    """
    def result(target, confidence, candidates=None):
        return df.sparkSession.createDataFrame([(target, confidence, candidates)],
                                               "target string, confidence string, candidates string")

    names = [(c.lower(), c) for c in df.columns]
    for fits in (lambda name, hint: name == hint, lambda name, hint: hint in name):
        for hint in TARGET_NAME_HINTS:              # the schema alone decides: no data is read
            if found := next((c for name, c in names if fits(name, hint)), None):
                return result(found, "high")
    # one row per column: bounded by the schema
    columns = sorted(column_profile(df, text_stats=False).select("pos", "column_name", "base", "n_unique").collect())
    if not columns:
        return result(None, "low")
    last = columns[-1]
    strings = sorted((r for r in columns if r.base in ("string", "boolean")), key=lambda r: (r.n_unique, r.pos))
    numbers = sorted((r for r in columns if r.base == "numeric"), key=lambda r: (r.n_unique, r.pos))
    if last.n_unique <= 20 if task_hint == "classification" else (task_hint == "regression" and last.base == "numeric"):
        return result(last.column_name, "medium")
    names = ",".join(r.column_name for r in strings[:3])
    best = strings or numbers
    return result(best[0].column_name, "low", names) if best else result(None, "low")
