"""Data-quality validation and the 0-100 readiness score (QUAL1-QUAL7).

Everything is derived from the per-column profile (one row per column), the duplicate count
and the target's class counts; the three pieces are one-row aggregates combined by
broadcast.  The report is a one-row DataFrame; raising on issues is opt-in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import attach, column_profile, duplicate_stats

# ---- fixed values -------------------------------------------------------------------------
MIN_ROWS = 10
MIN_COLUMNS = 2
DUPLICATE_ISSUE_RATIO = 0.8
TARGET_MISSING_LIMIT = 0.5
USABLE_MISSING_LIMIT = 0.9
HIGH_MISSING_WARNING = 0.5
IMBALANCE_WARNING = 10
# -------------------------------------------------------------------------------------------


def class_imbalance(df: DataFrame, target: str | None) -> DataFrame:
    """QUAL5: one row with n_classes and max/min class count (1.0 below two classes)."""
    if not target or target not in df.columns:
        return df.sparkSession.range(1).select(
            F.lit(0).cast("long").alias("n_classes"),
            F.lit(1.0).alias("class_imbalance_ratio"))
    counts = (df.where(F.col(target).isNotNull()).groupBy(target)
              .agg(F.count(F.lit(1)).alias("n")))
    return counts.agg(F.count(F.lit(1)).alias("n_classes"),
                      F.max("n").alias("mx"), F.min("n").alias("mn")).select(
        "n_classes",
        F.when(F.col("n_classes") >= 2, F.col("mx") / F.col("mn"))
         .otherwise(F.lit(1.0)).alias("class_imbalance_ratio"))


def score_expr(rows: Column, missing: Column, dup: Column, zero_var: Column, cols: Column,
               imbalance: Column) -> Column:
    """QUAL6: 100 minus capped penalties, clamped at 0, rounded half-even to one place."""
    s = F.lit(100.0)
    s = s - F.least(missing * 60, F.lit(30.0))
    s = s - F.least(dup * 40, F.lit(20.0))
    s = s - F.when(cols > 0, F.least((zero_var / cols) * 30, F.lit(15.0))).otherwise(0.0)
    s = s - F.when(imbalance > 1, F.least((imbalance / 50) * 15, F.lit(15.0))).otherwise(0.0)
    s = s - F.when(rows < 1000, 20.0).when(rows < 5000, 10.0).otherwise(0.0)
    return F.bround(F.greatest(s, F.lit(0.0)), 1)


def _codes(*pairs: tuple[Column, str]) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in pairs])), ",")


def quality_report(df: DataFrame, target: str | None = None) -> DataFrame:
    """QUAL7: one-row validation report.

    Columns: num_rows, num_columns, issues, warnings, is_valid, quality_score,
    missing_value_ratio, duplicate_ratio, class_imbalance_ratio, zero_variance_columns,
    usable_features.  Issues and warnings are comma-joined codes in the reference's order.
    """
    cp = column_profile(df, text_stats=False)
    tgt = F.lit(target) if target else F.lit(None).cast("string")
    is_t = F.col("column_name") == tgt
    zero_var = F.col("n_unique") <= 1
    usable = (~is_t | is_t.isNull()) & (F.col("n_unique") > 1) & (F.col("missing_frac") < USABLE_MISSING_LIMIT)
    per_table = cp.agg(
        F.max("n_rows").alias("cp_rows"),
        F.count(F.lit(1)).alias("num_columns"),
        F.avg("missing_frac").alias("missing_value_ratio"),
        F.count_if(zero_var).alias("zero_var_count"),
        F.array_join(F.transform(
            F.filter(F.array_sort(F.collect_list(F.struct("pos", "column_name", "n_unique"))),
                     lambda s: s["n_unique"] <= 1), lambda s: s["column_name"]), ",").alias("zero_variance_columns"),
        F.count_if(usable).alias("usable_features"),
        F.count_if(is_t).alias("target_present"),
        F.max(F.when(is_t, F.col("n_unique"))).alias("target_unique"),
        F.max(F.when(is_t, F.col("missing_frac"))).alias("target_missing"),
    )
    dup = duplicate_stats(df).select("n_rows", "duplicate_ratio")
    imb = class_imbalance(df, target).select("class_imbalance_ratio")
    r = attach(attach(per_table, dup), imb)

    rows, cols = F.col("n_rows"), F.col("num_columns")
    has_target = F.lit(bool(target))
    issues = _codes(
        ((rows == 0) | (cols == 0), "empty"),
        (rows < MIN_ROWS, "too_few_rows"),
        (cols < MIN_COLUMNS, "too_few_columns"),
        (F.col("duplicate_ratio") > DUPLICATE_ISSUE_RATIO, "mostly_duplicates"),
        (has_target & (F.col("target_present") == 0), "target_not_found"),
        (has_target & (F.col("target_present") > 0) & (F.col("target_unique") < 2), "target_single_value"),
        (has_target & (F.col("target_present") > 0) & (F.col("target_missing") > TARGET_MISSING_LIMIT),
         "target_mostly_missing"),
        (F.col("usable_features") < 1, "no_usable_features"),
    )
    warnings = _codes(
        (F.col("missing_value_ratio") > HIGH_MISSING_WARNING, "high_missing"),
        (F.col("zero_var_count") > 0, "zero_variance_columns"),
        (F.col("class_imbalance_ratio") > IMBALANCE_WARNING, "class_imbalance"),
    )
    missing = F.coalesce(F.col("missing_value_ratio"), F.lit(0.0))
    return r.select(
        rows.alias("num_rows"), cols.cast("long").alias("num_columns"),
        issues.alias("issues"), warnings.alias("warnings"),
        (issues == "").alias("is_valid"),
        score_expr(rows, missing, F.col("duplicate_ratio"), F.col("zero_var_count"), cols,
                   F.col("class_imbalance_ratio")).alias("quality_score"),
        missing.alias("missing_value_ratio"),
        F.col("duplicate_ratio"),
        F.col("class_imbalance_ratio"),
        F.col("zero_variance_columns"),
        F.col("usable_features").cast("long").alias("usable_features"),
    )


def validate(df: DataFrame, target: str | None = None, raise_on_issues: bool = True):
    """Run the report, raise ``RuntimeError`` listing issue codes when any (as the reference)."""
    row = quality_report(df, target).first()
    if raise_on_issues and not row["is_valid"]:
        raise RuntimeError(f"Dataset validation failed: {row['issues']}")
    return row
