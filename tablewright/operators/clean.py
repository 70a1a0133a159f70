"""Cleaning (CLN1-CLN16): quotes, dropped columns, duplicates, numeric strings, imputation.

Column decisions (which to drop, which to coerce) come from the column profile, a frame
with one row per column, so only schema-sized results reach the driver.  Fill values are
exact: medians through ``functions.stats.exact_median`` (distributed range narrowing),
modes through a shuffle of ``(column, value)`` counts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (base_family, clean_value, guarded_double, nonfinite_to_zero,
                                 strip_quotes, strip_quotes_fill)
from ..functions.stats import column_modes, exact_medians, ordered_codes
from .profile import column_profile, feature_flags

# ---- fixed values -------------------------------------------------------------------------
HIGH_MISSING_THRESHOLD = 0.6     # drop a column when more than this share is missing
NUMERIC_STRING_SHARE = 0.9       # coerce a string column when more than this share parses
SAFE_FLOAT_NUMERIC_SHARE = 0.8   # safe-to-float cascade: coerce above this share
SAFE_FLOAT_MAX_LABELS = 200      # safe-to-float cascade: label-code up to this many values
UNKNOWN_CATEGORY = "unknown"
# -------------------------------------------------------------------------------------------


def _string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def strip_quotes_all(df: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """CLN1: strip quote characters, then whitespace, from both ends of every string column."""
    skip = set(exclude or [])
    return df.select(*[strip_quotes(F.col(c)).alias(c) if c in _string_columns(df) and c not in skip
                       else F.col(c) for c in df.columns])


def strip_quotes_fill_all(df: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """CLN2: NULL -> '' then strip quotes and spaces (the empty string becomes a category)."""
    skip = set(exclude or [])
    strs = set(_string_columns(df))
    return df.select(*[strip_quotes_fill(F.col(c)).alias(c) if c in strs and c not in skip
                       else F.col(c) for c in df.columns])


def flagged_columns(df: DataFrame, target: str | None = None) -> list[str]:
    """CLN3 input: constant or id-like columns (never the target)."""
    rows = (feature_flags(df)
            .where(F.array_contains("flags", "constant") | F.array_contains("flags", "id_like"))
            .select("column_name").collect())
    return [r[0] for r in rows if r[0] != target]


def drop_flagged(df: DataFrame, target: str | None = None) -> DataFrame:
    """CLN3: drop constant and id-like columns."""
    return df.drop(*flagged_columns(df, target))


def missing_decisions(df: DataFrame, threshold: float = HIGH_MISSING_THRESHOLD) -> DataFrame:
    """CLN4 decisions: keep a column iff non-null >= int(rows * (1 - threshold)).

    One counting aggregate (partial per task, one row out), then one row per column."""
    cols = [(i, f.name, f.dataType) for i, f in enumerate(df.schema.fields)]
    one = df.agg(F.count(F.lit(1)).alias("n_rows"),
                 *[F.count(clean_value(c, t)).alias(f"c{i}") for i, c, t in cols])
    per_col = one.select("n_rows", F.inline(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column_name"), F.col(f"c{i}").alias("n_non_null"))
        for i, c, _ in cols])))
    need = F.floor(F.col("n_rows") * F.lit(1 - threshold))
    return per_col.select("pos", "column_name", "n_non_null", need.cast("long").alias("min_non_null"),
                          (F.col("n_non_null") >= need).alias("keep"))


def drop_high_missing(df: DataFrame, threshold: float = HIGH_MISSING_THRESHOLD,
                      protect: list[str] | None = None) -> DataFrame:
    """CLN4: drop columns with more than ``threshold`` missing."""
    keep = {r[0] for r in missing_decisions(df, threshold).where("keep").select("column_name").collect()}
    keep |= set(protect or [])
    return df.select(*[c for c in df.columns if c in keep])


def dedup_rows(df: DataFrame) -> DataFrame:
    """CLN5: exact duplicate rows removed (NULLs compare equal)."""
    return df.dropDuplicates()


def numeric_string_columns(df: DataFrame, share: float = NUMERIC_STRING_SHARE) -> list[str]:
    """String columns whose non-null values are numeric-looking in more than ``share``."""
    strs = _string_columns(df)
    if not strs:
        return []
    from ..functions.columns import numeric_like
    row = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(strs)],
                 *[F.count_if(numeric_like(F.col(c))).alias(f"k{i}") for i, c in enumerate(strs)]).first()
    return [c for i, c in enumerate(strs) if row[f"n{i}"] and row[f"k{i}"] / row[f"n{i}"] > share]


def coerce_numeric(df: DataFrame, columns: list[str] | None = None,
                   share: float = NUMERIC_STRING_SHARE) -> DataFrame:
    """CLN6/CLN12: numeric-looking string columns to double; unparsable values -> NULL."""
    cols = set(numeric_string_columns(df, share) if columns is None else columns)
    return df.select(*[guarded_double(F.col(c)).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def fill_median(df: DataFrame, columns: list[str] | None = None,
                medians: dict[str, float | None] | None = None) -> DataFrame:
    """CLN7/CLN9: numeric NULL (and NaN) -> exact median of the column; all-NULL -> 0.0."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = columns if columns is not None else [c for c, t in types.items() if base_family(t) == "numeric"]
    if medians is None:
        if cols:   # only columns that hold a NULL/NaN are touched (one counting pass)
            nulls = df.agg(*[F.count_if(F.col(c).isNull() | (F.isnan(F.col(c))
                                         if isinstance(types[c], (T.FloatType, T.DoubleType))
                                         else F.lit(False))).alias(c) for c in cols]).first()
            cols = [c for c in cols if nulls[c] > 0]
        medians = exact_medians(df, cols)
    out = []
    for c in df.columns:
        if c in cols:
            m = medians.get(c)
            fill = 0.0 if m is None or (isinstance(m, float) and math.isnan(m)) else m
            v = F.col(c)
            if isinstance(types[c], (T.FloatType, T.DoubleType)):
                v = F.when(~F.isnan(v), v)
            out.append(F.coalesce(v.cast("double"), F.lit(float(fill))).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def fill_mode(df: DataFrame, columns: list[str] | None = None,
              modes: dict[str, str] | None = None) -> DataFrame:
    """CLN8: string NULL -> most frequent value (smallest on ties); none -> 'unknown'."""
    cols = columns if columns is not None else _string_columns(df)
    if modes is None and cols:
        nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
        cols = [c for c in cols if nulls[c] > 0]
    if modes is None and cols:
        modes = {r[0]: r[1] for r in column_modes(df, cols).collect()}
    modes = modes or {}
    return df.select(*[F.coalesce(F.col(c), F.lit(modes.get(c, UNKNOWN_CATEGORY))).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def nonfinite_zero_all(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """CLN14: NaN and +-inf -> 0 in floating columns."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = columns or [c for c, t in types.items() if isinstance(t, (T.FloatType, T.DoubleType))]
    return df.select(*[nonfinite_to_zero(F.col(c)).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def clean_dataset(df: DataFrame, drop_columns: list[str] | None = None,
                  protect: list[str] | None = None) -> DataFrame:
    """The full cleaning pass, in the reference's order.

    strip quotes -> drop given columns -> drop >60 %-missing columns -> drop duplicate rows
    -> coerce numeric strings -> numeric NULL to median -> string NULL to mode.
    Medians and modes are computed on the table passed in (fit-on-train is the caller's
    choice: pass the training frame).
    """
    out = strip_quotes_all(df)
    if drop_columns:
        out = out.drop(*[c for c in drop_columns if c in out.columns])
    out = drop_high_missing(out, protect=protect)
    # The de-duplicated table feeds several statistics jobs below; it is written once to
    # the shared checkpoint folder so the dedup shuffle is not repeated (and lineage is cut).
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    out = dedup_rows(out).checkpoint(eager=True)
    # every later decision (which strings to coerce, which columns hold NULLs before and after
    # coercion) comes from one counting pass over the de-duplicated table
    coerce, med_cols, mode_cols = _fill_decisions(out)
    out = coerce_numeric(out, coerce)
    out = fill_median(out, med_cols, medians=exact_medians(out, med_cols))
    modes = {r[0]: r[1] for r in column_modes(out, mode_cols).collect()} if mode_cols else {}
    return fill_mode(out, mode_cols, modes=modes)


def _fill_decisions(df: DataFrame, share: float = NUMERIC_STRING_SHARE) -> tuple[list[str], list[str], list[str]]:
    """(strings to coerce, numeric columns to median-fill after coercion, strings to mode-fill),
    with the same rules as ``coerce_numeric``, ``fill_median`` and ``fill_mode`` run one after
    another - from one aggregate."""
    from ..functions.columns import numeric_like
    types = {f.name: f.dataType for f in df.schema.fields}
    strs = _string_columns(df)
    nums = [c for c, t in types.items() if base_family(t) == "numeric"]

    def null_or_nan(v, t):
        return v.isNull() | F.isnan(v) if isinstance(t, (T.FloatType, T.DoubleType)) else v.isNull()
    row = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(strs)],
                 *[F.count_if(numeric_like(F.col(c))).alias(f"k{i}") for i, c in enumerate(strs)],
                 *[F.count_if(F.col(c).isNull()).alias(f"z{i}") for i, c in enumerate(strs)],
                 *[F.count_if(null_or_nan(guarded_double(F.col(c)), T.DoubleType())).alias(f"g{i}")
                   for i, c in enumerate(strs)],
                 *[F.count_if(null_or_nan(F.col(c), types[c])).alias(f"m{j}") for j, c in enumerate(nums)],
                 F.count(F.lit(1)).alias("__rows")).first()
    coerce = [c for i, c in enumerate(strs) if row[f"n{i}"] and row[f"k{i}"] / row[f"n{i}"] > share]
    med = set(c for j, c in enumerate(nums) if row[f"m{j}"] > 0)
    med |= {c for i, c in enumerate(strs) if c in coerce and row[f"g{i}"] > 0}
    modes = [c for i, c in enumerate(strs) if c not in coerce and row[f"z{i}"] > 0]
    return coerce, [c for c in df.columns if c in med], modes


def safe_to_float(train: DataFrame, test: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, dict]:
    """CLN16: make every column numeric, fitted on ``train`` and applied to both.

    numeric -> kept; boolean -> 0/1; > 80 % numeric-looking -> double with NULL -> 0;
    <= 200 distinct -> dense code in sorted order of the string image, fitted on train only
    (the reference fits on train and test together); values unseen in train get -1;
    otherwise dropped.  Remaining NULLs -> 0.  Raises when no column survives.
    """
    types = {f.name: f.dataType for f in train.schema.fields}
    cp = {r["column_name"]: r for r in column_profile(train).collect()}
    plan: dict[str, str] = {}
    for c, t in types.items():
        fam = base_family(t)
        r = cp[c]
        if fam == "numeric":
            plan[c] = "keep"
        elif fam == "boolean":
            plan[c] = "bool"
        elif fam == "string" and r["n_rows"] and (r["n_numeric_like"] or 0) / r["n_rows"] > SAFE_FLOAT_NUMERIC_SHARE:
            plan[c] = "coerce"
        elif r["n_unique"] <= SAFE_FLOAT_MAX_LABELS:
            plan[c] = "label"
        else:
            plan[c] = "drop"
    if all(v == "drop" for v in plan.values()):
        raise ValueError("no numeric features remain after safe conversion")

    def apply(frame: DataFrame) -> DataFrame:
        cols = []
        for c in frame.columns:
            how = plan.get(c, "drop")
            if how == "keep":
                cols.append(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c))
            elif how == "bool":
                cols.append(F.coalesce(F.col(c).cast("int"), F.lit(0)).cast("double").alias(c))
            elif how == "coerce":
                cols.append(F.coalesce(guarded_double(F.col(c)), F.lit(0.0)).alias(c))
            elif how == "label":
                cols.append(F.coalesce(F.col(c).cast("string"), F.lit("__nan__")).alias(c))
        out = frame.select(*cols)
        for c, how in plan.items():
            if how == "label" and c in out.columns:
                out = _apply_codes(out, c, label_maps[c])
        return out

    label_maps = {}
    for c, how in plan.items():
        if how == "label":
            img = train.select(F.coalesce(F.col(c).cast("string"), F.lit("__nan__")).alias(c))
            label_maps[c] = ordered_codes(img, c, "code")
    return apply(train), (apply(test) if test is not None else None), plan


def _apply_codes(df: DataFrame, c: str, codes: DataFrame) -> DataFrame:
    """Replace string column ``c`` by its dictionary code (unseen -> -1); at most 200 keys."""
    k = f"__k_{c}"
    joined = df.join(F.broadcast(codes.withColumnRenamed(c, k)), F.col(c) == F.col(k), "left")
    return joined.select(*[F.coalesce(F.col("code"), F.lit(-1)).cast("double").alias(x) if x == c
                           else F.col(x) for x in df.columns])
