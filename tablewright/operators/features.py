"""Feature engineering on DataFrames (FEAT1, FEAT2, FEAT4-6, FEAT10, FEAT12, CLN10).

Fitted values (medians, means, category lists, code dictionaries) are computed from the
training frame only and applied to any frame.  Category lists for one-hot encoding are
bounded (at most 50 per column) and become literal expressions; ordinal dictionaries can be
large, so they stay DataFrames and are joined (broadcast only if the planner finds them small).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.columns import base_family, finite_or_null, guarded_double, parse_datetime, strip_label
from ..functions.stats import column_modes, exact_medians, join_dictionary, ordered_codes

# ---- fixed values -------------------------------------------------------------------------
MAX_OHE_CATEGORIES = 50          # pipeline: one-hot up to this many categories, else ordinal
STANDALONE_OHE_LIMIT = 15        # standalone encoder: one-hot for 3..15 categories
SEQUENCE_WINDOW = 30
DATETIME_SUFFIXES = ("year", "month", "day", "hour")
# -------------------------------------------------------------------------------------------


# ---- target encoding (FEAT1 / FEAT2) -----------------------------------------------------

def target_codes(df: DataFrame, target: str) -> DataFrame:
    """Dictionary (label, code) for a string target: stripped labels, sorted, 0-based."""
    lab = df.select(strip_label(F.col(target).cast("string")).alias("label"))
    return ordered_codes(lab, "label", "code")


def encode_target(df: DataFrame, target: str, task: str, codes: DataFrame | None = None,
                  out: str = "y") -> DataFrame:
    """FEAT1: regression -> double (unparsable/NULL -> 0.0); numeric classification -> the
    integer (NULL -> 0), or the rank of the value if any label has a fraction; string
    classification -> sorted label code."""
    dtype = df.schema[target].dataType
    fam = base_family(dtype)
    if task == "regression":
        v = F.col(target).cast("double") if fam == "numeric" else guarded_double(F.col(target).cast("string"))
        return df.withColumn(out, F.coalesce(v, F.lit(0.0)))
    if fam in ("numeric", "boolean"):
        keyed = df.withColumn("__label", F.coalesce(finite_or_null(F.col(target)), F.lit(0.0)))
        if keyed.where(F.col("__label") != F.floor("__label")).isEmpty():
            return keyed.withColumn(out, F.col("__label")).drop("__label")
        ranked = join_dictionary(keyed, ordered_codes(keyed, "__label", "code"), "__label")
        return ranked.withColumn(out, F.col("code").cast("double")).drop("__label", "code")
    if codes is None:
        codes = target_codes(df, target)
    lab = strip_label(F.col(target).cast("string"))
    keyed = df.withColumn("__label", lab)
    joined = join_dictionary(keyed, codes.withColumnRenamed("label", "__label"), "__label")
    return joined.withColumn(out, F.col("code").cast("double")).drop("__label", "code")


def decode_target(df: DataFrame, codes: DataFrame, col: str = "prediction", out: str = "label") -> DataFrame:
    """FEAT2: code -> original label through the same dictionary."""
    inv = codes.select(F.col("code").cast("double").alias("__code"), F.col("label").alias(out))
    return join_dictionary(df.withColumn("__code", F.col(col).cast("double")), inv, "__code").drop("__code")


# ---- datetime parts (CLN10) --------------------------------------------------------------

def datetime_parts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace each date column by ``<col>_year/_month/_day/_hour`` ints; unparsed -> 0."""
    out = df
    for c in columns:
        dtype = df.schema[c].dataType
        ts = F.col(c) if base_family(dtype) == "datetime" else parse_datetime(F.col(c).cast("string"))
        out = (out.withColumn(f"{c}_year", F.coalesce(F.year(ts), F.lit(0)))
                  .withColumn(f"{c}_month", F.coalesce(F.month(ts), F.lit(0)))
                  .withColumn(f"{c}_day", F.coalesce(F.dayofmonth(ts), F.lit(0)))
                  .withColumn(f"{c}_hour", F.coalesce(F.hour(ts), F.lit(0)))
                  .drop(c))
    return out


# ---- numeric scaling (FEAT4) -------------------------------------------------------------

@dataclass
class ScalerFit:
    medians: dict = field(default_factory=dict)
    means: dict = field(default_factory=dict)
    stds: dict = field(default_factory=dict)


def fit_standard_scaler(train: DataFrame, columns: list[str]) -> ScalerFit:
    """Exact median for imputation, then mean and *population* std of the imputed column; NaN
    and infinities are missing values."""
    usable = train.select(*[finite_or_null(F.col(c)).alias(c) for c in columns])
    med = exact_medians(usable, columns)
    med = {c: (0.0 if v is None else v) for c, v in med.items()}
    imputed = usable.select(*[F.coalesce(F.col(c), F.lit(med[c])).alias(c) for c in columns])
    row = imputed.agg(*[F.avg(c).alias(f"m_{c}") for c in columns],
                      *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return ScalerFit(med, {c: row[f"m_{c}"] for c in columns}, {c: row[f"s_{c}"] for c in columns})


def apply_standard_scaler(df: DataFrame, fit: ScalerFit, suffix: str = "") -> DataFrame:
    """(x - mean) / std, missing -> median; a zero std gives 0."""
    out = df
    for c in fit.means:
        x = F.coalesce(finite_or_null(F.col(c)), F.lit(fit.medians[c]))
        s = fit.stds[c] or 0.0
        val = (x - F.lit(fit.means[c])) / F.lit(s) if s > 0 else (x - F.lit(fit.means[c]))
        out = out.withColumn(c + suffix, val)
    return out


# ---- categorical encoders (FEAT5 / FEAT6 / FEAT10) ----------------------------------------

def _cat_image(c: str) -> Column:
    return F.col(c).cast("string")


def fit_categories(train: DataFrame, columns: list[str], limit: int = MAX_OHE_CATEGORIES) -> dict:
    """Sorted category list per column; one shuffle of (column, value) pairs.  A column with
    more than ``limit`` values raises: it needs an ordinal dictionary (``fit_ordinal``)."""
    long = train.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), _cat_image(c).alias("v")) for c in columns])))
    d = long.where(F.col("v").isNotNull()).distinct()
    w = Window.partitionBy("column_name").orderBy("v")
    firsts = (d.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= limit + 1)
              .groupBy("column_name").agg(F.array_sort(F.collect_list("v")).alias("vals")).collect())
    wide = sorted(r["column_name"] for r in firsts if len(r["vals"]) > limit)
    if wide:
        raise ValueError(f"more than {limit} categories, use ordinal codes: {wide}")
    return {r["column_name"]: list(r["vals"]) for r in firsts}


def onehot(df: DataFrame, column: str, categories: list[str], fill: str | None = None,
           drop_first: bool = False) -> DataFrame:
    """FEAT5: one 0/1 column ``<column>__<value>`` per known category; unknown -> all zeros.
    NULL takes the fitted mode ``fill``."""
    v = F.coalesce(_cat_image(column), F.lit(fill)) if fill is not None else _cat_image(column)
    cats = categories[1:] if drop_first else categories
    return df.select(*[x for x in df.columns if x != column],
                     *[F.when(v == F.lit(cat), 1.0).otherwise(0.0).alias(f"{column}__{cat}") for cat in cats])


def fit_ordinal(train: DataFrame, column: str, fill: str | None = None) -> DataFrame:
    """FEAT6 fit: dictionary (value, code) in sorted order of the string image."""
    v = F.coalesce(_cat_image(column), F.lit(fill)) if fill is not None else _cat_image(column)
    return ordered_codes(train.select(v.alias("__v")), "__v", "__code")


def ordinal(df: DataFrame, column: str, dictionary: DataFrame, fill: str | None = None) -> DataFrame:
    """FEAT6 apply: code of the value, -1 for a value unseen in training."""
    v = F.coalesce(_cat_image(column), F.lit(fill)) if fill is not None else _cat_image(column)
    j = join_dictionary(df.withColumn("__v", v), dictionary, "__v")
    return j.withColumn(column, F.coalesce(F.col("__code"), F.lit(-1)).cast("double")).drop("__v", "__code")


def category_modes(train: DataFrame, columns: list[str]) -> dict:
    return {r["column_name"]: r["mode"] for r in column_modes(train, columns).collect()}


def encode_standalone(df: DataFrame, target: str | None = None) -> DataFrame:
    """FEAT10: string/bool columns with <= 2 or > 15 distinct values -> label code (sorted
    string image, NULL as the string 'None'); 3..15 distinct -> one-hot dropping the first
    category.  The target is left alone."""
    cols = [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.StringType, T.BooleanType)) and f.name != target]
    if not cols:
        return df
    from .profile import column_profile
    nun = {r["column_name"]: r["n_unique"] for r in column_profile(df, cols, text_stats=False).collect()}
    ohe_cols = [c for c in cols if 2 < nun[c] <= STANDALONE_OHE_LIMIT]
    label_cols = [c for c in cols if c not in ohe_cols]
    cats = fit_categories(df, ohe_cols, STANDALONE_OHE_LIMIT) if ohe_cols else {}
    out = df
    for c in label_cols:
        img = F.coalesce(F.col(c).cast("string"), F.lit("None"))
        out = out.withColumn(c, img)
        codes = ordered_codes(out.select(c), c, "__code")
        out = join_dictionary(out, codes, c).withColumn(c, F.col("__code").cast("long")).drop("__code")
    for c in ohe_cols:
        out = onehot(out, c, cats[c], drop_first=True)
    return out


# ---- sequence windows (FEAT12) -----------------------------------------------------------

def rank_within(df: DataFrame, entity: str, order_cols: list[str], out: str = "_rn") -> DataFrame:
    """1-based row number per entity in ``order_cols`` order, without a per-entity task.

    Rows are range-partitioned on (entity, order); a hot entity spans many partitions.
    Local row numbers per (partition, entity) plus per-entity offsets from the small
    (partition, entity) count table give the global number.
    """
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    n_parts = max(2, df.sparkSession.sparkContext.defaultParallelism)
    # Partition ids must be identical for both uses below, so the range-partitioned frame is
    # checkpointed (reliable storage; also cuts lineage against executor loss).
    ranged = (df.repartitionByRange(n_parts, entity, *order_cols)
              .withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True))
    local = ranged.withColumn("_lr", F.row_number().over(
        Window.partitionBy("_pid", entity).orderBy(*order_cols)))
    sizes = ranged.groupBy(entity, "_pid").agg(F.count(F.lit(1)).alias("_sz"))
    off = sizes.withColumn("_off", F.coalesce(F.sum("_sz").over(
        Window.partitionBy(entity).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (local.join(off.select(entity, "_pid", "_off"), [entity, "_pid"])
            .withColumn(out, F.col("_off") + F.col("_lr")).drop("_pid", "_lr", "_off"))


def sequence_windows(df: DataFrame, entity: str, order_cols: list[str], features: list[str],
                     target: str, window: int = SEQUENCE_WINDOW, chunk: int = 100_000) -> DataFrame:
    """FEAT12: for each row with ``window`` predecessors in its entity, the array of the
    previous ``window`` feature structs (oldest first) and the row's target.

    The timeline of each entity is cut into chunks of ``chunk`` rows; the last ``window``
    rows of a chunk are copied into the next one as a halo, so each window partition holds at
    most ``chunk + window`` rows however large one entity is.
    """
    ranked = rank_within(df, entity, order_cols)
    z = F.col("_rn") - 1
    own = ranked.withColumn("_chunk", F.floor(z / chunk)).withColumn("_halo", F.lit(False))
    halo = (ranked.where(z % chunk >= chunk - window)
            .withColumn("_chunk", F.floor(z / chunk) + 1).withColumn("_halo", F.lit(True)))
    both = own.unionByName(halo)
    w = (Window.partitionBy(entity, "_chunk").orderBy("_rn")
         .rowsBetween(-window, -1))
    feats = F.struct(*[F.col(c) for c in features])
    seq = both.withColumn("seq", F.collect_list(feats).over(w))
    return (seq.where(~F.col("_halo") & (F.size("seq") == window))
            .select(entity, F.col("_rn").alias("position"), "seq", F.col(target).alias("target")))
