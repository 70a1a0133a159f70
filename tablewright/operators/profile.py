"""Table profiling (PROF1-PROF16): shape, missing values, distinct counts, flags, families.

Physical design: a table is profiled by at most two passes, whatever its width.

* Pass A - one ``agg`` over the table: row count, non-null counts, numeric moments, parse
  rates and word counts for every column at once.  Partial aggregation means each task
  ships one row to the final stage.
* Pass B, only for callers that need distinct counts - one unpivot of the columns to
  ``(pos, key)`` followed by a distinct and a count.  The key is the value, or its 128-bit
  hash if it is longer than 32 bytes, so documents never travel.  Hot values are combined
  map-side, so one holding a third of all rows costs one row per task.

Both results have one row per column (bounded by the schema, not the data), so joining
them uses a broadcast.  Nothing row-level reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.columns import (base_family, clean_value, parse_datetime, numeric_like,
                                 value_as_string, word_count)

# ---- fixed values -------------------------------------------------------------------------
SMALL_DATASET_ROWS = 50_000      # fewer rows -> "small"
MEDIUM_DATASET_ROWS = 500_000    # fewer rows -> "medium", else "large"
TEXT_MEAN_WORDS = 5              # analyzer: mean words above this -> text column
DATETIME_PARSE_SHARE = 0.8       # analyzer: share of all rows parsing as dates
HIGH_CARDINALITY_RATIO = 0.95    # feature flags: distinct / rows above this
PREFIX = 32                      # characters that find the first values of a column
SKEW_LIMIT = 2.0                 # feature flags: |bias-corrected skew| above this
# -------------------------------------------------------------------------------------------

_PASS_A_FIELDS = [
    ("n_non_null", T.LongType()), ("v_min", T.DoubleType()), ("v_max", T.DoubleType()),
    ("v_mean", T.DoubleType()), ("skew_pop", T.DoubleType()), ("var_pop", T.DoubleType()),
    ("n_date", T.LongType()), ("n_numeric_like", T.LongType()),
    ("sum_words", T.LongType()), ("sum_len", T.LongType()),
]


def _pass_a_struct(i: int, name: str, dtype: T.DataType, text_stats: bool = True) -> Column:
    fam = base_family(dtype)
    v = clean_value(name, dtype)
    nulls = {f: F.lit(None).cast(t) for f, t in _PASS_A_FIELDS}
    fields = dict(nulls)
    fields["n_non_null"] = F.count(v)
    if fam == "numeric":
        d = v.cast("double")
        fields.update(v_min=F.min(d), v_max=F.max(d), v_mean=F.avg(d),
                      skew_pop=F.skewness(d), var_pop=F.var_pop(d))
    elif fam == "string" and text_stats:
        s = F.col(name)
        fields.update(n_date=F.count_if(parse_datetime(s).isNotNull()),
                      n_numeric_like=F.count_if(numeric_like(s)),
                      sum_words=F.sum(word_count(s)), sum_len=F.sum(F.length(s)))
    return F.struct(F.lit(i).alias("pos"),
                    *[fields[f].cast(t).alias(f) for f, t in _PASS_A_FIELDS]).alias(f"c{i}")


def _columns(df: DataFrame, columns: list[str] | None) -> list[tuple[int, str, T.DataType]]:
    names = columns if columns is not None else df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    return [(i, c, types[c]) for i, c in enumerate(names)]


def distinct_key(c: str, dtype: T.DataType) -> Column:
    """A short stand-in for a value in distinct counts: its string image, or that image's MD5
    if it is longer than 32 bytes (so the two forms never meet: an MD5 is marked)."""
    image = value_as_string(c, dtype)
    if base_family(dtype) in ("string", "nested", "other"):
        return F.when(F.octet_length(image) > 32, F.concat(F.lit("md5 of a long value: "), F.md5(image))).otherwise(image)
    return image


def column_profile(df: DataFrame, columns: list[str] | None = None,
                   text_stats: bool = True, distinct: bool = True) -> DataFrame:
    """One row per column with everything the reference derives per column.

    Columns: pos, column_name, dtype, base, n_rows, n_non_null, n_null, missing_frac, n_unique,
    v_min, v_max, v_mean, skew, n_date, n_numeric_like, avg_words, avg_len.
    ``skew`` is bias-corrected (the pandas / DuckDB definition); NULL below 3 values and 0
    for a constant column.  ``text_stats=False`` skips the date/number parse rates and word
    counts (the costly per-string expressions); ``distinct=False`` skips pass B and leaves
    ``n_unique`` NULL.
    """
    cols = _columns(df, columns)
    meta = df.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column_name"),
                 F.lit(t.simpleString()).alias("dtype"), F.lit(base_family(t)).alias("base"))
        for i, c, t in cols])))

    # Pass A: one aggregation, one row, then one row per column.
    structs = [_pass_a_struct(i, c, t, text_stats) for i, c, t in cols]
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *structs)
    pass_a = one.select("n_rows", F.inline(F.array(*[F.col(f"c{i}") for i, _, _ in cols])))

    per_column = F.broadcast(meta).join(F.broadcast(pass_a), "pos")
    if distinct:
        # Pass B: unpivot to (pos, key), exact distinct count per column.
        long = df.select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("pos"), distinct_key(c, t).alias("v")) for i, c, t in cols
        ]))).where(F.col("v").isNotNull())
        pass_b = long.distinct().groupBy("pos").agg(F.count(F.lit(1)).alias("n_unique"))
        per_column = per_column.join(pass_b, "pos", "left")
    else:
        per_column = per_column.withColumn("n_unique", F.lit(None).cast("long"))

    n = F.col("n_rows")
    nn = F.col("n_non_null")
    skew_n = nn  # skew is over non-null values
    corrected = F.col("skew_pop") * F.sqrt(skew_n * (skew_n - 1)) / (skew_n - 2)
    return (per_column
            .select(
                "pos", "column_name", "dtype", "base", "n_rows", "n_non_null",
                (n - nn).alias("n_null"),
                F.when(n > 0, (n - nn) / n).otherwise(F.lit(0.0)).alias("missing_frac"),
                (F.coalesce(F.col("n_unique"), F.lit(0)) if distinct else F.col("n_unique")).cast("long").alias("n_unique"),
                "v_min", "v_max", "v_mean",
                F.when(F.col("base") != "numeric", None)
                 .when(skew_n < 3, None)
                 .when(F.col("var_pop") == 0, F.lit(0.0))
                 .otherwise(corrected).alias("skew"),
                "n_date", "n_numeric_like",
                (F.col("sum_words") / nn).alias("avg_words"),
                (F.col("sum_len") / nn).alias("avg_len"),
            ))


def row_hash(df: DataFrame) -> list[Column]:
    """Two independent 64-bit hashes of a whole row; NULL (and NaN) differs from every value
    and from a NULL in another column."""
    values = [F.to_json(F.col(f.name)) if base_family(f.dataType) == "nested" else clean_value(f.name, f.dataType)
              for f in df.schema.fields]
    gaps = F.concat(*[F.when(v.isNull(), "0").otherwise("1") for v in values])
    return [F.xxhash64(F.lit(seed), gaps, *values).alias(f"__h{seed}") for seed in (1, 2)]


def duplicate_stats(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_distinct_rows, n_duplicates, duplicate_ratio (NULLs compare equal).
    One scan; rows travel as 128-bit hashes, counted map-side first."""
    seen = df.select(*row_hash(df)).groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("n"))
    out = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct_rows"))
    return out.select("n_rows", "n_distinct_rows",
                      (F.col("n_rows") - F.col("n_distinct_rows")).alias("n_duplicates"),
                      ((F.col("n_rows") - F.col("n_distinct_rows"))
                       / F.greatest(F.col("n_rows"), F.lit(1))).alias("duplicate_ratio"))


def attach(left: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row frame to every row of ``left``.

    The right side has exactly one row by construction (a global aggregate), so it is
    broadcast and joined on a constant key.
    """
    k = "__one"
    return (left.withColumn(k, F.lit(1))
            .join(F.broadcast(one_row.withColumn(k, F.lit(1))), k).drop(k))


def size_bucket(n_rows: Column) -> Column:
    return (F.when(n_rows < SMALL_DATASET_ROWS, "small")
            .when(n_rows < MEDIUM_DATASET_ROWS, "medium").otherwise("large"))


def analyzer_family(cp: DataFrame) -> DataFrame:
    """Add ``family`` (numeric / categorical / datetime / text / other) as the analyzer sees it.

    Numeric storage -> numeric.  String and boolean columns become datetime when more than
    80 % of *all* rows parse as a date, else text when the mean word count of non-null values
    exceeds 5, else categorical.  Native date/time columns are reported as datetime.  The
    reference reads only its first 200 non-null values for the word rule; we use the whole
    column (documented difference: sampling by row order has no meaning in Spark).
    """
    date_share = F.col("n_date") / F.col("n_rows")
    fam = (F.when(F.col("base") == "numeric", "numeric")
           .when(F.col("base") == "datetime", "datetime")
           .when(F.col("base") == "boolean", "categorical")
           .when(F.col("base") == "string",
                 F.when(date_share > DATETIME_PARSE_SHARE, "datetime")
                  .when(F.col("avg_words") > TEXT_MEAN_WORDS, "text")
                  .otherwise("categorical"))
           .otherwise("other"))
    return cp.withColumn("family", fam)


def _joined(cp: DataFrame, family: str) -> Column:
    sel = F.filter(F.array_sort(F.collect_list(F.struct("pos", "column_name", "family"))),
                   lambda s: s["family"] == family)
    return F.array_join(F.transform(sel, lambda s: s["column_name"]), ",")


def dataset_profile(df: DataFrame) -> DataFrame:
    """PROF12: one row with rows, features, column families, ratios and size bucket."""
    cp = analyzer_family(column_profile(df, distinct=False))
    summary = cp.agg(
        F.max("n_rows").alias("num_rows"),
        F.count(F.lit(1)).alias("num_features"),
        _joined(cp, "numeric").alias("numeric_columns"),
        _joined(cp, "categorical").alias("categorical_columns"),
        _joined(cp, "datetime").alias("datetime_columns"),
        _joined(cp, "text").alias("text_columns"),
        F.avg("missing_frac").alias("missing_raw"),
    )
    dup = duplicate_stats(df).select("duplicate_ratio")
    return attach(summary, dup).select(
        F.coalesce("num_rows", F.lit(0)).cast("long").alias("num_rows"),
        F.col("num_features").cast("long").alias("num_features"),
        "numeric_columns", "categorical_columns", "datetime_columns", "text_columns",
        F.bround(F.coalesce("missing_raw", F.lit(0.0)), 4).alias("missing_value_ratio"),
        F.bround("duplicate_ratio", 4).alias("duplicate_row_ratio"),
        size_bucket(F.coalesce("num_rows", F.lit(0))).alias("size_bucket"),
    )


def profile_shape(df: DataFrame) -> DataFrame:
    """PROF1: row and column count."""
    return df.agg(F.count(F.lit(1)).alias("num_rows")).select(
        "num_rows", F.lit(len(df.columns)).cast("long").alias("num_columns"))


def missing_by_column(df: DataFrame) -> DataFrame:
    """PROF2: missing percentage per column, rounded half-even to 2 places."""
    return column_profile(df, text_stats=False, distinct=False).select(
        "column_name", F.bround(F.col("missing_frac") * 100, 2).alias("missing_pct"))


def missing_ratio(df: DataFrame) -> DataFrame:
    """PROF3: mean of the per-column missing fractions, plus the >0.5 warning flag."""
    return column_profile(df, text_stats=False, distinct=False).agg(F.avg("missing_frac").alias("r")).select(
        F.bround("r", 4).alias("missing_value_ratio"), (F.col("r") > 0.5).alias("high_missing"))


def distinct_by_column(df: DataFrame) -> DataFrame:
    """PROF5: exact distinct count per column, NULLs (and NaN) excluded."""
    return column_profile(df, text_stats=False).select("column_name", "n_unique")


def column_stats(df: DataFrame) -> DataFrame:
    """PROF6: per-column storage family, distinct count and missing percentage."""
    return column_profile(df, text_stats=False).select(
        "column_name", "base", "n_unique", F.bround(F.col("missing_frac") * 100, 2).alias("missing_pct"))


def constant_columns(df: DataFrame) -> DataFrame:
    """PROF7: columns with at most one distinct value (an all-NULL column counts)."""
    return column_profile(df, text_stats=False).where(F.col("n_unique") <= 1).select("column_name", "n_unique")


def skewed_columns(df: DataFrame) -> DataFrame:
    """PROF8: bias-corrected skewness of every numeric column and the |skew| > 2 flag."""
    return (column_profile(df, text_stats=False, distinct=False).where(F.col("base") == "numeric")
            .select("column_name", "skew", (F.abs(F.col("skew")) > SKEW_LIMIT).alias("skewed")))


def feature_flags(df: DataFrame) -> DataFrame:
    """PROF9/PROF13: per column flags constant / high_cardinality / id_like / skewed.

    ``high_cardinality`` and ``id_like`` only apply to non-constant columns; ``id_like``
    needs high cardinality and a name containing "id" or "index" (plain substring, so
    "width" matches too, as in the reference).  Skew is tested for numeric columns.
    """
    cp = column_profile(df, text_stats=False)
    lname = F.lower(F.col("column_name"))
    constant = F.col("n_unique") <= 1
    high = ~constant & (F.col("n_unique") / F.col("n_rows") > HIGH_CARDINALITY_RATIO)
    id_like = high & (lname.contains("id") | lname.contains("index"))
    skewed = (F.col("base") == "numeric") & (F.abs(F.col("skew")) > SKEW_LIMIT)
    flags = F.array_compact(F.array(
        F.when(constant, F.lit("constant")), F.when(high, F.lit("high_cardinality")),
        F.when(id_like, F.lit("id_like")), F.when(skewed, F.lit("skewed"))))
    return cp.select("pos", "column_name", flags.alias("flags"))


def _first_values(df: DataFrame, cols: list, n: int, prefix: int | None, bounds: dict | None = None) -> list[tuple]:
    """The ``n`` least distinct values of each column as (position, value): their first ``prefix``
    characters where given, only values that begin no later than the column's bound where given."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("pos"),
                 (F.when(F.left(v, F.lit(PREFIX)) <= F.lit(bounds[i]), v) if bounds else
                  F.left(v, F.lit(prefix)) if prefix else v).alias("v"))
        for i, v in ((i, value_as_string(c, t)) for i, c, t in cols)]))).where(F.col("v").isNotNull()).distinct()
    w = F.row_number().over(Window.partitionBy("pos").orderBy("v"))
    return [tuple(r) for r in long.withColumn("rk", w).where(F.col("rk") <= n).select("pos", "v").collect()]


def value_summary(df: DataFrame, columns: list[str] | None = None, max_options: int = 10,
                  n_examples: int = 5) -> DataFrame:
    """PROF14: per column min/max/mean (numeric, rounded to 2) and either all options
    (at most ``max_options`` distinct values) or ``n_examples`` example values.

    The first values are found by their first ``PREFIX`` characters, which order as the values do;
    only columns where one of these is cut need a second pass, over the values whose beginning is
    no larger than the last of them.  Whole long texts beyond that are never shuffled.
    """
    cols = _columns(df, columns)
    first = _first_values(df, cols, max_options + 1, PREFIX)
    cut = {}
    for pos, v in first:
        if len(v) >= PREFIX:
            cut[pos] = max(v for p, v in first if p == pos)
    if cut:
        first = [(pos, v) for pos, v in first if pos not in cut]
        first += _first_values(df, [c for c in cols if c[0] in cut], max_options + 1, None, cut)
    firsts = df.sparkSession.createDataFrame(first, "pos int, v string").groupBy("pos").agg(
        F.array_sort(F.collect_list("v")).alias("vals"))
    cp = column_profile(df, [c for _, c, _ in cols], text_stats=False)
    return (cp.join(firsts, "pos", "left").select(
        "column_name",
        F.when(F.col("base") == "numeric", F.bround("v_min", 2)).alias("min"),
        F.when(F.col("base") == "numeric", F.bround("v_max", 2)).alias("max"),
        F.when(F.col("base") == "numeric", F.bround("v_mean", 2)).alias("mean"),
        F.when(F.col("n_unique") <= max_options, F.array_join("vals", "|")).alias("options"),
        F.when(F.col("n_unique") > max_options,
               F.array_join(F.slice("vals", 1, n_examples), "|")).alias("examples"),
    ))


def sample_row(df: DataFrame, order_by: list[str]) -> DataFrame:
    """PROF15: one complete row (no NULL in any column), the first by ``order_by``.

    Returns an empty frame when every row has a NULL (the reference raises).
    """
    return df.dropna(how="any").orderBy(*order_by).limit(1)


def target_counts(df: DataFrame, target: str) -> DataFrame:
    """PROF16: value counts of the target, quote-stripped string labels, NULL excluded."""
    from ..functions.columns import strip_quotes
    label = strip_quotes(F.col(target).cast("string"))
    return (df.where(F.col(target).isNotNull()).groupBy(label.alias("label"))
            .agg(F.count(F.lit(1)).alias("n")))
