"""Checked queries for profiling and quality (PROF*, QUAL1-7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import quality as Q
from ..operators import sketches as SK
from ..session import scratch_path
from .derived import DIRTY_ORDERS_COLUMNS, DIRTY_ORDERS_SQL, TABLES, dirty_orders, table
from .registry import query
from .sqlgen import TABLE_COLUMNS, column_profile_sql, families_sql as _families_sql, per_column

D = DIRTY_ORDERS_SQL
DCP = column_profile_sql(D, DIRTY_ORDERS_COLUMNS)


@query("profile_shape", "SELECT count(*) AS num_rows, CAST(6 AS BIGINT) AS num_columns FROM orders")
def profile_shape(spark, d):
    return P.profile_shape(table(spark, d, "orders"))


@query("profile_missing_by_column",
       f"SELECT column_name, round_even(missing_frac * 100, 2) AS missing_pct FROM {DCP}")
def profile_missing_by_column(spark, d):
    return P.missing_by_column(dirty_orders(table(spark, d, "orders")))


@query("profile_missing_ratio",
       f"SELECT round_even(avg(missing_frac), 4) AS missing_value_ratio, avg(missing_frac) > 0.5 AS high_missing FROM {DCP}")
def profile_missing_ratio(spark, d):
    return P.missing_ratio(dirty_orders(table(spark, d, "orders")))


@query("profile_duplicate_ratio", f"""
SELECT n_rows, n_distinct_rows, n_rows - n_distinct_rows AS n_duplicates,
       round((n_rows - n_distinct_rows) / greatest(n_rows, 1), 9) AS duplicate_ratio
FROM (SELECT (SELECT count(*) FROM {D}) AS n_rows,
             (SELECT count(*) FROM (SELECT DISTINCT * FROM {D})) AS n_distinct_rows)
""")
def profile_duplicate_ratio(spark, d):
    s = P.duplicate_stats(dirty_orders(table(spark, d, "orders")))
    return s.withColumn("duplicate_ratio", F.round("duplicate_ratio", 9))


@query("profile_distinct_by_column",
       f"SELECT column_name, n_unique FROM {column_profile_sql('lineitem', TABLE_COLUMNS['lineitem'])}")
def profile_distinct_by_column(spark, d):
    return P.distinct_by_column(table(spark, d, "lineitem"))


@query("profile_column_stats",
       f"SELECT column_name, base, n_unique, round_even(missing_frac * 100, 2) AS missing_pct FROM {DCP}")
def profile_column_stats(spark, d):
    return P.column_stats(dirty_orders(table(spark, d, "orders")))


@query("profile_constant_columns", f"SELECT column_name, n_unique FROM {DCP} WHERE n_unique <= 1")
def profile_constant_columns(spark, d):
    return P.constant_columns(dirty_orders(table(spark, d, "orders")))


_EV = "(SELECT *, value * value AS value_sq FROM events)"
_EV_COLS = TABLE_COLUMNS["events"] + [("value_sq", "numeric")]
_SKEW_SQL = per_column(_EV, [c for c in _EV_COLS if c[1] == "numeric"], """
'{name}' AS column_name,
round(CASE WHEN count({c}) < 3 THEN NULL WHEN var_pop({c}) = 0 THEN 0.0 ELSE skewness({c}) END, 6) AS skew,
abs(CASE WHEN count({c}) < 3 THEN NULL WHEN var_pop({c}) = 0 THEN 0.0 ELSE skewness({c}) END) > 2.0 AS skewed""")


@query("profile_skewed_columns", _SKEW_SQL)
def profile_skewed_columns(spark, d):
    ev = table(spark, d, "events").withColumn("value_sq", F.col("value") * F.col("value"))
    return P.skewed_columns(ev).withColumn("skew", F.round("skew", 6))


_FLAGS_SQL = per_column("events", TABLE_COLUMNS["events"], """
'{name}' AS column_name,
concat_ws(',',
  CASE WHEN count(DISTINCT {c}) <= 1 THEN 'constant' END,
  CASE WHEN count(DISTINCT {c}) > 1 AND count(DISTINCT {c}) / count(*) > 0.95 THEN 'high_cardinality' END,
  CASE WHEN count(DISTINCT {c}) > 1 AND count(DISTINCT {c}) / count(*) > 0.95
        AND (contains(lower('{name}'), 'id') OR contains(lower('{name}'), 'index')) THEN 'id_like' END,
  CASE WHEN '{base}' = 'numeric' AND abs(CASE WHEN count({c}) < 3 THEN NULL
        WHEN var_pop(TRY_CAST({c} AS DOUBLE)) = 0 THEN 0.0 ELSE skewness(TRY_CAST({c} AS DOUBLE)) END) > 2.0
       THEN 'skewed' END) AS flags""")


@query("profile_feature_flags", _FLAGS_SQL)
def profile_feature_flags(spark, d):
    return P.feature_flags(table(spark, d, "events")).select(
        "column_name", F.array_join("flags", ",").alias("flags"))


_SIZE_SQL = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS num_rows, CASE WHEN count(*) < 50000 THEN 'small' "
    f"WHEN count(*) < 500000 THEN 'medium' ELSE 'large' END AS size_bucket FROM {t}" for t in TABLES)


@query("profile_size_bucket", _SIZE_SQL)
def profile_size_bucket(spark, d):
    out = None
    for t in TABLES:
        one = table(spark, d, t).agg(F.count(F.lit(1)).alias("num_rows")).select(
            F.lit(t).alias("table_name"), "num_rows", P.size_bucket(F.col("num_rows")).alias("size_bucket"))
        out = one if out is None else out.unionByName(one)
    return out


@query("profile_column_families",
       "SELECT 'dirty_orders' AS table_name, * FROM (" + _families_sql(D, DIRTY_ORDERS_COLUMNS) + ")"
       "\nUNION ALL\nSELECT 'documents' AS table_name, * FROM ("
       + _families_sql("documents", TABLE_COLUMNS["documents"]) + ")")
def profile_column_families(spark, d):
    a = P.analyzer_family(P.column_profile(dirty_orders(table(spark, d, "orders")), distinct=False))
    b = P.analyzer_family(P.column_profile(table(spark, d, "documents"), distinct=False))
    return (a.select(F.lit("dirty_orders").alias("table_name"), "column_name", "family")
            .unionByName(b.select(F.lit("documents").alias("table_name"), "column_name", "family")))


def _dataset_profile_sql() -> str:
    fam = _families_sql(D, DIRTY_ORDERS_COLUMNS)
    pos = " ".join(f"WHEN '{n}' THEN {i}" for i, (n, _) in enumerate(DIRTY_ORDERS_COLUMNS))

    def joined(f):
        return (f"coalesce(string_agg(CASE WHEN family = '{f}' THEN column_name END, ',' "
                f"ORDER BY CASE column_name {pos} END), '') AS {f.replace('categorical', 'categorical')}_columns")
    return f"""
WITH fam AS ({fam}),
cp AS {DCP},
dup AS (SELECT (SELECT count(*) FROM {D}) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM {D})) AS nd)
SELECT (SELECT n FROM dup) AS num_rows, CAST(count(*) AS BIGINT) AS num_features,
  {joined('numeric')}, {joined('categorical')}, {joined('datetime')}, {joined('text')},
  (SELECT round_even(avg(missing_frac), 4) FROM cp) AS missing_value_ratio,
  (SELECT round_even((n - nd) / greatest(n, 1), 4) FROM dup) AS duplicate_row_ratio,
  CASE WHEN (SELECT n FROM dup) < 50000 THEN 'small' WHEN (SELECT n FROM dup) < 500000 THEN 'medium'
       ELSE 'large' END AS size_bucket
FROM fam"""


@query("profile_dataset", _dataset_profile_sql())
def profile_dataset(spark, d):
    return P.dataset_profile(dirty_orders(table(spark, d, "orders")))


_PART = TABLE_COLUMNS["part"]
_VALUE_SUMMARY_SQL = per_column("part", _PART, """
'{name}' AS column_name,
CASE WHEN '{base}' = 'numeric' THEN round_even(min(TRY_CAST({c} AS DOUBLE)), 2) END AS "min",
CASE WHEN '{base}' = 'numeric' THEN round_even(max(TRY_CAST({c} AS DOUBLE)), 2) END AS "max",
CASE WHEN '{base}' = 'numeric' THEN round_even(avg(TRY_CAST({c} AS DOUBLE)), 2) END AS "mean",
CASE WHEN count(DISTINCT {c}) <= 10 THEN array_to_string(list_sort(list(DISTINCT CAST({c} AS VARCHAR))), '|') END AS options,
CASE WHEN count(DISTINCT {c}) > 10 THEN array_to_string(list_slice(list_sort(list(DISTINCT CAST({c} AS VARCHAR))), 1, 5), '|') END AS examples""")


@query("profile_value_summary", _VALUE_SUMMARY_SQL)
def profile_value_summary(spark, d):
    return P.value_summary(table(spark, d, "part"))


@query("profile_sample_row", f"""
SELECT o_orderkey, o_totalprice, o_orderpriority, o_orderstatus FROM {D}
WHERE o_orderkey IS NOT NULL AND o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL
ORDER BY o_orderkey LIMIT 1""")
def profile_sample_row(spark, d):
    df = dirty_orders(table(spark, d, "orders")).select(
        "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    return P.sample_row(df, ["o_orderkey"])


@query("profile_target_counts", f"""
SELECT regexp_replace(regexp_replace(o_orderstatus, '^[''"]+|[''"]+$', '', 'g'), '^\\s+|\\s+$', '', 'g') AS label,
       count(*) AS n
FROM {D} WHERE o_orderstatus IS NOT NULL GROUP BY 1""")
def profile_target_counts(spark, d):
    return P.target_counts(dirty_orders(table(spark, d, "orders")), "o_orderstatus")


# ---- quality -----------------------------------------------------------------------------

def _quality_sql(src: str, cols: list[tuple[str, str]], target: str | None) -> str:
    cp = column_profile_sql(src, cols)
    names = [n for n, _ in cols]
    t = f"'{target}'" if target else "NULL"
    if target and target in names:
        imb = (f"(SELECT CASE WHEN count(*) >= 2 THEN max(n) / min(n) ELSE 1.0 END FROM "
               f"(SELECT count(*) AS n FROM {src} AS t WHERE \"{target}\" IS NOT NULL GROUP BY \"{target}\"))")
    else:
        imb = "1.0"
    has_t = "TRUE" if target else "FALSE"
    return f"""
WITH cp AS {cp},
dup AS (SELECT (SELECT count(*) FROM {src} AS t) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM {src} AS t)) AS nd),
agg AS (
  SELECT count(*) AS num_columns, avg(missing_frac) AS missing_value_ratio,
    count(*) FILTER (WHERE n_unique <= 1) AS zero_var_count,
    coalesce(string_agg(CASE WHEN n_unique <= 1 THEN column_name END, ',' ORDER BY pos), '') AS zero_variance_columns,
    count(*) FILTER (WHERE column_name IS DISTINCT FROM {t} AND n_unique > 1 AND missing_frac < 0.9) AS usable_features,
    count(*) FILTER (WHERE column_name = {t}) AS target_present,
    max(CASE WHEN column_name = {t} THEN n_unique END) AS target_unique,
    max(CASE WHEN column_name = {t} THEN missing_frac END) AS target_missing
  FROM cp),
r AS (SELECT agg.*, dup.n AS n_rows, (dup.n - dup.nd) / greatest(dup.n, 1) AS duplicate_ratio,
        {imb} AS class_imbalance_ratio FROM agg, dup),
c AS (SELECT r.*,
  concat_ws(',',
    CASE WHEN n_rows = 0 OR num_columns = 0 THEN 'empty' END,
    CASE WHEN n_rows < 10 THEN 'too_few_rows' END,
    CASE WHEN num_columns < 2 THEN 'too_few_columns' END,
    CASE WHEN duplicate_ratio > 0.8 THEN 'mostly_duplicates' END,
    CASE WHEN {has_t} AND target_present = 0 THEN 'target_not_found' END,
    CASE WHEN {has_t} AND target_present > 0 AND target_unique < 2 THEN 'target_single_value' END,
    CASE WHEN {has_t} AND target_present > 0 AND target_missing > 0.5 THEN 'target_mostly_missing' END,
    CASE WHEN usable_features < 1 THEN 'no_usable_features' END) AS issues,
  concat_ws(',',
    CASE WHEN missing_value_ratio > 0.5 THEN 'high_missing' END,
    CASE WHEN zero_var_count > 0 THEN 'zero_variance_columns' END,
    CASE WHEN class_imbalance_ratio > 10 THEN 'class_imbalance' END) AS warnings
  FROM r)
SELECT n_rows AS num_rows, CAST(num_columns AS BIGINT) AS num_columns, issues, warnings, issues = '' AS is_valid,
  round_even(greatest(100.0 - least(missing_value_ratio * 60, 30.0) - least(duplicate_ratio * 40, 20.0)
    - CASE WHEN num_columns > 0 THEN least((zero_var_count / num_columns) * 30, 15.0) ELSE 0.0 END
    - CASE WHEN class_imbalance_ratio > 1 THEN least((class_imbalance_ratio / 50) * 15, 15.0) ELSE 0.0 END
    - CASE WHEN n_rows < 1000 THEN 20.0 WHEN n_rows < 5000 THEN 10.0 ELSE 0.0 END, 0.0), 1) AS quality_score,
  round(missing_value_ratio, 9) AS missing_value_ratio, round(duplicate_ratio, 9) AS duplicate_ratio,
  round(class_imbalance_ratio, 9) AS class_imbalance_ratio, zero_variance_columns,
  CAST(usable_features AS BIGINT) AS usable_features
FROM c"""


def _rounded(df):
    return (df.withColumn("missing_value_ratio", F.round("missing_value_ratio", 9))
              .withColumn("duplicate_ratio", F.round("duplicate_ratio", 9))
              .withColumn("class_imbalance_ratio", F.round("class_imbalance_ratio", 9)))


@query("quality_report", _quality_sql("orders", TABLE_COLUMNS["orders"], "o_orderstatus"))
def quality_report(spark, d):
    return _rounded(Q.quality_report(table(spark, d, "orders"), "o_orderstatus"))


@query("quality_report_dirty", _quality_sql(D, DIRTY_ORDERS_COLUMNS, "o_orderstatus"))
def quality_report_dirty(spark, d):
    return _rounded(Q.quality_report(dirty_orders(table(spark, d, "orders")), "o_orderstatus"))


@query("quality_score", "SELECT quality_score, class_imbalance_ratio FROM ("
       + _quality_sql("labels", TABLE_COLUMNS["labels"], "quality") + ")")
def quality_score(spark, d):
    return _rounded(Q.quality_report(table(spark, d, "labels"), "quality")).select(
        "quality_score", "class_imbalance_ratio")


@query("quality_issues", "SELECT 'region' AS table_name, issues, is_valid FROM ("
       + _quality_sql("region", TABLE_COLUMNS["region"], "r_name")
       + ") UNION ALL SELECT 'nation' AS table_name, issues, is_valid FROM ("
       + _quality_sql("nation", TABLE_COLUMNS["nation"], "missing_target") + ")")
def quality_issues(spark, d):
    a = Q.quality_report(table(spark, d, "region"), "r_name").select(
        F.lit("region").alias("table_name"), "issues", "is_valid")
    b = Q.quality_report(table(spark, d, "nation"), "missing_target").select(
        F.lit("nation").alias("table_name"), "issues", "is_valid")
    return a.unionByName(b)


@query("quality_usable_features", "SELECT usable_features, zero_variance_columns FROM ("
       + _quality_sql(D, DIRTY_ORDERS_COLUMNS, "o_orderstatus") + ")")
def quality_usable_features(spark, d):
    return Q.quality_report(dirty_orders(table(spark, d, "orders")), "o_orderstatus").select(
        "usable_features", "zero_variance_columns")


@query("quality_class_imbalance", """
SELECT 'toxic' AS target, count(*) AS n_classes, round(max(n) / min(n), 9) AS class_imbalance_ratio
FROM (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic)
UNION ALL
SELECT 'role' AS target, count(*) AS n_classes, round(max(n) / min(n), 9) AS class_imbalance_ratio
FROM (SELECT role, count(*) AS n FROM conversations GROUP BY role)""")
def quality_class_imbalance(spark, d):
    a = Q.class_imbalance(table(spark, d, "labels"), "toxic").select(F.lit("toxic").alias("target"), "*")
    b = Q.class_imbalance(table(spark, d, "conversations"), "role").select(F.lit("role").alias("target"), "*")
    return a.unionByName(b).withColumn("class_imbalance_ratio", F.round("class_imbalance_ratio", 9))


_SKETCHED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]


@query("profile_distinct_sketches", "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, true AS within_bound, true AS union_within_bound FROM orders HAVING count(DISTINCT {c}) > 0"
    for c in _SKETCHED))
def profile_distinct_sketches(spark, d):
    """PROF5 by sketches: one a column and year, stored and united, against the exact counts."""
    orders = table(spark, d, "orders").select(*_SKETCHED, F.year("o_orderdate").alias("year"))
    path = scratch_path(spark, "sketches")
    SK.distinct_sketches(orders, _SKETCHED, by=["year"]).write.parquet(path)
    joined = SK.estimates(SK.united(spark.read.parquet(path))).withColumnRenamed("n_distinct", "joined")
    whole = SK.estimates(SK.distinct_sketches(orders, _SKETCHED))
    exact = P.column_profile(orders.select(*_SKETCHED)).select("column_name", F.col("n_unique").alias("exact"))

    def near(c):
        return F.abs(F.col(c) - F.col("exact")) <= F.col("exact") * SK.error_bound()

    return (whole.join(joined, "column_name").join(exact, "column_name")
            .select("column_name", near("n_distinct").alias("within_bound"), near("joined").alias("union_within_bound")))
