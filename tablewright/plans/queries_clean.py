"""Checked queries for typing (TYP*) and cleaning (CLN*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import (NUMERIC_PATTERN, sql_guarded_double, sql_parse_datetime,
                                 sql_strip_quotes, sql_strip_quotes_fill, sql_word_count)
from ..functions.stats import column_modes
from ..operators import clean as C
from ..operators import coltypes as TY
from ..operators import profile as P
from .derived import (DIRTY_ORDERS_COLUMNS, DIRTY_ORDERS_SQL, NUMERIC_STRINGS_SQL, dirty_orders,
                      numeric_strings, table)
from .registry import query
from .sqlgen import TABLE_COLUMNS, families_sql

D = DIRTY_ORDERS_SQL
TS_FMT_SPARK, TS_FMT_SQL = "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"


def _ts(c):
    return F.date_format(c, TS_FMT_SPARK).alias(c)


# ---- typing ------------------------------------------------------------------------------

def _classify_sql(label: str, src: str, cols, target=None) -> str:
    parts = []
    for name, base in cols:
        if name == target:
            continue
        c = f'"{name}"'
        miss = "(count(*) - count({c})) / count(*)".format(c=c)
        if base in ("numeric", "datetime"):
            t = f"CASE WHEN {miss} > 0.9 THEN 'drop' ELSE '{base}' END"
        else:
            t = (f"CASE WHEN {miss} > 0.9 THEN 'drop' "
                 f"WHEN count(DISTINCT {c}) > 5 AND coalesce(count({sql_parse_datetime(c)}) / count({c}), 0) > 0.7 THEN 'datetime' "
                 f"WHEN coalesce(count(*) FILTER (WHERE regexp_matches({c}, '{NUMERIC_PATTERN}')) / count({c}), 0) > 0.85 THEN 'numeric' "
                 f"WHEN count(DISTINCT {c}) / greatest(count(*), 1) > 0.95 THEN 'id' "
                 f"WHEN coalesce(sum({sql_word_count(c)}) / count({c}), 0) > 5 OR coalesce(avg(length({c})), 0) > 100 THEN 'text' "
                 f"ELSE 'categorical' END")
        parts.append(
            f"SELECT '{label}' AS table_name, '{name}' AS column_name, {t} AS col_type, "
            f"CASE WHEN ({t}) = 'categorical' THEN CASE WHEN count(DISTINCT {c}) <= 50 THEN 'ohe' ELSE 'ordinal' END END AS encoder, "
            f"count(DISTINCT {c}) AS n_unique, round({miss}, 9) AS missing_frac FROM {src} AS t")
    return "\nUNION ALL\n".join(parts)


@query("types_classify_columns",
       _classify_sql("dirty_orders", D, DIRTY_ORDERS_COLUMNS, "o_orderstatus") + "\nUNION ALL\n"
       + _classify_sql("documents", "documents", TABLE_COLUMNS["documents"]) + "\nUNION ALL\n"
       + _classify_sql("customer", "customer", TABLE_COLUMNS["customer"]))
def types_classify_columns(spark, d):
    out = None
    for label, df, tgt in [("dirty_orders", dirty_orders(table(spark, d, "orders")), "o_orderstatus"),
                           ("documents", table(spark, d, "documents"), None),
                           ("customer", table(spark, d, "customer"), None)]:
        one = TY.classify_columns(df, tgt).select(
            F.lit(label).alias("table_name"), "column_name", "col_type", "encoder", "n_unique",
            F.round("missing_frac", 9).alias("missing_frac"))
        out = one if out is None else out.unionByName(one)
    return out


_TASK_CASES = [("orders", "o_orderstatus"), ("lineitem", "l_extendedprice"),
               ("lineitem", "l_linenumber"), ("events", "ts"), ("labels", "quality")]


def _task_sql() -> str:
    parts = []
    for t, c in _TASK_CASES:
        base = dict(TABLE_COLUMNS[t])[c]
        task = ("'time_series'" if base == "datetime" else
                f"CASE WHEN count(DISTINCT {c}) > 20 THEN 'regression' ELSE 'classification' END"
                if base == "numeric" else "'classification'")
        parts.append(f"SELECT '{t}' AS table_name, '{c}' AS target, count(DISTINCT {c}) AS n_unique, "
                     f"{task} AS task_type FROM {t}")
    return "\nUNION ALL\n".join(parts)


@query("types_task_from_target", _task_sql())
def types_task_from_target(spark, d):
    out = None
    for t, c in _TASK_CASES:
        one = TY.detect_task(table(spark, d, t), c).select(
            F.lit(t).alias("table_name"), "target", "n_unique", "task_type")
        out = one if out is None else out.unionByName(one)
    return out


_REFINE_CASES = [("documents", "lang", "nlp"), ("events", "event_type", "time_series"),
                 ("lineitem", "l_extendedprice", "classification"), ("orders", "o_orderstatus", "regression"),
                 ("conversations", "role", "clustering"), ("part", "p_size", "regression")]


def _refine_sql() -> str:
    parts = []
    for t, c, hint in _REFINE_CASES:
        fam = families_sql(t, TABLE_COLUMNS[t])
        parts.append(f"""
SELECT '{t}' AS table_name, '{hint}' AS initial_task, tu AS target_unique,
  CASE WHEN {('has_text AND ' + repr(hint) + ' NOT IN (' + "'classification','regression')")} THEN 'nlp'
       WHEN has_dt AND '{hint}' NOT IN ('classification', 'regression') THEN 'time_series'
       WHEN tu <= 20 AND '{hint}' = 'regression' THEN 'classification'
       WHEN tu > 20 AND '{hint}' = 'classification' THEN 'regression'
       ELSE '{hint}' END AS task_type
FROM (SELECT (SELECT count(DISTINCT {c}) FROM {t}) AS tu,
             (SELECT count(*) FILTER (WHERE family = 'text') > 0 FROM ({fam})) AS has_text,
             (SELECT count(*) FILTER (WHERE family = 'datetime') > 0 FROM ({fam})) AS has_dt)""")
    return "\nUNION ALL\n".join(parts)


@query("types_task_refine", _refine_sql())
def types_task_refine(spark, d):
    out = None
    for t, c, hint in _REFINE_CASES:
        df = table(spark, d, t)
        fam = P.analyzer_family(P.column_profile(df))
        ev = fam.agg(F.count_if(F.col("family") == "text").alias("nt"),
                     F.count_if(F.col("family") == "datetime").alias("nd"),
                     F.max(F.when(F.col("column_name") == c, F.col("n_unique"))).alias("tu"))
        one = ev.select(F.lit(t).alias("table_name"), F.lit(hint).alias("initial_task"),
                        F.col("tu").alias("target_unique"),
                        TY.refine_task(F.lit(hint), F.col("tu"), F.col("nd") > 0, F.col("nt") > 0,
                                       F.lit(False)).alias("task_type"))
        out = one if out is None else out.unionByName(one)
    return out


_TARGET_TABLES = ["orders", "labels", "region", "conversations", "events", "documents", "lineitem"]


def _detect_target_sql(t: str) -> str:
    cols = TABLE_COLUMNS[t]
    seen = {}
    for i, h in enumerate(TY.TARGET_NAME_HINTS):
        seen.setdefault(h, i)
    hints = ", ".join(f"('{h}', {i})" for h, i in seen.items())
    prof = "\nUNION ALL\n".join(
        f"SELECT {p} AS pos, '{n}' AS column_name, lower('{n}') AS lname, '{b}' AS base, "
        f"count(DISTINCT \"{n}\") AS n_unique FROM {t}" for p, (n, b) in enumerate(cols))
    last = len(cols) - 1
    return f"""
WITH cp AS ({prof}),
h AS (SELECT * FROM (VALUES {hints}) AS v(hint, hint_rank)),
hits AS (SELECT cp.*, h.hint_rank, cp.lname = h.hint AS exact FROM cp JOIN h ON contains(cp.lname, h.hint)),
cand AS (
  SELECT 0 AS stage, hint_rank AS k, pos, column_name, 'high' AS confidence FROM hits WHERE exact
  UNION ALL SELECT 1, hint_rank, pos, column_name, 'high' FROM hits WHERE NOT exact
  UNION ALL SELECT 2, 0, pos, column_name, 'medium' FROM cp WHERE pos = {last} AND n_unique <= 20
  UNION ALL SELECT 3, n_unique, pos, column_name, 'low' FROM cp WHERE base = 'string'
  UNION ALL SELECT 4, n_unique, pos, column_name, 'low' FROM cp WHERE base = 'numeric'),
best AS (SELECT * FROM cand ORDER BY stage, k, pos LIMIT 1),
top3 AS (SELECT string_agg(column_name, ',' ORDER BY n_unique, pos) AS c FROM
         (SELECT * FROM cp WHERE base = 'string' ORDER BY n_unique, pos LIMIT 3))
SELECT '{t}' AS table_name, column_name AS target, confidence,
       CASE WHEN stage >= 3 THEN (SELECT c FROM top3) END AS candidates FROM best"""


@query("types_detect_target", "\nUNION ALL\n".join(f"SELECT * FROM ({_detect_target_sql(t)})" for t in _TARGET_TABLES))
def types_detect_target(spark, d):
    out = None
    for t in _TARGET_TABLES:
        one = TY.detect_target(table(spark, d, t)).select(F.lit(t).alias("table_name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


# ---- cleaning ----------------------------------------------------------------------------

_STR_COLS = [n for n, b in DIRTY_ORDERS_COLUMNS if b == "string"]


@query("clean_strip_quotes", "SELECT o_orderkey, "
       + ", ".join(f"{sql_strip_quotes(c)} AS {c}" for c in _STR_COLS) + f" FROM {D}")
def clean_strip_quotes(spark, d):
    return C.strip_quotes_all(dirty_orders(table(spark, d, "orders")).select("o_orderkey", *_STR_COLS))


@query("clean_strip_quotes_fill", "SELECT o_orderkey, "
       + ", ".join(f"{sql_strip_quotes_fill(c)} AS {c}" for c in _STR_COLS) + f" FROM {D}")
def clean_strip_quotes_fill(spark, d):
    return C.strip_quotes_fill_all(dirty_orders(table(spark, d, "orders")).select("o_orderkey", *_STR_COLS))


@query("clean_drop_flagged", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '{TS_FMT_SQL}') AS o_orderdate,
       o_orderpriority, sparse_custkey, rare_priority, order_day FROM {D}""")
def clean_drop_flagged(spark, d):
    out = C.drop_flagged(dirty_orders(table(spark, d, "orders")), "o_orderstatus")
    return out.withColumn("o_orderdate", F.date_format("o_orderdate", TS_FMT_SPARK))


@query("clean_drop_missing_cols", "\nUNION ALL\n".join(
    f"SELECT '{n}' AS column_name, count(\"{n}\") AS n_non_null, "
    f"CAST(floor(count(*) * (1 - CAST(0.6 AS DOUBLE))) AS BIGINT) AS min_non_null, "
    f"count(\"{n}\") >= floor(count(*) * (1 - CAST(0.6 AS DOUBLE))) AS keep FROM {D}"
    for n, _ in DIRTY_ORDERS_COLUMNS))
def clean_drop_missing_cols(spark, d):
    return C.missing_decisions(dirty_orders(table(spark, d, "orders"))).drop("pos")


_ALL_D = [n for n, _ in DIRTY_ORDERS_COLUMNS]
_ALL_D_SQL = ", ".join(f"strftime({n}, '{TS_FMT_SQL}') AS {n}" if n == "o_orderdate" else n for n in _ALL_D)


@query("clean_dedup_rows", f"SELECT DISTINCT {_ALL_D_SQL} FROM {D}")
def clean_dedup_rows(spark, d):
    return C.dedup_rows(dirty_orders(table(spark, d, "orders"))).withColumn(
        "o_orderdate", F.date_format("o_orderdate", TS_FMT_SPARK))


@query("clean_coerce_numeric",
       f"SELECT l_orderkey, l_linenumber, {sql_guarded_double('qty_str')} AS qty_str, l_returnflag FROM {NUMERIC_STRINGS_SQL}")
def clean_coerce_numeric(spark, d):
    return C.coerce_numeric(numeric_strings(table(spark, d, "lineitem")))


@query("clean_fill_median", f"""
SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT median(o_totalprice) FROM {D})), 6) AS o_totalprice,
       CAST(coalesce(sparse_custkey, (SELECT median(sparse_custkey) FROM {D})) AS DOUBLE) AS sparse_custkey,
       coalesce(empty_col, 0.0) AS empty_col
FROM {D}""")
def clean_fill_median(spark, d):
    df = dirty_orders(table(spark, d, "orders")).select("o_orderkey", "o_totalprice", "sparse_custkey", "empty_col")
    out = C.fill_median(df, ["o_totalprice", "sparse_custkey", "empty_col"])
    return out.withColumn("o_totalprice", F.round("o_totalprice", 6))


@query("clean_fill_mode", f"""
SELECT o_orderkey,
  coalesce(o_orderpriority, (SELECT o_orderpriority FROM {D} WHERE o_orderpriority IS NOT NULL
                             GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority,
  coalesce(rare_priority, (SELECT rare_priority FROM {D} WHERE rare_priority IS NOT NULL
                           GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS rare_priority,
  coalesce(CAST(NULL AS VARCHAR), 'unknown') AS all_null
FROM {D}""")
def clean_fill_mode(spark, d):
    df = dirty_orders(table(spark, d, "orders")).select(
        "o_orderkey", "o_orderpriority", "rare_priority", F.lit(None).cast("string").alias("all_null"))
    return C.fill_mode(df, ["o_orderpriority", "rare_priority", "all_null"])


def _mode_sql(t, c):
    return f"""(SELECT '{t}' AS table_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS mode, count(*) AS mode_count
  FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"""


_MODE_COLUMNS = {"documents": ["text", "lang", "source"], "pages": ["url", "html"], "orders": ["o_orderpriority", "o_orderdate"]}


@query("clean_mode_values", "\nUNION ALL\n".join(_mode_sql(t, c) for t, cs in _MODE_COLUMNS.items() for c in cs))
def clean_mode_values(spark, d):
    """CLN8's most frequent values by themselves, whole documents and pages included."""
    out = None
    for t, columns in _MODE_COLUMNS.items():
        found = column_modes(table(spark, d, t), columns).select(F.lit(t).alias("table_name"), "*")
        out = found if out is None else out.unionByName(found)
    return out


def _nonfinite_events(ev):
    k = F.col("event_id")
    return ev.select("event_id", F.when(k % 11 == 0, F.lit(float("nan")))
                     .when(k % 13 == 0, F.lit(float("inf")))
                     .when(k % 17 == 0, F.lit(float("-inf"))).otherwise(F.col("value")).alias("value"))


@query("clean_nonfinite_to_zero", """
SELECT event_id, CASE WHEN isnan(v) OR isinf(v) THEN 0.0 ELSE v END AS value FROM (
  SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 13 = 0 THEN 'inf'::DOUBLE
                        WHEN event_id % 17 = 0 THEN '-inf'::DOUBLE ELSE value END AS v FROM events)""")
def clean_nonfinite_to_zero(spark, d):
    return C.nonfinite_zero_all(_nonfinite_events(table(spark, d, "events")))


def _safe_float_input(li):
    code = F.concat(F.lit("c"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    return numeric_strings(li.withColumn("part_code", code), "part_code")


@query("clean_safe_to_float", f"""
SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber,
       coalesce({sql_guarded_double('qty_str')}, 0.0) AS qty_str,
       CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS DOUBLE) AS l_returnflag
FROM {NUMERIC_STRINGS_SQL}""")
def clean_safe_to_float(spark, d):
    li = table(spark, d, "lineitem")
    train, _, _ = C.safe_to_float(_safe_float_input(li))
    return train


@query("clean_dataset", f"""
WITH s AS (SELECT DISTINCT o_orderkey, o_custkey, {sql_strip_quotes('o_orderstatus')} AS o_orderstatus, o_totalprice,
             o_orderdate, {sql_strip_quotes('o_orderpriority')} AS o_orderpriority,
             {sql_strip_quotes('const_col')} AS const_col, {sql_strip_quotes('order_day')} AS order_day FROM {D})
SELECT o_orderkey, o_custkey, o_orderstatus,
  round(coalesce(o_totalprice, (SELECT median(o_totalprice) FROM s)), 6) AS o_totalprice,
  strftime(o_orderdate, '{TS_FMT_SQL}') AS o_orderdate,
  coalesce(o_orderpriority, (SELECT o_orderpriority FROM s WHERE o_orderpriority IS NOT NULL
                             GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority,
  const_col, order_day
FROM s""")
def clean_dataset(spark, d):
    out = C.clean_dataset(dirty_orders(table(spark, d, "orders")))
    return (out.withColumn("o_totalprice", F.round("o_totalprice", 6))
               .withColumn("o_orderdate", F.date_format("o_orderdate", TS_FMT_SPARK)))
