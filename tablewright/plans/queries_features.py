"""Checked queries for splitting, encoding, scaling, TF-IDF, selection and windows (FEAT*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import sql_parse_datetime, sql_strip_label
from ..functions.text import sql_tokens
from ..operators import features as FE
from ..operators import leakage as LK
from ..operators import select as SEL
from ..operators import split as SP
from ..operators import target_stats as TS
from ..operators import tfidf as TF
from .derived import DIRTY_ORDERS_SQL, dirty_orders, table
from .registry import query

D = DIRTY_ORDERS_SQL


@query("feat_target_encode", f"""
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY {sql_strip_label('o_orderstatus')}) - 1 AS DOUBLE) AS y
FROM {D}""")
def feat_target_encode(spark, d):
    df = dirty_orders(table(spark, d, "orders"))
    return FE.encode_target(df, "o_orderstatus", "classification").select("o_orderkey", "y")


@query("feat_target_encode_regression", """
SELECT l_orderkey, l_linenumber, coalesce(l_extendedprice, 0.0) AS y FROM lineitem""")
def feat_target_encode_regression(spark, d):
    df = table(spark, d, "lineitem")
    return FE.encode_target(df, "l_extendedprice", "regression").select("l_orderkey", "l_linenumber", "y")


@query("feat_target_decode", f"SELECT o_orderkey, {sql_strip_label('o_orderstatus')} AS label FROM {D}")
def feat_target_decode(spark, d):
    df = dirty_orders(table(spark, d, "orders"))
    codes = FE.target_codes(df, "o_orderstatus")
    enc = FE.encode_target(df, "o_orderstatus", "classification", codes=codes)
    return FE.decode_target(enc, codes, col="y").select("o_orderkey", "label")


_SPLIT_SQL = """
WITH c AS (SELECT o_orderstatus AS g, count(*) AS n FROM orders GROUP BY 1),
tot AS (SELECT sum(n) AS total, ceil(CAST(0.2 AS DOUBLE) * sum(n)) AS n_test FROM c),
fl AS (SELECT g, n, n / total * (total - n_test) AS cont, floor(n / total * (total - n_test)) AS f,
              n / total * (total - n_test) - floor(n / total * (total - n_test)) AS rem FROM c, tot),
need AS (SELECT (SELECT total - n_test FROM tot) - sum(f) AS k FROM fl),
q AS (SELECT g, n - (f + CASE WHEN row_number() OVER (ORDER BY rem DESC, g) <= (SELECT k FROM need)
                              THEN 1 ELSE 0 END) AS q_test FROM fl)
SELECT o_orderkey, o_orderstatus,
  CASE WHEN row_number() OVER (PARTITION BY o_orderstatus
            ORDER BY md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42'))) <= q_test THEN 'test' ELSE 'train' END AS split
FROM orders JOIN q ON o_orderstatus = g"""


@query("feat_split_stratified", _SPLIT_SQL)
def feat_split_stratified(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return SP.train_test_split(df, ["o_orderkey"], label="o_orderstatus").select(
        "o_orderkey", "o_orderstatus", "split")


@query("feat_split_plain", """
SELECT 'test' AS split, CAST(ceil(CAST(0.2 AS DOUBLE) * count(*)) AS BIGINT) AS n FROM lineitem
UNION ALL SELECT 'train', count(*) - CAST(ceil(CAST(0.2 AS DOUBLE) * count(*)) AS BIGINT) FROM lineitem""")
def feat_split_plain(spark, d):
    df = table(spark, d, "lineitem")
    s = SP.train_test_split(df, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"],
                            label=None)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("feat_scale_standard", f"""
WITH m AS (SELECT median(o_totalprice) AS med FROM {D}),
i AS (SELECT o_orderkey, coalesce(o_totalprice, (SELECT med FROM m)) AS x,
             CAST(o_custkey AS DOUBLE) AS c FROM {D}),
s AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(c) AS mc, stddev_pop(c) AS sc FROM i)
SELECT o_orderkey, round((x - mx) / sx, 6) AS o_totalprice, round((c - mc) / sc, 6) AS o_custkey FROM i, s""")
def feat_scale_standard(spark, d):
    df = dirty_orders(table(spark, d, "orders")).select("o_orderkey", "o_totalprice", "o_custkey")
    fit = FE.fit_standard_scaler(df, ["o_totalprice", "o_custkey"])
    out = FE.apply_standard_scaler(df, fit)
    return out.select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"),
                      F.round("o_custkey", 6).alias("o_custkey"))


def _long(df, key):
    """(key, feature, value) rows of all other columns; text stays text."""
    return df.select(key, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in df.columns if c != key])))


def _onehot_sql(col: str) -> str:
    return f"""
SELECT p_partkey, '{col}__' || c AS feature, CASE WHEN {col} = c THEN '1.0' ELSE '0.0' END AS value
FROM part, (SELECT DISTINCT {col} AS c FROM part WHERE p_brand <> 'Brand#13')"""


@query("feat_onehot", _onehot_sql("p_brand") + "\nUNION ALL" + _onehot_sql("p_type"))
def feat_onehot(spark, d):
    part = table(spark, d, "part")
    train = part.where(F.col("p_brand") != "Brand#13")
    cats = FE.fit_categories(train, ["p_brand", "p_type"])
    modes = FE.category_modes(train, ["p_brand", "p_type"])
    out = part.select("p_partkey", "p_brand", "p_type")
    for c in ["p_brand", "p_type"]:
        out = FE.onehot(out, c, cats[c], fill=modes.get(c))
    return _long(out, "p_partkey")


@query("feat_ordinal", """
WITH tr AS (SELECT * FROM part WHERE p_brand <> 'Brand#13'),
nb AS (SELECT p_name AS v, dense_rank() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM tr)),
bb AS (SELECT p_brand AS v, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM tr))
SELECT p_partkey, CAST(coalesce(nb.code, -1) AS DOUBLE) AS p_name, CAST(coalesce(bb.code, -1) AS DOUBLE) AS p_brand
FROM part LEFT JOIN nb ON p_name = nb.v LEFT JOIN bb ON p_brand = bb.v""")
def feat_ordinal(spark, d):
    part = table(spark, d, "part")
    train = part.where(F.col("p_brand") != "Brand#13")
    out = part.select("p_partkey", "p_name", "p_brand")
    for c in ["p_name", "p_brand"]:
        out = FE.ordinal(out, c, FE.fit_ordinal(train, c))
    return out


@query("feat_encode_standalone", """
WITH c AS (SELECT *, dense_rank() OVER (ORDER BY c_name) - 1 AS code FROM customer),
s AS (SELECT DISTINCT c_mktsegment AS seg FROM customer
      WHERE c_mktsegment > (SELECT min(c_mktsegment) FROM customer))
SELECT c_custkey, 'c_name' AS feature, CAST(code AS VARCHAR) AS value FROM c
UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM c
UNION ALL SELECT c_custkey, 'c_mktsegment__' || seg, CASE WHEN c_mktsegment = seg THEN '1.0' ELSE '0.0' END FROM c, s""")
def feat_encode_standalone(spark, d):
    return _long(FE.encode_standalone(table(spark, d, "customer").drop("c_acctbal")), "c_custkey")


@query("feat_target_encode_labels", """
SELECT 'fraction' AS kind, c_custkey AS id, CAST(dense_rank() OVER (ORDER BY coalesce(x, 0.0)) - 1 AS DOUBLE) AS y
FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN (c_custkey % 4) / 4.0 END AS x FROM customer)
UNION ALL SELECT 'spaced', c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS DOUBLE) FROM customer""")
def feat_target_encode_labels(spark, d):
    """Class labels with fractions (ranked, NULL as 0) and with mixed quotes and spaces."""
    k = F.col("c_custkey")
    customer = table(spark, d, "customer").select(
        "c_custkey", F.when(k % 9 != 0, (k % 4) / 4.0).alias("x"),
        F.when(k % 3 == 0, F.concat(F.lit(" ' "), "c_mktsegment", F.lit("\" '"))).otherwise(F.col("c_mktsegment")).alias("s"))
    out = [FE.encode_target(customer, c, "classification").select(F.lit(kind).alias("kind"), k.alias("id"), "y")
           for kind, c in (("fraction", "x"), ("spaced", "s"))]
    return out[0].unionByName(out[1])


@query("feat_datetime_parts", f"""
SELECT o_orderkey,
  year(o_orderdate) AS o_orderdate_year, month(o_orderdate) AS o_orderdate_month,
  day(o_orderdate) AS o_orderdate_day, hour(o_orderdate) AS o_orderdate_hour,
  coalesce(year({sql_parse_datetime('order_day')}), 0) AS order_day_year,
  coalesce(month({sql_parse_datetime('order_day')}), 0) AS order_day_month,
  coalesce(day({sql_parse_datetime('order_day')}), 0) AS order_day_day,
  coalesce(hour({sql_parse_datetime('order_day')}), 0) AS order_day_hour
FROM {D}""")
def feat_datetime_parts(spark, d):
    df = dirty_orders(table(spark, d, "orders")).select("o_orderkey", "o_orderdate", "order_day")
    return FE.datetime_parts(df, ["o_orderdate", "order_day"])


_TFIDF_SQL = f"""
WITH d AS (SELECT doc_id, {sql_tokens('text')} AS t FROM documents),
terms AS (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
st AS (SELECT term, sum(tf) AS ttf, count(*) AS df FROM tf GROUP BY term),
vocab AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM st, (SELECT count(*) AS n FROM documents)
          ORDER BY ttf DESC, term LIMIT 200),
w AS (SELECT doc_id, term, tf * idf AS x FROM tf JOIN vocab USING (term))
SELECT doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"""


@query("feat_tfidf", _TFIDF_SQL)
def feat_tfidf(spark, d):
    docs = table(spark, d, "documents")
    return TF.tfidf(docs, "doc_id", "text").select("doc_id", "term", F.round("weight", 6).alias("weight"))


_LI_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _anova_sql() -> str:
    parts = []
    for i, c in enumerate(_LI_FEATURES):
        parts.append(f"""
SELECT '{c}' AS feature, {i} AS position, sum(n) AS n_all, count(*) AS k, sum(q) AS ss_all, sum(s) AS s_all,
       sum(s * s / n) AS sq_args
FROM (SELECT l_returnflag, count(*) AS n, sum(CAST({c} AS DOUBLE)) AS s, sum(CAST({c} AS DOUBLE) ^ 2) AS q
      FROM lineitem GROUP BY l_returnflag)""")
    body = "\nUNION ALL\n".join(parts)
    return f"""
WITH a AS ({body}),
f AS (SELECT feature, position,
        ((sq_args - s_all * s_all / n_all) / (k - 1)) /
        (((ss_all - s_all * s_all / n_all) - (sq_args - s_all * s_all / n_all)) / (n_all - k)) AS f_score FROM a)
SELECT feature, round(f_score, 4) AS f_score, row_number() OVER (ORDER BY f_score DESC, position DESC) AS rank,
       row_number() OVER (ORDER BY f_score DESC, position DESC) <= 3 AS selected FROM f"""


@query("feat_select_anova", _anova_sql())
def feat_select_anova(spark, d):
    sc = SEL.f_classif(table(spark, d, "lineitem"), _LI_FEATURES, "l_returnflag")
    return SEL.select_k_best(sc, 3).select("feature", F.round("f_score", 4).alias("f_score"), "rank", "selected")


_REG_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query("feat_select_fregression", "WITH f AS (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, {i} AS position, corr({c}, l_extendedprice) ^ 2 / (1 - corr({c}, l_extendedprice) ^ 2)"
    f" * (count(*) - 2) AS f_score FROM lineitem" for i, c in enumerate(_REG_FEATURES)) + """)
SELECT feature, round(f_score, 4) AS f_score, row_number() OVER (ORDER BY f_score DESC, position DESC) AS rank,
       row_number() OVER (ORDER BY f_score DESC, position DESC) <= 2 AS selected FROM f""")
def feat_select_fregression(spark, d):
    sc = SEL.f_regression(table(spark, d, "lineitem"), _REG_FEATURES, "l_extendedprice")
    return SEL.select_k_best(sc, 2).select("feature", F.round("f_score", 4).alias("f_score"), "rank", "selected")


@query("feat_sequence_windows", """
SELECT user_id, position, n, first_value, last_value, round(sum_value, 6) AS sum_value, target FROM (
  SELECT user_id, row_number() OVER w AS position, value AS target,
         count(*) OVER f AS n, first(value) OVER f AS first_value, last(value) OVER f AS last_value,
         sum(value) OVER f AS sum_value
  FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id),
         f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
WHERE n = 30""")
def feat_sequence_windows(spark, d):
    ev = table(spark, d, "events")
    seq = FE.sequence_windows(ev, "user_id", ["ts", "event_id"], ["value"], "value", window=30)
    vals = F.transform("seq", lambda s: s["value"])
    return seq.select("user_id", "position", F.size("seq").alias("n"),
                      F.element_at(vals, 1).alias("first_value"), F.element_at(vals, -1).alias("last_value"),
                      F.round(F.aggregate(vals, F.lit(0.0), lambda a, b: a + b), 6).alias("sum_value"), "target")


# ---- leakage (§2.4) and ordered target statistics (MOD3) -----------------------------------

_SIDES_SQL = "(SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag, l_orderkey % 5 = 0 AS test FROM lineitem)"
_FEATURES = ["l_partkey", "l_quantity", "l_returnflag"]


def _sides(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_FEATURES)
    return rows.where("l_orderkey % 5 <> 0"), rows.where("l_orderkey % 5 = 0")


@query("feat_split_leakage", f"""
SELECT l_orderkey, l_linenumber, EXISTS (
    SELECT 1 FROM {_SIDES_SQL} t WHERE NOT t.test AND t.l_quantity IS NOT DISTINCT FROM s.l_quantity
    AND t.l_returnflag IS NOT DISTINCT FROM s.l_returnflag AND t.l_partkey IS NOT DISTINCT FROM s.l_partkey) AS in_train
FROM {_SIDES_SQL} s WHERE test""")
def feat_split_leakage(spark, d):
    """Test rows whose features a training row has too."""
    train, test = _sides(spark, d)
    return LK.leaked_rows(train, test, _FEATURES).select("l_orderkey", "l_linenumber", "in_train")


@query("feat_unseen_categories", """
WITH v AS (SELECT o_orderkey % 5 = 0 AS test, unnest(['o_custkey', 'o_orderpriority']) AS column_name,
                  unnest([CAST(o_custkey AS VARCHAR), CAST(o_orderpriority AS VARCHAR)]) AS value FROM orders)
SELECT column_name, value, count(*) AS n FROM v t WHERE test AND value IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM v s WHERE NOT s.test AND s.column_name = t.column_name AND s.value = t.value)
GROUP BY column_name, value""")
def feat_unseen_categories(spark, d):
    """Categories of the test rows that training has not seen."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return LK.unseen_categories(orders.where("o_orderkey % 5 <> 0"), orders.where("o_orderkey % 5 = 0"),
                                ["o_custkey", "o_orderpriority"])


@query("feat_ordered_target_stats", """
SELECT l_orderkey, l_linenumber,
       (coalesce(sum(CAST(l_quantity AS DOUBLE)) OVER w, 0) + CAST(25.0 AS DOUBLE)) / (count(l_quantity) OVER w + CAST(1.0 AS DOUBLE)) AS target_stat
FROM lineitem WINDOW w AS (
    PARTITION BY l_returnflag
    ORDER BY md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), '42')), CAST(l_quantity AS DOUBLE)
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def feat_ordered_target_stats(spark, d):
    """The return flag as the mean quantity of the rows before each in a seeded permutation."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return TS.ordered_target_stats(lines, "l_returnflag", "l_quantity", ["l_orderkey", "l_linenumber"], prior=25.0).select(
        "l_orderkey", "l_linenumber", "target_stat")
