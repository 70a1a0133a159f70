"""Deterministic dirt derived from the given tables (NULLs, quotes, copies, strings).

The test tables contain no NULLs, stray quotes or numeric strings, so cleaning operators are
checked on frames derived here.  Each Spark builder has an SQL twin with the same rule so the
DuckDB oracle sees identical input.  The modulo tests decide *which* value is dirtied; no row
is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from ..sources.readers import spread
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def dirty_orders(orders: DataFrame) -> DataFrame:
    """orders with NULLs, quotes, a 70 %- and a 95 %-missing column, an all-NULL column,
    a constant column, mixed-format date strings, and every tenth order repeated."""
    k = F.col("o_orderkey")
    base = orders.select(
        "o_orderkey", "o_custkey",
        F.when(k % 2 == 0, F.concat(F.lit("'"), F.col("o_orderstatus"), F.lit("'")))
         .otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.when(k % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(k % 10 >= 7, F.col("o_custkey")).alias("sparse_custkey"),
        F.when(k % 20 == 0, F.col("o_orderpriority")).alias("rare_priority"),
        F.lit(None).cast("double").alias("empty_col"),
        F.lit("x").alias("const_col"),
        F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
         .otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("order_day"),
    )
    return base.unionByName(base.where(k % 10 == 0))


DIRTY_ORDERS_SQL = """
(WITH b AS (
  SELECT o_orderkey, o_custkey,
    CASE WHEN o_orderkey % 2 = 0 THEN concat('''', o_orderstatus, '''') ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice,
    o_orderdate,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_orderpriority,
    CASE WHEN o_orderkey % 10 >= 7 THEN o_custkey END AS sparse_custkey,
    CASE WHEN o_orderkey % 20 = 0 THEN o_orderpriority END AS rare_priority,
    CAST(NULL AS DOUBLE) AS empty_col,
    'x' AS const_col,
    CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
         ELSE strftime(o_orderdate, '%m/%d/%Y') END AS order_day
  FROM orders)
 SELECT * FROM b UNION ALL SELECT * FROM b WHERE o_orderkey % 10 = 0)
""".strip()

DIRTY_ORDERS_COLUMNS = [
    ("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "string"),
    ("o_totalprice", "numeric"), ("o_orderdate", "datetime"), ("o_orderpriority", "string"),
    ("sparse_custkey", "numeric"), ("rare_priority", "string"), ("empty_col", "numeric"),
    ("const_col", "string"), ("order_day", "string"),
]


def dirty_features(orders: DataFrame) -> DataFrame:
    """Training columns as they arrive: prices as strings with 'n/a' and NULL, customer numbers
    with NaN and infinity, priorities with quotes, spaces and NULL, and on every eighth order
    (never a training row) a category that training has not seen."""
    k = F.col("o_orderkey")
    priority = F.when(k % 8 == 0, F.lit("9-NEW")).otherwise(F.col("o_orderpriority"))
    return orders.select(
        "o_orderkey",
        F.when(k % 7 != 0, F.when(k % 20 == 1, F.lit("n/a")).otherwise(
            F.round("o_totalprice").cast("long").cast("string"))).alias("price"),
        F.when(k % 11 == 0, F.lit(float("nan"))).when(k % 13 == 0, F.lit(float("inf")))
         .otherwise(F.col("o_custkey").cast("double")).alias("custkey"),
        F.when(k % 5 != 0, F.when(k % 3 == 0, F.concat(F.lit(" '"), priority, F.lit("\" "))).otherwise(priority)).alias("priority"))


DIRTY_FEATURES_SQL = """
(WITH p AS (SELECT *, CASE WHEN o_orderkey % 8 = 0 THEN '9-NEW' ELSE o_orderpriority END AS pr FROM orders)
 SELECT o_orderkey,
   CASE WHEN o_orderkey % 7 <> 0 THEN CASE WHEN o_orderkey % 20 = 1 THEN 'n/a'
        ELSE CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) END END AS price,
   CASE WHEN o_orderkey % 11 = 0 THEN 'nan'::DOUBLE WHEN o_orderkey % 13 = 0 THEN 'infinity'::DOUBLE
        ELSE CAST(o_custkey AS DOUBLE) END AS custkey,
   CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN concat(' ''', pr, '" ') ELSE pr END END AS priority
 FROM p)
""".strip()


def numeric_strings(lineitem: DataFrame, *extra: str) -> DataFrame:
    """lineitem quantities as strings; one in twenty replaced by 'n/a'."""
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return lineitem.select(
        "l_orderkey", "l_linenumber",
        F.when(k % 20 == 0, F.lit("n/a")).otherwise(F.col("l_quantity").cast("string")).alias("qty_str"),
        "l_returnflag", *extra)


NUMERIC_STRINGS_SQL = """
(SELECT l_orderkey, l_linenumber,
   CASE WHEN (l_orderkey * 10 + l_linenumber) % 20 = 0 THEN 'n/a' ELSE CAST(l_quantity AS VARCHAR) END AS qty_str,
   l_returnflag
 FROM lineitem)
""".strip()


def pages_with_links(pages: DataFrame) -> DataFrame:
    """pages with dataset-file links appended to the html (the raw pages contain none):
    raw GitHub CSV links on every third page, a relative machine-learning-databases file on
    every fifth, a download link on even pages, and a huggingface viewer link on every fourth."""
    pid = F.col("page_id").cast("string")
    extra = F.concat(
        F.when(F.col("page_id") % 3 == 0, F.concat(
            F.lit('<a href="https://raw.githubusercontent.com/o'), (F.col("page_id") % 7).cast("string"),
            F.lit("/r/main/d"), pid, F.lit('.csv">d</a>'))).otherwise(F.lit("")),
        F.when(F.col("page_id") % 5 == 0, F.concat(
            F.lit("<a href=ml/machine-learning-databases/x"), pid, F.lit(".data>x</a>"))).otherwise(F.lit("")),
        F.when(F.col("page_id") % 2 == 0, F.concat(
            F.lit('<a href="/files/download?f=t'), pid, F.lit('.tsv">t</a>'))).otherwise(F.lit("")),
        F.when(F.col("page_id") % 4 == 0, F.concat(
            F.lit("<a href='https://huggingface.co/datasets/u"), pid,
            F.lit("/blob/main/blob/d.csv'>h</a>"))).otherwise(F.lit("")))
    return pages.select("page_id", "url", F.concat(F.col("html"), extra).alias("html"))


PAGES_WITH_LINKS_SQL = """
(SELECT page_id, url, html
   || CASE WHEN page_id % 3 = 0 THEN '<a href="https://raw.githubusercontent.com/o' || CAST(page_id % 7 AS VARCHAR)
        || '/r/main/d' || CAST(page_id AS VARCHAR) || '.csv">d</a>' ELSE '' END
   || CASE WHEN page_id % 5 = 0 THEN '<a href=ml/machine-learning-databases/x' || CAST(page_id AS VARCHAR) || '.data>x</a>' ELSE '' END
   || CASE WHEN page_id % 2 = 0 THEN '<a href="/files/download?f=t' || CAST(page_id AS VARCHAR) || '.tsv">t</a>' ELSE '' END
   || CASE WHEN page_id % 4 = 0 THEN '<a href=''https://huggingface.co/datasets/u' || CAST(page_id AS VARCHAR)
        || '/blob/main/blob/d.csv''>h</a>' ELSE '' END AS html
 FROM pages)
""".strip()


def data_link_results(pages: DataFrame) -> DataFrame:
    """Search-result rows for direct data-file links derived from pages (FIXTURES recipe),
    with junk hosts on every eleventh page.  Links take the odd positions."""
    pid = F.col("page_id").cast("string")
    url = F.when(F.col("page_id") % 11 == 0,
                 F.concat(F.lit("https://export-jrc.example.org/catalogue/d"), pid, F.lit(".csv"))
                 ).otherwise(F.concat(F.lit("https://raw.githubusercontent.com/o"),
                                      (F.col("page_id") % 7).cast("string"), F.lit("/r/main/d"), pid, F.lit(".csv")))
    return pages.select((F.col("page_id") * 2 + 1).alias("pos"),
                        F.concat(F.lit("d"), pid, F.lit(".csv")).alias("title"), url.alias("url"),
                        F.lit("csv data file").alias("snippet"))


DATA_LINK_RESULTS_SQL = """
(SELECT page_id * 2 + 1 AS pos, 'd' || CAST(page_id AS VARCHAR) || '.csv' AS title,
   CASE WHEN page_id % 11 = 0 THEN 'https://export-jrc.example.org/catalogue/d' || CAST(page_id AS VARCHAR) || '.csv'
        ELSE 'https://raw.githubusercontent.com/o' || CAST(page_id % 7 AS VARCHAR) || '/r/main/d' || CAST(page_id AS VARCHAR) || '.csv' END AS url,
   'csv data file' AS snippet
 FROM pages)
""".strip()


# search-idea phrases appended to every third document (the invented prose names no dataset)
IDEA_PHRASES = [
    "predict heart disease from patient records", "customer churn at a telecom company",
    "house prices in boston", "classify iris flower species", "titanic passenger survival",
    "movie review sentiment", "red wine quality", "salary from years of experience",
    "breast cancer diagnosis", "parkinsons voice measurements", "penguin species size",
    "diamond prices and tips", "spam email detection",
]


def documents_with_ideas(documents: DataFrame) -> DataFrame:
    """(doc_id, text): every third document ends with one of ``IDEA_PHRASES`` (by doc_id)."""
    phrase = F.element_at(F.array(*[F.lit(p) for p in IDEA_PHRASES]),
                          (F.col("doc_id") % len(IDEA_PHRASES) + 1).cast("int"))
    return documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text"), F.lit(" "), phrase))
                            .otherwise(F.col("text")).alias("text"))


DOCUMENTS_WITH_IDEAS_SQL = ("(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' ' || list_extract(["
                            + ", ".join("'" + p + "'" for p in IDEA_PHRASES)
                            + f"], CAST(doc_id % {len(IDEA_PHRASES)} + 1 AS INTEGER)) ELSE text END AS text"
                            " FROM documents)")
