"""Small generators for the DuckDB oracle SQL (per-column UNION ALL blocks).

The oracle is written independently of the Spark operators: it uses DuckDB's own
``count(DISTINCT)``, ``skewness`` and ``mode``-free ordering, one SELECT per column.
"""

from __future__ import annotations

TABLE_COLUMNS = {
    "orders": [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "string"),
               ("o_totalprice", "numeric"), ("o_orderdate", "datetime"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "numeric"), ("l_partkey", "numeric"), ("l_suppkey", "numeric"),
                 ("l_linenumber", "numeric"), ("l_quantity", "numeric"), ("l_extendedprice", "numeric"),
                 ("l_discount", "numeric"), ("l_tax", "numeric"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "datetime")],
    "events": [("event_id", "numeric"), ("ts", "datetime"), ("user_id", "numeric"),
               ("event_type", "string"), ("value", "numeric"), ("props", "string")],
    "part": [("p_partkey", "numeric"), ("p_name", "string"), ("p_brand", "string"),
             ("p_type", "string"), ("p_size", "numeric"), ("p_retailprice", "numeric")],
    "customer": [("c_custkey", "numeric"), ("c_name", "string"), ("c_nationkey", "numeric"),
                 ("c_acctbal", "numeric"), ("c_mktsegment", "string")],
    "documents": [("doc_id", "numeric"), ("text", "string"), ("lang", "string"),
                  ("source", "string"), ("n_chars", "numeric")],
    "labels": [("doc_id", "numeric"), ("quality", "numeric"), ("toxic", "numeric")],
    "conversations": [("conv_id", "numeric"), ("turn", "numeric"), ("role", "string"), ("text", "string")],
    "nation": [("n_nationkey", "numeric"), ("n_name", "string"), ("n_regionkey", "numeric")],
    "region": [("r_regionkey", "numeric"), ("r_name", "string")],
    "supplier": [("s_suppkey", "numeric"), ("s_name", "string"), ("s_nationkey", "numeric"),
                 ("s_acctbal", "numeric")],
}


def per_column(src: str, columns: list[tuple[str, str]], select: str) -> str:
    """UNION ALL of ``select`` (a template using {c}, {name}, {pos}, {base}) per column."""
    parts = []
    for pos, (name, base) in enumerate(columns):
        body = select.format(c=f'"{name}"', name=name, pos=pos, base=base)
        parts.append(f"SELECT {body} FROM {src} AS t")
    return "\nUNION ALL\n".join(parts)


def column_profile_sql(src: str, columns: list[tuple[str, str]]) -> str:
    """pos, column, base, n_rows, n_non_null, n_unique, missing_frac as an SQL subquery."""
    body = per_column(src, columns,
                      "{pos} AS pos, '{name}' AS column_name, '{base}' AS base, count(*) AS n_rows, "
                      "count({c}) AS n_non_null, count(DISTINCT {c}) AS n_unique, "
                      "CASE WHEN count(*) > 0 THEN (count(*) - count({c})) / count(*) ELSE 0.0 END AS missing_frac")
    return f"({body})"


def families_sql(src: str, cols: list[tuple[str, str]]) -> str:
    from ..functions.columns import sql_parse_datetime, sql_word_count
    parts = []
    for name, base in cols:
        c = f'"{name}"'
        if base in ("numeric", "datetime"):
            parts.append(f"SELECT '{name}' AS column_name, '{base}' AS family")
            continue
        else:
            fam = (f"CASE WHEN count({sql_parse_datetime(c)}) / count(*) > 0.8 THEN 'datetime' "
                   f"WHEN sum({sql_word_count(c)}) / count({c}) > 5 THEN 'text' ELSE 'categorical' END")
        parts.append(f"SELECT '{name}' AS column_name, {fam} AS family FROM {src} AS t")
    return "\nUNION ALL\n".join(parts)
