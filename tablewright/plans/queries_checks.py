"""Checked queries for candidate-table hard rejects (QUAL8), the idea-vs-data keyword check
(QUAL10), the curated catalog lookup (CAT2), the rest of problem understanding (TXT3) and the
knowledge-base payload of the semantic match (CAT1)."""

from __future__ import annotations

from ..operators import relevance as RV
from ..operators import verified as VF
from .derived import DOCUMENTS_WITH_IDEAS_SQL, documents_with_ideas, table
from .queries_text import _ALL_COLS, _CANDIDATES, RELEVANCE_IDEA, _q
from .registry import query
from .sqlgen import TABLE_COLUMNS


def _table_columns(t: str) -> list[str]:
    return [c for c, _ in (TABLE_COLUMNS.get(t) or _ALL_COLS[t])]


def _schema_signals(spark, d, with_sample: bool):
    out = None
    for t in _CANDIDATES:
        row = RV.schema_signals(table(spark, d, t), t, with_sample)
        out = row if out is None else out.unionByName(row)
    return out


def _cnt(expr: str, needles) -> str:
    return "(" + " + ".join(f"CAST(contains({expr}, {_q(n)}) AS INTEGER)" for n in needles) + ")"


def _names_sql() -> str:
    rows = ", ".join(f"({_q(t)}, {i}, {_q(c)})" for t in _CANDIDATES for i, c in enumerate(_table_columns(t)))
    return f"(SELECT * FROM (VALUES {rows}) AS v(table_name, pos, name))"


def _flags_sql() -> str:
    """Per candidate table: col_text (lower-case joined names), the scorer's junk reason and
    the catalog-signal / wrong-pattern flags."""
    junk = "CASE " + " ".join(f"WHEN {_cnt('norm_text', p)} >= 2 THEN {_q(why)}"
                              for p, why in RV.JUNK_SCHEMA_PATTERNS) + " END"
    catalog = " OR ".join("(" + " + ".join(f"CAST(list_contains(col_set, {_q(x)}) AS INTEGER)" for x in sig)
                          + f") >= {RV.CATALOG_SIGNAL_MIN}" for sig in RV.CATALOG_SIGNAL_SETS)
    wrong = " OR ".join(f"{_cnt('col_text', p)} >= {RV.WRONG_PATTERN_MIN}" for p in RV.WRONG_COLUMN_PATTERNS)
    return f"""
(SELECT table_name, n_cols, col_text, {junk} AS junk_reason, ({catalog}) AS catalog_file, ({wrong}) AS wrong_pattern
 FROM (SELECT table_name, count(*) AS n_cols,
              lower(string_agg(name, ' ' ORDER BY pos)) AS col_text,
              string_agg(replace(replace(lower(name), ' ', '_'), '/', '_'), ' ' ORDER BY pos) AS norm_text,
              list(trim(lower(name))) AS col_set
       FROM {_names_sql()} GROUP BY table_name))"""


# ---- QUAL8 ---------------------------------------------------------------------------------

def _junk_sql() -> str:
    counts = " UNION ALL ".join(f"SELECT {_q(t)} AS table_name, count(*) AS n_rows FROM {t}" for t in _CANDIDATES)
    return f"""
WITH f AS {_flags_sql()}, n AS ({counts}),
r AS (SELECT f.*, n.n_rows, CASE WHEN junk_reason IS NOT NULL THEN 'junk: ' || junk_reason
             WHEN n_rows < 20 THEN 'too small' WHEN n_cols < 2 THEN 'too few columns' END AS reject_reason
      FROM f JOIN n USING (table_name))
SELECT table_name, n_rows, n_cols, junk_reason IS NOT NULL AS is_junk, junk_reason, catalog_file, wrong_pattern,
       reject_reason IS NOT NULL AS rejected, reject_reason FROM r"""


@query("quality_junk_schema", _junk_sql())
def quality_junk_schema(spark, d):
    return RV.hard_rejects(_schema_signals(spark, d, with_sample=False))


# ---- QUAL10 --------------------------------------------------------------------------------

def _sample_sql(t: str) -> str:
    cols = [f'"{c}"' for c in _table_columns(t)]
    order = ", ".join(cols)
    row = "concat_ws(' ', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + ")"
    return (f"SELECT {_q(t)} AS table_name, (SELECT lower(string_agg(r, ' ' ORDER BY {order})) "
            f"FROM (SELECT *, {row} AS r FROM {t} ORDER BY {order} LIMIT {RV.SAMPLE_ROWS})) AS sample_text")


def _words_sql(stops) -> str:
    return (f"list_filter(string_split_regex(lower({_q(RELEVANCE_IDEA)}), {_q(VF.PY_WHITESPACE)}), "
            f"lambda w: length(w) >= {RV.IDEA_WORD_MIN_CHARS} AND NOT list_contains([{', '.join(_q(x) for x in stops)}], w))")


def _keyword_match_sql() -> str:
    samples = " UNION ALL ".join(_sample_sql(t) for t in _CANDIDATES)
    idea_low = _q(RELEVANCE_IDEA.lower())
    flag = "CASE " + " ".join(f"WHEN {_cnt('col_text', cols)} >= {RV.RED_FLAG_MIN} AND NOT contains({idea_low}, {_q(topic)}) "
                              f"THEN {_q(topic)}" for topic, cols in RV.RED_FLAG_COLUMNS) + " END"
    rejected = "('catalog file', 'wrong dataset pattern', 'no keyword match')"
    return f"""
WITH f AS {_flags_sql()}, s AS ({samples}),
b AS (SELECT f.*, coalesce(s.sample_text, '') AS sample_text, {_words_sql(RV.IDEA_MATCH_STOP_WORDS)} AS words,
             {_words_sql(RV.WARN_STOP_WORDS)} AS warn_words FROM f JOIN s USING (table_name)),
c AS (SELECT *, len(list_filter(words, lambda w: contains(col_text, w))) > 0 AS in_columns,
             len(list_filter(words, lambda w: contains(sample_text, w))) > 0 AS in_values, {flag} AS flag,
             len(warn_words) >= {RV.WARN_MIN_WORDS}
               AND len(list_filter(warn_words, lambda w: contains(col_text, w))) = 0 AS no_kw
      FROM b),
v AS (SELECT *, CASE WHEN length({_q(RELEVANCE_IDEA)}) = 0 OR n_cols = 0 THEN 'no idea or columns'
                     WHEN catalog_file THEN 'catalog file' WHEN wrong_pattern THEN 'wrong dataset pattern'
                     WHEN len(words) = 0 THEN 'no idea keywords' WHEN in_columns THEN 'keyword in columns'
                     WHEN in_values THEN 'keyword in values' ELSE 'no keyword match' END AS verdict FROM c)
SELECT table_name, array_to_string(words, ' ') AS idea_words, catalog_file, wrong_pattern, in_columns, in_values,
       verdict NOT IN {rejected} AS is_relevant, verdict,
       CASE WHEN verdict NOT IN {rejected} THEN NULL
            WHEN flag IS NOT NULL THEN 'looks like a ' || flag || ' dataset'
            WHEN no_kw THEN 'no idea keyword in columns' END AS warning
FROM v"""


@query("quality_keyword_match", _keyword_match_sql())
def quality_keyword_match(spark, d):
    return RV.keyword_match(_schema_signals(spark, d, with_sample=True), RELEVANCE_IDEA)


# ---- CAT2 ----------------------------------------------------------------------------------

def _verified_sql() -> str:
    keys = ", ".join(f"({i}, {_q(k)}, [{', '.join(_q(w) for w in VF.key_words(k))}])"
                     for i, (k, _) in enumerate(VF.VERIFIED_CATALOG))
    links = ", ".join(f"({_q(k)}, {j + 1}, {_q(u)})" for k, urls in VF.VERIFIED_CATALOG
                      for j, u in enumerate(urls[:VF.MAX_LINKS]))
    snippet_head, snippet_tail = VF.SNIPPET_TEMPLATE.split("{}")
    return f"""
WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS l FROM {DOCUMENTS_WITH_IDEAS_SQL}),
w AS (SELECT doc_id, l, string_split_regex(l, {_q(VF.PY_WHITESPACE)}) AS ws FROM t),
k AS (SELECT * FROM (VALUES {keys}) AS v(pos, key, kw)),
s AS (SELECT doc_id, pos, key, len(list_filter(kw, lambda x: list_contains(ws, x)))
             + CASE WHEN contains(l, key) THEN {VF.PHRASE_BONUS} ELSE 0 END AS sc FROM w, k),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sc DESC, pos) AS rn
                     FROM s WHERE sc > 0) WHERE rn = 1),
u AS (SELECT * FROM (VALUES {links}) AS v(key, link_rank, url))
SELECT doc_id, b.key AS dataset_key, sc AS match_score, link_rank, url, {_q(VF.TITLE_PREFIX)} || b.key AS title,
       {_q(snippet_head)} || b.key || {_q(snippet_tail)} AS snippet, CAST({VF.VERIFIED_SCORE} AS DOUBLE) AS score
FROM b JOIN u ON b.key = u.key"""


@query("catalog_verified_lookup", _verified_sql())
def catalog_verified_lookup(spark, d):
    return VF.verified_lookup(documents_with_ideas(table(spark, d, "documents")), ["doc_id"], "text")


# ---- TXT3: expected columns and search queries -----------------------------------------------

def _problem_queries_sql() -> str:
    from ..operators import text_rules as TR
    from .queries_text import _kw_sql_variant, _problem_sql
    cols = " ".join(f"WHEN {_q(dom)} THEN {_q(','.join(names['columns'] + names['targets']))}"
                    for dom, names in RV.DOMAIN_COLUMNS.items())
    return f"""
WITH p AS ({_problem_sql(DOCUMENTS_WITH_IDEAS_SQL)}),
e AS {_kw_sql_variant('entities', DOCUMENTS_WITH_IDEAS_SQL)},
j AS (SELECT p.*, coalesce(e.n, 0) AS n_entities,
             array_to_string(list_slice(string_split(coalesce(e.s, ''), ','), 1, {TR.QUERY_ENTITIES}), ' ') AS ents
      FROM p LEFT JOIN e USING (doc_id)),
q AS (SELECT *, list_filter([ents || ' dataset ' || task_type || ' csv',
                             replace(domain, '_', ' ') || ' ' || task_type || ' dataset csv',
                             CASE WHEN data_type = 'text' THEN ents || ' text dataset nlp'
                                  WHEN use_case = 'diagnosis' THEN ents || ' clinical dataset diagnosis'
                                  WHEN use_case = 'price_prediction' THEN ents || ' regression dataset csv' END,
                             ents || ' kaggle dataset'], lambda x: x IS NOT NULL) AS qs FROM j)
SELECT doc_id, task_type, domain, data_type, use_case, n_hits, n_entities,
       coalesce(CASE domain {cols} END, '') AS relevant_columns,
       array_to_string(list_filter(qs, lambda x, i: list_position(qs, x) = i), '|') AS search_queries
FROM q"""


@query("text_problem_queries", _problem_queries_sql())
def text_problem_queries(spark, d):
    from ..operators import text_rules as TR
    return TR.problem_queries(documents_with_ideas(table(spark, d, "documents")), "text", ["doc_id"])


# ---- CAT1 complete: knowledge-base match with its payload and search queries ----------------

def _semantic_intent_sql() -> str:
    from ..operators import semantic as SM
    from .queries_text import _kw_sql_variant, _semantic_sql

    def lst(xs):
        return "CAST([" + ", ".join(_q(x) for x in xs) + "] AS VARCHAR[])"
    pay = ", ".join(f"({_q(k)}, {_q(e['task'])}, {_q(e['name'])}, {lst(e['columns'])}, {lst(e['urls'])}, {lst(e['queries'])})"
                    for k, e in SM.KNOWLEDGE_BASE.items())
    src = DOCUMENTS_WITH_IDEAS_SQL
    return f"""
WITH m AS ({_semantic_sql(src, ("doc_id",))}),
k AS {_kw_sql_variant('semantic', src)},
p AS (SELECT * FROM (VALUES {pay}) AS v(key, task, canonical_name, cols, urls, qs)),
j AS (SELECT m.*, p.task, p.canonical_name, p.cols, p.urls, p.qs, coalesce(k.n, 0) AS nc,
             string_split(coalesce(k.s, ''), ',') AS c
      FROM m JOIN p ON m.dataset_key = p.key LEFT JOIN k USING (doc_id)),
q AS (SELECT *, list_filter(list_concat(qs, [
        CASE WHEN nc > 0 THEN array_to_string(list_slice(c, 1, 3), ' ') || ' dataset csv' END,
        CASE WHEN nc > 0 THEN array_to_string(list_slice(c, 1, 2), ' ') || ' classification dataset' END]),
        lambda x: x IS NOT NULL AND x <> '') AS aq FROM j)
SELECT doc_id, dataset_key, score, confidence, task, canonical_name, array_to_string(urls, '|') AS direct_urls,
       array_to_string(cols, ',') AS expected_cols,
       array_to_string(list_slice(list_filter(aq, lambda x, i: list_position(aq, x) = i), 1, {SM.MAX_INTENT_QUERIES}), '|')
         AS search_queries
FROM q"""


@query("catalog_semantic_intent", _semantic_intent_sql())
def catalog_semantic_intent(spark, d):
    from pyspark.sql import functions as F

    from ..operators import semantic as SM
    out = SM.semantic_intent(documents_with_ideas(table(spark, d, "documents")), ["doc_id"], "text")
    return out.withColumn("score", F.round("score", 6)).withColumn("confidence", F.round("confidence", 6))
