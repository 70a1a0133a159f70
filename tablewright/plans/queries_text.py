"""Checked queries for text rules (TXT*) and catalog operators (CAT*, SET1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as CA
from ..operators import text_rules as TR
from .derived import (DATA_LINK_RESULTS_SQL, PAGES_WITH_LINKS_SQL, data_link_results,
                      pages_with_links, table)
from .registry import query


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_any_contains(expr: str, needles) -> str:
    return "(" + " OR ".join(f"contains({expr}, {_q(n)})" for n in needles) + ")"


def _sql_rule_chain(expr: str, rules, default: str) -> str:
    return ("CASE " + " ".join(f"WHEN {_sql_any_contains(expr, trig)} THEN {_q(name)}" for name, trig in rules)
            + f" ELSE {_q(default)} END")


# ---- TXT1 --------------------------------------------------------------------------------

@query("text_rule_classify", f"""
SELECT 'documents' AS source, doc_id AS id, CAST(0 AS BIGINT) AS sub_id,
  {_sql_rule_chain("lower(text)", TR.TASK_RULES, "classification")} AS task_type,
  {_sql_rule_chain("lower(text)", TR.DOMAIN_RULES, "general")} AS domain
FROM documents
UNION ALL
SELECT 'conversations', conv_id, turn,
  {_sql_rule_chain("lower(text)", TR.TASK_RULES, "classification")},
  {_sql_rule_chain("lower(text)", TR.DOMAIN_RULES, "general")}
FROM conversations""")
def text_rule_classify(spark, d):
    docs = table(spark, d, "documents").select(
        F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("sub_id"),
        TR.rule_task(F.col("text")).alias("task_type"), TR.rule_domain(F.col("text")).alias("domain"))
    conv = table(spark, d, "conversations").select(
        F.lit("conversations").alias("source"), F.col("conv_id").alias("id"), F.col("turn").alias("sub_id"),
        TR.rule_task(F.col("text")).alias("task_type"), TR.rule_domain(F.col("text")).alias("domain"))
    return docs.unionByName(conv)


# ---- TXT2 --------------------------------------------------------------------------------

def _kw_sql_variant(name: str, src: str = "documents") -> str:
    lower_first, stops, cap, distinct = TR.KEYWORD_VARIANTS[name]
    text = "lower(coalesce(text, ''))" if lower_first else "coalesce(text, '')"
    stop_list = "[" + ", ".join(_q(s) for s in stops) + "]"
    words = f"""
  (SELECT doc_id, lower(w) AS w, i FROM (
     SELECT doc_id, unnest(r) AS w, generate_subscripts(r, 1) AS i
     FROM (SELECT doc_id, regexp_extract_all({text}, '{TR.WORD_RUN}') AS r FROM {src}))
   WHERE regexp_full_match(w, '[a-zA-Z]{{3,}}') AND NOT list_contains({stop_list}, lower(w)))"""
    if distinct:
        words = f"(SELECT doc_id, w, min(i) AS i FROM {words} GROUP BY doc_id, w)"
    ranked = f"(SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM {words})"
    keep = f"WHERE rn <= {cap}" if cap else ""
    return (f"(SELECT doc_id, string_agg(w, ',' ORDER BY rn) AS s, count(*) AS n FROM {ranked} {keep} "
            f"GROUP BY doc_id)")


@query("text_keywords", f"""
SELECT d.doc_id, coalesce(a.s, '') AS kw_idea, coalesce(b.s, '') AS kw_concept, coalesce(c.s, '') AS kw_semantic,
       coalesce(e.n, 0) AS n_core, md5(coalesce(e.s, '')) AS core_md5,
       coalesce(f.n, 0) AS n_entities, md5(coalesce(f.s, '')) AS entities_md5
FROM documents d
LEFT JOIN {_kw_sql_variant('idea')} a USING (doc_id)
LEFT JOIN {_kw_sql_variant('concept')} b USING (doc_id)
LEFT JOIN {_kw_sql_variant('semantic')} c USING (doc_id)
LEFT JOIN {_kw_sql_variant('core')} e USING (doc_id)
LEFT JOIN {_kw_sql_variant('entities')} f USING (doc_id)""")
def text_keywords(spark, d):
    kw = TR.keyword_columns(table(spark, d, "documents"), "text",
                            ["idea", "concept", "semantic", "core", "entities"], ["doc_id"])
    return kw.select(
        "doc_id",
        F.array_join("idea", ",").alias("kw_idea"),
        F.array_join("concept", ",").alias("kw_concept"),
        F.array_join("semantic", ",").alias("kw_semantic"),
        F.size("core").cast("long").alias("n_core"), F.md5(F.array_join("core", ",")).alias("core_md5"),
        F.size("entities").cast("long").alias("n_entities"), F.md5(F.array_join("entities", ",")).alias("entities_md5"))


# ---- TXT3 --------------------------------------------------------------------------------

def _problem_sql(src: str = "documents") -> str:
    parts = []
    for i, (trig, task, dom, dtype, use) in enumerate(TR.PROBLEM_RULES):
        hits = " + ".join(f"CAST(contains(lower(coalesce(text, '')), {_q(t)}) AS INTEGER)" for t in trig)
        parts.append(f"SELECT doc_id, {i} AS rule, {hits} AS hits, {_q(task)} AS task_type, {_q(dom)} AS domain, "
                     f"{_q(dtype)} AS data_type, {_q(use)} AS use_case FROM {src}")
    body = "\nUNION ALL\n".join(parts)
    dt, dd, ddt, du = TR.PROBLEM_DEFAULTS
    return f"""
WITH h AS ({body}),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, rule) AS rk FROM h)
SELECT doc_id,
  CASE WHEN hits > 0 THEN task_type ELSE {_q(dt)} END AS task_type,
  CASE WHEN hits > 0 THEN domain ELSE {_q(dd)} END AS domain,
  CASE WHEN hits > 0 THEN data_type ELSE {_q(ddt)} END AS data_type,
  CASE WHEN hits > 0 THEN use_case ELSE {_q(du)} END AS use_case,
  hits AS n_hits
FROM b WHERE rk = 1"""


@query("text_problem_rules", _problem_sql())
def text_problem_rules(spark, d):
    return TR.problem_table(table(spark, d, "documents"), "text", ["doc_id"])


@query("text_slug", r"""
SELECT item_id,
  substr(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-zA-Z0-9\s]', '', 'g'), '^\s+|\s+$', '', 'g'),
         '\s+', '_', 'g'), 1, 40) || '_' || substr(md5(text), 1, 6) AS slug
FROM benchmark""")
def text_slug(spark, d):
    return table(spark, d, "benchmark").select("item_id", TR.slug(F.col("text")).alias("slug"))


# ---- catalog -----------------------------------------------------------------------------

IDEA_KEYWORDS = ["the", "quality", "pages", "and", "documents", "data"]

_PAGE_RESULTS_SQL = r"""
(SELECT page_id * 2 AS pos, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, url,
   regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g') AS snippet
 FROM pages)"""

_RESULTS_SQL = f"(SELECT * FROM {_PAGE_RESULTS_SQL} UNION ALL SELECT * FROM {DATA_LINK_RESULTS_SQL})"


def _results(spark, d):
    pages = table(spark, d, "pages")
    return CA.page_results(pages).unionByName(data_link_results(pages))


def _score_sql(src: str, kws: list[str]) -> str:
    comb = "concat_ws(' ', lower(coalesce(title, '')), lower(coalesce(snippet, '')), lower(coalesce(url, '')))"
    u = "lower(coalesce(url, ''))"
    sn = "lower(coalesce(snippet, ''))"
    matches = " + ".join(f"CAST(contains({comb}, {_q(k)}) AS INTEGER)" for k in kws)
    partial = " + ".join(f"CAST(contains({comb}, {_q(k[:4])}) AS INTEGER)" for k in kws if len(k) >= 4) or "0"
    direct = "(" + " OR ".join(f"ends_with({u}, {_q(e)})" for e in CA.DIRECT_EXTENSIONS) + ")"
    s = (f"(CASE WHEN {matches} >= 3 THEN 0.50 WHEN {matches} = 2 THEN 0.40 WHEN {matches} = 1 THEN 0.15 "
         f"WHEN {partial} >= 2 THEN 0.10 WHEN {partial} = 1 THEN 0.05 ELSE -0.05 END"
         f" + CASE WHEN {direct} THEN 0.30 ELSE 0.0 END"
         f" + CASE WHEN {_sql_any_contains(u, CA.DATASET_DOMAINS)} THEN 0.20 ELSE 0.0 END"
         f" + CASE WHEN {_sql_any_contains(sn, [f.lstrip('.') for f in CA.SUPPORTED_FORMATS])} THEN 0.10 ELSE 0.0 END)")
    s = f"CASE WHEN starts_with(coalesce(title, ''), 'Known:') THEN least({s}, 0.70) ELSE {s} END"
    return f"""
(SELECT *, greatest(0.05, round_even(CAST({s} AS DOUBLE), 3)) AS score FROM {src}
 WHERE NOT {_sql_any_contains(u, CA.FILTER_JUNK_SIGNALS)}
   AND (contains({comb}, 'dataset') OR contains({comb}, 'data') OR {direct}))"""


@query("catalog_score_results", f"SELECT pos, url, score FROM {_score_sql(_RESULTS_SQL, IDEA_KEYWORDS)}")
def catalog_score_results(spark, d):
    return CA.score_results(_results(spark, d), IDEA_KEYWORDS).select("pos", "url", "score")


_OWNER_SQL = """
CASE WHEN url IS NULL OR url = '' THEN 'unknown'
     WHEN (contains(lower(url), 'githubusercontent.com') OR contains(lower(url), 'github.com'))
          AND list_position(list_transform(string_split(lower(url), '/'), lambda p: contains(p, 'github')), true) IS NOT NULL
          AND list_position(list_transform(string_split(lower(url), '/'), lambda p: contains(p, 'github')), true) < len(string_split(lower(url), '/'))
       THEN string_split(lower(url), '/')[list_position(list_transform(string_split(lower(url), '/'), lambda p: contains(p, 'github')), true) + 1]
     WHEN contains(lower(url), 'openml') THEN 'openml' WHEN contains(lower(url), 'uci.edu') THEN 'uci'
     WHEN contains(lower(url), 'kaggle') THEN 'kaggle' WHEN contains(lower(url), 'huggingface') THEN 'huggingface'
     WHEN len(string_split(lower(url), '/')) >= 3 THEN string_split(lower(url), '/')[3]
     ELSE substr(lower(url), 1, 20) END"""

_SOURCE_SQL = ("CASE WHEN starts_with(coalesce(title, ''), 'Known:') THEN 'KnownDatasets' "
               + " ".join(f"WHEN contains(lower(url), {_q(n)}) THEN {_q(lab)}" for n, lab in CA.SOURCE_LABELS)
               + " ELSE 'Web' END")

def _lang_spark():
    return F.regexp_extract(F.col("url"), r"/(en|fr|de|es)/", 1)
_LANG_SQL = r"regexp_extract(url, '/(en|fr|de|es)/', 1)"


def _rank_sql() -> str:
    scored = _score_sql(_RESULTS_SQL, IDEA_KEYWORDS)
    junk = _sql_any_contains("lower(coalesce(url, ''))", CA.RANKER_JUNK_SIGNALS)
    return f"""
WITH s AS (SELECT *, {_LANG_SQL} AS lang FROM {scored}),
p AS (SELECT * FROM s WHERE NOT {junk}
      UNION ALL SELECT * FROM s WHERE lang NOT IN (SELECT lang FROM s WHERE NOT {junk})),
o AS (SELECT *, {_OWNER_SQL} AS owner FROM p),
e AS (SELECT *, row_number() OVER (PARTITION BY lang, owner ORDER BY score DESC, pos) <= 2 AS eligible FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY eligible DESC, score DESC, pos) AS rank FROM e)
SELECT lang, rank, pos, url, owner, {_SOURCE_SQL} AS source FROM r WHERE rank <= 5"""


@query("catalog_rank_diverse", _rank_sql())
def catalog_rank_diverse(spark, d):
    scored = CA.score_results(_results(spark, d), IDEA_KEYWORDS).withColumn("lang", _lang_spark())
    ranked = CA.rank_diverse(scored, top_n=5, per_owner=2, group_cols=["lang"])
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "pos", "url", "owner", "source")


_HREFS_SQL = f"""
(SELECT page_id, url AS page_url, unnest(list_concat(
    regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1), regexp_extract_all(html, '(?i)href=([^\\s>]+)', 1))) AS href
 FROM {PAGES_WITH_LINKS_SQL})"""

_EXT_SQL = "(" + " OR ".join(
    f"ends_with(regexp_replace(lower(split_part(split_part(nu, '?', 1), '#', 1)), '/+$', ''), {_q(e)})"
    for e in CA.SEARCH_FILE_EXTENSIONS) + ")"
_HOST_SQL = "lower(regexp_extract(nu, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1))"
_DOMAIN_SQL = "(" + " OR ".join(f"{_HOST_SQL} = {_q(x)} OR ends_with({_HOST_SQL}, {_q('.' + x)})"
                                for x in CA.ALLOWED_DOWNLOAD_DOMAINS) + ")"
_ALLOWED_EXT_SQL = ("CASE WHEN contains(string_split(lower(split_part(nu, '?', 1)), '/')[-1], '.') THEN ("
                    + " OR ".join(f"ends_with(lower(split_part(nu, '?', 1)), {_q(e)})" for e in CA.ALLOWED_DOWNLOAD_EXTENSIONS)
                    + ") ELSE true END")


@query("catalog_link_filter", f"""
SELECT page_id, href AS url, nu AS normalized_url, {_EXT_SQL} AS is_dataset_file, {_DOMAIN_SQL} AS domain_allowed,
       {_ALLOWED_EXT_SQL} AS extension_allowed
FROM (SELECT *, CASE WHEN contains(href, 'huggingface.co') AND contains(href, '/blob/')
                     THEN regexp_replace(href, '/blob/(.*)$', '/resolve/\\1') ELSE href END AS nu FROM {_HREFS_SQL})""")
def catalog_link_filter(spark, d):
    pages = pages_with_links(table(spark, d, "pages"))
    quoted = F.regexp_extract_all(F.col("html"), F.lit(r"(?i)href=[\"']([^\"']+)[\"']"), 1)
    bare = F.regexp_extract_all(F.col("html"), F.lit(r"(?i)href=([^\s>]+)"), 1)
    links = pages.select("page_id", F.explode(F.concat(quoted, bare)).alias("url"))
    return CA.link_filter(links).select("page_id", "url", "normalized_url", "is_dataset_file",
                                        "domain_allowed", "extension_allowed")


def _extract_sql() -> str:
    exts = CA.PAGE_LINK_EXTENSIONS
    ends = "(" + " OR ".join(f"ends_with(low, {_q(e)})" for e in exts) + ")"
    has = "(" + " OR ".join(f"contains(low, {_q(e)})" for e in exts) + ")"
    pref = "CASE " + " ".join(f"WHEN ends_with(low, {_q(e)}) THEN {j}"
                              for j, e in enumerate(CA.PREFERRED_LINK_EXTENSIONS)) + f" ELSE {len(CA.PREFERRED_LINK_EXTENSIONS)} END"
    return f"""
WITH h AS (SELECT page_id, url AS page_url, unnest(l) AS href, generate_subscripts(l, 1) - 1 AS i FROM (
     SELECT page_id, url, list_concat(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1),
                                      regexp_extract_all(html, '(?i)href=([^\\s>]+)', 1)) AS l FROM {PAGES_WITH_LINKS_SQL})),
t AS (SELECT page_id, i, regexp_replace(href, '^\\s+|\\s+$', '', 'g') AS hh,
        regexp_extract(page_url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS base,
        regexp_extract(regexp_replace(page_url, '[?#].*$', ''), '^(.*/)', 1) AS pdir FROM h),
f AS (SELECT page_id, i, CASE WHEN starts_with(hh, 'http') THEN hh WHEN starts_with(hh, '/') THEN base || hh
                         ELSE CASE WHEN pdir = '' THEN base || '/' ELSE pdir END || hh END AS link
      FROM t WHERE NOT (starts_with(hh, '#') OR starts_with(hh, 'javascript:') OR starts_with(hh, 'mailto:'))),
k AS (SELECT page_id, i, link, lower(link) AS low FROM f),
c AS (SELECT page_id, link,
        CASE WHEN contains(low, 'machine-learning-databases') AND {ends} THEN 0
             WHEN contains(low, 'machine-learning-databases') THEN 1 WHEN {ends} THEN 1
             WHEN contains(low, 'download') AND {has} THEN 1 END AS kind, i, {pref} AS pref FROM k),
b AS (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY pref, kind,
        CASE WHEN kind = 0 THEN -i ELSE i END, link) AS rn FROM c WHERE kind IS NOT NULL)
SELECT p.page_id, b.link AS dataset_link FROM pages p LEFT JOIN b ON p.page_id = b.page_id AND b.rn = 1"""


@query("catalog_extract_links", _extract_sql())
def catalog_extract_links(spark, d):
    return CA.extract_dataset_link(pages_with_links(table(spark, d, "pages")))


@query("catalog_content_sniff", """
SELECT 'pages' AS source, page_id AS id,
  (starts_with(upper(substr(html, 1, 200)), '<!DOCTYPE') OR starts_with(upper(substr(html, 1, 200)), '<HTML')
   OR starts_with(upper(substr(html, 1, 200)), '<HEAD>') OR starts_with(upper(substr(html, 1, 200)), '<BODY>')) AS is_html,
  strlen(html) < 100 AS too_small, strlen(html) > 524288000 AS too_large FROM pages
UNION ALL
SELECT 'documents', doc_id,
  (starts_with(upper(substr(text, 1, 200)), '<!DOCTYPE') OR starts_with(upper(substr(text, 1, 200)), '<HTML')
   OR starts_with(upper(substr(text, 1, 200)), '<HEAD>') OR starts_with(upper(substr(text, 1, 200)), '<BODY>')),
  strlen(text) < 100, strlen(text) > 524288000 FROM documents""")
def catalog_content_sniff(spark, d):
    p = CA.content_sniff(table(spark, d, "pages").select(F.lit("pages").alias("source"),
                                                         F.col("page_id").alias("id"), F.col("html").alias("c")), "c")
    q = CA.content_sniff(table(spark, d, "documents").select(F.lit("documents").alias("source"),
                                                             F.col("doc_id").alias("id"), F.col("text").alias("c")), "c")
    return p.unionByName(q).drop("c")


CATALOG_QUERY = "Thheouble data erster the inon heenwh"


def _name_overlap_sql() -> str:
    qwords = sorted({w.lower() for w in CATALOG_QUERY.split() if len(w) >= 3 and w.lower() not in CA.CATALOG_STOP_WORDS})
    ql = "[" + ", ".join(_q(w) for w in qwords) + "]"
    return f"""
WITH e AS (SELECT r.pos, r.title, len(regexp_extract_all(r.snippet_full, '\\S+')) AS n_rows FROM (
     SELECT page_id AS pos, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title,
            regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'), '^ | $', '', 'g') AS snippet_full
     FROM pages) r),
nw AS (SELECT pos, unnest(string_split_regex(translate(lower(title), '-_', '  '), '\\s+')) AS w FROM e),
qw AS (SELECT unnest({ql}) AS q),
hit AS (SELECT DISTINCT pos FROM nw, qw WHERE w <> '' AND (contains(w, q) OR contains(q, w)))
SELECT pos, title FROM e WHERE n_rows >= 50 AND pos IN (SELECT pos FROM hit)"""


@query("catalog_name_overlap", _name_overlap_sql())
def catalog_name_overlap(spark, d):
    pages = table(spark, d, "pages")
    entries = pages.select(F.col("page_id").alias("pos"), CA.page_title(F.col("html")).alias("title"),
                           F.size(F.regexp_extract_all(CA.page_text(F.col("html")), F.lit(r"\S+"), 0)).alias("n_rows"))
    return CA.name_overlap(entries, "title", "n_rows", CATALOG_QUERY).select("pos", "title")


@query("set_union_first_by_url", f"""
WITH u AS (
  SELECT 0 AS priority, pos, url, title FROM {DATA_LINK_RESULTS_SQL}
  UNION ALL SELECT 1, page_id * 1000 + i, link, NULL FROM (
    SELECT page_id, unnest(l) AS link, generate_subscripts(l, 1) - 1 AS i FROM (
      SELECT page_id, regexp_extract_all(html, 'href="(https?://[^"]+)"', 1) AS l FROM {PAGES_WITH_LINKS_SQL}))
  UNION ALL SELECT 2, page_id, url, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) FROM pages)
SELECT url, priority, pos, title FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY priority, pos, title) AS rn FROM u) WHERE rn = 1""")
def set_union_first_by_url(spark, d):
    pages = table(spark, d, "pages")
    s0 = data_link_results(pages).select(F.lit(0).alias("priority"), "pos", "url", "title")
    links = pages_with_links(pages).select(
        "page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'href="(https?://[^"]+)"'), 1)).alias("i", "link"))
    s1 = links.select(F.lit(1).alias("priority"), (F.col("page_id") * 1000 + F.col("i")).alias("pos"),
                      F.col("link").alias("url"), F.lit(None).cast("string").alias("title"))
    s2 = pages.select(F.lit(2).alias("priority"), F.col("page_id").alias("pos"), "url",
                      CA.page_title(F.col("html")).alias("title"))
    return CA.union_first_by_url([s0, s1, s2]).select("url", "priority", "pos", "title")


_SOURCE_OF_SQL = ("CASE WHEN contains(lower(url), 'kaggle') THEN 'Kaggle' WHEN contains(lower(url), 'huggingface') THEN 'HuggingFace' "
                  "WHEN contains(lower(url), 'openml') THEN 'OpenML' WHEN page_id % 4 = 0 THEN 'Semantic' WHEN page_id % 4 = 3 THEN 'other' "
                  "WHEN page_id % 4 = 1 THEN 'HuggingFace' ELSE 'Web' END")


@query("catalog_default_scores", f"""
SELECT page_id, {_SOURCE_OF_SQL} AS source, CAST(CASE {_SOURCE_OF_SQL} WHEN 'Semantic' THEN 0.9 WHEN 'Web' THEN 0.72 WHEN 'Kaggle' THEN 0.7
       WHEN 'OpenML' THEN 0.65 WHEN 'HuggingFace' THEN 0.5 END AS DOUBLE) AS score FROM pages""")
def catalog_default_scores(spark, d):
    """CAT9 over pages as candidates; the source is read from the url, else dealt by page id."""
    source = F.expr("CASE WHEN contains(lower(url), 'kaggle') THEN 'Kaggle' WHEN contains(lower(url), 'huggingface') THEN 'HuggingFace' "
                    "WHEN contains(lower(url), 'openml') THEN 'OpenML' WHEN page_id % 4 = 0 THEN 'Semantic' WHEN page_id % 4 = 3 THEN 'other' "
                    "WHEN page_id % 4 = 1 THEN 'HuggingFace' ELSE 'Web' END")
    return table(spark, d, "pages").select("page_id", source.alias("source"), CA.default_score(source).alias("score"))


# ---- streaming ---------------------------------------------------------------------------

@query("stream_rule_classify", f"""
SELECT doc_id, {_sql_rule_chain("lower(text)", TR.TASK_RULES, "classification")} AS task_type,
  {_sql_rule_chain("lower(text)", TR.DOMAIN_RULES, "general")} AS domain FROM documents""")
def stream_rule_classify(spark, d):
    from ..streaming import rowwise as SW
    stream = SW.read_stream(spark, f"{d.rstrip('/')}/documents.parquet")
    path = SW.run_to_table(SW.classify_texts(stream, ["doc_id"]).drop("keywords"), "rule-classify")
    return spark.read.parquet(path)


# ---- CAT1: semantic knowledge-base match ---------------------------------------------------

def _semantic_sql(src: str = "conversations", ids: tuple[str, ...] = ("conv_id", "turn")) -> str:
    from ..operators import semantic as SM
    idx = ", ".join(f"({p}, {_q(t)}, {_q(k)}, {w})" for p, t, k, w in SM.index_rows())
    words = ", ".join(f"({_q(w)}, {_q(k)}, {n}, {o})" for w, k, n, o in SM.word_rows())
    n_index = len(SM.index_rows())
    il = ", ".join(ids)
    ho = ", ".join(f"coalesce(h.{i}, o.{i}) AS {i}" for i in ids)
    on_ho = " AND ".join(f"h.{i} = o.{i}" for i in ids)
    on_cb = " AND ".join(f"c.{i} = best.{i}" for i in ids)
    cl = ", ".join(f"c.{i}" for i in ids)
    return f"""
WITH low AS (SELECT {il}, lower(coalesce(text, '')) AS l FROM {src}),
idx AS (SELECT * FROM (VALUES {idx}) AS v(pos, trig, key, weight)),
wd AS (SELECT * FROM (VALUES {words}) AS v(word, key, n, key_order)),
hits AS (SELECT {il}, key, sum(weight) AS s1, min(pos) AS first_pos
         FROM low JOIN idx ON contains(l, trig) GROUP BY ALL),
w AS (SELECT DISTINCT {il}, r AS word FROM (SELECT {il}, unnest(regexp_extract_all(l, '[\\p{{L}}\\p{{N}}_]+')) AS r FROM low)
      WHERE regexp_full_match(r, '[a-z]{{4,}}')),
ov AS (SELECT {il}, key, sum(n) * 0.3 AS s2, min(key_order) AS key_order FROM w JOIN wd USING (word) GROUP BY ALL),
bo AS (SELECT {ho}, coalesce(h.key, o.key) AS key,
              coalesce(s1, 0.0) + coalesce(s2, 0.0) AS score, coalesce(first_pos, key_order + {n_index}) AS ord
       FROM hits h FULL JOIN ov o ON {on_ho} AND h.key = o.key),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {il} ORDER BY score DESC, ord, key) AS rn FROM bo) WHERE rn = 1)
SELECT {cl}, coalesce(best.key, 'generic_tabular') AS dataset_key, round(coalesce(best.score, 0.0), 6) AS score,
       round(least(1.0, coalesce(best.score, 0.0) / 3.0), 6) AS confidence
FROM {src} c LEFT JOIN best ON {on_cb}"""


@query("catalog_semantic_match", _semantic_sql())
def catalog_semantic_match(spark, d):
    from ..operators import semantic as SM
    out = SM.semantic_match(table(spark, d, "conversations"), ["conv_id", "turn"], "text")
    return out.select("conv_id", "turn", "dataset_key", F.round("score", 6).alias("score"),
                      F.round("confidence", 6).alias("confidence"))


# ---- TXT5: structural term expansion --------------------------------------------------------

def _expand_sql() -> str:
    lower_first, stops, cap, _ = TR.KEYWORD_VARIANTS["concept"]
    stop_list = "[" + ", ".join(_q(s) for s in stops) + "]"
    exp_stops = "[" + ", ".join(_q(s) for s in TR.EXPANSION_STOP_WORDS) + "]"
    stem = "CASE " + " ".join(
        f"WHEN ends_with(t, {_q(s)}) AND length(t) > {len(s) + 2} THEN substr(t, 1, length(t) - {len(s)}) || {_q(r)}"
        for s, r in TR.EXPANSION_SUFFIXES) + " END"
    stem_ok = f"CASE WHEN length({stem}) > 2 AND NOT list_contains({exp_stops}, {stem}) THEN {stem} END"
    task_a = "CASE " + " ".join(f"WHEN task_type = {_q(k)} THEN t || {_q(' ' + v[0])}"
                                for k, v in TR.TASK_SUFFIX_WORDS.items()) + " END"
    task_b = "CASE " + " ".join(f"WHEN task_type = {_q(k)} THEN t || {_q(' ' + v[1])}"
                                for k, v in TR.TASK_SUFFIX_WORDS.items()) + " END"
    words = f"""
  (SELECT doc_id, lower(w) AS w, i FROM (
     SELECT doc_id, unnest(r) AS w, generate_subscripts(r, 1) AS i
     FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{TR.WORD_RUN}') AS r FROM documents))
   WHERE regexp_full_match(w, '[a-zA-Z]{{3,}}') AND NOT list_contains({stop_list}, lower(w)))"""
    first = f"(SELECT doc_id, w, min(i) AS i FROM {words} GROUP BY doc_id, w)"
    core = (f"(SELECT doc_id, list(w ORDER BY rn) AS core FROM (SELECT doc_id, w, row_number() OVER "
            f"(PARTITION BY doc_id ORDER BY i) AS rn FROM {first}) WHERE rn <= {cap} GROUP BY doc_id)")
    return f"""
WITH base AS (
  SELECT d.doc_id, {_sql_rule_chain("lower(d.text)", TR.TASK_RULES, "classification")} AS task_type,
         coalesce(c.core, []) AS core
  FROM documents d LEFT JOIN {core} c USING (doc_id)),
r AS (SELECT *, list_filter(flatten(list_transform(list_slice(core, 1, 4),
        lambda t: [{stem_ok}, {task_a}, {task_b}])), lambda x: x IS NOT NULL) AS raw FROM base),
s AS (SELECT *, list_slice(list_filter(raw, lambda x, i: list_position(raw, x) = i AND NOT list_contains(core, x)), 1, 8) AS st FROM r),
l AS (SELECT *, list_transform(st, lambda x: lower(trim(x))) AS lo FROM s),
e AS (SELECT *, list_slice(list_filter(lo, lambda x, i: list_position(lo, x) = i AND NOT list_contains(core, x)
        AND NOT list_contains({exp_stops}, x) AND length(x) > 2), 1, 8) AS expanded FROM l),
v AS (SELECT *, list_filter([
        CASE WHEN len(core) > 0 THEN array_to_string(list_slice(core, 1, 3), ' ') || ' dataset csv' END,
        CASE WHEN len(core) > 0 THEN array_to_string(list_slice(core, 1, 3), ' ') || ' data' END,
        CASE WHEN len(expanded) > 0 THEN expanded[1] || ' dataset csv' END,
        CASE WHEN len(expanded) > 1 THEN expanded[2] || ' dataset csv' END,
        CASE WHEN len(expanded) > 2 THEN expanded[3] || ' dataset csv' END,
        CASE WHEN len(core) > 0 AND len(expanded) > 0 THEN core[1] || ' ' || expanded[1] || ' dataset' END,
        CASE WHEN len(expanded) > 0 THEN expanded[1] || ' data records' END,
        CASE WHEN len(expanded) > 1 THEN expanded[2] || ' data records' END], lambda x: x IS NOT NULL) AS va FROM e)
SELECT doc_id, task_type, array_to_string(core, ',') AS core_terms, array_to_string(expanded, ',') AS expanded_terms,
       array_to_string(list_slice(list_filter(va, lambda x, i: list_position(va, x) = i), 1, 6), '|') AS variations
FROM v"""


@query("text_expand_terms", _expand_sql())
def text_expand_terms(spark, d):
    kw = TR.keyword_columns(table(spark, d, "documents"), "text", ["concept"], ["doc_id", "text"])
    staged = kw.select("doc_id", TR.rule_task(F.col("text")).alias("task_type"), F.col("concept").alias("core"))
    ex = staged.select("doc_id", "task_type", "core", TR.expand_terms(F.col("core"), F.col("task_type")).alias("x"))
    return ex.select("doc_id", "task_type", F.array_join("core", ",").alias("core_terms"),
                     F.array_join("x.expanded", ",").alias("expanded_terms"),
                     F.array_join("x.variations", "|").alias("variations"))


# ---- QUAL9 / QUAL11: candidate tables scored against an idea -------------------------------

RELEVANCE_IDEA = "classify the sentiment of customer review text documents"
# problem understanding the text rules derive from RELEVANCE_IDEA (checked in the builder)
RELEVANCE_PU = ("sentiment", "text", ["the", "sentiment", "customer", "review", "text", "documents"])
_CANDIDATES = ["documents", "conversations", "orders", "lineitem", "customer", "region", "events", "pages",
               "part", "benchmark", "labels", "supplier", "nation", "embeddings"]
_ALL_COLS = {
    "pages": [("page_id", "numeric"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "numeric"), ("text", "string")],
    "embeddings": [("vec_id", "numeric"), ("embedding", "nested"), ("label", "numeric")],
}


def _idea_pu(spark):
    one = spark.range(1).select(F.lit(RELEVANCE_IDEA).alias("idea"))
    pu = TR.problem_table(one, "idea", []).first()
    ents = TR.keyword_columns(one, "idea", ["entities"], []).first()["entities"]
    return pu["domain"], pu["data_type"], list(ents)


def _signals(spark, d):
    from ..operators import relevance as RV
    out = None
    for i, t in enumerate(_CANDIDATES):
        row = RV.table_signals(table(spark, d, t), t).withColumn("candidate_order", F.lit(i))
        out = row if out is None else out.unionByName(row)
    return out


def _relevance_sql() -> str:
    from ..operators import relevance as RV
    from .sqlgen import TABLE_COLUMNS, column_profile_sql
    domain, dtype, ents = RELEVANCE_PU
    parts = []
    for i, t in enumerate(_CANDIDATES):
        cols = TABLE_COLUMNS.get(t) or _ALL_COLS[t]
        names = [c for c, _ in cols]
        ct = RV.column_text(names)
        row = "concat_ws(' ', " + ", ".join(f"CAST(\"{c}\" AS VARCHAR)" for c in names) + ")"
        order = ", ".join(f'"{c}"' for c in names)
        text_cols = " + ".join(f"(SELECT CASE WHEN avg(length(\"{c}\")) > 20 THEN 1 ELSE 0 END FROM {t})"
                               for c, b in cols if b == "string") or "0"
        parts.append(f"""
SELECT '{t}' AS table_name, {i} AS candidate_order, {len(names)} AS n_cols, '{ct}' AS col_text,
  (SELECT avg(missing_frac) FROM {column_profile_sql(t, cols)}) AS missing,
  (SELECT count(*) FROM {t}) AS n_rows,
  ((SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t}))) / greatest((SELECT count(*) FROM {t}), 1) AS duplicate_ratio,
  (SELECT lower(string_agg(r, ' ' ORDER BY {order})) FROM (SELECT *, {row} AS r FROM {t} ORDER BY {order} LIMIT 5)) AS sample_text,
  {text_cols} AS n_text_cols""")
    sig = RV.DOMAIN_COLUMNS.get(domain, {"columns": []})["columns"]

    def cnt(expr, needles):
        return "(" + " + ".join(f"CAST(contains({expr}, {_q(n)}) AS INTEGER)" for n in needles) + ")"
    junk = "CASE " + " ".join(f"WHEN {cnt('col_text', pats)} >= 2 THEN {_q(why)}" for pats, why in RV.JUNK_SCHEMA_PATTERNS) + " END"
    s = ("0.50 + CASE WHEN n_rows >= 50000 THEN 0.20 WHEN n_rows >= 10000 THEN 0.15 WHEN n_rows >= 1000 THEN 0.10 "
         "WHEN n_rows >= 100 THEN 0.05 ELSE -0.10 END - least(0.25, coalesce(missing, 0.0) * 1.5) "
         "- least(0.15, duplicate_ratio)")
    if sig:
        s += f" + CASE WHEN {cnt('col_text', sig)} > 0 THEN least(0.20, 0.05 * {cnt('col_text', sig)}) ELSE 0.0 END"
    if ents:
        tot = f"({cnt('col_text', ents[:6])} + {cnt(chr(99) + 'oalesce(sample_text, ' + chr(39) * 2 + ')', ents[:6])})"
        s += f" + CASE WHEN {tot} >= 2 THEN 0.15 WHEN {tot} = 1 THEN 0.05 ELSE 0.0 END"
    if dtype == "text":
        s += " + CASE WHEN n_text_cols > 0 THEN 0.15 ELSE -0.20 END"
    return f"""
WITH sg AS ({' UNION ALL '.join(parts)}),
sc AS (SELECT table_name, candidate_order, {junk} AS junk, n_rows, n_cols,
              greatest(0.0, least(1.0, round_even(CAST({s} AS DOUBLE), 3))) AS raw_score FROM sg)
SELECT table_name, NOT (junk IS NOT NULL OR n_rows < 20 OR n_cols < 2) AS is_relevant,
       CASE WHEN junk IS NOT NULL OR n_rows < 20 OR n_cols < 2 THEN 0.0 ELSE raw_score END AS score,
       CASE WHEN junk IS NOT NULL THEN 'junk: ' || junk WHEN n_rows < 20 THEN 'too small'
            WHEN n_cols < 2 THEN 'too few columns' ELSE 'scored' END AS reason
FROM sc"""


_REL_SQL = _relevance_sql()


@query("quality_relevance_score", _REL_SQL)
def quality_relevance_score(spark, d):
    from ..operators import relevance as RV
    domain, dtype, ents = _idea_pu(spark)
    return RV.relevance(_signals(spark, d), domain, dtype, ents).drop("candidate_order")


@query("quality_pick_best", f"""
WITH s AS ({_REL_SQL}), o AS (SELECT s.*, c.i AS candidate_order FROM s JOIN
  (SELECT * FROM (VALUES {", ".join(f"('{t}', {i})" for i, t in enumerate(_CANDIDATES))}) AS v(t, i)) c ON s.table_name = c.t)
SELECT table_name, score, score >= 0.70 AS early_accept FROM o WHERE is_relevant AND score > 0
ORDER BY CASE WHEN score >= 0.70 THEN 0 ELSE 1 END, CASE WHEN score >= 0.70 THEN candidate_order ELSE -score END,
         candidate_order LIMIT 1""")
def quality_pick_best(spark, d):
    from ..operators import relevance as RV
    domain, dtype, ents = _idea_pu(spark)
    return RV.pick_best(RV.relevance(_signals(spark, d), domain, dtype, ents))
