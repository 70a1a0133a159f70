"""Catalog operators: score, filter and rank candidate dataset links at table scale
(CAT3-CAT8, SET1, QUAL8).

Candidates are rows ``(pos, title, url, snippet)`` - e.g. derived from a table of web pages.
Every rule is a column expression over literal lists; ranking uses bounded top-k steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


# ---- fixed values -------------------------------------------------------------------------
DATASET_DOMAINS = [
    "kaggle.com", "github.com", "openml.org",
    "archive.ics.uci.edu", "data.world",
    "huggingface.co", "raw.githubusercontent.com",
    "zenodo.org", "figshare.com", "datahub.io",
]
DIRECT_EXTENSIONS = [".csv", ".json", ".xlsx", ".xls", ".parquet", ".zip", ".tsv", ".data"]
FILTER_JUNK_SIGNALS = [
    "ai-watch", "jrc-data", "jrc-catalogue",
    "sdss.org", "skyserver", "astroquery",
    "export-jrc", "catalogue",
]
RANKER_JUNK_SIGNALS = [
    "ai-watch", "jrc-data", "catalogue", "sdss", "skyserver",
    "astroquery", "export-jrc",
]
SUPPORTED_FORMATS = [".csv", ".json", ".xlsx", ".xls", ".parquet"]
SEARCH_FILE_EXTENSIONS = [
    ".csv", ".xlsx", ".xls", ".data", ".json",
    ".parquet", ".tsv", ".zip", ".arff", ".gz",
]
PAGE_LINK_EXTENSIONS = [".csv", ".data", ".xls", ".xlsx", ".json", ".parquet", ".tsv", ".zip", ".gz"]
PREFERRED_LINK_EXTENSIONS = [".csv", ".data", ".tsv", ".xlsx"]
ALLOWED_DOWNLOAD_DOMAINS = [
    "kaggle.com", "raw.githubusercontent.com", "github.com",
    "openml.org", "archive.ics.uci.edu", "data.world",
    "huggingface.co", "drive.google.com",
    "storage.googleapis.com", "s3.amazonaws.com",
    "api.openml.org", "datasets-server.huggingface.co",
]
ALLOWED_DOWNLOAD_EXTENSIONS = [".csv", ".json", ".xlsx", ".xls", ".parquet", ".zip", ".tsv", ".data", ".arff"]
HTML_SIGNATURES = ["<!DOCTYPE", "<HTML", "<HEAD>", "<BODY>"]   # compared upper-case
SNIFF_PREFIX = 200
MIN_CONTENT_BYTES = 100
MAX_CONTENT_BYTES = 500 * 1024 * 1024
KNOWN_PREFIX = "Known:"
KNOWN_CAP = 0.70
CATALOG_STOP_WORDS = [
    "the", "and", "for", "with", "dataset", "data", "csv",
    "predict", "classify", "using", "based", "patients", "patient",
    "whether", "that", "this", "from",
]
CATALOG_MIN_ROWS = 50
JUNK_SCHEMA_PATTERNS = [
    (["package", "rows", "cols"], "R dataset catalog"),
    (["package", "item", "title"], "Package index"),
    (["hallucination", "appropriateness"], "LLM eval dataset"),
    (["obj_id", "alpha", "delta"], "Astronomical SDSS data"),
    (["ra", "dec", "redshift"], "Astronomy data"),
    (["shape_reported", "colors_reported"], "UFO sightings"),
    (["dataset_name", "num_rows", "num_cols"], "Dataset registry"),
]
# source labels checked in order against the lower-case url
SOURCE_LABELS = [
    ("jbrownlee", "jbrownlee"), ("openml", "OpenML"), ("uci.edu", "UCI"),
    ("seaborn-data", "seaborn"), ("plotly", "plotly"), ("datasciencedojo", "datasciencedojo"),
    ("githubusercontent", "GitHub"), ("huggingface", "HuggingFace"), ("kaggle", "Kaggle"),
]
# -------------------------------------------------------------------------------------------


def _any(col: Column, needles: list[str], how: str = "contains") -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | (col.contains(n) if how == "contains" else col.endswith(n))
    return out


def _count_contains(col: Column, needles: list[str]) -> Column:
    return sum((F.when(col.contains(n), 1).otherwise(0) for n in needles), F.lit(0))


# ---- candidates from pages ---------------------------------------------------------------

def page_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)


def page_text(html: Column) -> Column:
    """Visible-ish text: tags replaced by spaces, whitespace runs collapsed, trimmed."""
    t = F.regexp_replace(html, r"<[^>]*>", " ")
    return F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^ | $", "")


def page_results(pages: DataFrame) -> DataFrame:
    """(pos, title, url, snippet) search-result rows derived from (page_id, url, html); the
    snippet is the page's whole text.  Pages take the even positions."""
    return pages.select((F.col("page_id") * 2).alias("pos"), page_title(F.col("html")).alias("title"),
                        "url", page_text(F.col("html")).alias("snippet"))


# ---- CAT3: scoring -----------------------------------------------------------------------

def score_results(results: DataFrame, keywords: list[str]) -> DataFrame:
    """Keep data-like, non-junk results and add ``score`` (0.05..; rounded to 3 places)."""
    url = F.lower(F.coalesce("url", F.lit("")))
    title = F.lower(F.coalesce("title", F.lit("")))
    snippet = F.lower(F.coalesce("snippet", F.lit("")))
    combined = F.concat_ws(" ", title, snippet, url)
    junk = _any(url, FILTER_JUNK_SIGNALS)
    direct = _any(url, DIRECT_EXTENSIONS, "endswith")
    data_page = combined.contains("dataset") | combined.contains("data") | direct
    s = F.lit(0.0)
    if keywords:
        matches = _count_contains(combined, keywords)
        partial = _count_contains(combined, [k[:4] for k in keywords if len(k) >= 4])
        s = (F.when(matches >= 3, 0.50).when(matches == 2, 0.40).when(matches == 1, 0.15)
             .when(partial >= 2, 0.10).when(partial == 1, 0.05).otherwise(-0.05))
    s = s + F.when(direct, 0.30).otherwise(0.0)
    s = s + F.when(_any(url, DATASET_DOMAINS), 0.20).otherwise(0.0)
    s = s + F.when(_any(snippet, [f.lstrip(".") for f in SUPPORTED_FORMATS]), 0.10).otherwise(0.0)
    s = F.when(F.coalesce(F.col("title"), F.lit("")).startswith(KNOWN_PREFIX), F.least(s, F.lit(KNOWN_CAP))).otherwise(s)
    return (results.where(~junk & data_page)
            .withColumn("score", F.greatest(F.lit(0.05), F.bround(s, 3))))


# ---- CAT6: owner, label, diversified ranking ---------------------------------------------

def repo_owner(url: Column) -> Column:
    """Repository owner for diversity: the path part after a 'github' host part, else a
    known source name, else the host."""
    u = F.lower(F.coalesce(url, F.lit("")))
    parts = F.split(u, "/")
    gh_idx = F.array_position(F.transform(parts, lambda p: p.contains("github")), True)
    gh_owner = F.when((gh_idx > 0) & (gh_idx < F.size(parts)), F.element_at(parts, (gh_idx + 1).cast("int")))
    host = F.when(F.size(parts) >= 3, F.element_at(parts, 3)).otherwise(F.substring(u, 1, 20))
    return (F.when(url.isNull() | (url == ""), "unknown")
            .when((u.contains("githubusercontent.com") | u.contains("github.com")) & gh_owner.isNotNull(), gh_owner)
            .when(u.contains("openml"), "openml").when(u.contains("uci.edu"), "uci")
            .when(u.contains("kaggle"), "kaggle").when(u.contains("huggingface"), "huggingface")
            .otherwise(host))


def source_label(url: Column, title: Column) -> Column:
    u = F.lower(F.coalesce(url, F.lit("")))
    out = F.lit("Web")
    for needle, label in reversed(SOURCE_LABELS):
        out = F.when(u.contains(needle), label).otherwise(out)
    return F.when(F.coalesce(title, F.lit("")).startswith(KNOWN_PREFIX), "KnownDatasets").otherwise(out)


def rank_diverse(scored: DataFrame, top_n: int = 5, per_owner: int = 2,
                 group_cols: list[str] | None = None) -> DataFrame:
    """Top ``top_n`` results per group by score (ties by ``pos``), at most ``per_owner`` per
    repository owner, refilled from the remaining results when too few; junk removed from every
    group that holds anything else.  Adds owner, source and rank.
    """
    groups = group_cols or []
    url = F.lower(F.coalesce("url", F.lit("")))
    # the prepared results are read twice below (is any clean, ranking): they are written once
    # to the shared checkpoint folder, so the upstream text work is not recomputed
    from ..session import checkpoint_dir
    checkpoint_dir(scored.sparkSession)
    prepared = scored.select(
        *[c for c in scored.columns if c != "score"],
        F.when(F.coalesce("title", F.lit("")).startswith(KNOWN_PREFIX),
               F.least("score", F.lit(KNOWN_CAP))).otherwise(F.col("score")).alias("score"),
        repo_owner(F.col("url")).alias("owner"), _any(url, RANKER_JUNK_SIGNALS).alias("_junk")
    ).checkpoint(eager=True)
    pool = prepared.where(~F.col("_junk"))
    if groups:
        # the junk of the groups that have no clean result; one row per group with one
        with_clean = pool.groupBy(*[F.col(g).alias(f"_{i}") for i, g in enumerate(groups)]).agg(F.lit(True).alias("_clean"))
        same = [F.col(g).eqNullSafe(F.col(f"_{i}")) for i, g in enumerate(groups)]
        pool = pool.unionByName(prepared.where("_junk").join(with_clean, same, "left_anti"))
    elif pool.isEmpty():
        pool = prepared
    pool = pool.drop("_junk")
    order = [F.col("score").desc(), F.col("pos")]
    # an owner's results beyond its own places and all places of the group cannot appear, so
    # both windows filter on a row number that Spark also applies before the shuffle
    per = pool.withColumn("_owner", F.row_number().over(Window.partitionBy(*groups, "owner").orderBy(*order)))
    per = per.where(F.col("_owner") <= per_owner + top_n).withColumn("_refill", F.col("_owner") > per_owner)
    ranked = per.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy("_refill", *order)))
    final = ranked.where(F.col("rank") <= top_n).drop("_owner", "_refill")
    return final.withColumn("source", source_label(F.col("url"), F.col("title")))


# ---- CAT4: link normalisation and filters ------------------------------------------------

def normalize_hf_url(url: Column) -> Column:
    """/blob/ -> /resolve/ (first occurrence) on huggingface.co links."""
    first = F.regexp_replace(url, r"/blob/(.*)$", "/resolve/$1")   # greedy tail: only the first /blob/
    return F.when(url.contains("huggingface.co") & url.contains("/blob/"), first).otherwise(url)


def is_dataset_file(url: Column) -> Column:
    """URL (query, fragment and trailing '/' removed) ends with a data-file extension."""
    clean = F.regexp_replace(F.lower(F.split(F.split(url, r"\?").getItem(0), "#").getItem(0)), "/+$", "")
    return F.coalesce(_any(clean, SEARCH_FILE_EXTENSIONS, "endswith"), F.lit(False)) & url.isNotNull() & (url != "")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)", 1))


def domain_allowed(url: Column) -> Column:
    h = url_host(url)
    out = F.lit(False)
    for d in ALLOWED_DOWNLOAD_DOMAINS:
        out = out | (h == d) | h.endswith("." + d)
    return out


def extension_allowed(url: Column) -> Column:
    path = F.lower(F.split(url, r"\?").getItem(0))
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(last.contains("."), _any(path, ALLOWED_DOWNLOAD_EXTENSIONS, "endswith")).otherwise(F.lit(True))


def link_filter(links: DataFrame, url_col: str = "url") -> DataFrame:
    u = F.col(url_col)
    n = normalize_hf_url(u)
    return links.select("*", n.alias("normalized_url"), is_dataset_file(n).alias("is_dataset_file"),
                        domain_allowed(n).alias("domain_allowed"), extension_allowed(n).alias("extension_allowed"))


# ---- CAT5: dataset link extraction from HTML ---------------------------------------------

def extract_dataset_link(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                         html_col: str = "html") -> DataFrame:
    """(page id, dataset_link or NULL): best dataset-file link among a page's hrefs.

    Quoted and bare href values are resolved against the page (absolute, root-relative,
    directory-relative); machine-learning-databases files go first (latest first), then links
    ending in a data extension, then 'download' links mentioning one; .csv, .data, .tsv,
    .xlsx are preferred in that order, else the first candidate.
    """
    quoted = F.regexp_extract_all(F.col(html_col), F.lit(r"(?i)href=[\"']([^\"']+)[\"']"), 1)
    bare = F.regexp_extract_all(F.col(html_col), F.lit(r"(?i)href=([^\s>]+)"), 1)
    page = F.col(url_col)
    staged = pages.select(
        id_col, F.transform(F.concat(quoted, bare), lambda h, i: F.struct(
            i.alias("i"), F.regexp_replace(h, r"^\s+|\s+$", "").alias("h"))).alias("hrefs"),
        F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1).alias("base"),
        F.regexp_extract(F.regexp_replace(page, r"[?#].*$", ""), r"^(.*/)", 1).alias("page_dir"))
    alt = "|".join(e.lstrip(".").replace(".", r"\.") for e in PAGE_LINK_EXTENSIONS)

    def is_link(x):
        return ~(x["h"].startswith("#") | x["h"].startswith("javascript:") | x["h"].startswith("mailto:"))

    def resolved(x):
        h = x["h"]
        folder = F.when(F.col("page_dir") == "", F.concat("base", F.lit("/"))).otherwise(F.col("page_dir"))
        link = (F.when(h.startswith("http"), h).when(h.startswith("/"), F.concat("base", h)).otherwise(F.concat(folder, h)))
        return F.struct(x["i"].alias("i"), link.alias("link"))

    def rated(x):
        low, i = F.lower(x["link"]), x["i"]
        ends, uci = low.rlike(rf"\.({alt})$"), low.contains("machine-learning-databases")
        kind = (F.when(uci & ends, 0).when(uci, 1).when(ends, 1)
                .when(low.contains("download") & low.rlike(rf"\.({alt})"), 1))
        pref = F.lit(len(PREFERRED_LINK_EXTENSIONS))
        for j, ext in reversed(list(enumerate(PREFERRED_LINK_EXTENSIONS))):
            pref = F.when(low.endswith(ext), F.lit(j)).otherwise(pref)
        return F.struct(pref.alias("pref"), kind.alias("kind"), F.when(kind == 0, -i).otherwise(i).alias("ord"),
                        x["link"].alias("link"))

    links = F.transform(F.filter("hrefs", is_link), resolved)
    best = F.array_min(F.filter(F.transform(links, rated), lambda x: x["kind"].isNotNull()))
    return staged.select(id_col, best["link"].alias("dataset_link"))


# ---- CAT7: content sniffing --------------------------------------------------------------

def content_sniff(df: DataFrame, content_col: str) -> DataFrame:
    """is_html (first 200 characters start with an HTML signature), too_small (< 100 bytes),
    too_large (> 500 MB)."""
    head = F.upper(F.substring(F.col(content_col), 1, SNIFF_PREFIX))
    is_html = F.lit(False)
    for s in HTML_SIGNATURES:
        is_html = is_html | head.startswith(s)
    n = F.octet_length(F.col(content_col))
    return df.select("*", is_html.alias("is_html"), (n < MIN_CONTENT_BYTES).alias("too_small"),
                     (n > MAX_CONTENT_BYTES).alias("too_large"))


# ---- CAT8: catalog entry filter ----------------------------------------------------------

def name_overlap(entries: DataFrame, name_col: str, rows_col: str, query: str) -> DataFrame:
    """Keep entries with >= 50 rows whose name shares a word with the query (either word
    containing the other); query words need >= 3 characters and are not stop words."""
    qwords = sorted({w.lower() for w in query.split() if len(w) >= 3 and w.lower() not in CATALOG_STOP_WORDS})
    name_words = F.split(F.translate(F.lower(F.col(name_col)), "-_", "  "), r"\s+")
    name_words = F.filter(name_words, lambda w: w != "")
    if qwords:
        q = F.array(*[F.lit(w) for w in qwords])
        overlap = F.exists(q, lambda qw: F.exists(name_words, lambda nw: nw.contains(qw) | qw.contains(nw)))
    else:
        overlap = F.lit(True)
    return entries.where((F.col(rows_col) >= CATALOG_MIN_ROWS) & overlap)


# ---- CAT9: default scores by source ------------------------------------------------------

# fixed values: score of a candidate by the source that found it, before any rescoring
SOURCE_SCORES = {"semantic": 0.90, "web": 0.72, "kaggle": 0.70, "openml": 0.65, "huggingface": 0.50}


def default_score(source: Column) -> Column:
    """CAT9: the score a candidate starts with; NULL for an unknown source."""
    return F.element_at(F.create_map(*[x for s, v in SOURCE_SCORES.items() for x in (F.lit(s), F.lit(v))]), F.lower(source))


# ---- SET1: union keeping the first occurrence per URL ------------------------------------

def union_first_by_url(sources: list[DataFrame]) -> DataFrame:
    """Union candidate lists (each with priority, pos, url, ...) keeping, per url, the row of
    the best (priority, pos).  An aggregation, so a URL repeated on a third of all rows is
    combined map-side instead of sorted in one task."""
    u = sources[0]
    for s in sources[1:]:
        u = u.unionByName(s)
    payload = [c for c in u.columns if c not in ("priority", "pos", "url")]
    best = u.groupBy("url").agg(F.min(F.struct("priority", "pos", *payload)).alias("b"))
    return best.select("url", "b.*")


# ---- QUAL8: junk schema ------------------------------------------------------------------

def junk_schema(schemas: DataFrame, columns_col: str = "columns") -> DataFrame:
    """Flag schemas (array of column names) that look like catalogs/indexes: two or more
    substrings of one pattern in the space-joined names, each lower-cased with spaces and
    slashes turned into underscores."""
    text = F.array_join(F.transform(F.col(columns_col),
                                    lambda c: F.regexp_replace(F.lower(c), "[ /]", "_")), " ")
    reason = F.lit(None).cast("string")
    for pats, why in reversed(JUNK_SCHEMA_PATTERNS):
        reason = F.when(_count_contains(text, pats) >= 2, F.lit(why)).otherwise(reason)
    return schemas.select("*", reason.isNotNull().alias("is_junk"), reason.alias("junk_reason"))
