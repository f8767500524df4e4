"""DuckDB SQL fragments for the oracle: the same test-table mapping and
analysis as the Spark side, written once and reused by every oracle query."""

from __future__ import annotations

from folio import constants as C


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


STOPS = _list(C.STOP_WORDS)
TOKEN = C.TOKEN_PATTERN


def analyze(expr: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({expr}), '{TOKEN}'), "
            f"lambda t: length(t) >= {C.MIN_TOKEN_LEN} AND NOT list_contains({STOPS}, t))")


def snippet(expr: str, n: int = C.SNIPPET_LENGTH) -> str:
    head = f"substring(coalesce({expr}, ''), 1, {n})"
    p = f"instr(reverse({head}), ' ')"
    cut = f"CASE WHEN {p} > 0 AND {n} - {p} > {n * C.SNIPPET_CUT_RATIO} THEN substring({head}, 1, {n} - {p}) ELSE {head} END"
    return f"CASE WHEN length(coalesce({expr}, '')) <= {n} THEN coalesce({expr}, '') ELSE {cut} || '...' END"


EXTS = _list(C.TEST_EXTENSIONS)
FMTS = _list(C.TEST_FORMATS)

# documents model without labels (columns as folio.sources.testcorpus.documents)
DOCS_BASE = f"""
docs_p AS (
  SELECT doc_id, text, lang, source,
         '/' || source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || {EXTS}[CAST(doc_id % 6 AS INTEGER) + 1] AS path,
         CAST(doc_id % 6 AS INTEGER) + 1 AS fi,
         TIMESTAMP '{C.TEST_EPOCH}' + to_hours(doc_id) AS created_at,
         CASE doc_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'indexed' END AS status
  FROM documents),
docs_b AS (
  SELECT doc_id, md5(path) AS id, path,
         coalesce(nullif(trim(substring(split_part(text, chr(10), 1), 1, 60)), ''), 'Document ' || CAST(doc_id AS VARCHAR)) AS title,
         text AS content, sha256(text) AS content_hash, {FMTS}[fi] AS format,
         CAST(octet_length(encode(text)) AS BIGINT) AS size,
         created_at, created_at + to_hours((doc_id * 7) % 720) AS modified_at,
         CASE WHEN status = 'indexed' THEN created_at + to_hours((doc_id * 7) % 720) + to_hours(1) END AS indexed_at,
         status, CASE WHEN status = 'failed' THEN 'decode error' END AS error,
         lang AS category, lang, source
  FROM docs_p)"""

DOCS = DOCS_BASE + """,
docs AS (
  SELECT b.*, CAST(coalesce(l.quality, 0) AS DOUBLE) AS score,
         CASE WHEN l.quality IS NOT NULL
              THEN [b.source, b.lang, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE 'clean' END, 'q' || CAST(l.quality AS VARCHAR)]
              ELSE [b.source, b.lang] END AS tags
  FROM docs_b b LEFT JOIN labels l USING (doc_id))"""

DOC_TAGS = """
doc_tags AS (
  SELECT doc_id, source AS tag FROM documents
  UNION ALL SELECT doc_id, lang FROM documents
  UNION ALL SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END FROM labels
  UNION ALL SELECT doc_id, 'q' || CAST(quality AS VARCHAR) FROM labels)"""

LINE_TAGS = """
line_tags AS (SELECT l_orderkey AS doc_id, 'p' || CAST(l_partkey AS VARCHAR) AS tag FROM lineitem)"""

CATEGORIES = """
categories AS (
  SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS id, r_name AS name, CAST(NULL AS VARCHAR) AS parent_id, r_regionkey AS ord FROM region
  UNION ALL
  SELECT 'n' || CAST(n_nationkey AS VARCHAR), n_name, 'r' || CAST(n_regionkey AS VARCHAR), n_nationkey FROM nation),
doc_categories AS (SELECT c_custkey AS doc_id, 'n' || CAST(c_nationkey AS VARCHAR) AS category_id FROM customer)"""

HISTORY = f"""
search_history AS (
  SELECT conv_id AS user_id, turn,
         array_to_string(regexp_extract_all(lower(text), '{TOKEN}'), ' ') AS query,
         TIMESTAMP '{C.TEST_EPOCH}' + to_minutes(conv_id * 10 + turn) AS searched_at,
         (conv_id * 7 + turn) % 150 AS results_count,
         ((conv_id * 13 + turn) % 1000) / 1000.0 AS execution_time
  FROM conversations WHERE role = 'user')"""

FILE_EVENTS = """
file_events AS (
  SELECT event_id,
         CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted'
                         WHEN 'purchase' THEN 'moved' ELSE 'modified' END AS type,
         CASE WHEN event_type = 'purchase' THEN '/m/' || CAST(user_id AS VARCHAR) || '.md'
              ELSE '/u/' || CAST(user_id AS VARCHAR) || '.md' END AS path,
         CASE WHEN event_type = 'purchase' THEN '/u/' || CAST(user_id AS VARCHAR) || '.md' END AS old_path,
         ts, value, user_id
  FROM events)"""

METRICS = """
metrics AS (SELECT event_id, event_type AS name, value, 'ms' AS unit, ts FROM events)"""


def tokens_cte(docs: str = "docs") -> str:
    """tok(doc_id, field, toks) for title, content, tags, format, category, status."""
    return f"""
tok AS (
  SELECT doc_id, 'title' AS field, {analyze('title')} AS toks FROM {docs}
  UNION ALL SELECT doc_id, 'content', {analyze('content')} FROM {docs}
  UNION ALL SELECT doc_id, 'tags', list_filter(list_transform(tags, lambda x: lower(trim(x))), lambda x: x <> '') FROM {docs}
  UNION ALL SELECT doc_id, 'format', [lower(format)] FROM {docs}
  UNION ALL SELECT doc_id, 'category', [lower(category)] FROM {docs}
  UNION ALL SELECT doc_id, 'status', [lower(status)] FROM {docs}),
nd AS (SELECT count(*) AS n_docs FROM {docs}),
st AS (SELECT field, sum(len(toks)) / (SELECT n_docs FROM nd) AS avgdl, (SELECT n_docs FROM nd) AS n_docs FROM tok GROUP BY field)"""


def postings_cte(term_filter: str = "TRUE") -> str:
    return f"""
post AS (
  SELECT doc_id, field, term, count(*) AS tf, max(dl) AS dl
  FROM (SELECT doc_id, field, len(toks) AS dl, unnest(toks) AS term FROM tok)
  WHERE {term_filter} GROUP BY doc_id, field, term),
voc AS (SELECT field, term, count(*) AS df FROM post GROUP BY field, term)"""


def bm25(alias: str = "") -> str:
    a = alias + "." if alias else ""
    boost = "CASE " + " ".join(f"WHEN {a}field = '{f}' THEN {bo}" for f, (bo, _) in C.FIELD_WEIGHTS.items()) + " ELSE 1.0 END"
    b = "CASE " + " ".join(f"WHEN {a}field = '{f}' THEN {bb}" for f, (_, bb) in C.FIELD_WEIGHTS.items()) + f" ELSE {C.BM25_B} END"
    return (f"({boost}) * ln(1.0 + (n_docs - df + 0.5) / (df + 0.5)) * "
            f"(tf * {C.BM25_K1 + 1.0} / (tf + {C.BM25_K1} * (1.0 - ({b}) + ({b}) * dl / avgdl)))")
