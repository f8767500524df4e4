"""Registered export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import export as O
from folio.operators import relational as R
from folio.operators import search as s
from folio.operators.search import positions
from folio.plans import sql as Q
from folio.plans.extract_plans import MD_CTE, md_frame
from folio.plans.registry import register
from folio.plans.search_plans import BM25_SQL, T12_SQL, T6_TERMS, corpus_index
from folio.sources import testcorpus as tc

_ISO = "strftime({c}, '%Y-%m-%dT%H:%M:%S')"


@register("o1_json_rows")
def o1(spark, sf_dir):
    return O.json_rows(tc.documents(spark, sf_dir))


O1_SQL = f"""WITH {Q.DOCS}
SELECT id, path, title, format, size, content_hash, sha256(content) AS content_sha256, {_ISO.format(c='created_at')} AS created_at, {_ISO.format(c='modified_at')} AS modified_at,
       array_to_string(tags, ',') AS tags, category FROM docs"""


@register("o1_json_round_trip", O1_SQL)
def o1_read_back(spark, sf_dir):
    """The JSON export written to files and read back, field by field."""
    from folio.session import scratch_path
    docs = tc.documents(spark, sf_dir)
    path = scratch_path(spark, "o1-json")
    O.write_json(docs, path)
    back = spark.read.schema(docs.select(*O.JSON_COLUMNS).schema).json(path)
    return back.select("id", "path", "title", "format", "size", "content_hash", F.sha2("content", 256).alias("content_sha256"),
                       O.iso("created_at").alias("created_at"), O.iso("modified_at").alias("modified_at"), F.array_join("tags", ",").alias("tags"), "category")


O2_SQL = f"""WITH {Q.DOCS_BASE}
SELECT id, title, path, format, CAST(size AS VARCHAR) AS size, coalesce({_ISO.format(c='created_at')}, '') AS created_at,
       coalesce({_ISO.format(c='modified_at')}, '') AS updated_at FROM docs_b"""


@register("o2_csv_rows", O2_SQL)
def o2(spark, sf_dir):
    return O.csv_rows(tc.documents(spark, sf_dir, with_labels=False))


def _prev_sql(c: str) -> str:
    return f"substring({c}, 1, 1000) || CASE WHEN length({c}) > 1000 THEN chr(10) || '... (truncated)' ELSE '' END"


O3_SQL = f"""WITH {Q.DOCS_BASE}
SELECT doc_id, concat_ws(chr(10), chr(10) || '## ' || title || chr(10), '- **Path**: `' || path || '`',
  '- **Format**: ' || format, '- **Size**: ' || CAST(size AS VARCHAR) || ' bytes', chr(10) || '### Metadata',
  '- **category**: ' || coalesce(category, ''),
  CASE WHEN coalesce(content, '') <> '' THEN chr(10) || '### Content' || chr(10) || '```' || chr(10) || {_prev_sql('content')} || chr(10) || '```' END)
  AS markdown FROM docs_b"""


@register("o3_markdown_render", O3_SQL)
def o3(spark, sf_dir):
    d = tc.documents(spark, sf_dir, with_labels=False)
    return d.select("doc_id", O.markdown_render(d).alias("markdown"))


O4_SQL = f"""WITH {Q.DOCS},
n AS (SELECT *, row_number() OVER (ORDER BY title, doc_id) AS n FROM docs)
SELECT n, doc_id, CAST(n AS VARCHAR) || '. [' || title || '](#' || replace(lower(title), ' ', '-') || ')' AS toc_line,
  '## ' || title || ' {{#' || replace(lower(title), ' ', '-') || '}}' || chr(10) || chr(10) || '*Path: ' || path || '*'
  || CASE WHEN category IS NOT NULL THEN chr(10) || '*Category: ' || category || '*' ELSE '' END
  || CASE WHEN len(tags) > 0 THEN chr(10) || '*Tags: ' || array_to_string(tags, ', ') || '*' ELSE '' END
  || chr(10) || chr(10) || coalesce(content, '') || chr(10) || chr(10) || '---' || chr(10) AS body FROM n"""


@register("o4_numbered_bundle", O4_SQL)
def o4(spark, sf_dir):
    return O.bundle(tc.documents(spark, sf_dir))


def _esc_sql(e: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        e = f"replace({e}, '{a.replace(chr(39), chr(39) * 2)}', '{b}')"
    return e


O5_SQL = f"""WITH {Q.DOCS_BASE}
SELECT doc_id, '<div class="document"><h2>' || {_esc_sql("coalesce(title, 'Untitled')")} || '</h2><div class="path">'
  || {_esc_sql('path')} || '</div>' || '<div class="metadata"><h3>Metadata</h3><ul>'
  || '<li><strong>category:</strong> ' || {_esc_sql("coalesce(category, '')")} || '</li></ul></div>'
  || CASE WHEN coalesce(content, '') <> '' THEN '<h3>Content Preview</h3><pre>' || {_esc_sql("substring(content, 1, 1000)")}
     || CASE WHEN length(content) > 1000 THEN '... (truncated)' ELSE '' END || '</pre>' ELSE '' END || '</div>' AS html
FROM docs_b"""


@register("o5_html_render", O5_SQL)
def o5(spark, sf_dir):
    d = tc.documents(spark, sf_dir, with_labels=False)
    return d.select("doc_id", O.html_render(d).alias("html"))


O6_SQL = f"""WITH h AS ({BM25_SQL.strip()}),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM h),
f AS ({T12_SQL.strip()})
SELECT 'header' AS section, CAST(0 AS BIGINT) AS pos, '# Search: {' '.join(T6_TERMS)} (' || CAST((SELECT count(*) FROM r) AS VARCHAR) || ' hits)' AS line
UNION ALL SELECT 'facet', count, field || ': ' || value || ' (' || CAST(count AS VARCHAR) || ')' FROM f
UNION ALL SELECT 'hit', rank, CAST(rank AS VARCHAR) || '. ' || title || ' (' || printf('%.6f', score) || ')' FROM r"""


@register("o6_search_report", O6_SQL)
def o6(spark, sf_dir):
    idx = corpus_index(spark, sf_dir)
    q = s.any_of(*[s.term(t) for t in T6_TERMS])
    hits = positions(s.search(idx, q, limit=20, with_snippet=False))  # bounded page: 20 rows
    hits = hits.withColumn("score", F.format_string("%.6f", "score"))
    return O.report(hits, s.facets(idx, q), " ".join(T6_TERMS))


O7_SQL = f"""WITH {Q.DOCS}
SELECT id, title, path, format, CAST(size AS VARCHAR) AS size, {_ISO.format(c='created_at')} AS created_at,
       {_ISO.format(c='modified_at')} AS updated_at
FROM docs WHERE category = 'en' AND format = 'markdown' AND list_contains(tags, 'clean')"""


@register("o7_filtered_export", O7_SQL)
def o7(spark, sf_dir):
    d = tc.documents(spark, sf_dir)
    sel = R.having_all_tags(R.apply_filters(d, {"category": "en", "format": "markdown"}),
                            tc.doc_tags(spark, sf_dir), ["clean"])
    return O.csv_rows(sel)


def _md_html_sql(e: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        e = f"replace({e}, '{a}', '{b}')"
    for rx, rep in O.MD_HTML_RULES:
        e = f"regexp_replace({e}, '{rx}', '{rep.replace('$', chr(92))}', 'g')"
    e = f"'<p>' || {e} || '</p>'"
    rx, rep = O.MD_LIST_RULES[0]
    e = f"regexp_replace({e}, '{rx}', '{rep.replace('$', chr(92))}', 'g')"
    rx, rep = O.MD_LIST_RULES[1]
    return f"regexp_replace({e}, '{rx}', '{rep.replace('$', chr(92))}')"


O8_SQL = f"""WITH {MD_CTE} SELECT doc_id, {_md_html_sql('content')} AS html FROM md"""


@register("o8_markdown_to_html", O8_SQL)
def o8(spark, sf_dir):
    return md_frame(spark, sf_dir).select("doc_id", O.markdown_to_html("content").alias("html"))
