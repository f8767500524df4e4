"""Registered extraction queries.

Test inputs are derived from the driver's tables with fixed templates, the
same on both sides: markdown and Python sources wrap `documents.text`, JSON
comes from `events.props`, YAML from `customer`, HTML is `pages`."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio import constants as C
from folio.functions import text as T
from folio.operators import extract as X
from folio.plans import sql as Q
from folio.plans.registry import register
from folio.sources import testcorpus as tc

NL = "\n"


def _spark_concat(parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _sql_concat(parts):
    out = []
    for p in parts:
        if isinstance(p, str):
            out.append("'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
        else:
            out.append(p.sql)
    return "(" + " || ".join(out) + ")"


class Col:
    """A column usable on both sides: a Spark Column (built lazily, so that
    importing this module needs no running session) and an SQL expression."""

    def __init__(self, make_spark, sql: str):
        self.make_spark, self.sql = make_spark, sql


def _both(parts):
    sp = [p.make_spark() if isinstance(p, Col) else p for p in parts]
    return _spark_concat(sp), _sql_concat(parts)


def _sql_only(parts):
    return _sql_concat(parts)


DOC = Col(lambda: F.col("doc_id").cast("string"), "CAST(doc_id AS VARCHAR)")
SRC = Col(lambda: F.col("source"), "source")
LANG = Col(lambda: F.col("lang"), "lang")
FIRST = Col(lambda: F.split_part(F.col("text"), F.lit(NL), F.lit(1)), "split_part(text, chr(10), 1)")
TEXT = Col(lambda: F.col("text"), "text")

_FM = ["---\ntitle: Doc ", DOC, "\nsource: ", SRC, "\n---\n"]
_BODY_TAIL = ["\n\n## Links and media\n[home](https://", SRC, ".example.com/", DOC, ") and ![logo](/img/", DOC,
              ".png)\n[ref]: /ref/", LANG, "\n\n```python\nprint(", DOC, ")\n```\n\n```\nplain block\n```\n"]
# variant by doc_id % 4: 0 = no front matter, no H1; 1 = front matter, no H1; else both
MD_V0 = [FIRST, "\n\n", TEXT] + _BODY_TAIL
MD_V1 = _FM + [FIRST, "\n\n", TEXT] + _BODY_TAIL
MD_V2 = _FM + ["# ", FIRST, "\n\n", TEXT] + _BODY_TAIL

PY_DOC = ['"""', FIRST, "\n\nLonger description of module ", DOC, '.\n"""\n']
PY_BODY = ["import os\nimport sys\nfrom collections import OrderedDict\n\n\nclass Doc", DOC,
           "(object):\n    \"\"\"Class doc.\"\"\"\n\n    def method_a(self):\n        return 1\n\n"
           "    def method_b(self, x):\n        return x\n\n\ndef helper_", DOC, "():\n    return ", DOC,
           "\n\n\nasync def fetch():\n    return None\n"]


def md_frame(spark, sf_dir):
    d = tc.table(spark, sf_dir, "documents")
    v = F.col("doc_id") % 4
    md = F.when(v == 0, _both(MD_V0)[0]).when(v == 1, _both(MD_V1)[0]).otherwise(_both(MD_V2)[0])
    path = F.concat(F.lit("/md/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return d.select("doc_id", path.alias("path"), md.alias("content"))


MD_CTE = (f"md AS (SELECT doc_id, '/md/' || source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path, "
          f"CASE doc_id % 4 WHEN 0 THEN {_sql_only(MD_V0)} WHEN 1 THEN {_sql_only(MD_V1)} ELSE {_sql_only(MD_V2)} END "
          f"AS content FROM documents)")


def py_frame(spark, sf_dir):
    d = tc.table(spark, sf_dir, "documents")
    src = F.when(F.col("doc_id") % 5 == 0, _both(PY_BODY)[0]).otherwise(_both(PY_DOC + PY_BODY)[0])
    path = F.concat(F.lit("/code/module_"), F.col("doc_id").cast("string"), F.lit(".py"))
    return d.select("doc_id", path.alias("path"), src.alias("content"))


PY_CTE = (f"py AS (SELECT doc_id, '/code/module_' || CAST(doc_id AS VARCHAR) || '.py' AS path, "
          f"CASE WHEN doc_id % 5 = 0 THEN {_sql_only(PY_BODY)} ELSE {_sql_only(PY_DOC + PY_BODY)} END AS content "
          f"FROM documents)")


def _strip(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def _lines(e: str) -> str:
    return (f"CAST(CASE WHEN {e} = '' THEN 0 WHEN ends_with({e}, chr(10)) THEN len(string_split({e}, chr(10))) - 1 "
            f"ELSE len(string_split({e}, chr(10))) END AS INTEGER)")


def _words(e: str) -> str:
    return f"CAST(len(regexp_extract_all({e}, '\\S+')) AS INTEGER)"


def _html_text(e: str) -> str:
    h = f"regexp_replace({e}, '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g')"
    h = f"regexp_replace({h}, '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g')"
    h = f"regexp_replace({h}, '(?s)<!--.*?-->', ' ', 'g')"
    h = f"regexp_replace({h}, '<[^>]*>', ' ', 'g')"
    for a, b in C.HTML_ENTITIES:
        h = f"replace({h}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({h}, '\\s+', ' ', 'g'))"


def _rx(e: str, rx: str, g: int) -> str:
    return f"regexp_extract_all({e}, '{rx}', {g})"


# ----------------------------------------------------------------------------- X1
X1_SQL = f"""SELECT doc_id, {_lines('text')} AS line_count, {_words('text')} AS word_count,
CAST(length(text) AS INTEGER) AS char_count FROM documents"""


@register("x1_text_stats", X1_SQL)
def x1(spark, sf_dir):
    d = tc.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return X.text_stats(d).select("doc_id", "line_count", "word_count", "char_count")


# ----------------------------------------------------------------------------- X2-X10
X2_SQL = f"""WITH {MD_CTE}
SELECT doc_id, CAST(len({_rx('content', X.RX_HEADER, 1)}) AS INTEGER) AS n_headers,
  array_to_string(list_transform({_rx('content', X.RX_HEADER, 1)}, lambda m: CAST(length(m) AS VARCHAR)), ',') AS levels,
  array_to_string(list_transform({_rx('content', X.RX_HEADER, 2)}, lambda t: {_strip('t')}), '|') AS header_texts
FROM md"""


@register("x2_markdown_headers", X2_SQL)
def x2(spark, sf_dir):
    h = X.headers(F.col("content"))
    return md_frame(spark, sf_dir).select(
        "doc_id", F.size(h).alias("n_headers"),
        F.array_join(F.transform(h, lambda x: x["level"].cast("string")), ",").alias("levels"),
        F.array_join(F.transform(h, lambda x: x["text"]), "|").alias("header_texts"))


_NOIMG = f"regexp_replace(content, '{X.RX_IMAGE}', '', 'g')"
X3_SQL = f"""WITH {MD_CTE}
SELECT doc_id, array_to_string(list_transform(list_zip({_rx(_NOIMG, X.RX_LINK_ANY, 1)}, {_rx(_NOIMG, X.RX_LINK_ANY, 2)}),
  lambda z: z[1] || '->' || z[2]), '|') AS links FROM md"""


@register("x3_markdown_links", X3_SQL)
def x3(spark, sf_dir):
    lk = X.links(F.col("content"))
    return md_frame(spark, sf_dir).select(
        "doc_id", F.array_join(F.transform(lk, lambda z: F.concat(z["text"], F.lit("->"), z["url"])), "|").alias("links"))


X4_SQL = f"""WITH {MD_CTE}
SELECT doc_id, array_to_string(list_transform(list_zip({_rx('content', X.RX_IMAGE, 1)}, {_rx('content', X.RX_IMAGE, 2)}),
  lambda z: z[1] || '->' || z[2]), '|') AS images FROM md"""


@register("x4_markdown_images", X4_SQL)
def x4(spark, sf_dir):
    im = X.images(F.col("content"))
    return md_frame(spark, sf_dir).select(
        "doc_id", F.array_join(F.transform(im, lambda z: F.concat(z["alt"], F.lit("->"), z["url"])), "|").alias("images"))


_FMB = f"regexp_extract(content, '{X.RX_FRONT_MATTER}', 1)"


def _fm_get(key: str) -> str:
    return (f"CASE WHEN regexp_matches(content, '{X.RX_FRONT_MATTER}') THEN "
            f"{_rx(_FMB, X.RX_FM_PAIR, 2)}[list_position({_rx(_FMB, X.RX_FM_PAIR, 1)}, '{key}')] END")


X5_SQL = f"""WITH {MD_CTE}
SELECT doc_id, regexp_matches(content, '{X.RX_FRONT_MATTER}') AS has_front_matter,
  {_fm_get('title')} AS fm_title, {_fm_get('source')} AS fm_source,
  CAST(length(regexp_replace(content, '{X.RX_FRONT_MATTER_STRIP}', '')) AS INTEGER) AS body_chars FROM md"""


@register("x5_front_matter", X5_SQL)
def x5(spark, sf_dir):
    c = F.col("content")
    fm = X.front_matter(c)
    return md_frame(spark, sf_dir).select(
        "doc_id", fm.isNotNull().alias("has_front_matter"), F.element_at(fm, F.lit("title")).alias("fm_title"),
        F.element_at(fm, F.lit("source")).alias("fm_source"),
        F.char_length(X.strip_front_matter(c)).cast("int").alias("body_chars"))


X6_SQL = f"""WITH {MD_CTE}
SELECT doc_id, coalesce(nullif({_strip(f"regexp_extract(content, '{X.RX_H1}', 1)")}, ''), {_fm_get('title')},
  CAST(doc_id AS VARCHAR)) AS md_title FROM md"""


@register("x6_markdown_title", X6_SQL)
def x6(spark, sf_dir):
    return md_frame(spark, sf_dir).select("doc_id", X.markdown_title(F.col("content"), F.col("path")).alias("md_title"))


_SLUG = "regexp_replace(regexp_replace(lower(trim({t})), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '\\s+', '-', 'g')"
X7_SQL = f"""WITH {MD_CTE}
SELECT doc_id, array_to_string(list_transform({_rx('content', X.RX_HEADER, 2)},
  lambda t: {_SLUG.format(t=_strip('t'))}), '|') AS anchors FROM md"""


@register("x7_table_of_contents", X7_SQL)
def x7(spark, sf_dir):
    t = X.toc(F.col("content"))
    return md_frame(spark, sf_dir).select("doc_id", F.array_join(F.transform(t, lambda x: x["anchor"]), "|").alias("anchors"))


_ALL = (f"list_sort(list_distinct(list_concat({_rx('content', X.RX_LINK_ANY, 2)}, {_rx('content', X.RX_REF_LINK, 2)}, "
        f"{_rx('content', X.RX_URL.replace(chr(39), chr(39) * 2), 0)})))")
X8_SQL = f"""WITH {MD_CTE}
SELECT doc_id, array_to_string({_ALL}, '|') AS links,
  CAST(len(list_filter({_ALL}, lambda x: starts_with(x, 'http'))) AS INTEGER) AS n_external,
  CAST(len(list_filter({_ALL}, lambda x: NOT starts_with(x, 'http'))) AS INTEGER) AS n_internal FROM md"""


@register("x8_all_links", X8_SQL)
def x8(spark, sf_dir):
    c = F.col("content")
    return md_frame(spark, sf_dir).select(
        "doc_id", F.array_join(X.all_links(c), "|").alias("links"),
        F.size(X.external_links(c)).alias("n_external"), F.size(X.internal_links(c)).alias("n_internal"))


X9_SQL = f"""WITH {MD_CTE}
SELECT doc_id, CAST(len({_rx('content', X.RX_FENCE, 1)}) AS INTEGER) AS n_blocks,
  array_to_string(list_sort(list_distinct(list_transform({_rx('content', X.RX_FENCE, 1)},
    lambda l: coalesce(nullif(l, ''), 'plain')))), ',') AS languages,
  CAST(list_sum(list_transform({_rx('content', X.RX_FENCE, 2)}, lambda c: {_lines('c')})) AS BIGINT) AS code_lines FROM md"""


@register("x9_code_blocks", X9_SQL)
def x9(spark, sf_dir):
    c = F.col("content")
    b = X.code_blocks(c)
    return md_frame(spark, sf_dir).select(
        "doc_id", F.size(b).alias("n_blocks"), F.array_join(X.code_languages(c), ",").alias("languages"),
        F.aggregate(b, F.lit(0).cast("long"), lambda acc, x: acc + x["lines"]).alias("code_lines"))


X10_SQL = f"""WITH {MD_CTE}
SELECT doc_id, CAST(greatest(1, round_even({_words(f"regexp_replace(content, '{X.RX_FENCE_ANY}', '', 'g')")} / 225.0, 0))
  AS INTEGER) AS reading_time FROM md"""


@register("x10_reading_time", X10_SQL)
def x10(spark, sf_dir):
    return md_frame(spark, sf_dir).select("doc_id", X.reading_time(F.col("content")).alias("reading_time"))


# ----------------------------------------------------------------------------- X11-X14
_JSON_DOC = ("CASE event_type WHEN 'error' THEN substring(props, 1, length(props) - 1) "
             "WHEN 'purchase' THEN '[' || props || ', ' || props || ']' ELSE props END")
X11_SQL = f"""WITH j AS (SELECT event_id, {_JSON_DOC} AS content FROM events)
SELECT event_id, json_valid(content) AS valid,
  CASE WHEN json_valid(content) AND regexp_extract(content, '^\\s*(\\S)', 1) = '{{' THEN array_to_string(json_keys(content)[1:20], ',') END AS keys,
  CASE WHEN json_valid(content) AND regexp_extract(content, '^\\s*(\\S)', 1) = '{{' THEN CAST(len(json_keys(content)) AS INTEGER) END AS key_count,
  CASE WHEN json_valid(content) AND regexp_extract(content, '^\\s*(\\S)', 1) = '[' THEN CAST(json_array_length(content) AS INTEGER) END AS array_length
FROM j"""


@register("x11_json_info", X11_SQL)
def x11(spark, sf_dir):
    e = tc.table(spark, sf_dir, "events")
    doc = (F.when(F.col("event_type") == "error", F.expr("substring(props, 1, char_length(props) - 1)"))
           .when(F.col("event_type") == "purchase", F.concat(F.lit("["), F.col("props"), F.lit(", "), F.col("props"), F.lit("]")))
           .otherwise(F.col("props")))
    j = X.json_info(e.select("event_id", doc.alias("content")))
    return j.select("event_id", "valid", F.array_join("keys", ",").alias("keys"), "key_count", "array_length")


def _yaml_s():
    return F.concat(F.lit("# customer record\nname: "), F.col("c_name"), F.lit("\nsegment: "), F.col("c_mktsegment"),
                   F.lit("\nnation: "), F.col("c_nationkey").cast("string"),
                   F.lit("\naddress:\n  street: main\n  city: c"), F.col("c_custkey").cast("string"), F.lit("\n"))
_YAML_Q = ("'# customer record' || chr(10) || 'name: ' || c_name || chr(10) || 'segment: ' || c_mktsegment || chr(10) || "
           "'nation: ' || CAST(c_nationkey AS VARCHAR) || chr(10) || 'address:' || chr(10) || '  street: main' || chr(10) || "
           "'  city: c' || CAST(c_custkey AS VARCHAR) || chr(10)")
X12_SQL = f"""WITH y AS (SELECT c_custkey, {_YAML_Q} AS content FROM customer)
SELECT c_custkey, array_to_string({_rx('content', X.RX_YAML_KEY, 1)}[1:20], ',') AS keys,
  CAST(len({_rx('content', X.RX_YAML_KEY, 1)}) AS INTEGER) AS key_count FROM y"""


@register("x12_yaml_keys", X12_SQL)
def x12(spark, sf_dir):
    c = tc.table(spark, sf_dir, "customer").select("c_custkey", _yaml_s().alias("content"))
    y = X.yaml_info(c)
    return y.select("c_custkey", F.array_join("keys", ",").alias("keys"), "key_count")


_DQ = X.RX_DOC_DQ
_SQ = X.RX_DOC_SQ.replace("'", "''")
_PYFIRST = (f"CASE WHEN regexp_matches(content, '{_DQ}') THEN split_part({_strip(f'regexp_extract(content, {chr(39)}{_DQ}{chr(39)}, 1)')}, chr(10), 1) "
            f"ELSE split_part({_strip(f'regexp_extract(content, {chr(39)}{_SQ}{chr(39)}, 1)')}, chr(10), 1) END")
X13_SQL = f"""WITH {PY_CTE}
SELECT doc_id, {_lines('content')} AS line_count,
  array_to_string({_rx('content', X.RX_IMPORT, 1)}[1:20], '|') AS imports,
  array_to_string({_rx('content', X.RX_CLASS, 1)}[1:20], ',') AS classes,
  array_to_string({_rx('content', X.RX_DEF, 1)}[1:20], ',') AS functions,
  CASE WHEN regexp_matches(content, '{_DQ}') THEN substring({_strip(f"regexp_extract(content, '{_DQ}', 1)")}, 1, 500)
       WHEN regexp_matches(content, '{_SQ}') THEN substring({_strip(f"regexp_extract(content, '{_SQ}', 1)")}, 1, 500) END AS docstring,
  CASE WHEN (regexp_matches(content, '{_DQ}') OR regexp_matches(content, '{_SQ}')) AND {_PYFIRST} <> ''
            AND length({_PYFIRST}) < 100 THEN {_PYFIRST} ELSE 'Module ' || CAST(doc_id AS VARCHAR) END AS py_title
FROM py"""


@register("x13_python_info", X13_SQL)
def x13(spark, sf_dir):
    p = X.python_info(py_frame(spark, sf_dir))
    return p.select("doc_id", "line_count", F.array_join("imports", "|").alias("imports"),
                    F.array_join("classes", ",").alias("classes"), F.array_join("functions", ",").alias("functions"),
                    "docstring", "py_title")


# ----------------------------------------------------------------------------- X15-X16
RX_META_ORACLE = r'(?is)<meta\s+(?:name|property)="([^"]+)"'  # as the test pages write them
_TITLE = f"nullif({_html_text(chr(39) + 'x' + chr(39))}, '')"
X15_SQL = f"""SELECT page_id, {_html_text('html')} AS text,
  coalesce(nullif({_html_text(f"regexp_extract(html, '{X.RX_HTML_TITLE}', 1)")}, ''),
           nullif({_html_text(f"regexp_extract(html, '{X.RX_HTML_H1}', 1)")}, '')) AS html_title,
  CAST(len({_rx('html', RX_META_ORACLE, 1)}) AS INTEGER) AS n_meta,
  CAST(len({_rx('html', X.RX_A, 0)}) AS INTEGER) AS link_count,
  CAST(len({_rx('html', X.RX_IMG, 0)}) AS INTEGER) AS image_count,
  CAST(len({_rx('html', X.RX_HEADING, 0)}) AS INTEGER) AS heading_count
FROM pages"""


@register("x15_html_extract", X15_SQL)
def x15(spark, sf_dir):
    h = X.html_info(tc.table(spark, sf_dir, "pages"))
    return h.select("page_id", "text", "html_title", F.size(F.map_keys("meta_tags")).alias("n_meta"),
                    "link_count", "image_count", "heading_count")


# ----------------------------------------------------------------------------- X17-X21
X17_SQL = """WITH p AS (SELECT n_nationkey, replace(replace(lower(n_name) || '_nation-file', '_', ' '), '-', ' ') AS s FROM nation)
SELECT n_nationkey, array_to_string(list_transform(string_split(s, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM p"""


@register("x17_title_from_file_name", X17_SQL)
def x17(spark, sf_dir):
    n = tc.table(spark, sf_dir, "nation")
    path = F.concat(F.lit("/docs/"), F.lower("n_name"), F.lit("_nation-file.md"))
    return n.select("n_nationkey", T.title_from_stem(path).alias("title"))


X18_SQL = f"""WITH {MD_CTE}, {PY_CTE}
SELECT 'markdown' AS format, doc_id,
  array_to_string(list_transform({_rx('content', X.RX_HEADER, 2)}, lambda t: {_strip('t')})[1:20], '|') AS keywords FROM md
UNION ALL
SELECT 'code', doc_id, array_to_string(list_concat({_rx('content', X.RX_DEF, 1)}[1:20][1:10],
  {_rx('content', X.RX_CLASS, 1)}[1:20][1:10]), '|') FROM py"""


@register("x18_keywords", X18_SQL)
def x18(spark, sf_dir):
    md = md_frame(spark, sf_dir).select("doc_id", F.lit("markdown").alias("format"),
                                         X.headers(F.col("content")).alias("h"),
                                         F.array().cast("array<string>").alias("fn"),
                                         F.array().cast("array<string>").alias("cl"))
    py = X.python_info(py_frame(spark, sf_dir)).select(
        "doc_id", F.lit("code").alias("format"),
        F.array().cast(md.schema["h"].dataType).alias("h"), F.col("functions").alias("fn"), F.col("classes").alias("cl"))
    u = md.unionByName(py)
    return u.select("format", "doc_id", F.array_join(X.keywords(F.col("format"), F.col("h"), F.col("fn"), F.col("cl")),
                                                     "|").alias("keywords"))


@register("x19_snippet", f"SELECT doc_id, {Q.snippet('text')} AS snippet FROM documents")
def x19(spark, sf_dir):
    d = tc.table(spark, sf_dir, "documents")
    return d.select("doc_id", T.snippet("text").alias("snippet"))


@register("x20_year_month_facets", f"WITH {Q.DOCS_BASE} SELECT CAST(year(created_at) AS INTEGER) AS year, "
          "CAST(month(created_at) AS INTEGER) AS month, count(*) AS count FROM docs_b GROUP BY ALL")
def x20(spark, sf_dir):
    d = X.date_facets(tc.documents(spark, sf_dir, with_labels=False))
    return d.groupBy("year", "month").agg(F.count(F.lit(1)).alias("count"))


_AGE = f"((CAST(epoch(TIMESTAMP '{C.TEST_AS_OF}') AS BIGINT) - CAST(epoch(modified_at) AS BIGINT)) // 60)"
_UNIT = "regexp_replace(printf('%.2f', floor(size * 100 / {d} + 0.5) / 100), '\\.?0+$', '') || ' {u}'"
_AGO = "CAST(CAST({n} AS BIGINT) AS VARCHAR) || ' {u}' || CASE WHEN {n} > 1 THEN 's' ELSE '' END || ' ago'"
X21_SQL = f"""WITH {Q.DOCS_BASE}
SELECT doc_id,
  CASE WHEN size < 1024 THEN CAST(size AS VARCHAR) || ' Bytes' WHEN size < 1048576 THEN {_UNIT.format(d='1024.0', u='KB')}
       WHEN size < 1073741824 THEN {_UNIT.format(d='1048576.0', u='MB')} ELSE {_UNIT.format(d='1073741824.0', u='GB')} END AS size_label,
  CASE WHEN {_AGE} < 1 THEN 'Just now' WHEN {_AGE} < 60 THEN {_AGO.format(n=_AGE, u='minute')}
       WHEN {_AGE} < 1440 THEN {_AGO.format(n=f"({_AGE} // 60)", u='hour')} WHEN {_AGE} < 11520 THEN {_AGO.format(n=f"({_AGE} // 1440)", u='day')}
       ELSE month(modified_at) || '/' || day(modified_at) || '/' || year(modified_at) END AS age_label
FROM docs_b"""


@register("x21_display_labels", X21_SQL)
def x21(spark, sf_dir):
    d = tc.documents(spark, sf_dir, with_labels=False)
    return d.select("doc_id", T.size_label("size").alias("size_label"),
                    T.age_label(F.col("modified_at"), T.ntz(C.TEST_AS_OF)).alias("age_label"))
