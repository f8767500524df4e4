"""Per-format extraction as columnar jobs.

Input rows carry (doc_id, path, content); every extractor adds typed
columns with JVM regular expressions (`regexp_extract_all`, `transform`,
`filter`), never a Python function per row. Patterns follow the Java regex
dialect; where the DuckDB oracle (RE2) lacks a feature the plan says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio import constants as C
from folio.functions.text import html_to_text, slug, title_from_stem

# --- fixed values: patterns ----------------------------------------------------
RX_HEADER = r"(?m)^(#{1,6})\s+(.+)$"
RX_H1 = r"(?m)^#\s+(.+)$"
RX_LINK = r"(?<!!)\[([^\]]+)\]\(([^)]+)\)"
RX_LINK_ANY = r"\[([^\]]+)\]\(([^)]+)\)"
RX_IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"
RX_REF_LINK = r"(?m)^\[([^\]]+)\]:\s+(.+)$"
RX_URL = r"https?://[^\s<>\"{}|\\^`\[\]]+"
RX_FRONT_MATTER = r"(?s)^---(.*?)\n---\n"
RX_FRONT_MATTER_STRIP = r"(?s)^---\n.*?\n---\n"
RX_FM_PAIR = r"(?m)^([A-Za-z_][A-Za-z0-9_-]*):[ \t]*(.*?)[ \t]*$"
RX_FENCE = r"(?s)```(\w+)?\n(.*?)\n```"
RX_FENCE_ANY = r"(?s)```.*?```"
RX_YAML_KEY = r"(?m)^([A-Za-z_][A-Za-z0-9_.-]*)[ \t]*:"
RX_IMPORT = r"(?m)^[ \t]*((?:import|from) .*?)[ \t]*$"
RX_CLASS = r"(?m)^\s*class\s+(\w+)"
RX_DEF = r"(?m)^\s*def\s+(\w+)"
RX_DOC_DQ = r"(?s)^\s*\"\"\"(.*?)\"\"\""
RX_DOC_SQ = r"(?s)^\s*'''(.*?)'''"
RX_HTML_TITLE = r"(?is)<title[^>]*>(.*?)</title>"
RX_HTML_H1 = r"(?is)<h1[^>]*>(.*?)</h1>"
RX_META_TAG = r"""(?is)<meta(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
RX_ATTRIBUTE = r"""([^\s"'<>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
RX_A = r"(?i)<a[\s>]"
RX_IMG = r"(?i)<img[\s>/]"
RX_HEADING = r"(?i)<h[1-6][\s>]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(c) -> Column:
    """Python-style strip(): all leading/trailing whitespace."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def _count(c, rx: str) -> Column:
    return F.size(F.regexp_extract_all(_c(c), F.lit(rx), 0))


# ----------------------------------------------------------------------------- X1
def line_count(c) -> Column:
    """`splitlines()` length for '\\n' text: a trailing newline adds no line."""
    c = _c(c)
    n = F.size(F.split(c, "\n"))
    return (F.when(c == "", 0).when(c.endswith("\n"), n - 1).otherwise(n)).cast("int")


def word_count(c) -> Column:
    return _count(c, r"\S+").cast("int")


def text_stats(df: DataFrame, col: str = "content") -> DataFrame:
    """Line, word and char counts."""
    return df.withColumn("line_count", line_count(col)).withColumn("word_count", word_count(col)) \
        .withColumn("char_count", F.char_length(col).cast("int"))


# ----------------------------------------------------------------------------- X2-X10
def headers(c) -> Column:
    """array<struct<level int, text string>>."""
    marks = F.regexp_extract_all(_c(c), F.lit(RX_HEADER), 1)
    texts = F.regexp_extract_all(_c(c), F.lit(RX_HEADER), 2)
    return F.transform(F.arrays_zip(marks.alias("m"), texts.alias("t")),
                       lambda z: F.struct(F.char_length(z["m"]).cast("int").alias("level"),
                                          strip_ws(z["t"]).alias("text")))


def links(c) -> Column:
    """X3 (D17): inline links not preceded by '!': array<struct<text, url>>."""
    t = F.regexp_extract_all(_c(c), F.lit(RX_LINK), 1)
    u = F.regexp_extract_all(_c(c), F.lit(RX_LINK), 2)
    return F.transform(F.arrays_zip(t.alias("t"), u.alias("u")),
                       lambda z: F.struct(z["t"].alias("text"), z["u"].alias("url")))


def images(c) -> Column:
    """array<struct<alt, url>>."""
    a = F.regexp_extract_all(_c(c), F.lit(RX_IMAGE), 1)
    u = F.regexp_extract_all(_c(c), F.lit(RX_IMAGE), 2)
    return F.transform(F.arrays_zip(a.alias("a"), u.alias("u")),
                       lambda z: F.struct(z["a"].alias("alt"), z["u"].alias("url")))


def _last_wins(keys: Column, vals: Column) -> Column:
    """A map in which the last of equal keys counts. The pairs are bound once
    (a one-element transform), so the patterns behind them run once a row."""
    def keep(pairs):
        return F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda x: x["k"] == e["k"]))
    zipped = F.arrays_zip(keys.alias("k"), vals.alias("v"))
    return F.map_from_entries(F.element_at(F.transform(F.array(zipped), keep), 1))


def front_matter(c) -> Column:
    """Flat `key: value` lines of a leading --- block as map<string,string>
    (nested YAML is not parsed); null when there is no block."""
    block = F.regexp_extract(_c(c), RX_FRONT_MATTER, 1)
    has = _c(c).rlike(RX_FRONT_MATTER)
    keys = F.regexp_extract_all(block, F.lit(RX_FM_PAIR), 1)
    vals = F.regexp_extract_all(block, F.lit(RX_FM_PAIR), 2)
    return F.when(has, _last_wins(keys, vals))


def strip_front_matter(c) -> Column:
    return F.regexp_replace(_c(c), RX_FRONT_MATTER_STRIP, "")


def markdown_title(content, path) -> Column:
    """First H1, else front-matter title, else the file-stem title."""
    h1 = strip_ws(F.regexp_extract(_c(content), RX_H1, 1))
    fm = front_matter(content)
    return F.coalesce(F.nullif(h1, F.lit("")), F.element_at(fm, F.lit("title")), title_from_stem(path))


def toc(c) -> Column:
    """Headers with slug anchors: array<struct<level, title, anchor>>."""
    return F.transform(headers(c), lambda h: F.struct(h["level"].alias("level"), h["text"].alias("title"),
                                                      slug(h["text"]).alias("anchor")))


def all_links(c) -> Column:
    """Inline + reference + bare URLs, distinct and sorted."""
    inline = F.regexp_extract_all(_c(c), F.lit(RX_LINK_ANY), 2)
    ref = F.regexp_extract_all(_c(c), F.lit(RX_REF_LINK), 2)
    bare = F.regexp_extract_all(_c(c), F.lit(RX_URL), 0)
    return F.array_sort(F.array_distinct(F.concat(inline, ref, bare)))


def external_links(c) -> Column:
    return F.filter(all_links(c), lambda x: x.startswith("http"))


def internal_links(c) -> Column:
    return F.filter(all_links(c), lambda x: ~x.startswith("http"))


def code_blocks(c) -> Column:
    """array<struct<language, code, lines>>; language defaults to 'plain'."""
    lang = F.regexp_extract_all(_c(c), F.lit(RX_FENCE), 1)
    code = F.regexp_extract_all(_c(c), F.lit(RX_FENCE), 2)
    return F.transform(F.arrays_zip(lang.alias("l"), code.alias("c")),
                       lambda z: F.struct(F.coalesce(F.nullif(z["l"], F.lit("")), F.lit("plain")).alias("language"),
                                          z["c"].alias("code"), line_count(z["c"]).alias("lines")))


def code_languages(c) -> Column:
    return F.array_sort(F.array_distinct(F.transform(code_blocks(c), lambda b: b["language"])))


def reading_time(c) -> Column:
    """max(1, round-half-even(words outside fences / 225))."""
    words = word_count(F.regexp_replace(_c(c), RX_FENCE_ANY, ""))
    return F.greatest(F.lit(1), F.bround(words / F.lit(C.READING_WPM), 0).cast("int"))


def extract_markdown(df: DataFrame, col: str = "content", path: str = "path") -> DataFrame:
    """X2-X10 in one projection."""
    c = F.col(col)
    return df.select("*", headers(c).alias("headers"), links(c).alias("links"), images(c).alias("images"),
                     front_matter(c).alias("frontmatter"), markdown_title(c, F.col(path)).alias("md_title"),
                     toc(c).alias("toc"), all_links(c).alias("all_links"), code_blocks(c).alias("code_blocks"),
                     reading_time(c).alias("reading_time"))


# ----------------------------------------------------------------------------- X11-X14
def json_info(df: DataFrame, col: str = "content") -> DataFrame:
    """X11: valid flag, first 20 keys and key count of an object, length of an
    array; malformed input stays as text with valid = false."""
    c = F.col(col)
    valid = F.try_parse_json(c).isNotNull()
    first = F.regexp_extract(c, r"^\s*(\S)", 1)
    keys = F.when(valid & (first == "{"), F.json_object_keys(c))
    return df.select("*", valid.alias("valid"), F.slice(keys, 1, 20).alias("keys"),
                     F.when(keys.isNotNull(), F.size(keys)).alias("key_count"),
                     F.when(valid & (first == "["), F.json_array_length(c)).alias("array_length"))


def yaml_info(df: DataFrame, col: str = "content") -> DataFrame:
    """Top-level keys of block mappings (column-0 `key:` lines), first 20, count."""
    keys = F.regexp_extract_all(F.col(col), F.lit(RX_YAML_KEY), 1)
    return df.select("*", F.slice(keys, 1, 20).alias("keys"), F.size(keys).alias("key_count"))


def python_docstring(c) -> Column:
    """Leading triple-quoted string (double quotes first), stripped, <= 500 chars."""
    raw = (F.when(_c(c).rlike(RX_DOC_DQ), F.regexp_extract(_c(c), RX_DOC_DQ, 1))
           .when(_c(c).rlike(RX_DOC_SQ), F.regexp_extract(_c(c), RX_DOC_SQ, 1)))
    return F.substring(strip_ws(raw), 1, 500)


def python_title(content, path) -> Column:
    """First docstring line when shorter than 100 chars, else the
    file-stem title."""
    c = _c(content)
    first = F.split_part(strip_ws(F.regexp_extract(c, RX_DOC_DQ, 1)), F.lit("\n"), F.lit(1))
    first = F.when(c.rlike(RX_DOC_DQ), first).otherwise(
        F.split_part(strip_ws(F.regexp_extract(c, RX_DOC_SQ, 1)), F.lit("\n"), F.lit(1)))
    has_doc = c.rlike(RX_DOC_DQ) | c.rlike(RX_DOC_SQ)
    return F.when(has_doc & (first != "") & (F.char_length(first) < 100), first).otherwise(title_from_stem(_c(path)))


def python_names(c, rx: str) -> Column:
    """First 20 names or lines that a pattern finds in the source."""
    return F.slice(F.regexp_extract_all(_c(c), F.lit(rx), 1), 1, 20)


def python_info(df: DataFrame, col: str = "content", path: str = "path") -> DataFrame:
    """Line count, first 20 imports, classes, functions (regex on
    source lines: `async def` excluded, order is textual), docstring (<= 500
    chars) and the title."""
    c = F.col(col)
    return df.select("*", line_count(c).alias("line_count"),
                     python_names(c, RX_IMPORT).alias("imports"),
                     python_names(c, RX_CLASS).alias("classes"),
                     python_names(c, RX_DEF).alias("functions"),
                     python_docstring(c).alias("docstring"), python_title(c, F.col(path)).alias("py_title"))


# ----------------------------------------------------------------------------- X15-X16
def html_title(html) -> Column:
    """<title> text, else the first <h1>, else null."""
    h = _c(html)
    title, h1 = (html_to_text(F.regexp_extract(h, rx, 1)) for rx in (RX_HTML_TITLE, RX_HTML_H1))
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(h1, F.lit("")))


def meta_tags(html) -> Column:
    """Map of meta name (else property) -> content, attributes in any order
    and quoting; a tag without content maps to '', the last of equal names counts."""
    def attributes(tag):
        keys = F.transform(F.regexp_extract_all(tag, F.lit(RX_ATTRIBUTE), 1), F.lower)
        vals = F.transform(F.regexp_extract_all(tag, F.lit(RX_ATTRIBUTE), 2),
                           lambda v: F.regexp_replace(v, r"""(?s)^(["'])(.*)\1$""", "$2"))
        return _last_wins(keys, vals)

    def entry(m):
        name = F.coalesce(*[F.nullif(F.element_at(m, F.lit(a)), F.lit("")) for a in ("name", "property")])
        return F.struct(name.alias("k"), F.coalesce(F.element_at(m, F.lit("content")), F.lit("")).alias("v"))

    tags = F.transform(F.regexp_extract_all(_c(html), F.lit(RX_META_TAG), 0), attributes)
    named = F.filter(F.transform(tags, entry), lambda e: e["k"].isNotNull())
    return _last_wins(F.transform(named, lambda e: e["k"]), F.transform(named, lambda e: e["v"]))


def html_info(df: DataFrame, col: str = "html") -> DataFrame:
    """Text without script/style/tags, <title> (else <h1>) text,
    meta name/property -> content map, link / image / heading counts."""
    h = F.col(col)
    return df.select("*", html_to_text(h).alias("text"), html_title(h).alias("html_title"),
                     meta_tags(h).alias("meta_tags"),
                     _count(h, RX_A).cast("int").alias("link_count"),
                     _count(h, RX_IMG).cast("int").alias("image_count"),
                     _count(h, RX_HEADING).cast("int").alias("heading_count"))


# ----------------------------------------------------------------------------- X17-X21
def keywords(fmt, md_headers, functions, classes) -> Column:
    """Up to 20 header texts (markdown) or 10 functions + 10 classes (code)."""
    hdr = F.slice(F.transform(md_headers, lambda x: x["text"]), 1, 20)
    code = F.concat(F.slice(functions, 1, 10), F.slice(classes, 1, 10))
    return (F.when(_c(fmt) == "markdown", hdr).when(_c(fmt) == "code", code)
            .otherwise(F.array().cast("array<string>")))


def date_facets(df: DataFrame, col: str = "created_at") -> DataFrame:
    """Year and month facet columns."""
    return df.withColumn("year", F.year(col)).withColumn("month", F.month(col))


def by_format(fmt, raw, path) -> dict[str, Column]:
    """U2, built in: title (X6, X14, X16, else X17), text (X15 for HTML, else
    as read) and keywords (X18) of a file by its format."""
    f, c = _c(fmt), _c(raw)
    title = (F.when(f == "markdown", markdown_title(c, _c(path))).when(f == "code", python_title(c, path))
             .when(f == "html", F.coalesce(html_title(c), title_from_stem(_c(path)))).otherwise(title_from_stem(_c(path))))
    return {"title": title, "content": F.when(f == "html", html_to_text(c)).otherwise(c),
            "keywords": keywords(f, headers(c), python_names(c, RX_DEF), python_names(c, RX_CLASS))}
