"""Column-expression helpers (all JVM built-ins, no Python per row)."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from folio import constants as C


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stop_array() -> Column:
    return F.array(*[F.lit(w) for w in C.STOP_WORDS])


def analyze(text, stop: bool = True) -> Column:
    """Tokenise, lower-case, drop short tokens and stop words (order kept).

    Tokens are maximal runs of the token class; requiring at least
    MIN_TOKEN_LEN characters inside the pattern drops short runs during the
    regex scan, and the stop filter is a hash-set membership test (InSet)."""
    low = F.lower(_c(text))
    if not stop:
        return F.regexp_extract_all(low, F.lit(C.TOKEN_PATTERN), 0)
    rx = C.TOKEN_PATTERN[:-1] + "{" + str(C.MIN_TOKEN_LEN) + ",}"  # [class]+ -> [class]{2,}
    stops = [w for w in C.STOP_WORDS if len(w) >= C.MIN_TOKEN_LEN]
    toks = F.regexp_extract_all(low, F.lit(rx), 0)
    return F.filter(toks, lambda t: ~t.isin(*stops))


def analyze_keywords(value) -> Column:
    """Keyword field: lower-cased, comma-split, trimmed, empties dropped."""
    v = _c(value)
    parts = F.split(F.lower(v), ",")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def snippet(content, length: int = C.SNIPPET_LENGTH) -> Column:
    """First `length` chars, cut at the last space when it lies past 80 %."""
    c = F.coalesce(_c(content), F.lit(""))
    head = F.substring(c, 1, length)
    p = F.locate(" ", F.reverse(head))  # 1-based position from the end, 0 = none
    cut = F.when((p > 0) & ((F.lit(length) - p) > F.lit(length * C.SNIPPET_CUT_RATIO)),
                 F.substring(head, 1, F.lit(length) - p)).otherwise(head)
    return F.when(F.char_length(c) <= length, c).otherwise(F.concat(cut, F.lit("...")))


def file_stem(path) -> Column:
    name = F.regexp_extract(_c(path), r"([^/]*)$", 1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def file_extension(path) -> Column:
    """Lower-case extension with the dot, '' when none."""
    name = F.regexp_extract(_c(path), r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))


def title_from_stem(path) -> Column:
    """Stem, `_`/`-` -> space, title case (initcap; differs from Python
    `.title()` after apostrophes and digits)."""
    return F.initcap(F.translate(file_stem(path), "_-", "  "))


def format_of(path, extra: dict | None = None) -> Column:
    """Format by extension, else 'unknown'."""
    mapping = dict(C.EXTENSION_FORMATS)
    if extra:
        mapping.update(extra)
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, file_extension(path)), F.lit("unknown"))


def upload_format(path) -> Column:
    """S4 for uploads: their own nine extensions, else 'unknown'."""
    m = F.create_map(*[F.lit(x) for kv in C.UPLOAD_EXTENSION_FORMATS.items() for x in kv])
    return F.coalesce(F.element_at(m, file_extension(path)), F.lit("unknown"))


def html_escape(col) -> Column:
    c = _c(col)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_to_text(html) -> Column:
    """Drop script/style, strip tags, decode common entities, collapse
    whitespace runs to one space, trim."""
    h = _c(html)
    h = F.regexp_replace(h, r"(?is)<script\b[^>]*>.*?</script\s*>", " ")
    h = F.regexp_replace(h, r"(?is)<style\b[^>]*>.*?</style\s*>", " ")
    h = F.regexp_replace(h, r"(?s)<!--.*?-->", " ")
    h = F.regexp_replace(h, r"<[^>]*>", " ")
    for a, b in C.HTML_ENTITIES:
        h = F.replace(h, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(h, r"\s+", " "))


def slug(text) -> Column:
    """X7 anchor: lower, drop non-word chars except space and '-', spaces -> '-'."""
    t = F.regexp_replace(F.lower(F.trim(_c(text))), r"[^\p{L}\p{N}_\s-]", "")
    return F.regexp_replace(t, r"\s+", "-")


def size_label(size) -> Column:
    """Bytes / KB / MB / GB with up to two decimals, no trailing zeros."""
    s = _c(size).cast("double")
    unit = lambda n, name: F.concat(F.regexp_replace(F.format_string("%.2f", F.floor(s * 100 / 1024.0 ** n + 0.5) / 100), r"\.?0+$", ""), F.lit(name))
    return (F.when(s < 1024, F.concat(s.cast("long").cast("string"), F.lit(" Bytes")))
            .when(s < 1024 ** 2, unit(1, " KB")).when(s < 1024 ** 3, unit(2, " MB")).otherwise(unit(3, " GB")))


def age_label(ts, as_of) -> Column:
    """X21: 'Just now', whole minutes, hours or days ago relative to an explicit
    as_of; a date beyond seven days."""
    mins = F.floor(F.timestamp_diff("SECOND", _c(ts), _c(as_of)) / 60)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, F.lit("s")).otherwise(F.lit("")), F.lit(" ago"))
    return (F.when(mins < 1, F.lit("Just now")).when(mins < 60, ago(mins, "minute")).when(mins < 1440, ago(F.floor(mins / 60), "hour"))
            .when(mins < 8 * 1440, ago(F.floor(mins / 1440), "day")).otherwise(F.date_format(_c(ts), "M/d/yyyy")))


def ntz(ts: str) -> Column:
    """A TIMESTAMP_NTZ literal."""
    return F.to_timestamp_ntz(F.lit(ts))


def as_ts(v) -> Column:
    """An explicit `as_of` (ISO string, datetime or Column) as TIMESTAMP_NTZ."""
    if isinstance(v, Column):
        return v
    if isinstance(v, str):
        return F.lit(v).cast("timestamp_ntz")
    return F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")
