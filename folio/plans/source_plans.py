"""Registered scan queries (S2-S12) over a file listing derived from the
`documents` table: (path, modificationTime, length, content bytes), the
shape of Spark's binaryFile source. Some derived paths fall under ignore
globs, and some files end in two bytes that are not UTF-8."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio import constants as C
from folio.plans import sql as Q
from folio.plans.registry import register
from folio.session import scratch_path
from folio.sources import files as S
from folio.sources import folders
from folio.sources import testcorpus as tc


def listing(spark, sf_dir):
    d = tc.documents(spark, sf_dir, with_labels=False)
    v = F.col("doc_id") % 9
    sid = F.col("doc_id").cast("string")
    path = (F.when(v == 0, F.concat(F.lit("/"), F.col("source"), F.lit("/.cache/"), sid, F.lit(".txt")))
            .when(v == 1, F.concat(F.lit("/"), F.col("source"), F.lit("/build/"), sid, F.lit(".tmp")))
            .when(v == 2, F.concat(F.lit("/"), F.col("source"), F.lit("/__pycache__/"), sid, F.lit(".pyc")))
            .otherwise(F.col("path")))
    body = F.encode(F.col("content"), "UTF-8")
    content = F.when(F.col("doc_id") % 7 == 3, F.concat(body, F.unhex(F.lit("8081")))).otherwise(body)
    return d.select("doc_id", path.alias("path"), F.col("modified_at").alias("modificationTime"),
                    F.octet_length(content).cast("long").alias("length"), content.alias("content"),
                    "category", "lang")


LISTING_CTE = f"""{Q.DOCS_BASE},
listing AS (
  SELECT doc_id,
         CASE doc_id % 9 WHEN 0 THEN '/' || source || '/.cache/' || CAST(doc_id AS VARCHAR) || '.txt'
                         WHEN 1 THEN '/' || source || '/build/' || CAST(doc_id AS VARCHAR) || '.tmp'
                         WHEN 2 THEN '/' || source || '/__pycache__/' || CAST(doc_id AS VARCHAR) || '.pyc'
                         ELSE path END AS path,
         modified_at AS mtime, content AS text, doc_id % 7 = 3 AS bad,
         CASE WHEN doc_id % 7 = 3 THEN encode(content) || '\\x80\\x81'::BLOB ELSE encode(content) END AS bytes,
         category, lang
  FROM docs_b)"""

_RX, _RX_PATH = S.ignore_regex(), S.ignore_regex(across=True)
_IGN = (f"(len(list_filter(string_split(path, '/'), lambda s: regexp_full_match(s, '{_RX}'))) > 0 "
        f"OR regexp_full_match(regexp_replace(path, '^/+', ''), '{_RX_PATH}') "
        f"OR regexp_full_match('/' || regexp_replace(path, '^/+', ''), '{_RX_PATH}'))")
_EXT = "lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '(\\.[^.]+)$', 1))"
_FMT = "CASE " + " ".join(f"WHEN {_EXT} = '{k}' THEN '{v}'" for k, v in C.EXTENSION_FORMATS.items()) + " ELSE 'unknown' END"
_STRICT_FAIL = f"(bad AND {_FMT} NOT IN ('text', 'html'))"


def _kept(spark, sf_dir):
    ls = listing(spark, sf_dir)
    return ls.filter(~S.ignored(F.col("path")))


@register("s2_ignore_globs", f"WITH {LISTING_CTE} SELECT doc_id, path FROM listing WHERE NOT {_IGN}")
def s2(spark, sf_dir):
    return _kept(spark, sf_dir).select("doc_id", "path")


@register("s3_extension_allow_list", f"WITH {LISTING_CTE} SELECT doc_id, path FROM listing "
          f"WHERE NOT {_IGN} AND {_EXT} IN ('.md', '.txt', '.py')")
def s3(spark, sf_dir):
    k = _kept(spark, sf_dir)
    return k.filter(S.extension_allowed(F.col("path"), ["md", ".TXT", "Py"])).select("doc_id", "path")


@register("s4_format_detection", f"WITH {LISTING_CTE} SELECT doc_id, {_FMT} AS format FROM listing")
def s4(spark, sf_dir):
    return S.identify(listing(spark, sf_dir)).select("doc_id", "format")


@register("s4_upload_formats", f"WITH {LISTING_CTE} SELECT doc_id, CASE {_EXT} WHEN '.md' THEN 'markdown' WHEN '.txt' THEN 'text' WHEN '.json' THEN 'json' "
          "WHEN '.yaml' THEN 'yaml' WHEN '.yml' THEN 'yaml' WHEN '.py' THEN 'code' WHEN '.js' THEN 'code' WHEN '.html' THEN 'html' WHEN '.htm' THEN 'html' "
          "ELSE 'unknown' END AS format FROM listing")
def s4u(spark, sf_dir):
    from folio.functions.text import upload_format
    return listing(spark, sf_dir).select("doc_id", upload_format("path").alias("format"))


@register("s5_incremental", f"WITH {LISTING_CTE} SELECT doc_id, path FROM listing "
          "WHERE NOT " + _IGN + " AND mtime > TIMESTAMP '2024-02-10 00:00:00'")
def s5(spark, sf_dir):
    k = _kept(spark, sf_dir)
    return k.filter(F.col("modificationTime") > F.lit("2024-02-10 00:00:00").cast("timestamp_ntz")) \
        .select("doc_id", "path")


@register("s5_modified_after", f"WITH {LISTING_CTE} SELECT path, CAST(octet_length(bytes) AS BIGINT) AS length FROM listing WHERE doc_id % 3 = 1")
def s5_listing(spark, sf_dir):
    """Files written after the last of an earlier scan, from a listing of the folder."""
    import time

    root, files = scratch_path(spark, "s5-tree"), listing(spark, sf_dir).select("doc_id", "path", "content")
    folders.write_files(files.filter("doc_id % 3 <> 1"), root)
    before = S.list_files(spark, root, with_content=False, ignore=()).agg(F.max("modificationTime").cast("string")).first()[0]
    time.sleep(0.05)  # file times are no finer than this everywhere
    folders.write_files(files.filter("doc_id % 3 = 1"), root)
    late = S.list_files(spark, root, with_content=False, modified_after=before, ignore=())
    return late.select(_below(root).alias("path"), "length")


@register("s6_identity_columns", f"WITH {LISTING_CTE} SELECT doc_id, md5(path) AS id, sha256(bytes) AS content_hash, "
          "CAST(octet_length(bytes) AS BIGINT) AS size, mtime AS modified_at FROM listing")
def s6(spark, sf_dir):
    return S.identify(listing(spark, sf_dir)).select("doc_id", "id", "content_hash", "size", "modified_at")


@register("s7_failed_files", f"WITH {LISTING_CTE} SELECT doc_id, path, 'invalid UTF-8' AS error FROM listing "
          f"WHERE NOT {_IGN} AND {_STRICT_FAIL}")
def s7(spark, sf_dir):
    dec = S.decode(S.identify(_kept(spark, sf_dir)))
    _, failed = S.split_failed(dec)
    return failed.select("doc_id", "path", "error")


@register("s8_scan_summary", f"WITH {LISTING_CTE} SELECT count(*) FILTER (WHERE NOT {_IGN}) AS total, "
          f"count(*) FILTER (WHERE NOT {_IGN} AND NOT {_STRICT_FAIL}) AS successful, "
          f"count(*) FILTER (WHERE NOT {_IGN} AND {_STRICT_FAIL}) AS failed, "
          f"count(*) FILTER (WHERE {_IGN}) AS skipped FROM listing")
def s8(spark, sf_dir):
    ls = listing(spark, sf_dir)
    ign = S.ignored(F.col("path"))
    dec = S.decode(S.identify(ls.filter(~ign)))
    return S.scan_summary(dec, ls.filter(ign))


@register("s8_format_counts", f"WITH {LISTING_CTE} SELECT {_FMT} AS format, count(*) AS count FROM listing "
          f"WHERE NOT {_IGN} GROUP BY ALL")
def s8f(spark, sf_dir):
    return S.format_counts(S.identify(_kept(spark, sf_dir)))


@register("s10_scan_defaults", f"WITH {LISTING_CTE} SELECT doc_id, CASE WHEN lang = 'es' THEN 'inbox' ELSE category END AS category, "
          "array_to_string(['scanned', 'batch-1'], ',') AS tags FROM listing WHERE NOT " + _IGN)
def s10(spark, sf_dir):
    k = _kept(spark, sf_dir).withColumn("category", F.when(F.col("lang") == "es", F.lit(None)).otherwise(F.col("category")))
    d = S.apply_defaults(k.select("doc_id", "category"), category="inbox", tags=["scanned", "batch-1"])
    return d.select("doc_id", "category", F.array_join("tags", ",").alias("tags"))


S11_SQL = f"""WITH {Q.DOCS_BASE},
c AS (SELECT string_split(lower(regexp_replace(path, '^/+', '')), '/') AS parts FROM docs_b),
d AS (SELECT parts[1:len(parts) - 1] AS comps FROM c),
e AS (SELECT unnest(range(1, least(len(comps), 2) + 1)) AS depth, comps FROM d)
SELECT CAST(depth AS INTEGER) AS depth, array_to_string(comps[1:depth], '/') AS prefix, count(*) AS count FROM e GROUP BY ALL"""


@register("s11_path_prefix_facets", S11_SQL)
def s11(spark, sf_dir):
    return S.prefix_facets(tc.documents(spark, sf_dir, with_labels=False), depth=2)


@register("s12_decode_policy", f"WITH {LISTING_CTE} SELECT doc_id, {_FMT} AS format, "
          f"CASE WHEN {_STRICT_FAIL} THEN 0 ELSE CAST(length(text) AS INTEGER) END AS chars, "
          f"CASE WHEN {_STRICT_FAIL} THEN 'failed' ELSE 'indexed' END AS status FROM listing WHERE NOT {_IGN}")
def s12(spark, sf_dir):
    dec = S.decode(S.identify(_kept(spark, sf_dir)))
    return dec.select("doc_id", "format", F.char_length("text").cast("int").alias("chars"), "status")


# ----------------------------------------------------------------------------- S1 / S9 / E1 over written files
def written_tree(spark, sf_dir) -> str:
    """The listing's files written below a new folder; every eleventh name starts with '_'."""
    root = scratch_path(spark, "tree")
    named = F.when(F.col("doc_id") % 11 == 5, F.regexp_replace("path", "/([^/]*)$", "/_$1")).otherwise(F.col("path"))
    folders.write_files(listing(spark, sf_dir).select(named.alias("path"), "content"), root)
    return root


TREE_CTE = f"""{LISTING_CTE},
tree AS (SELECT doc_id, CASE WHEN doc_id % 11 = 5 THEN regexp_replace(path, '/([^/]*)$', '/_\\1') ELSE path END AS path,
                CAST(octet_length(bytes) AS BIGINT) AS length, source, split_part(path, '/', 3) AS sub
         FROM listing JOIN (SELECT doc_id AS d, source FROM documents) s ON s.d = doc_id)"""


def _below(root):
    return F.substring_index("path", root.rstrip("/").split("/")[-1], -1)


@register("s1_recursive_listing", f"WITH {TREE_CTE} SELECT path, length FROM tree WHERE NOT {_IGN}")
def s1(spark, sf_dir):
    """Recursive listing of files written from the documents, over a root and a root inside it."""
    root = written_tree(spark, sf_dir)
    source = tc.table(spark, sf_dir, "documents").agg(F.min("source")).first()[0]
    ls = S.list_files(spark, [root, f"{root}/{source}"], with_content=False, ignore=C.DEFAULT_IGNORE)
    return ls.select(_below(root).alias("path"), "length")


@register("s1_s9_dry_run_listing", f"WITH {TREE_CTE} SELECT path, length FROM tree "
          "WHERE sub IN ('en', 'fr', '.cache') AND sub <> '.cache' AND NOT contains(path, '/fr/_1') AND NOT contains(path, '.yaml')")
def s1_s9(spark, sf_dir):
    """Flat dry run over several folders with substring excludes; no file is opened."""
    root = written_tree(spark, sf_dir)
    sources = [r[0] for r in tc.table(spark, sf_dir, "documents").select("source").distinct().filter("source is not null").collect()]
    roots = [f"{root}/{s}/{lang}" for s in sources for lang in ("en", "fr", "missing")]
    ls = S.list_files(spark, roots, recursive=False, with_content=False, excludes=["/fr/_1", ".yaml"])
    return ls.select(_below(root).alias("path"), "length")


E1_SQL = f"""WITH {Q.DOCS_BASE},
d AS (SELECT doc_id, path, content, content || '!' AS longer FROM docs_b)
SELECT 1 AS version, path, 'added' AS change, CAST(octet_length(encode(content)) AS BIGINT) AS size, sha256(content) AS content_hash FROM d WHERE doc_id % 4 <> 3
UNION ALL SELECT 2, path, 'modified', CAST(octet_length(encode(longer)) AS BIGINT), sha256(longer) FROM d WHERE doc_id % 4 = 1
UNION ALL SELECT 2, path, 'deleted', NULL, NULL FROM d WHERE doc_id % 4 = 2
UNION ALL SELECT 2, path, 'added', CAST(octet_length(encode(content)) AS BIGINT), sha256(content) FROM d WHERE doc_id % 4 = 3
UNION ALL SELECT 3, path, 'deleted', NULL, NULL FROM d WHERE doc_id % 8 = 3
UNION ALL SELECT 3, path, 'added', CAST(octet_length(encode(content)) AS BIGINT), sha256(content) FROM d WHERE doc_id % 8 = 2"""


@register("e1_watch_directory", E1_SQL)
def e1(spark, sf_dir):
    """Three versions of a folder written from the documents, polled, and their changes streamed as documents."""
    from folio.streaming import stream_ops as E

    root, base = scratch_path(spark, "watched"), scratch_path(spark, "e1-watch")
    d = tc.documents(spark, sf_dir, with_labels=False).select("doc_id", "path", F.encode("content", "UTF-8").alias("content"))
    m = F.col("doc_id") % 4
    longer = d.withColumn("content", F.concat("content", F.lit(b"!")))
    steps = [[(folders.write_files, d.filter(m != 3))],
             [(folders.write_files, longer.filter(m == 1)), (folders.delete_files, d.filter(m == 2)), (folders.write_files, d.filter(m == 3))],
             [(folders.delete_files, d.filter("doc_id % 8 = 3")), (folders.write_files, d.filter("doc_id % 8 = 2"))]]
    watch = folders.FolderWatch(spark, root, f"{base}/versions")
    for step in steps:
        for change, rows in step:
            change(rows, root)
        watch.poll()
        seen = watch.documents().select("version", "path", "change", F.when(F.col("status") == "indexed", F.col("size")).alias("size"), "content_hash")
        out = E.run_available_now(seen, "e1", base=base)
    return spark.read.parquet(out).select("version", _below(root).alias("path"), "change", "size", "content_hash")
