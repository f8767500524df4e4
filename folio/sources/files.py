"""File sources and the scan job.

The listing is Spark's `binaryFile` source: (path, modificationTime, length,
content). File bytes are read on executors; the driver only plans. Every step
after the read is a column expression over the listing, so the same
operators apply to a listing that arrives from any other source (a table of
paths and bytes, or a stream).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import constants as C
from folio.functions.text import file_extension, format_of, snippet
from folio.operators.extract import by_format

# decode policies (S12): lenient formats drop undecodable bytes, strict fail
LENIENT_FORMATS = ("text", "html")


def glob_regex(glob: str, across: bool = False) -> str:
    """One glob -> regex: `*` any run, `?` one char, `[..]` class, the rest
    literal; `*` and `?` take a '/' only with `across` (whole paths)."""
    one = "." if across else "[^/]"
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        if ch == "*":
            out.append(one + "*")
        elif ch == "?":
            out.append(one)
        elif ch == "[":
            j = glob.find("]", i + 1)
            if j == -1:
                out.append(re.escape(ch))
            else:
                body = glob[i + 1:j]
                if body.startswith("!"):
                    body = "^" + body[1:]
                out.append("[" + body.replace("\\", "\\\\") + "]")
                i = j
        else:
            out.append(re.escape(ch))
        i += 1
    return "".join(out)


def ignore_regex(globs=C.DEFAULT_IGNORE, across: bool = False) -> str:
    return "^(?:" + "|".join(glob_regex(g, across) for g in globs) + ")$"


def relative_path(path, root) -> Column:
    """The path below its root; of several roots, the longest that holds it."""
    p = out = F.col(path) if isinstance(path, str) else path
    roots = [root] if isinstance(root, str) else list(root or [])
    for r in sorted((re.sub(r"^file:(//)?", "", r).rstrip("/") + "/" for r in roots if r), key=len):
        out = F.when(p.startswith(r), F.substring(p, len(r) + 1, 1 << 30)).otherwise(out)
    return out


def ignored(path, globs=C.DEFAULT_IGNORE, root=None) -> Column:
    """S2 (D18): a glob hits the file name, any directory segment below the
    root (or one of several roots), or the whole relative path, with or without
    a leading '/'."""
    rx = ignore_regex(globs)
    rel = relative_path(path, root)
    segs = F.split(rel, "/")
    whole, path_rx = F.regexp_replace(rel, "^/+", ""), ignore_regex(globs, across=True)
    return F.exists(segs, lambda s: s.rlike(rx)) | whole.rlike(path_rx) | F.concat(F.lit("/"), whole).rlike(path_rx)


def extension_allowed(path, extensions) -> Column:
    """S3: allow-list, dot optional, case-insensitive."""
    exts = sorted({("." + e.lstrip(".")).lower() for e in extensions})
    return file_extension(path).isin(exts)


def list_files(spark: SparkSession, roots, recursive: bool = True, with_content: bool = True,
               modified_after: str | None = None, path_glob: str | None = None, ignore=(".*",), excludes=()) -> DataFrame:
    """Recursive or flat listing of several roots, each path once.
    Directories that an `ignore` glob hits are not listed (sources/folders.py);
    `excludes` are substrings of paths to leave out. `with_content=False` is
    the dry run (S9): file bytes are never read. Stores that only Spark opens
    are listed by its own file index, which skips names starting with '_'."""
    from folio.sources import folders

    roots = [roots] if isinstance(roots, str) else list(roots)
    if all(folders.can_open(r) for r in roots):
        listing = folders.list_tree(spark, roots, recursive, ignore).select("path", "modificationTime", "length")
    else:
        listing = _file_index(spark, roots, recursive, with_content)
    if modified_after:
        listing = listing.filter(F.col("modificationTime") > F.to_timestamp(F.lit(modified_after)))
    if path_glob:
        listing = listing.filter(F.regexp_extract("path", "([^/]*)$", 1).rlike(ignore_regex([path_glob])))
    for part in excludes:
        listing = listing.filter(~F.col("path").contains(part))
    return folders.with_bytes(listing) if with_content and "content" not in listing.columns else listing


def _file_index(spark: SparkSession, roots, recursive: bool, with_content: bool) -> DataFrame:
    """The listing by Spark's binaryFile source. Roots below other roots are listed once."""
    roots = sorted({r.rstrip("/") for r in roots if _exists(spark, r)})  # a missing root lists nothing
    cols = ["path", "modificationTime", "length"] + (["content"] if with_content else [])
    if not roots:
        return spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, content binary").select(*cols)
    if recursive:
        roots = [r for r in roots if not any(r.startswith(o + "/") for o in roots)]
    rd = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = reduce(lambda a, b: a.unionByName(b), [rd.load(r) for r in roots])
    if not recursive:
        parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
        df = df.filter(reduce(lambda a, b: a | b, [parent == r for r in roots]))
    return df.select(*cols)


def _exists(spark: SparkSession, path: str) -> bool:
    """Metadata check on the driver (no data read)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def local_path(path) -> Column:
    """'file:/a/b' -> '/a/b' (other schemes kept)."""
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(p, r"^file:(//)?", "")


def identify(listing: DataFrame, extra_formats: dict | None = None) -> DataFrame:
    """S4 + S6: format by extension, id = md5(path
    without a file: scheme), content_hash =
    sha256(bytes), size = length, created/modified from the file time (NTZ)."""
    p = F.col("path")
    ts = F.col("modificationTime").cast("timestamp_ntz")
    out = listing.select(
        "*", F.md5(local_path(p)).alias("id"), format_of(p, extra_formats).alias("format"),
        F.col("length").cast("long").alias("size"), ts.alias("created_at"), ts.alias("modified_at"))
    if "content" in listing.columns:
        out = out.withColumn("content_hash", F.sha2(F.col("content"), 256))
    return out


def decode(listing: DataFrame) -> DataFrame:
    """Bytes -> text per format policy. Lenient formats drop bad
    bytes; strict formats with invalid UTF-8 become failed rows (empty
    content, error text). Adds text, status, error."""
    raw = F.col("content").cast("string")
    valid = F.is_valid_utf8(raw)
    lenient = F.col("format").isin(list(LENIENT_FORMATS))
    cleaned = F.replace(F.make_valid_utf8(raw), F.lit("�"), F.lit(""))
    ok = (valid | lenient) & raw.isNotNull()
    return listing.withColumn("text", F.when(valid, raw).when(lenient, cleaned).otherwise(F.lit(""))) \
        .withColumn("status", F.when(ok, F.lit("indexed")).otherwise(F.lit("failed"))) \
        .withColumn("error", F.when(ok, F.lit(None).cast("string")).when(raw.isNull(), F.lit("no content")).otherwise(F.lit("invalid UTF-8")))


def split_failed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ok rows, dead-letter rows)."""
    return df.filter(F.col("status") != "failed"), df.filter(F.col("status") == "failed")


def scan_summary(scanned: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """S8 (D1): total, successful, failed, skipped in one aggregate; each
    file counted once."""
    s = scanned.agg(F.count(F.lit(1)).alias("total"),
                    F.count_if(F.col("status") != "failed").alias("successful"),
                    F.count_if(F.col("status") == "failed").alias("failed"))
    if skipped is None:
        return s.withColumn("skipped", F.lit(0).cast("long"))
    return s.select("*", skipped.select(F.count(F.lit(1))).scalar().alias("skipped"))


def format_counts(scanned: DataFrame) -> DataFrame:
    """Files per format."""
    return scanned.groupBy("format").agg(F.count(F.lit(1)).alias("count"))


def top_errors(scanned: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent error texts."""
    return (scanned.filter(F.col("error").isNotNull()).groupBy("error")
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), F.col("error")).limit(k))


def apply_defaults(docs: DataFrame, category: str | None = None, tags=None) -> DataFrame:
    """Default category / tags for the documents of one scan."""
    out = docs
    if category is not None:
        out = out.withColumn("category", F.coalesce(F.col("category"), F.lit(category))
                             if "category" in docs.columns else F.lit(category))
    if tags:
        arr = F.array(*[F.lit(t) for t in tags])
        out = out.withColumn("tags", F.array_distinct(F.concat(F.coalesce(F.col("tags"), F.array().cast("array<string>")), arr))
                             if "tags" in docs.columns else arr)
    return out


def path_components(path, root: str | None = None) -> Column:
    """Lower-cased directory components of the path (relative to root)."""
    rel = relative_path(path, root)
    parts = F.filter(F.split(F.regexp_replace(rel, "^/+", ""), "/"), lambda x: x != "")
    return F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.lower(x))


def prefix_facets(docs: DataFrame, path_col: str = "path", root: str | None = None, depth: int = 2) -> DataFrame:
    """Document counts per directory prefix, for every depth up to `depth`."""
    comps = path_components(path_col, root)
    d = docs.select(comps.alias("c")).filter(F.size("c") > 0).select(
        F.explode(F.sequence(F.lit(1), F.least(F.size("c"), F.lit(depth)))).alias("d"), "c")
    return d.select("d", F.array_join(F.slice("c", 1, F.col("d")), "/").alias("prefix")) \
        .groupBy("d", "prefix").agg(F.count(F.lit(1)).alias("count")).withColumnRenamed("d", "depth")


def scan(spark: SparkSession, roots, recursive: bool = True, extensions=None, ignore=C.DEFAULT_IGNORE,
         since: str | None = None, category: str | None = None, tags=None, registry=None) -> DataFrame:
    """S1-S7, S10 and the formats' own title, text and keywords (U2), snippet
    (X19). Names are filtered before any file is opened. `registry` is an
    ExtractorRegistry (U2): its extensions get their formats, and the columns of its
    extractors (over `content`) replace or join the document's."""
    from folio.sources import folders

    listing = list_files(spark, roots, recursive, with_content=False, modified_after=since, ignore=ignore)
    listing = listing.filter(~ignored(local_path("path"), ignore, root=roots))
    formats = registry.format_column(F.col("path")) if registry else format_of(F.col("path"))
    listing = listing.filter(extension_allowed(F.col("path"), extensions) if extensions else formats != "unknown")
    if folders.can_open(roots if isinstance(roots, str) else roots[0]):  # bytes of the files that are left
        listing = folders.with_bytes(listing)
    else:
        listing = _file_index(spark, [roots] if isinstance(roots, str) else roots, recursive, True).join(listing.select("path"), "path", "left_semi")
    return apply_defaults(to_documents(listing, registry), category, tags)


def to_documents(files: DataFrame, registry=None, keep=()) -> DataFrame:
    """Document rows of `files(path, modificationTime, length, content)`: identity, decoded text, and title, text and
    keywords by format (S4-S7, X*); `keep` columns stay."""
    formats = registry.format_column(F.col("path")) if registry else format_of(F.col("path"))
    dec = decode(identify(files).withColumn("format", formats))
    own = by_format("format", "text", "path")
    docs = dec.select(*keep, "id", local_path("path").alias("path"), own["title"].alias("title"),
                      own["content"].alias("content"), "content_hash", "format", "size", "created_at",
                      "modified_at", "status", "error", own["keywords"].alias("keywords"))
    if registry:
        docs = registry.extend(docs)
    return docs.withColumn("snippet", snippet("content"))
