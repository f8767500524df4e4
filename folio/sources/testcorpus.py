"""Map the driver's test tables to the document model.

All derivations use integer arithmetic and constants so that Spark and the
DuckDB oracle produce the same rows. Every frame is lazy and column-pruned:
a query that never touches `content` never reads `documents.text`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import constants as C
from folio.functions.text import ntz

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(values, idx) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), idx)


def documents(spark: SparkSession, sf_dir: str, with_labels: bool = True) -> DataFrame:
    """Document rows: doc_id, id, path, title, content, content_hash, format, size,
    created_at, modified_at, indexed_at, status, error, score, tags, category,
    lang, source."""
    from folio.session import spread
    # whole-text rows: spread the scan over the cores before per-row work
    base = documents_from(spread(table(spark, sf_dir, "documents")))
    if not with_labels:
        return base
    return with_labels_from(base, table(spark, sf_dir, "labels"))


def documents_from(d: DataFrame) -> DataFrame:
    """The document model of raw `documents` rows (batch or streaming)."""
    idx = (F.col("doc_id") % 6).cast("int") + 1
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"),
                    F.col("doc_id").cast("string"), _pick(C.TEST_EXTENSIONS, idx))
    created = F.timestamp_add("HOUR", F.col("doc_id"), ntz(C.TEST_EPOCH))
    modified = F.timestamp_add("HOUR", (F.col("doc_id") * 7) % 720, created)
    m = F.col("doc_id") % 10
    status = F.when(m == 0, "failed").when(m == 1, "pending").otherwise("indexed")
    first_line = F.substring(F.split_part(F.col("text"), F.lit("\n"), F.lit(1)), 1, 60)
    title = F.coalesce(F.nullif(F.trim(first_line), F.lit("")),
                       F.concat(F.lit("Document "), F.col("doc_id").cast("string")))
    base = d.select(
        "doc_id",
        F.md5(path).alias("id"),
        path.alias("path"),
        title.alias("title"),
        F.col("text").alias("content"),
        F.sha2(F.col("text"), 256).alias("content_hash"),
        _pick(C.TEST_FORMATS, idx).alias("format"),
        F.octet_length("text").cast("long").alias("size"),
        created.alias("created_at"),
        modified.alias("modified_at"),
        F.when(status == "indexed", F.timestamp_add("HOUR", F.lit(1), modified)).alias("indexed_at"),
        status.alias("status"),
        F.when(status == "failed", F.lit("decode error")).alias("error"),
        F.col("lang").alias("category"),
        "lang", "source",
    )
    return base


def with_labels_from(base: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds score (quality, 0 when absent) and tags (source, lang, toxic/clean, q0/q1)."""
    lab = labels.select("doc_id", "quality", "toxic")
    j = base.join(lab, "doc_id", "left")
    extra = F.when(F.col("quality").isNotNull(),
                   F.array(F.when(F.col("toxic") == 1, "toxic").otherwise("clean"),
                           F.concat(F.lit("q"), F.col("quality").cast("string"))))
    tags = F.concat(F.array("source", "lang"),
                    F.coalesce(extra, F.array().cast("array<string>")))
    return j.select(*base.columns,
                    F.coalesce(F.col("quality"), F.lit(0)).cast("double").alias("score"),
                    tags.alias("tags"))


def doc_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small tag edges (doc_id, tag): source, lang, toxic/clean, q0/q1."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return (d.select("doc_id", F.col("source").alias("tag"))
            .unionByName(d.select("doc_id", F.col("lang").alias("tag")))
            .unionByName(lab.select("doc_id", F.when(F.col("toxic") == 1, "toxic")
                                    .otherwise("clean").alias("tag")))
            .unionByName(lab.select("doc_id", F.concat(F.lit("q"), F.col("quality")
                                                       .cast("string")).alias("tag"))))


def line_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag edges at scale from lineitem: document = order, tag = 'p' || partkey."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return li.select(F.col("l_orderkey").alias("doc_id"),
                     F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("tag"))


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category tree: regions are roots (id r<k>), nations their children (id n<k>)."""
    r = table(spark, sf_dir, "region")
    n = table(spark, sf_dir, "nation")
    roots = r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"),
                     F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_id"),
                     F.col("r_regionkey").alias("ord"))
    kids = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"),
                    F.col("n_name").alias("name"),
                    F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"),
                    F.col("n_nationkey").alias("ord"))
    return roots.unionByName(kids)


def doc_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers filed under their nation: (doc_id, category_id)."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("doc_id"),
                    F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("category_id"))


def search_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_history_from(table(spark, sf_dir, "conversations"))


def search_history_from(cv: DataFrame) -> DataFrame:
    """Query log from user turns: query = all tokens of the turn (lower case),
    searched_at = epoch + (conv_id*10 + turn) minutes, user = conv_id."""
    cv = cv.filter(F.col("role") == "user")
    words = F.regexp_extract_all(F.lower("text"), F.lit(C.TOKEN_PATTERN), 0)
    return cv.select(
        F.col("conv_id").alias("user_id"),
        F.col("turn"),
        F.array_join(words, " ").alias("query"),
        F.timestamp_add("MINUTE", F.col("conv_id") * 10 + F.col("turn"), ntz(C.TEST_EPOCH)).alias("searched_at"),
        ((F.col("conv_id") * 7 + F.col("turn")) % 150).alias("results_count"),
        (((F.col("conv_id") * 13 + F.col("turn")) % 1000) / 1000.0).alias("execution_time"),
    )


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_events_from(table(spark, sf_dir, "events"))


def file_events_from(e: DataFrame) -> DataFrame:
    """File events from `events` (batch or streaming): signup = created,
    error = deleted, purchase = moved from /u/<user>.md to /m/<user>.md,
    anything else = modified of /u/<user>.md."""
    typ = (F.when(F.col("event_type") == "signup", "created")
           .when(F.col("event_type") == "error", "deleted")
           .when(F.col("event_type") == "purchase", "moved")
           .otherwise("modified"))
    path = F.concat(F.lit("/u/"), F.col("user_id").cast("string"), F.lit(".md"))
    return e.select("event_id", typ.alias("type"),
                    F.when(typ == "moved", F.concat(F.lit("/m/"), F.col("user_id").cast("string"), F.lit(".md")))
                    .otherwise(path).alias("path"),
                    F.when(typ == "moved", path).alias("old_path"), "ts", "value", "user_id")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics_from(table(spark, sf_dir, "events"))


def metrics_from(e: DataFrame) -> DataFrame:
    """Metric rows from `events`: name = event_type, value, ts, unit."""
    return e.select("event_id", F.col("event_type").alias("name"), "value",
                    F.lit("ms").alias("unit"), "ts",
                    F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("tags"))


def scan_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan run per order date: files scanned = orders that day."""
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(F.col("o_orderdate").alias("started_at"))
            .agg(F.count("*").alias("total_files"),
                 F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).cast("long").alias("successful"),
                 F.round(F.sum("o_totalprice") / 100000.0, 3).alias("duration")))
