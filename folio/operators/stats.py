"""Corpus statistics, metric windows and health checks.

Shares over the whole table use a scalar subquery for the total instead of
an un-partitioned window, so no step ever funnels every row into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio import constants as C


def _ts(v) -> Column:
    from folio.functions.text import as_ts
    return as_ts(v)


def per_value_counts(docs: DataFrame, column: str = "format") -> DataFrame:
    """A2 / A4: documents per value of a column."""
    return docs.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def format_shares(docs: DataFrame, column: str = "format", bar_width: int = 40) -> DataFrame:
    """A3: count, percent of total, bar length = count / max * width.
    Total and max come from a global aggregate of the (small) grouped frame."""
    g = per_value_counts(docs, column)
    tot = g.select(F.sum("count")).scalar()
    mx = g.select(F.max("count")).scalar()
    return g.select(column, "count",
                    F.round(F.col("count") * 100.0 / tot, 2).alias("percent"),
                    F.floor(F.col("count") * bar_width / mx).cast("int").alias("bar"))


def top_values(docs: DataFrame, column: str = "category", k: int = 10) -> DataFrame:
    """A4: top-k values by count (ties by value)."""
    return per_value_counts(docs, column).orderBy(F.col("count").desc(), F.col(column)).limit(k)


def period_counts(docs: DataFrame, as_of, column: str = "created_at") -> DataFrame:
    """A5: today / last 7 days / last 30 days / all, in one pass."""
    now = _ts(as_of)
    today = F.date_trunc("day", now)
    c = F.col(column)
    return docs.agg(
        F.count_if(c >= today).alias("today"),
        F.count_if(c >= F.timestamp_add("DAY", F.lit(-7), now)).alias("last_7_days"),
        F.count_if(c >= F.timestamp_add("DAY", F.lit(-30), now)).alias("last_30_days"),
        F.count(F.lit(1)).alias("all_time"))


def scan_history(runs: DataFrame) -> DataFrame:
    """Total scans, last scan, files scanned, total duration."""
    return runs.agg(F.count(F.lit(1)).alias("total_scans"),
                    F.max("started_at").alias("last_scan"),
                    F.sum("total_files").alias("total_scanned"),
                    F.round(F.sum("duration"), 3).alias("total_duration"))


def corpus_profile(docs: DataFrame) -> DataFrame:
    """Totals + per format + per status + per category in one pass
    (GROUPING SETS). Output (dimension, value, count, total_size)."""
    g = docs.groupingSets([[], ["format"], ["status"], ["category"]],
                          "format", "status", "category") \
        .agg(F.count(F.lit(1)).alias("count"), F.sum("size").alias("total_size"),
             F.grouping_id().alias("gid"))
    dim = (F.when(F.col("gid") == 7, "total").when(F.col("gid") == 3, "format")
           .when(F.col("gid") == 5, "status").otherwise("category"))
    val = (F.when(F.col("gid") == 7, "all").when(F.col("gid") == 3, F.col("format"))
           .when(F.col("gid") == 5, F.col("status")).otherwise(F.col("category")))
    return g.select(dim.alias("dimension"), val.alias("value"), "count", "total_size")


def index_freshness(docs: DataFrame, as_of) -> DataFrame:
    """Age in days of the newest indexed_at; band fresh (0) / recent (<7) / stale."""
    age = F.timestamp_diff("DAY", F.max("indexed_at"), _ts(as_of)).cast("int")
    return docs.agg(F.max("indexed_at").alias("last_indexed"), age.alias("age_days")) \
        .withColumn("band", F.when(F.col("age_days") <= 0, "fresh")
                    .when(F.col("age_days") < 7, "recent").otherwise("stale"))


def counters(metrics: DataFrame) -> DataFrame:
    """Sum per counter name."""
    return metrics.groupBy("name").agg(F.round(F.sum("value"), 6).alias("total"),
                                       F.count(F.lit(1)).alias("increments"))


def table_counts(**frames: DataFrame) -> DataFrame:
    """A10: one row per named table with its row count."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
             for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def metric_history(metrics: DataFrame, keep: int = C.METRIC_HISTORY,
                   window: int = C.METRIC_WINDOW, salt_buckets: int = 64) -> DataFrame:
    """Keep the last `keep` values per name; over the last `window` of
    them: count, min, max, avg; latest value and unit; count kept.
    Ordered by (ts, event_id) so ties resolve the same way everywhere.
    A name may hold a third of all rows: the cut uses the salted top-k."""
    order = [F.col("ts").desc(), F.col("event_id").desc()]
    r = top_k_per_group(metrics, ["name"], order, keep, salt_buckets=salt_buckets, rank_col="rn")
    recent = F.col("rn") <= window
    return r.groupBy("name").agg(
        F.count(F.lit(1)).alias("kept"),
        F.count_if(recent).alias("count"),
        F.min(F.when(recent, F.col("value"))).alias("min"),
        F.max(F.when(recent, F.col("value"))).alias("max"),
        F.round(F.avg(F.when(recent, F.col("value"))), 6).alias("avg"),
        F.max_by("value", F.struct("ts", "event_id")).alias("latest"),
        F.max_by("unit", F.struct("ts", "event_id")).alias("unit"))


def latest_per_key(events: DataFrame, key: str = "path", tick: str = "1 second",
                   ts: str = "ts", order=("ts", "event_id")) -> DataFrame:
    """Latest event per key within each debounce tick (batch twin of E2).
    One aggregation with `max_by` on (tick, key): partial aggregation before
    the shuffle, so a hot key costs one partial row per map task."""
    return (events.withColumn("tick", tick_start(F.col(ts), tick))
            .groupBy("tick", key)
            .agg(F.max_by(F.struct(*events.columns), F.struct(*order)).alias("e"))
            .select("tick", "e.*"))


TICK_UNITS = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600,
              "day": 86400, "days": 86400}
EPOCH_NTZ = "1970-01-01 00:00:00"


def tick_seconds(tick: str) -> int:
    n, unit = tick.split()
    return int(n) * TICK_UNITS[unit]


def tick_start(ts: Column, tick: str) -> Column:
    """Start of the fixed window of length `tick` ('N second/minute/hour/day'),
    computed in TIMESTAMP_NTZ arithmetic (independent of the session zone)."""
    secs = tick_seconds(tick)
    epoch = F.to_timestamp_ntz(F.lit(EPOCH_NTZ))
    sec = F.timestamp_diff("SECOND", epoch, ts.cast("timestamp_ntz"))
    return F.timestamp_add("SECOND", sec - F.pmod(sec, F.lit(secs)), epoch)


#: Up to this k, Spark cuts each group in every input partition before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
EARLY_CUT = 1000


def top_k_per_group(df: DataFrame, group, order, k: int, salt_buckets: int = 64,
                    rank_col: str = "rank", salt_col=None) -> DataFrame:
    """First k rows per group by `order` (which ends in a unique key).

    `row_number() <= k` is planned with a limit on both sides of one exchange:
    every input partition keeps its own first k rows of a group, so a hot group
    sends at most partitions * k rows to one task. Spark does this up to a
    fixed k; beyond it the rows are first cut in `salt_buckets` sub-groups (hash
    of the row, or of `salt_col`). Both forms are exact."""
    group = list(group)
    cand = df
    if k > EARLY_CUT:
        # deterministic salt (retries re-create the same split); maps are not hashable
        salt_col = salt_col or [f.name for f in df.schema.fields if not f.dataType.simpleString().startswith("map")]
        w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
        cand = (df.withColumn("_salt", F.pmod(F.xxhash64(*salt_col), F.lit(salt_buckets)))
                .withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k).drop("_r1", "_salt"))
    w2 = Window.partitionBy(*group).orderBy(*order)
    return cand.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= k)


def threshold_checks(metrics: DataFrame, thresholds: dict | None = None,
                     default: float = C.DEFAULT_THRESHOLD) -> DataFrame:
    """H1: per metric name, latest value vs threshold -> healthy flag + message;
    a missing value is unhealthy, never an error."""
    thresholds = thresholds or {}
    latest = metrics.groupBy("name").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    thr = F.lit(default)
    for name, t in thresholds.items():
        thr = F.when(F.col("name") == name, F.lit(float(t))).otherwise(thr)
    healthy = F.coalesce(F.col("value") <= thr, F.lit(False))
    msg = F.when(F.col("value").isNull(), F.concat(F.col("name"), F.lit(": no data"))) \
        .when(healthy, F.concat(F.col("name"), F.lit(": ok"))) \
        .otherwise(F.concat(F.col("name"), F.lit(" above threshold")))
    return latest.select("name", "value", thr.alias("threshold"), healthy.alias("healthy"), msg.alias("message"))


def overall_health(checks: DataFrame) -> DataFrame:
    """H1: overall healthy = every check healthy."""
    return checks.agg(F.bool_and("healthy").alias("healthy"),
                      F.count_if(~F.col("healthy")).alias("failing"),
                      F.count(F.lit(1)).alias("checks"))


def table_health(docs: DataFrame, indexed_ids: DataFrame) -> DataFrame:
    """H2: document count, index count, and whether they agree."""
    n = docs.agg(F.count(F.lit(1)).alias("documents"))
    i = indexed_ids.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("indexed"))
    return n.select("documents", i.select("indexed").scalar().alias("indexed")) \
        .withColumn("in_sync", F.col("documents") == F.col("indexed"))


def integrity(docs: DataFrame, doc_tags: DataFrame, categories: DataFrame,
              doc_categories: DataFrame) -> DataFrame:
    """H3: (check, violations): duplicate paths, duplicate category names,
    tag edges without a document, category edges without a category,
    categories with a missing parent, missing titles, repeated tag and category
    edges, and tag names that are blank or that differ in case or outer spaces only."""
    dup_path = docs.groupBy("path").count().filter(F.col("count") > 1) \
        .agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("n"))
    dup_name = categories.groupBy("name").count().filter(F.col("count") > 1) \
        .agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("n"))
    orphan_tags = doc_tags.join(docs.select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    orphan_cat = doc_categories.join(categories.select(F.col("id").alias("category_id")),
                                     "category_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    parents = categories.filter(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("id"))
    bad_parent = parents.join(categories.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    no_title = docs.filter(F.col("title").isNull() | (F.trim("title") == "")).agg(F.count(F.lit(1)).alias("n"))
    repeated = lambda df, *cols: (df.groupBy(*cols).count().filter(F.col("count") > 1)
                                  .agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("n")))
    names = doc_tags.select("tag").distinct()
    same = (names.groupBy(F.lower(F.trim("tag")).alias("t")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1 or t = ''")
            .agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("n")))
    parts = [("duplicate_path", dup_path), ("duplicate_tag_edges", repeated(doc_tags, "doc_id", "tag")),
             ("duplicate_category_edges", repeated(doc_categories, "doc_id", "category_id")), ("unclear_tag_names", same), ("duplicate_category_name", dup_name),
             ("orphan_tag_edges", orphan_tags), ("orphan_category_edges", orphan_cat),
             ("missing_parent", bad_parent), ("missing_title", no_title)]
    return reduce(lambda a, b: a.unionByName(b),
                  [df.select(F.lit(k).alias("check"), F.col("n").alias("violations")) for k, df in parts])
