"""Filters, lookups, sort/page, set operations, joins and table mutations
(P1-P6, P16, L1-L5, J1-J8, M1-M4, A1).

Mutations never overwrite what they read: each returns the new snapshot as a
DataFrame; the caller writes it to a new directory and swaps the pointer
(`write_snapshot`)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators.search import filter_predicate, range_predicate


# ----------------------------------------------------------------------------- P
def list_documents(docs: DataFrame, format: str | None = None, status: str | None = None,
                   category: str | None = None) -> DataFrame:
    """Optional equality filters."""
    conds = [F.col(c) == v for c, v in (("format", format), ("status", status),
                                        ("category", category)) if v is not None]
    return docs.filter(reduce(lambda a, b: a & b, conds)) if conds else docs


def modified_since(docs: DataFrame, since) -> DataFrame:
    """Strictly after `since`."""
    from folio.functions.text import as_ts
    return docs.filter(F.col("modified_at") > as_ts(since))


def apply_filters(docs: DataFrame, filters: dict | None) -> DataFrame:
    """Filter dictionary (term / OR list / from-to range), unknown keys ignored."""
    return docs.filter(filter_predicate(filters, docs.columns))


def in_range(docs: DataFrame, column: str, lo=None, hi=None) -> DataFrame:
    """Inclusive range, either end open."""
    return docs.filter(range_predicate(column, lo, hi))


RELATIVE_UNITS = {"day": 1, "days": 1, "week": 7, "weeks": 7, "month": 30, "months": 30,
                  "year": 365, "years": 365}


def relative_range(expr: str, as_of) -> tuple[Column, Column]:
    """P5: 'today', 'yesterday', 'last N days/weeks/months/years' (no N -> 1)
    as a [lo, hi) pair of day-truncated timestamps relative to as_of (D2, D3)."""
    import re

    from folio.functions.text import as_ts
    today = F.date_trunc("day", as_ts(as_of))
    e = expr.strip().lower()
    if e == "today":
        return today, F.timestamp_add("DAY", F.lit(1), today)
    if e == "yesterday":
        return F.timestamp_add("DAY", F.lit(-1), today), today
    m = re.fullmatch(r"last\s+(\d+)?\s*(day|days|week|weeks|month|months|year|years)", e)
    if not m:
        raise ValueError(f"not a relative date: {expr}")
    n = int(m.group(1) or 1) * RELATIVE_UNITS[m.group(2)]
    return F.timestamp_add("DAY", F.lit(-n), today), F.timestamp_add("DAY", F.lit(1), today)


def relative_dates(docs: DataFrame, expr: str, as_of, column: str = "modified_at") -> DataFrame:
    lo, hi = relative_range(expr, as_of)
    return docs.filter((F.col(column) >= lo) & (F.col(column) < hi))


def lookup(docs: DataFrame, id: str | None = None, path: str | None = None) -> DataFrame:
    """By id or by path."""
    if id is not None:
        return docs.filter(F.col("id") == id)
    return docs.filter(F.col("path") == path)


# ----------------------------------------------------------------------------- L
def sort_documents(docs: DataFrame, sort_by: str | None = "modified_at", descending: bool = True,
                   key: str = "doc_id") -> DataFrame:
    """L1: sort by any column (unknown = no sort), unique key as tiebreak."""
    if sort_by is None or sort_by not in docs.columns:
        return docs
    c = F.col(sort_by)
    return docs.orderBy(c.desc() if descending else c.asc(), F.col(key).asc())


def page(df: DataFrame, page: int = 1, size: int = 20, max_size: int = 100) -> DataFrame:
    """L2: 1-based page of an ordered frame; a size outside 1..max_size is an error."""
    if not 1 <= size <= max_size:
        raise ValueError(f"page size must be in 1..{max_size}")
    return df.offset((max(page, 1) - 1) * size).limit(size)


def page_info(df: DataFrame, size: int = 20) -> DataFrame:
    """L2: total, page size, page count = ceil(total / size) (one row)."""
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(size).alias("page_size"),
        F.ceil(F.col("total") / F.lit(size)).cast("long").alias("pages"))


def union_roots(*frames: DataFrame, key: str = "path") -> DataFrame:
    """L4: union of several listings without repeats."""
    return reduce(lambda a, b: a.unionByName(b), frames).dropDuplicates([key])


def snapshot_minus(a: DataFrame, b: DataFrame, keys=("path",)) -> DataFrame:
    """Rows of `a` whose key is absent from `b`."""
    return a.join(b.select(*keys), list(keys), "left_anti")


# ----------------------------------------------------------------------------- J
def in_category(docs: DataFrame, doc_categories: DataFrame, category_id: str) -> DataFrame:
    """Documents filed under one category."""
    edges = doc_categories.filter(F.col("category_id") == category_id).select("doc_id")
    return docs.join(edges, "doc_id", "left_semi")


def having_all_tags(docs: DataFrame, doc_tags: DataFrame, tags) -> DataFrame:
    """J2 (D9): documents carrying every one of `tags`."""
    tags = sorted(set(tags))
    if not tags:
        return docs
    hit = (doc_tags.filter(F.col("tag").isin(tags)).groupBy("doc_id")
           .agg(F.count_distinct("tag").alias("n")).filter(F.col("n") == len(tags)).select("doc_id"))
    return docs.join(hit, "doc_id", "left_semi")


def with_tags_and_category(docs: DataFrame, doc_tags: DataFrame, doc_categories: DataFrame,
                           categories: DataFrame | None = None) -> DataFrame:
    """Document with its sorted tag list and first category (by id)."""
    t = doc_tags.groupBy("doc_id").agg(F.array_sort(F.collect_set("tag")).alias("tag_list"))
    c = doc_categories.groupBy("doc_id").agg(F.min("category_id").alias("category_id"))
    out = docs.join(t, "doc_id", "left").join(c, "doc_id", "left")
    if categories is not None:
        out = out.join(categories.select(F.col("id").alias("category_id"),
                                         F.col("name").alias("category_name")), "category_id", "left")
    return out


def hits_to_documents(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Search hits back to stored rows (one join, not one lookup per hit)."""
    return hits.select("doc_id", "score").join(docs, "doc_id")


def duplicates(docs: DataFrame, key: str = "content_hash") -> DataFrame:
    """Rows whose hash occurs more than once, with the group size.

    One shuffle on the hash. A hash held by a third of all rows only sends
    (hash, count) partials through the exchange; AQE splits the skewed
    join partition on the way back."""
    groups = (docs.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
              .filter(F.col("copies") > 1))
    return docs.join(groups, key)


def upsert_plan(existing: DataFrame, incoming: DataFrame, key: str = "path") -> DataFrame:
    """Incoming rows with the existing id / created_at of the same path
    (null when new) and an `is_new` flag."""
    old = existing.select(key, F.col("id").alias("old_id"), F.col("created_at").alias("old_created_at"))
    return incoming.join(old, key, "left").withColumn("is_new", F.col("old_id").isNull())


def index_coverage(docs: DataFrame, indexed_ids: DataFrame) -> DataFrame:
    """Stored vs indexed counts, ratio and band (>= .95 good, >= .8 fair)."""
    stored = docs.agg(F.count(F.lit(1)).alias("stored"))
    covered = docs.join(indexed_ids.select("doc_id").distinct(), "doc_id", "left_semi") \
        .agg(F.count(F.lit(1)).alias("indexed"))
    ratio = F.when(F.col("stored") > 0, F.col("indexed") / F.col("stored")).otherwise(F.lit(1.0))
    return stored.select("stored", covered.select("indexed").scalar().alias("indexed")) \
        .withColumn("missing", F.col("stored") - F.col("indexed")) \
        .withColumn("ratio", F.round(ratio, 6)) \
        .withColumn("band", F.when(F.col("ratio") >= 0.95, "good")
                    .when(F.col("ratio") >= 0.8, "fair").otherwise("poor"))


def missing_from_index(docs: DataFrame, indexed_ids: DataFrame) -> DataFrame:
    """Stored documents absent from the index."""
    return docs.join(indexed_ids.select("doc_id"), "doc_id", "left_anti")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "path") -> DataFrame:
    """Added / modified (size or mtime changed) / deleted between two listings."""
    b = before.select(key, F.col("size").alias("b_size"), F.col("mtime").alias("b_mtime"))
    a = after.select(key, F.col("size").alias("a_size"), F.col("mtime").alias("a_mtime"))
    j = b.join(a, key, "full_outer")
    change = (F.when(F.col("b_size").isNull() & F.col("b_mtime").isNull(), "added")
              .when(F.col("a_size").isNull() & F.col("a_mtime").isNull(), "deleted")
              .when((F.col("a_size") != F.col("b_size")) | (F.col("a_mtime") != F.col("b_mtime")), "modified"))
    return j.select(key, change.alias("change")).filter(F.col("change").isNotNull())


# ----------------------------------------------------------------------------- M
def upsert(existing: DataFrame, incoming: DataFrame, key: str = "path",
           order_col: str = "modified_at") -> DataFrame:
    """M1: new snapshot = existing rows whose key is not incoming + incoming rows,
    the last writer per key (max by order_col, then id) winning, keeping the old
    id and created_at when the key existed."""
    # last writer per key by max_by: partial aggregation, so a hot key never
    # lands whole in one task
    latest = (incoming.groupBy(key)
              .agg(F.max_by(F.struct(*incoming.columns), F.struct(order_col, "id")).alias("_e"))
              .select("_e.*"))
    old = existing.select(key, F.col("id").alias("_old_id"), F.col("created_at").alias("_old_created"))
    merged = (latest.join(old, key, "left")
              .withColumn("id", F.coalesce("_old_id", "id"))
              .withColumn("created_at", F.coalesce("_old_created", "created_at"))
              .drop("_old_id", "_old_created"))
    kept = existing.join(latest.select(key), key, "left_anti")
    return kept.unionByName(merged.select(*existing.columns))


def update_by_id(docs: DataFrame, patch: DataFrame, as_of) -> DataFrame:
    """M2: patch (id + some columns). id and created_at immutable; modified_at bumped."""
    cols = [c for c in patch.columns if c not in ("id", "created_at", "doc_id")]
    p = patch.select("id", *[F.col(c).alias(f"_p_{c}") for c in cols]).withColumn("_hit", F.lit(True))
    j = docs.join(p, "id", "left")
    out = j
    for c in cols:
        out = out.withColumn(c, F.when(F.col("_hit"), F.col(f"_p_{c}")).otherwise(F.col(c)))
    from folio.functions.text import as_ts
    ts = as_ts(as_of)
    out = out.withColumn("modified_at", F.when(F.col("_hit"), ts).otherwise(F.col("modified_at")))
    return out.select(*docs.columns)


def bulk_update(docs: DataFrame, ids: DataFrame, **values) -> DataFrame:
    """M3: set columns to constants for the listed ids."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    j = docs.join(hit, "id", "left")
    for c, v in values.items():
        j = j.withColumn(c, F.when(F.col("_hit"), F.lit(v)).otherwise(F.col(c)))
    return j.select(*docs.columns)


def bulk_delete(docs: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """M3: drop the listed ids."""
    return docs.join(ids.select(key), key, "left_anti")


def store_counts(existing: DataFrame, incoming: DataFrame, key: str = "path") -> DataFrame:
    """M4: stored / new / updated counts of a scan result (one row)."""
    j = upsert_plan(existing, incoming.dropDuplicates([key]), key)
    return j.agg(F.count(F.lit(1)).alias("stored"),
                 F.count_if(F.col("is_new")).alias("new"),
                 F.count_if(~F.col("is_new")).alias("updated"))


def write_snapshot(df: DataFrame, base: str, version: int) -> str:
    """Write a new snapshot directory (never the one being read)."""
    path = f"{base.rstrip('/')}/v{version:06d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def count_documents(docs: DataFrame, filters: dict | None = None, tags=None,
                    doc_tags: DataFrame | None = None) -> DataFrame:
    """A1 (D10): count under the same filters as the list."""
    d = apply_filters(docs, filters)
    if tags:
        d = having_all_tags(d, doc_tags, tags)
    return d.agg(F.count(F.lit(1)).alias("count"))
