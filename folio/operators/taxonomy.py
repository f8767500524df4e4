"""Tags and the category tree.

Tags: `doc_tags(doc_id, tag)` edges; a tag's usage is its number of edges
(D14). Categories: `categories(id, name, parent_id, ord)` plus
`doc_categories(doc_id, category_id)` edges. Walks over the tree double their
reach each round, so they read one row a category and round, at any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.session import written


def tags_from_documents(docs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """G1: get-or-create: every distinct tag name in the documents' tag lists
    that is not yet a tag becomes one (id = md5(name)); existing rows kept."""
    names = docs.select(F.explode("tags").alias("name")).filter(F.col("name").isNotNull()).distinct()
    new = names.select(F.md5("name").alias("id"), "name")
    if existing is None:
        return new
    fresh = new.join(existing.select("name"), "name", "left_anti").select("id", "name")
    return existing.select("id", "name").unionByName(fresh)


def tag_usage(doc_tags: DataFrame) -> DataFrame:
    """(tag, usage, last_doc) usage = number of distinct documents."""
    return doc_tags.groupBy("tag").agg(F.count_distinct("doc_id").alias("usage"))


def list_tags(doc_tags: DataFrame, by: str = "usage") -> DataFrame:
    """Tags ordered by usage (desc, ties by name), by name, or newest
    first: by the earliest `created_at` of their edges (desc, ties by name)."""
    if by not in ("usage", "name", "newest"):
        raise ValueError(f"unknown order {by!r}")
    u = tag_usage(doc_tags)
    if by == "newest":
        born = doc_tags.groupBy("tag").agg(F.min("created_at").alias("created_at"))
        return u.join(born, "tag").orderBy(F.col("created_at").desc(), F.col("tag"))
    if by == "name":
        return u.orderBy("tag")
    return u.orderBy(F.col("usage").desc(), F.col("tag"))


def popular_tags(doc_tags: DataFrame, k: int = 20) -> DataFrame:
    """G3 (D23): global top-k tags by document count (ties by name)."""
    return tag_usage(doc_tags).orderBy(F.col("usage").desc(), F.col("tag")).limit(k)


def tag_cloud(doc_tags: DataFrame) -> DataFrame:
    """weight = count / max count. The max is a scalar subquery over the
    grouped frame, not an un-partitioned window."""
    u = tag_usage(doc_tags)
    mx = u.select(F.max("usage")).scalar()
    return u.select("tag", "usage", F.round(F.col("usage") / mx, 6).alias("weight"))


def merge_tags(doc_tags: DataFrame, mapping: DataFrame) -> DataFrame:
    """Move edges of `src` tags onto `dst` without repeats; source tags
    disappear. `mapping(src, dst)` handles many merges in one join."""
    m = mapping.select(F.col("src").alias("tag"), "dst")
    return (doc_tags.join(m, "tag", "left")
            .select("doc_id", F.coalesce("dst", "tag").alias("tag"))
            .dropDuplicates(["doc_id", "tag"]))


def roots(categories: DataFrame) -> DataFrame:
    """Root categories ordered by (ord, name)."""
    return categories.filter(F.col("parent_id").isNull()).orderBy("ord", "name")


def children(categories: DataFrame, parent_id: str) -> DataFrame:
    """Direct children of one category ordered by (ord, name)."""
    return categories.filter(F.col("parent_id") == parent_id).orderBy("ord", "name")


# Both walks below double their reach every round: after k rounds a category knows its 2^k-th ancestor (`up`), and
# what lies between. So a round reads one row a category, and a chain of 100,000 levels takes 17 rounds.

def _rounds(categories: DataFrame) -> int:
    """Rounds after which every category under a root has reached it; who has not by then is in or below a cycle."""
    return max(1, categories.count()).bit_length() + 1


def category_tree(spark: SparkSession, categories: DataFrame) -> DataFrame:
    """Every category with depth (root = 0) and path 'A/B/C', at any depth.
    Categories in or below a cycle, or below a missing parent, have no root and
    no row."""
    step = F.when(F.col("parent_id").isNotNull(), 1).otherwise(0)
    state = written(categories.select("id", "name", "parent_id", "ord", F.col("parent_id").alias("up"), F.col("id").alias("root_id"),
                                      step.alias("depth"), F.col("name").cast("string").alias("path")), "tree")
    for _ in range(_rounds(categories)):
        open_ = state.filter("up is not null")
        if not open_.limit(1).count():
            break
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("root_id").alias("top"), F.col("depth").alias("more"), F.col("path").alias("head"))
        moved = open_.join(above, "up").select("id", "name", "parent_id", "ord", F.col("next").alias("up"), F.col("top").alias("root_id"),
                                               (F.col("depth") + F.col("more")).alias("depth"), F.concat("head", F.lit("/"), "path").alias("path"))
        state = written(state.filter("up is null").unionByName(moved), "tree")
    return state.filter("up is null").drop("up")


def _subtree_sums(tree: DataFrame, rounds: int) -> DataFrame:
    """(id, up, total) from tree(id, up, total): the sum of `total` over each node and all nodes below it. `up` stays
    set for nodes in or below a cycle, whose sums mean nothing."""
    state = written(tree, "subtree")
    for _ in range(rounds):
        if not state.filter("up is not null").limit(1).count():
            break
        below = state.filter("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("total").alias("below"))
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"))
        state = written(state.join(below, "id", "left").withColumn("total", F.col("total") + F.coalesce("below", F.lit(0)))
                        .join(above, "up", "left").select("id", F.col("next").alias("up"), "total"), "subtree")
    return state


def _rings(tree: DataFrame, rounds: int) -> DataFrame:
    """(id, ring) of the categories on cycles, `ring` the smallest id on the cycle."""
    state = written(tree.select("id", "up", F.col("id").alias("least")), "rings")
    for _ in range(rounds):
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("least").alias("other"))
        state = written(state.join(above, "up").filter("next is not null").select("id", F.col("next").alias("up"), F.least("least", "other").alias("least")), "rings")
    # 2^rounds steps up from anywhere end on a cycle, and every place of it is reached
    return state.join(state.select(F.col("up").alias("id")).distinct(), "id", "left_semi").select("id", F.col("least").alias("ring"))


def category_counts(spark: SparkSession, categories: DataFrame, doc_categories: DataFrame) -> DataFrame:
    """Documents per category, direct and summed over the whole subtree.
    The categories of a cycle are below one another: each has the sum of all."""
    direct = doc_categories.groupBy(F.col("category_id").alias("id")).agg(F.count_distinct("doc_id").alias("direct"))
    rounds = _rounds(categories)
    base = written(categories.select("id", "name", F.col("parent_id").alias("up")).join(direct, "id", "left")
                   .withColumn("direct", F.coalesce("direct", F.lit(0)).cast("long")), "categories")
    sums = _subtree_sums(base.select("id", "up", F.col("direct").alias("total")), rounds)
    total = sums.select("id", "total")
    if sums.filter("up is not null").limit(1).count():  # contract every cycle to one node and add up again
        rings = written(_rings(base.select("id", "up"), rounds), "rings")
        named = base.join(rings, "id", "left").join(rings.select(F.col("id").alias("up"), F.col("ring").alias("up_ring")), "up", "left")
        nodes = named.groupBy(F.coalesce("ring", "id").alias("id")).agg(
            F.max(F.when(F.col("ring").isNull(), F.coalesce("up_ring", "up"))).alias("up"), F.sum("direct").alias("total"))
        sums = _subtree_sums(nodes, rounds).select(F.col("id").alias("node"), "total")
        total = base.join(rings, "id", "left").select("id", F.coalesce("ring", "id").alias("node")).join(sums, "node").select("id", "total")
    return base.join(total, "id").select("id", "name", "direct", F.col("total").cast("long").alias("subtree"))


def category_closure(spark: SparkSession, categories: DataFrame) -> DataFrame:
    """(id, ancestor_id) for every category and each of its ancestors (self
    included): as many rows as the depths add up to. Each round joins what
    2^k steps up reach with what as many more reach; the walk ends
    where a cycle comes back to a category it has seen."""
    one = categories.filter("parent_id is not null").select("id", F.col("parent_id").alias("ancestor_id"))
    reach, n = written(categories.select("id", F.col("id").alias("ancestor_id")).unionByName(one).distinct(), "closure"), -1
    while n != (now := reach.count()):
        n = now
        on = reach.select(F.col("id").alias("ancestor_id"), F.col("ancestor_id").alias("far"))
        reach = written(reach.join(on, "ancestor_id").select("id", F.col("far").alias("ancestor_id")).unionByName(reach).distinct(), "closure")
    return reach


def nested_children(categories: DataFrame) -> DataFrame:
    """Each category with its direct children as a sorted array of structs."""
    kids = (categories.filter(F.col("parent_id").isNotNull())
            .groupBy(F.col("parent_id").alias("id"))
            .agg(F.array_sort(F.collect_list(F.struct("ord", "name", F.col("id").alias("child_id"))))
                 .alias("children")))
    return categories.join(kids, "id", "left").withColumn(
        "children", F.coalesce("children", F.array().cast(kids.schema["children"].dataType)))


def delete_category(categories: DataFrame, doc_categories: DataFrame, category_id: str,
                    reassign_to: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Drop a category; its children become roots; its documents
    move to `reassign_to` (edges dropped when None), without repeats."""
    cats = (categories.filter(F.col("id") != category_id)
            .withColumn("parent_id", F.nullif(F.col("parent_id"), F.lit(category_id))))
    if reassign_to is None:
        edges = doc_categories.filter(F.col("category_id") != category_id)
    else:
        edges = (doc_categories.withColumn("category_id", F.when(F.col("category_id") == category_id,
                                                                 F.lit(reassign_to)).otherwise(F.col("category_id")))
                 .dropDuplicates(["doc_id", "category_id"]))
    return cats, edges


def delete_tag(doc_tags: DataFrame, tags) -> DataFrame:
    """Remove tags and all their edges."""
    return doc_tags.filter(~F.col("tag").isin(list(tags)))
