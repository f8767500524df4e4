"""Registered tag and category-tree queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import taxonomy as G
from folio.plans import sql as Q
from folio.plans.registry import register
from folio.sources import testcorpus as tc


@register("g1_get_or_create_tags", f"WITH {Q.DOCS}, names AS (SELECT DISTINCT unnest(tags) AS name FROM docs) "
          "SELECT md5(name) AS id, name FROM names WHERE name NOT IN ('en', 'de') "
          "UNION ALL SELECT md5(name), name FROM (VALUES ('en'), ('de')) v(name)")
def g1(spark, sf_dir):
    docs = tc.documents(spark, sf_dir)
    # existing tags: the language tags of the first languages (built from the data)
    existing = (tc.table(spark, sf_dir, "documents").select(F.col("lang").alias("name"))
                .filter(F.col("name").isin("en", "de")).distinct()
                .select(F.md5("name").alias("id"), "name"))
    return G.tags_from_documents(docs, existing)


@register("g2_tags_by_usage", f"WITH {Q.DOC_TAGS} SELECT tag, count(DISTINCT doc_id) AS usage FROM doc_tags "
          "GROUP BY tag ORDER BY usage DESC, tag")
def g2(spark, sf_dir):
    return G.list_tags(tc.doc_tags(spark, sf_dir))


@register("g3_popular_parts", f"WITH {Q.LINE_TAGS} SELECT tag, count(DISTINCT doc_id) AS usage FROM line_tags "
          "GROUP BY tag ORDER BY usage DESC, tag LIMIT 20")
def g3(spark, sf_dir):
    return G.popular_tags(tc.line_tags(spark, sf_dir), 20)


@register("g4_tag_cloud_lineitem", f"WITH {Q.LINE_TAGS}, u AS (SELECT tag, count(DISTINCT doc_id) AS usage "
          "FROM line_tags GROUP BY tag) SELECT tag, usage, round(usage / (SELECT max(usage) FROM u), 6) AS weight FROM u")
def g4(spark, sf_dir):
    return G.tag_cloud(tc.line_tags(spark, sf_dir))


@register("g5_merge_tags", f"WITH {Q.DOC_TAGS} SELECT DISTINCT doc_id, CASE WHEN tag IN ('toxic', 'q0') THEN 'flagged' "
          "ELSE tag END AS tag FROM doc_tags")
def g5(spark, sf_dir):
    mapping = spark.createDataFrame([("toxic", "flagged"), ("q0", "flagged")], "src string, dst string")
    return G.merge_tags(tc.doc_tags(spark, sf_dir), mapping)


@register("g6_roots", f"WITH {Q.CATEGORIES} SELECT id, name, ord FROM categories WHERE parent_id IS NULL")
def g6(spark, sf_dir):
    return G.roots(tc.categories(spark, sf_dir)).select("id", "name", "ord")


@register("g6_children", f"WITH {Q.CATEGORIES} SELECT id, name, ord FROM categories WHERE parent_id = 'r1'")
def g6c(spark, sf_dir):
    return G.children(tc.categories(spark, sf_dir), "r1").select("id", "name", "ord")


TREE_SQL = f"""WITH RECURSIVE {Q.CATEGORIES.strip()},
tree (id, name, parent_id, ord, root_id, depth, path) AS (
  SELECT id, name, parent_id, ord, id, 0, name FROM categories WHERE parent_id IS NULL
  UNION ALL
  SELECT c.id, c.name, c.parent_id, c.ord, t.root_id, t.depth + 1, t.path || '/' || c.name
  FROM categories c JOIN tree t ON c.parent_id = t.id)
SELECT id, name, parent_id, ord, root_id, depth, path FROM tree"""


@register("g7_category_tree", TREE_SQL)
def g7(spark, sf_dir):
    return G.category_tree(spark, tc.categories(spark, sf_dir))


G8_SQL = f"""WITH RECURSIVE {Q.CATEGORIES.strip()},
up (id, ancestor_id) AS (
  SELECT id, id FROM categories
  UNION ALL
  SELECT u.id, c.parent_id FROM up u JOIN categories c ON c.id = u.ancestor_id WHERE c.parent_id IS NOT NULL),
direct AS (SELECT category_id AS id, count(DISTINCT doc_id) AS direct FROM doc_categories GROUP BY category_id),
sub AS (SELECT u.ancestor_id AS id, sum(d.direct) AS subtree FROM up u JOIN direct d ON d.id = u.id GROUP BY u.ancestor_id)
SELECT c.id, c.name, CAST(coalesce(d.direct, 0) AS BIGINT) AS direct, CAST(coalesce(s.subtree, 0) AS BIGINT) AS subtree
FROM categories c LEFT JOIN direct d USING (id) LEFT JOIN sub s USING (id)"""


@register("g8_category_counts", G8_SQL)
def g8(spark, sf_dir):
    return G.category_counts(spark, tc.categories(spark, sf_dir), tc.doc_categories(spark, sf_dir))


@register("g9_nested_children", f"WITH {Q.CATEGORIES} SELECT p.id, p.name, "
          "coalesce((SELECT string_agg(c.name, ',' ORDER BY c.ord, c.name) FROM categories c WHERE c.parent_id = p.id), '') "
          "AS children FROM categories p")
def g9(spark, sf_dir):
    n = G.nested_children(tc.categories(spark, sf_dir))
    return n.select("id", "name", F.array_join(F.transform("children", lambda x: x["name"]), ",").alias("children"))


@register("g10_delete_category", f"WITH {Q.CATEGORIES} SELECT DISTINCT doc_id, CASE WHEN category_id = 'n3' THEN 'n2' "
          "ELSE category_id END AS category_id FROM doc_categories")
def g10(spark, sf_dir):
    _, edges = G.delete_category(tc.categories(spark, sf_dir), tc.doc_categories(spark, sf_dir), "n3", "n2")
    return edges


@register("g10_delete_root_reparent", f"WITH {Q.CATEGORIES} SELECT id, name, CASE WHEN parent_id = 'r0' THEN NULL "
          "ELSE parent_id END AS parent_id FROM categories WHERE id <> 'r0'")
def g10r(spark, sf_dir):
    cats, _ = G.delete_category(tc.categories(spark, sf_dir), tc.doc_categories(spark, sf_dir), "r0")
    return cats.select("id", "name", "parent_id")


@register("g11_delete_tag", f"WITH {Q.DOC_TAGS} SELECT doc_id, tag FROM doc_tags WHERE tag NOT IN ('toxic', 'src3')")
def g11(spark, sf_dir):
    return G.delete_tag(tc.doc_tags(spark, sf_dir), ["toxic", "src3"])
