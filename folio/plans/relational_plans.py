"""Registered relational queries (P1-P6, P16, L*, J*, M*, A1) on the test corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio import constants as C
from folio.operators import relational as R
from folio.plans import sql as Q
from folio.plans.registry import register
from folio.sources import testcorpus as tc

AS_OF = C.TEST_AS_OF
W = f"WITH {Q.DOCS}"
WB = f"WITH {Q.DOCS_BASE}"


def _docs(spark, sf_dir, labels=False):
    return tc.documents(spark, sf_dir, with_labels=labels)


@register("p1_list_filtered", f"{WB} SELECT doc_id, id, path, format, status FROM docs_b "
          "WHERE format = 'markdown' AND status = 'indexed'")
def p1(spark, sf_dir):
    return R.list_documents(_docs(spark, sf_dir), format="markdown", status="indexed") \
        .select("doc_id", "id", "path", "format", "status")


@register("p2_modified_since", f"{WB} SELECT doc_id, modified_at FROM docs_b "
          "WHERE modified_at > TIMESTAMP '2024-02-01 00:00:00'")
def p2(spark, sf_dir):
    return R.modified_since(_docs(spark, sf_dir), "2024-02-01 00:00:00").select("doc_id", "modified_at")


@register("p3_filter_dict", f"{WB} SELECT doc_id, format, category, size FROM docs_b "
          "WHERE format IN ('markdown', 'code') AND category = 'en' AND size >= 1000 AND size <= 5000")
def p3(spark, sf_dir):
    f = {"format": ["markdown", "code"], "category": "en", "size": {"from": 1000, "to": 5000},
         "no_such_field": "x"}
    return R.apply_filters(_docs(spark, sf_dir), f).select("doc_id", "format", "category", "size")


@register("p3_filter_tags", f"{W} SELECT doc_id, score FROM docs "
          "WHERE list_has_any(tags, ['toxic', 'q1']) AND status = 'indexed'")
def p3_tags(spark, sf_dir):
    f = {"tags": ["toxic", "q1"], "status": "indexed"}
    return R.apply_filters(_docs(spark, sf_dir, True), f).select("doc_id", "score")


@register("p4_created_range", f"{WB} SELECT doc_id, created_at FROM docs_b "
          "WHERE created_at >= TIMESTAMP '2024-01-10 00:00:00' AND created_at <= TIMESTAMP '2024-01-20 00:00:00'")
def p4(spark, sf_dir):
    return R.in_range(_docs(spark, sf_dir), "created_at", "2024-01-10 00:00:00",
                      "2024-01-20 00:00:00").select("doc_id", "created_at")


@register("p4_open_range", f"{WB} SELECT doc_id, size FROM docs_b WHERE size >= 10000")
def p4_open(spark, sf_dir):
    return R.in_range(_docs(spark, sf_dir), "size", lo=10000).select("doc_id", "size")


@register("p5_last_7_days", f"{WB} SELECT doc_id, modified_at FROM docs_b "
          f"WHERE modified_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND modified_at < TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY")
def p5(spark, sf_dir):
    return R.relative_dates(_docs(spark, sf_dir), "last 7 days", AS_OF).select("doc_id", "modified_at")


@register("p5_last_week_default_n", f"{WB} SELECT doc_id FROM docs_b "
          f"WHERE modified_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND modified_at < TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY")
def p5b(spark, sf_dir):
    return R.relative_dates(_docs(spark, sf_dir), "last week", AS_OF).select("doc_id")


@register("p5_yesterday", f"{WB} SELECT doc_id FROM docs_b "
          f"WHERE modified_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY AND modified_at < TIMESTAMP '{AS_OF}'")
def p5c(spark, sf_dir):
    return R.relative_dates(_docs(spark, sf_dir), "yesterday", AS_OF).select("doc_id")


@register("p6_match_all_count", f"{WB} SELECT count(*) AS count FROM docs_b")
def p6(spark, sf_dir):
    return R.count_documents(_docs(spark, sf_dir))


@register("p16_lookup_path", f"{WB} SELECT doc_id, id, title FROM docs_b WHERE path = '/src1/en/1.txt'")
def p16(spark, sf_dir):
    return R.lookup(_docs(spark, sf_dir), path="/src1/en/1.txt").select("doc_id", "id", "title")


@register("l1_sort_modified", f"{WB} SELECT doc_id, modified_at FROM docs_b ORDER BY modified_at DESC, doc_id")
def l1(spark, sf_dir):
    return R.sort_documents(_docs(spark, sf_dir)).select("doc_id", "modified_at")


@register("l2_page3_by_size", f"{WB} SELECT doc_id, size FROM docs_b ORDER BY size DESC, doc_id LIMIT 25 OFFSET 50")
def l2(spark, sf_dir):
    d = R.sort_documents(_docs(spark, sf_dir), "size", True)
    return R.page(d, page=3, size=25).select("doc_id", "size")


@register("l2_page_info", f"{WB} SELECT count(*) AS total, 20 AS page_size, "
          "CAST(ceil(count(*) / 20) AS BIGINT) AS pages FROM docs_b WHERE status = 'indexed'")
def l2_info(spark, sf_dir):
    return R.page_info(_docs(spark, sf_dir).filter(F.col("status") == "indexed"), 20)


@register("l3_sort_title_asc", f"{WB} SELECT doc_id, title FROM docs_b ORDER BY title, doc_id LIMIT 50")
def l3(spark, sf_dir):
    return R.sort_documents(_docs(spark, sf_dir), "title", False).limit(50).select("doc_id", "title")


@register("l4_union_roots", f"{WB} SELECT DISTINCT path FROM docs_b WHERE lang = 'en' OR source IN ('src1', 'src2')")
def l4(spark, sf_dir):
    d = _docs(spark, sf_dir).select("path", "lang", "source")
    a = d.filter(F.col("lang") == "en").select("path")
    b = d.filter(F.col("source").isin("src1", "src2")).select("path")
    return R.union_roots(a, b)


@register("l5_snapshot_minus", f"{WB} SELECT path FROM docs_b WHERE created_at >= TIMESTAMP '2024-01-20 00:00:00'")
def l5(spark, sf_dir):
    d = _docs(spark, sf_dir).select("path", "created_at")
    before = d.filter(F.col("created_at") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return R.snapshot_minus(d, before).select("path")


@register("j1_in_category", f"WITH {Q.CATEGORIES} SELECT c_custkey, c_name FROM customer "
          "WHERE c_custkey IN (SELECT doc_id FROM doc_categories WHERE category_id = 'n7')")
def j1(spark, sf_dir):
    cust = tc.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name")
    return R.in_category(cust, tc.doc_categories(spark, sf_dir), "n7") \
        .select(F.col("doc_id").alias("c_custkey"), "c_name")


@register("j2_all_tags", f"WITH {Q.DOC_TAGS} SELECT doc_id FROM documents WHERE doc_id IN "
          "(SELECT doc_id FROM doc_tags WHERE tag IN ('clean', 'en') GROUP BY doc_id HAVING count(DISTINCT tag) = 2)")
def j2(spark, sf_dir):
    d = tc.table(spark, sf_dir, "documents").select("doc_id")
    return R.having_all_tags(d, tc.doc_tags(spark, sf_dir), ["en", "clean"])


@register("j2_all_tags_scale", f"WITH {Q.LINE_TAGS} SELECT o_orderkey FROM orders WHERE o_orderkey IN "
          "(SELECT doc_id FROM line_tags WHERE tag IN ('p1') GROUP BY doc_id HAVING count(DISTINCT tag) = 1)")
def j2_scale(spark, sf_dir):
    o = tc.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return R.having_all_tags(o, tc.line_tags(spark, sf_dir), ["p1"]).select(F.col("doc_id").alias("o_orderkey"))


@register("j3_doc_tags_category", f"WITH {Q.DOC_TAGS}, {Q.CATEGORIES}, "
          "t AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(tag))), ',') AS tag_list FROM doc_tags GROUP BY doc_id), "
          "c AS (SELECT doc_id, min(category_id) AS category_id FROM doc_categories GROUP BY doc_id) "
          "SELECT d.doc_id, t.tag_list, c.category_id, cat.name AS category_name FROM documents d "
          "LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN categories cat ON cat.id = c.category_id")
def j3(spark, sf_dir):
    d = tc.table(spark, sf_dir, "documents").select("doc_id")
    out = R.with_tags_and_category(d, tc.doc_tags(spark, sf_dir), tc.doc_categories(spark, sf_dir),
                                   tc.categories(spark, sf_dir))
    return out.select("doc_id", F.array_join("tag_list", ",").alias("tag_list"), "category_id", "category_name")


@register("j5_duplicates", f"WITH {Q.DOCS_BASE}, g AS (SELECT content_hash, count(*) AS copies FROM docs_b "
          "GROUP BY content_hash HAVING count(*) > 1) SELECT doc_id, content_hash, copies FROM docs_b JOIN g USING (content_hash)")
def j5(spark, sf_dir):
    return R.duplicates(_docs(spark, sf_dir)).select("doc_id", "content_hash", "copies")


@register("j6_upsert_lookup", f"{WB} SELECT n.path, n.doc_id, o.id AS old_id, o.id IS NULL AS is_new FROM docs_b n "
          "LEFT JOIN (SELECT path, id FROM docs_b WHERE created_at < TIMESTAMP '2024-01-25 00:00:00') o USING (path) "
          "WHERE n.created_at >= TIMESTAMP '2024-01-15 00:00:00'")
def j6(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "id", "path", "created_at")
    old = d.filter(F.col("created_at") < F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))
    new = d.filter(F.col("created_at") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).drop("id")
    return R.upsert_plan(old, new.withColumn("id", F.lit(None).cast("string"))) \
        .select("path", "doc_id", "old_id", "is_new")


@register("j7_index_coverage", f"{WB} SELECT count(*) AS stored, count(*) FILTER (WHERE status = 'indexed') AS indexed, "
          "count(*) - count(*) FILTER (WHERE status = 'indexed') AS missing, "
          "round(count(*) FILTER (WHERE status = 'indexed') / count(*), 6) AS ratio, "
          "CASE WHEN round(count(*) FILTER (WHERE status = 'indexed') / count(*), 6) >= 0.95 THEN 'good' "
          "WHEN round(count(*) FILTER (WHERE status = 'indexed') / count(*), 6) >= 0.8 THEN 'fair' ELSE 'poor' END AS band FROM docs_b")
def j7(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "status")
    return R.index_coverage(d, d.filter(F.col("status") == "indexed"))


@register("j7_missing_from_index", f"{WB} SELECT doc_id, status FROM docs_b WHERE status <> 'indexed'")
def j7m(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "status")
    return R.missing_from_index(d, d.filter(F.col("status") == "indexed"))


_DIFF_SQL = f"""{WB},
b AS (SELECT path, size, modified_at AS mtime FROM docs_b WHERE created_at < TIMESTAMP '2024-02-01 00:00:00'),
a AS (SELECT path, CASE WHEN status = 'pending' THEN size + 1 ELSE size END AS size, modified_at AS mtime
      FROM docs_b WHERE created_at >= TIMESTAMP '2024-01-10 00:00:00')
SELECT coalesce(b.path, a.path) AS path,
       CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'deleted' ELSE 'modified' END AS change
FROM b FULL OUTER JOIN a ON a.path = b.path
WHERE b.path IS NULL OR a.path IS NULL OR a.size <> b.size OR a.mtime <> b.mtime"""


@register("j8_snapshot_diff", _DIFF_SQL)
def j8(spark, sf_dir):
    d = _docs(spark, sf_dir).select("path", "size", "status", "modified_at", "created_at")
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    before = d.filter(F.col("created_at") < ts("2024-02-01 00:00:00")).select(
        "path", "size", F.col("modified_at").alias("mtime"))
    after = d.filter(F.col("created_at") >= ts("2024-01-10 00:00:00")).select(
        "path", F.when(F.col("status") == "pending", F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.col("modified_at").alias("mtime"))
    return R.snapshot_diff(before, after)


_UPSERT_SQL = f"""{WB},
ex AS (SELECT * FROM docs_b WHERE created_at < TIMESTAMP '2024-02-01 00:00:00'),
inc AS (SELECT doc_id, md5(path || '#2') AS id, path, title || ' v2' AS title, created_at + INTERVAL 1 DAY AS created_at
        FROM docs_b WHERE created_at >= TIMESTAMP '2024-01-20 00:00:00')
SELECT doc_id, id, path, title, created_at FROM ex WHERE path NOT IN (SELECT path FROM inc)
UNION ALL
SELECT i.doc_id, coalesce(e.id, i.id) AS id, i.path, i.title, coalesce(e.created_at, i.created_at) AS created_at
FROM inc i LEFT JOIN ex e USING (path)"""


@register("m1_upsert_by_path", _UPSERT_SQL)
def m1(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "id", "path", "title", "created_at", "modified_at")
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    ex = d.filter(F.col("created_at") < ts("2024-02-01 00:00:00"))
    inc = d.filter(F.col("created_at") >= ts("2024-01-20 00:00:00")).select(
        "doc_id", F.md5(F.concat("path", F.lit("#2"))).alias("id"), "path", F.concat("title", F.lit(" v2")).alias("title"),
        F.timestamp_add("DAY", F.lit(1), "created_at").alias("created_at"), "modified_at")
    return R.upsert(ex, inc).select("doc_id", "id", "path", "title", "created_at")


@register("m2_update_by_id", f"{WB} SELECT doc_id, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status, "
          f"CASE WHEN status = 'failed' THEN TIMESTAMP '{AS_OF}' ELSE modified_at END AS modified_at, created_at FROM docs_b")
def m2(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "id", "status", "modified_at", "created_at")
    patch = d.filter(F.col("status") == "failed").select("id", F.lit("pending").alias("status"),
                                                         F.lit(None).cast("timestamp_ntz").alias("created_at"))
    return R.update_by_id(d, patch, AS_OF).select("doc_id", "status", "modified_at", "created_at")


@register("m3_bulk_delete", f"{WB} SELECT doc_id, format FROM docs_b WHERE format <> 'json'")
def m3(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "id", "format")
    return R.bulk_delete(d, d.filter(F.col("format") == "json")).select("doc_id", "format")


@register("m3_bulk_update", f"{WB} SELECT doc_id, CASE WHEN format = 'yaml' THEN 'updated' ELSE status END AS status FROM docs_b")
def m3u(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "id", "format", "status")
    return R.bulk_update(d, d.filter(F.col("format") == "yaml"), status="updated").select("doc_id", "status")


@register("m4_store_counts", f"{WB} SELECT count(*) AS stored, count(*) FILTER (WHERE e.path IS NULL) AS new, "
          "count(*) FILTER (WHERE e.path IS NOT NULL) AS updated FROM docs_b n "
          "LEFT JOIN (SELECT path FROM docs_b WHERE status = 'indexed') e USING (path)")
def m4(spark, sf_dir):
    d = _docs(spark, sf_dir).select("path", "id", "created_at", "status")
    return R.store_counts(d.filter(F.col("status") == "indexed"), d)


@register("a1_count_with_tags", f"WITH {Q.DOCS_BASE}, {Q.DOC_TAGS} SELECT count(*) AS count FROM docs_b "
          "WHERE format = 'markdown' AND doc_id IN (SELECT doc_id FROM doc_tags WHERE tag = 'en')")
def a1(spark, sf_dir):
    return R.count_documents(_docs(spark, sf_dir), {"format": "markdown"}, tags=["en"],
                             doc_tags=tc.doc_tags(spark, sf_dir))
