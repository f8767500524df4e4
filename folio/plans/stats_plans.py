"""Registered statistics, window and health queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio import constants as C
from folio.operators import stats as S
from folio.operators.search import positions
from folio.plans import sql as Q
from folio.plans.registry import register
from folio.plans.search_plans import bm25_top20, BM25_SQL
from folio.sources import testcorpus as tc

AS_OF = C.TEST_AS_OF
WB = f"WITH {Q.DOCS_BASE}"


def _docs(spark, sf_dir):
    return tc.documents(spark, sf_dir, with_labels=False)


@register("a2_per_format", f"{WB} SELECT format, count(*) AS count FROM docs_b GROUP BY format")
def a2(spark, sf_dir):
    return S.per_value_counts(_docs(spark, sf_dir), "format")


@register("a3_format_shares", f"{WB}, g AS (SELECT format, count(*) AS count FROM docs_b GROUP BY format) "
          "SELECT format, count, round(count * 100.0 / (SELECT sum(count) FROM g), 2) AS percent, "
          "CAST(floor(count * 40 / (SELECT max(count) FROM g)) AS INTEGER) AS bar FROM g")
def a3(spark, sf_dir):
    return S.format_shares(_docs(spark, sf_dir), "format")


@register("a4_top_categories", f"{WB} SELECT category, count(*) AS count FROM docs_b GROUP BY category "
          "ORDER BY count DESC, category LIMIT 10")
def a4(spark, sf_dir):
    return S.top_values(_docs(spark, sf_dir), "category", 10)


@register("a4_per_status", f"{WB} SELECT status, count(*) AS count FROM docs_b GROUP BY status")
def a4s(spark, sf_dir):
    return S.per_value_counts(_docs(spark, sf_dir), "status")


@register("a5_period_counts", f"{WB} SELECT "
          f"count(*) FILTER (WHERE created_at >= date_trunc('day', TIMESTAMP '{AS_OF}')) AS today, "
          f"count(*) FILTER (WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS last_7_days, "
          f"count(*) FILTER (WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS last_30_days, "
          "count(*) AS all_time FROM docs_b")
def a5(spark, sf_dir):
    return S.period_counts(_docs(spark, sf_dir), AS_OF, "created_at")


@register("a6_scan_history", "WITH runs AS (SELECT o_orderdate AS started_at, count(*) AS total_files, "
          "sum(o_totalprice) / 100000.0 AS duration FROM orders GROUP BY o_orderdate) "
          "SELECT count(*) AS total_scans, max(started_at) AS last_scan, CAST(sum(total_files) AS BIGINT) AS total_scanned, "
          "round(sum(round(duration, 3)), 3) AS total_duration FROM runs")
def a6(spark, sf_dir):
    return S.scan_history(tc.scan_runs(spark, sf_dir))


@register("a7_corpus_profile", f"{WB} SELECT 'total' AS dimension, 'all' AS value, count(*) AS count, "
          "CAST(sum(size) AS BIGINT) AS total_size FROM docs_b "
          "UNION ALL SELECT 'format', format, count(*), CAST(sum(size) AS BIGINT) FROM docs_b GROUP BY format "
          "UNION ALL SELECT 'status', status, count(*), CAST(sum(size) AS BIGINT) FROM docs_b GROUP BY status "
          "UNION ALL SELECT 'category', category, count(*), CAST(sum(size) AS BIGINT) FROM docs_b GROUP BY category")
def a7(spark, sf_dir):
    return S.corpus_profile(_docs(spark, sf_dir))


@register("a8_index_freshness", f"{WB} SELECT max(indexed_at) AS last_indexed, "
          f"CAST(date_sub('day', max(indexed_at), TIMESTAMP '{AS_OF}') AS INTEGER) AS age_days, "
          f"CASE WHEN date_sub('day', max(indexed_at), TIMESTAMP '{AS_OF}') <= 0 THEN 'fresh' "
          f"WHEN date_sub('day', max(indexed_at), TIMESTAMP '{AS_OF}') < 7 THEN 'recent' "
          "ELSE 'stale' END AS band FROM docs_b")
def a8(spark, sf_dir):
    return S.index_freshness(_docs(spark, sf_dir), AS_OF)


@register("a9_counters", f"WITH {Q.METRICS} SELECT name, round(sum(value), 6) AS total, count(*) AS increments "
          "FROM metrics GROUP BY name")
def a9(spark, sf_dir):
    return S.counters(tc.metrics(spark, sf_dir))


@register("a10_table_counts", f"WITH {Q.CATEGORIES}, {Q.DOC_TAGS} "
          "SELECT 'documents' AS \"table\", count(*) AS rows FROM documents "
          "UNION ALL SELECT 'categories', count(*) FROM categories "
          "UNION ALL SELECT 'tags', count(DISTINCT tag) FROM doc_tags")
def a10(spark, sf_dir):
    return S.table_counts(documents=tc.table(spark, sf_dir, "documents"),
                          categories=tc.categories(spark, sf_dir),
                          tags=tc.doc_tags(spark, sf_dir).select("tag").distinct())


W1_SQL = f"""WITH {Q.METRICS},
m AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts DESC, event_id DESC) AS rn FROM metrics)
SELECT name, count(*) AS kept, count(*) FILTER (WHERE rn <= 100) AS count,
       min(value) FILTER (WHERE rn <= 100) AS min, max(value) FILTER (WHERE rn <= 100) AS max,
       round(avg(value) FILTER (WHERE rn <= 100), 6) AS avg,
       max(value) FILTER (WHERE rn = 1) AS latest, max(unit) FILTER (WHERE rn = 1) AS unit
FROM m WHERE rn <= 1000 GROUP BY name"""


@register("w1_metric_history", W1_SQL)
def w1(spark, sf_dir):
    return S.metric_history(tc.metrics(spark, sf_dir))


W2_SQL = f"""WITH {Q.FILE_EVENTS},
e AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS tick FROM file_events),
r AS (SELECT *, row_number() OVER (PARTITION BY tick, path ORDER BY ts DESC, event_id DESC) AS rn FROM e)
SELECT tick, event_id, type, path, old_path, ts, value, user_id FROM r WHERE rn = 1"""


@register("w2_debounce_latest", W2_SQL)
def w2(spark, sf_dir):
    return S.latest_per_key(tc.file_events(spark, sf_dir), "path", "1 hour")


@register("w3_hit_positions", "WITH h AS (" + BM25_SQL.strip() + ") SELECT doc_id, score, "
          "CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM h")
def w3(spark, sf_dir):
    # ranks a bounded page (20 rows), so the un-partitioned window is cheap
    return positions(bm25_top20(spark, sf_dir).select("doc_id", "score"))


@register("w4_largest_per_category", f"{WB}, r AS (SELECT doc_id, category, size, row_number() OVER "
          "(PARTITION BY category ORDER BY size DESC, doc_id) AS rank FROM docs_b) "
          "SELECT doc_id, category, size, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def w4(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "category", "size")
    return S.top_k_per_group(d, ["category"], [F.col("size").desc(), F.col("doc_id")], 3)


H1_SQL = f"""WITH {Q.METRICS},
l AS (SELECT name, arg_max(value, (ts, event_id)) AS value FROM metrics GROUP BY name)
SELECT name, value, CAST(CASE WHEN name = 'view' THEN 10.0 ELSE 90.0 END AS DOUBLE) AS threshold,
       coalesce(value <= CASE WHEN name = 'view' THEN 10.0 ELSE 90.0 END, false) AS healthy,
       CASE WHEN value IS NULL THEN name || ': no data'
            WHEN value <= CASE WHEN name = 'view' THEN 10.0 ELSE 90.0 END THEN name || ': ok'
            ELSE name || ' above threshold' END AS message
FROM l"""


@register("h1_threshold_checks", H1_SQL)
def h1(spark, sf_dir):
    return S.threshold_checks(tc.metrics(spark, sf_dir), {"view": 10.0})


@register("h1_overall_health", "SELECT bool_and(healthy) AS healthy, count(*) FILTER (WHERE NOT healthy) AS failing, "
          "count(*) AS checks FROM (" + H1_SQL + ") c")
def h1_overall(spark, sf_dir):
    return S.overall_health(S.threshold_checks(tc.metrics(spark, sf_dir), {"view": 10.0}))


@register("h2_table_health", f"{WB} SELECT count(*) AS documents, count(*) FILTER (WHERE status = 'indexed') AS indexed, "
          "count(*) = count(*) FILTER (WHERE status = 'indexed') AS in_sync FROM docs_b")
def h2(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "status")
    return S.table_health(d, d.filter(F.col("status") == "indexed"))


# every seventh document has its language tag twice, every eleventh in capitals
H3_SQL = f"""WITH {Q.DOCS_BASE}, {Q.DOC_TAGS}, {Q.CATEGORIES},
edges AS (SELECT * FROM doc_tags UNION ALL SELECT doc_id, lang FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id, upper(lang) FROM documents WHERE doc_id % 11 = 0)
SELECT 'duplicate_path' AS "check", CAST(coalesce(sum(n), 0) AS BIGINT) AS violations
  FROM (SELECT count(*) AS n FROM docs_b GROUP BY path HAVING count(*) > 1)
UNION ALL SELECT 'duplicate_category_name', CAST(coalesce(sum(n), 0) AS BIGINT)
  FROM (SELECT count(*) AS n FROM categories GROUP BY name HAVING count(*) > 1)
UNION ALL SELECT 'orphan_tag_edges', count(*) FROM doc_tags WHERE doc_id NOT IN (SELECT doc_id FROM docs_b)
UNION ALL SELECT 'orphan_category_edges', count(*) FROM doc_categories WHERE category_id NOT IN (SELECT id FROM categories)
UNION ALL SELECT 'missing_parent', count(*) FROM categories WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM categories)
UNION ALL SELECT 'missing_title', count(*) FROM docs_b WHERE title IS NULL OR trim(title) = ''
UNION ALL SELECT 'duplicate_tag_edges', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM edges GROUP BY doc_id, tag HAVING count(*) > 1)
UNION ALL SELECT 'duplicate_category_edges', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM doc_categories GROUP BY doc_id, category_id HAVING count(*) > 1)
UNION ALL SELECT 'unclear_tag_names', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n, lower(trim(tag)) AS t FROM (SELECT DISTINCT tag FROM edges)
  GROUP BY lower(trim(tag)) HAVING count(*) > 1 OR lower(trim(tag)) = '')"""


@register("h3_integrity", H3_SQL)
def h3(spark, sf_dir):
    d = tc.table(spark, sf_dir, "documents")
    edges = (tc.doc_tags(spark, sf_dir).unionByName(d.filter("doc_id % 7 = 0").select("doc_id", F.col("lang").alias("tag")))
             .unionByName(d.filter("doc_id % 11 = 0").select("doc_id", F.upper("lang").alias("tag"))))
    return S.integrity(_docs(spark, sf_dir), edges, tc.categories(spark, sf_dir),
                       tc.doc_categories(spark, sf_dir))
