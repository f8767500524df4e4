"""Registered streaming queries (E2-E9): each runs its stream over the
test table with `availableNow` into the shared checkpoint folder and
returns the sink's contents for comparison with the batch oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import index as ix
from folio.plans import sql as Q
from folio.plans.registry import register
from folio.plans.search_plans import T2_SQL, corpus_index
from folio.session import scratch_path
from folio.sources import testcorpus as tc
from folio.streaming import stream_ops as E


def _events(spark, sf_dir):
    return tc.file_events_from(E.table_stream(spark, sf_dir, "events"))


E2_SQL = f"""WITH {Q.FILE_EVENTS},
e AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS tick FROM file_events),
r AS (SELECT *, row_number() OVER (PARTITION BY tick, path ORDER BY ts DESC, event_id DESC) AS rn FROM e)
SELECT tick, event_id, type, path, old_path, ts, value, user_id FROM r
WHERE rn = 1 AND tick + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 SECOND"""


@register("e2_debounce_stream", E2_SQL)
def e2(spark, sf_dir):
    out = E.run_available_now(E.debounce(_events(spark, sf_dir), "1 hour", "10 seconds"), "e2-debounce")
    return spark.read.parquet(out)


E3_SQL = f"""WITH RECURSIVE {Q.FILE_EVENTS},
touch AS (SELECT path AS p, ts, event_id, value, type <> 'deleted' AS present, CASE type WHEN 'deleted' THEN 'drop' WHEN 'moved' THEN 'in' ELSE 'set' END AS kind,
                 CASE type WHEN 'deleted' THEN 1 ELSE 2 END AS o FROM file_events
          UNION ALL SELECT old_path, ts, event_id, value, false, 'out', 1 FROM file_events WHERE type = 'moved'),
w AS (SELECT *, coalesce(lag(present) OVER (PARTITION BY p ORDER BY ts, event_id, o), false) AS was FROM touch),
n AS (SELECT *, CASE WHEN present AND (kind = 'in' OR NOT was) THEN kind || event_id || p END AS node FROM w),
s AS (SELECT *, last_value(node IGNORE NULLS) OVER (PARTITION BY p ORDER BY ts, event_id, o ROWS UNBOUNDED PRECEDING) AS start FROM n),
link AS (SELECT a.node, b.start AS parent, md5(a.p) AS own FROM s a LEFT JOIN s b ON a.kind = 'in' AND b.kind = 'out' AND b.was AND a.event_id = b.event_id
         WHERE a.node IS NOT NULL),
ids AS (SELECT node, own AS id FROM link WHERE parent IS NULL UNION ALL SELECT l.node, i.id FROM link l JOIN ids i ON l.parent = i.node),
r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY ts DESC, event_id DESC, o DESC) AS rn FROM s)
SELECT p AS path, ids.id AS id, ts AS last_ts, value FROM r JOIN ids ON r.start = ids.node WHERE rn = 1 AND present"""


@register("e3_apply_file_events", E3_SQL)
def e3(spark, sf_dir):
    log = E.ChangeLog(spark, scratch_path(spark, "e3-state"), E.empty_touches(spark))
    E.run_available_now(_events(spark, sf_dir), "e3-apply", foreach_batch=E.change_log_sink(log))
    return E.current_state(log).select("path", "id", "last_ts", "value")


@register("e4_stream_indexing", T2_SQL)
def e4(spark, sf_dir):
    log = E.ChangeLog(spark, scratch_path(spark, "e4-index"), E.empty_postings(spark))
    docs = E.table_stream(spark, sf_dir, "documents")
    E.run_available_now(docs, "e4-index", foreach_batch=E.index_log_sink(log, tc.documents_from))
    post = E.current_postings(log)
    return post.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


E4D_SQL = f"""WITH later AS (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'renewed ' || text ELSE text END AS text, lang, source FROM documents WHERE doc_id % 4 <> 2 OR doc_id % 8 = 2),
{Q.DOCS.replace('FROM documents)', 'FROM later)', 1)}, {Q.tokens_cte()}, {Q.postings_cte("field IN ('title', 'content', 'category')")}
SELECT field, term, df, CAST(cf AS BIGINT) AS cf, round(avgdl, 6) AS avgdl, n_docs FROM (SELECT field, term, count(*) AS df, sum(tf) AS cf FROM post GROUP BY field, term) JOIN st USING (field)"""


@register("e4_index_changes", E4D_SQL)
def e4_changes(spark, sf_dir):
    """Adds, changes and deletes of documents streamed into a segmented index: counts and statistics after three versions."""
    from folio.operators.segments import SegmentedIndex

    raw = tc.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    told = lambda df, v, change: df.withColumn("version", F.lit(v)).withColumn("change", F.lit(change))
    m = F.col("doc_id") % 4
    versions = [told(raw, 1, "added"),
                told(raw.filter(m == 1).withColumn("text", F.concat(F.lit("renewed "), "text")), 2, "modified").unionByName(told(raw.filter(m == 2), 2, "deleted")),
                told(raw.filter("doc_id % 8 = 2"), 3, "added")]
    feed, base = scratch_path(spark, "e4-feed"), scratch_path(spark, "e4-segments")
    index = SegmentedIndex(spark, f"{base}/index", keyword_fields=("category",))
    for v, rows in enumerate(versions):
        rows.write.mode("append").parquet(feed)
        stream = spark.readStream.schema(rows.schema).parquet(feed)
        E.run_available_now(stream, "e4-changes", foreach_batch=E.segment_sink(index, tc.documents_from), base=base)
    idx = index.open(tc.documents(spark, sf_dir, with_labels=False))
    return idx.vocab.join(idx.stats, "field").select("field", "term", "df", "cf", F.round("avgdl", 6).alias("avgdl"), "n_docs")


@register("e5_watch_stats", f"WITH {Q.FILE_EVENTS} SELECT type, count(*) AS events, max(ts) AS last_update "
          "FROM file_events GROUP BY type")
def e5(spark, sf_dir):
    out = scratch_path(spark, "e5-stats")
    E.run_available_now(E.watch_stats(_events(spark, sf_dir)), "e5-stats", output_mode="complete",
                        foreach_batch=E.overwrite_sink(out))
    return spark.read.parquet(out)


E6_SQL = f"""WITH {Q.DOCS}, {Q.HISTORY}, {Q.tokens_cte()},
qs AS (SELECT user_id * 1000 + turn AS qid, query FROM search_history WHERE length(trim(query)) >= 2),
qt AS (SELECT DISTINCT qid, unnest({Q.analyze('query')}) AS term FROM qs),
{Q.postings_cte("field IN ('title', 'content') AND term IN (SELECT term FROM qt)")},
sc AS (SELECT qt.qid, p.doc_id, round(sum({Q.bm25('p')}), 6) AS score
       FROM qt JOIN post p USING (term) JOIN voc v USING (field, term) JOIN st USING (field) GROUP BY qt.qid, p.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sc)
SELECT qid, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""


#: Files of queries that a batch of the live search takes at most; each query's answer is the same in any batch.
LIVE_FILES = 1000


@register("e6_live_search", E6_SQL)
def e6(spark, sf_dir):
    docs = tc.documents(spark, sf_dir)
    path = scratch_path(spark, "e6-index")
    ix.write_index(corpus_index(spark, sf_dir), path, shard_docs=2000)
    idx = ix.read_index(spark, path, docs)
    # the whole index is read for each batch, so a batch takes all files that are there
    conv = E.table_stream(spark, sf_dir, "conversations", max_files=LIVE_FILES)
    q = tc.search_history_from(conv).select((F.col("user_id") * 1000 + F.col("turn")).alias("qid"),
                                            F.col("query").alias("text"))
    out = scratch_path(spark, "e6-results")
    E.run_available_now(q, "e6-live", foreach_batch=E.live_search_sink(idx, out, k=10))
    return spark.read.parquet(out).select("qid", "doc_id", "score", "rank")


E7_SQL = f"""WITH {Q.FILE_EVENTS},
subs AS (SELECT c_custkey AS subscriber, CASE WHEN c_mktsegment = 'BUILDING' THEN 'scan_progress' ELSE 'document_update' END AS topic,
                CAST(c_custkey AS BIGINT) AS user_id FROM customer)
SELECT s.subscriber, e.event_id, s.topic, json_object('type', e.type, 'path', e.path, 'event_id', e.event_id)::VARCHAR AS message
FROM file_events e JOIN subs s ON s.user_id = e.user_id AND s.topic = 'document_update'"""


@register("e7_topic_feed", E7_SQL)
def e7(spark, sf_dir):
    subs = tc.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("subscriber"),
        F.when(F.col("c_mktsegment") == "BUILDING", "scan_progress").otherwise("document_update").alias("topic"),
        F.col("c_custkey").cast("long").alias("user_id"))
    feed = E.topic_feed(_events(spark, sf_dir), subs)
    out = E.run_available_now(feed.select("subscriber", "event_id", "topic", "message"), "e7-feed")
    return spark.read.parquet(out)


@register("e8_event_filters", f"WITH {Q.FILE_EVENTS} SELECT event_id, type, path FROM file_events "
          "WHERE type = 'deleted' OR path NOT LIKE '/m/%'")
def e8(spark, sf_dir):
    f = E.filter_events(_events(spark, sf_dir), ignore=["m"], formats=["markdown"])
    out = E.run_available_now(f.select("event_id", "type", "path"), "e8-filter")
    return spark.read.parquet(out)


@register("e9_running_totals", f"WITH {Q.METRICS} SELECT name, round(sum(value), 6) AS total, count(*) AS increments "
          "FROM metrics GROUP BY name")
def e9(spark, sf_dir):
    out = scratch_path(spark, "e9-totals")
    m = tc.metrics_from(E.table_stream(spark, sf_dir, "events"))
    E.run_available_now(E.running_totals(m), "e9-totals", output_mode="complete", foreach_batch=E.overwrite_sink(out))
    return spark.read.parquet(out).select("name", F.round("total", 6).alias("total"), "increments")
