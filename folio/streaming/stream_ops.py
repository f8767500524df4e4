"""Structured Streaming operators.

Streams read files as they arrive (`readStream`), keep state in the state
store (watermarked windows) or in change logs written by
`foreachBatch`, and write to sinks with a checkpoint in the shared folder
named by `spark.checkpoint.dir`. Every foreachBatch writer is idempotent per
batch id: a retried batch rewrites its own partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from folio.functions.text import format_of
from folio.operators import index as ix
from folio.operators import search as srch
from folio.sources import files as S
from folio.session import scratch_path, written


# ----------------------------------------------------------------------------- sources
def table_stream(spark: SparkSession, directory: str, name: str, max_files: int = 1) -> DataFrame:
    """A parquet table of a folder as a stream source: `name.parquet` as a
    single file (new files of that name pattern are picked up as they land)
    or as a folder of part files (new parts are picked up)."""
    path = f"{directory.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    jvm = spark._jvm
    hp = jvm.org.apache.hadoop.fs.Path(path)
    is_dir = hp.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hp).isDirectory()
    rs = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if is_dir:
        return rs.parquet(path)
    return rs.option("pathGlobFilter", f"{name}.parquet").parquet(directory)


def watch_directory(spark: SparkSession, root: str, ignore=None, extensions=None) -> DataFrame:
    """New files under `root` arrive as document rows (S2-S7 on the
    stream). The file source sees new files only; a FolderWatch
    (sources/folders.py) sees changes and deletes too, over several roots."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"  # binaryFile's fixed schema
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)
    raw = raw.filter(~S.ignored(S.local_path("path"), ignore or S.C.DEFAULT_IGNORE, root=root))
    ident = S.identify(raw)
    ident = ident.filter(S.extension_allowed(F.col("path"), extensions)) if extensions else \
        ident.filter(F.col("format") != "unknown")
    dec = S.decode(ident)
    return dec.select("id", S.local_path("path").alias("path"), F.col("text").alias("content"), "content_hash",
                      "format", "size", "created_at", "modified_at", "status", "error")


# ----------------------------------------------------------------------------- E2 / E8
def to_event_time(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP: NTZ event times are read as UTC wall time."""
    return events.withColumn("event_time", F.col(ts).cast("timestamp"))


def debounce(events: DataFrame, tick: str = "1 second", watermark: str = "10 seconds",
             key: str = "path") -> DataFrame:
    """Latest event per key within each tick, emitted once the watermark
    passes the end of the tick (append mode). Ties on time resolve by
    event_id. Output: tick (TIMESTAMP_NTZ start) + the event columns."""
    cols = [c for c in events.columns]
    ev = to_event_time(events).withWatermark("event_time", watermark)
    agg = (ev.groupBy(F.window("event_time", tick).alias("w"), key)
           .agg(F.max_by(F.struct(*cols), F.struct("event_time", "event_id")).alias("e")))
    return agg.select(F.col("w.start").cast("timestamp_ntz").alias("tick"), "e.*")


def filter_events(events: DataFrame, ignore=None, formats=None) -> DataFrame:
    """Ignore globs and format allow-list on event paths; deletes always pass."""
    keep = F.lit(True)
    if ignore:
        keep = keep & ~S.ignored(F.col("path"), ignore)
    if formats:
        keep = keep & format_of(F.col("path")).isin(list(formats))
    return events.filter(keep | (F.col("type") == "deleted"))


# ----------------------------------------------------------------------------- E3
STATE_COLS = ("path", "id", "last_ts", "value")
TOUCH_SCHEMA = ("path string, ts timestamp_ntz, event_id bigint, value double, type string, "
                "old_path string, present boolean, kind string, id string")
_TOUCH_COLS = [f.split()[0] for f in TOUCH_SCHEMA.split(", ")]
#: Order of the touches of one event on one path: a state row stands before events of its time, leaving before arriving.
_KIND_ORDER = {"state": 0, "out": 1, "drop": 1, "in": 2, "set": 2}


def touches(events: DataFrame) -> DataFrame:
    """What events do to paths: created and modified set one, deleted drops
    one, moved leaves the old (`out`) and takes the new one (`in`)."""
    kind = F.when(F.col("type") == "deleted", "drop").when(F.col("type") == "moved", "in").otherwise("set")
    own = events.select("path", "ts", "event_id", "value", "type", "old_path", (F.col("type") != "deleted").alias("present"), kind.alias("kind"))
    left = events.filter(F.col("type") == "moved").select(
        F.col("old_path").alias("path"), "ts", "event_id", "value", "type", "old_path", F.lit(False).alias("present"), F.lit("out").alias("kind"))
    return own.unionByName(left).withColumn("id", F.lit(None).cast("string")).select(*_TOUCH_COLS)


def resolve(all_touches: DataFrame) -> DataFrame:
    """The last touch of every path, with the id of the document there.

    A document begins where a path is set that holds none, under md5(path), and
    keeps its id while it is modified or moved, over any number of moves. A
    move takes the place of what was there; one from an empty path begins a
    document. So the result depends on the set of touches alone, not on the
    batches they came in.

    Each stretch in which a path holds one document is a node; a move links its
    stretch to the one it ended at the old path. Links are followed by pointer
    jumping, a table in the shared folder a round."""
    order = [F.col("ts"), F.coalesce("event_id", F.lit(-1)), F.element_at(F.create_map(*[F.lit(x) for kv in _KIND_ORDER.items() for x in kv]), F.col("kind"))]
    w = Window.partitionBy("path").orderBy(*order)
    was = F.coalesce(F.lag("present").over(w), F.lit(False))
    once = all_touches.dropDuplicates(["path", "ts", "event_id", "kind"])
    begins = F.col("present") & (F.col("kind").isin("in", "state") | ~F.col("was"))
    seen = (once.withColumn("was", was)
            .withColumn("node", F.when(begins, F.concat_ws("|", "kind", F.col("event_id").cast("string"), "path")))
            .withColumn("start", F.last("node", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    seen = written(seen, "e3-touches")
    outs = seen.filter("kind = 'out' and was").select("event_id", F.col("start").alias("parent"))
    begun = seen.filter("node is not null").select("node", F.when(F.col("kind") == "in", F.col("event_id")).alias("event_id"), F.coalesce("id", F.md5("path")).alias("own"))
    nodes = written(begun.join(outs, "event_id", "left").select("node", "parent", F.when(F.col("parent").isNull(), F.col("own")).alias("id")), "e3-nodes")
    while nodes.filter("id is null").limit(1).count():
        up = nodes.select(F.col("node").alias("parent"), F.col("parent").alias("next"), F.col("id").alias("up_id"))
        done = nodes.filter("id is not null")
        step = nodes.filter("id is null").join(up, "parent").select("node", F.col("next").alias("parent"), F.col("up_id").alias("id"))
        nodes = written(done.unionByName(step), "e3-nodes")
    last = seen.groupBy("path").agg(F.max_by(F.struct("ts", "event_id", "value", "type", "old_path", "present", "start"), F.struct(*order)).alias("e")).select("path", "e.*")
    ids = nodes.select(F.col("node").alias("start"), "id")
    out = last.join(ids, "start", "left").withColumn("id", F.when(F.col("present"), F.col("id"))).withColumn("kind", F.lit("state"))
    return out.select(*_TOUCH_COLS)


def _state(resolved: DataFrame) -> DataFrame:
    return resolved.filter("present").select("path", "id", F.col("ts").alias("last_ts"), "value")


def apply_events(state: DataFrame, events: DataFrame) -> DataFrame:
    """E3 on one batch: state(path, id, last_ts, value) and events -> new state."""
    held = state.select("path", F.col("last_ts").alias("ts"), F.lit(None).cast("bigint").alias("event_id"), "value", F.lit(None).cast("string").alias("type"),
                        F.lit(None).cast("string").alias("old_path"), F.lit(True).alias("present"), F.lit("state").alias("kind"), "id")
    return _state(resolve(held.unionByName(touches(events))))


class ChangeLog:
    """Append-only log of micro-batch outputs with merge-on-read: batch b
    writes only its own partition `batch=b` (overwritten when the batch is
    retried), so a batch costs its own size, not the size of the state.
    Readers combine the partitions; `compact` folds them into a snapshot
    that later reads start from."""

    def __init__(self, spark: SparkSession, base: str, empty: DataFrame):
        self.spark, self.base = spark, base.rstrip("/")
        self.schema = empty.schema

    def append(self, batch_id: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.base}/log/batch={batch_id}")

    def _fs(self):
        jvm = self.spark._jvm
        return jvm, jvm.org.apache.hadoop.fs.Path(self.base).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _snapshot(self) -> int | None:
        """Batch number folded into the latest committed snapshot, if any."""
        jvm, fs = self._fs()
        p = jvm.org.apache.hadoop.fs.Path(f"{self.base}/snapshot")
        if not fs.exists(p):
            return None
        done = [int(st.getPath().getName().split("=")[1]) for st in fs.listStatus(p)
                if st.getPath().getName().startswith("upto=")
                and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{st.getPath().toString()}/_SUCCESS"))]
        return max(done) if done else None

    def read(self) -> DataFrame:
        """Rows with their `batch`: the latest snapshot (as batch = its
        horizon) plus the log partitions after it (pruned by partition)."""
        jvm, fs = self._fs()
        schema = StructType(list(self.schema.fields) + [StructField("batch", IntegerType())])
        snap = self._snapshot()
        out = self.spark.createDataFrame([], schema)
        if snap is not None:
            out = self.spark.read.schema(self.schema).parquet(f"{self.base}/snapshot/upto={snap}") \
                .withColumn("batch", F.lit(snap).cast("int"))
        if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.base}/log")):
            log = self.spark.read.schema(schema).parquet(f"{self.base}/log")
            out = out.unionByName(log.filter(F.col("batch") > snap) if snap is not None else log)
        return out

    def compact(self, merged: DataFrame, upto_batch: int) -> None:
        """Write the merged state of batches <= upto_batch as the new snapshot;
        later reads skip those log partitions. Idempotent per horizon."""
        merged.select(*self.schema.fieldNames()).write.mode("overwrite") \
            .parquet(f"{self.base}/snapshot/upto={upto_batch}")


def latest_touches(log: ChangeLog) -> DataFrame:
    """The last touch per path, also those that drop it, with ids (log schema)."""
    return resolve(log.read().select(*_TOUCH_COLS))


def compact_state(log: ChangeLog, upto_batch: int) -> None:
    """E3 compaction: fold the log up to a batch into a snapshot. Marks of
    deleted paths stay, so that a late older event does not bring one back."""
    log.compact(latest_touches(log), upto_batch)


def compact_postings(log: ChangeLog, upto_batch: int) -> None:
    """E4 compaction: fold the postings log into one segment."""
    log.compact(current_postings(log), upto_batch)


def current_state(log: ChangeLog) -> DataFrame:
    """E3 state (path, id, last_ts, value) of everything logged."""
    return _state(latest_touches(log))


def change_log_sink(log: ChangeLog) -> Callable[[DataFrame, int], None]:
    """E3 foreachBatch on a change log: the batch's touches are appended as
    partition b. Nothing else is read or written, so a batch costs its own size;
    readers resolve ids, and compact_state() folds the log."""
    def run(batch: DataFrame, batch_id: int) -> None:
        log.append(batch_id, touches(batch))
    return run


def empty_touches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TOUCH_SCHEMA)


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "path string, id string, last_ts timestamp_ntz, value double")


# ----------------------------------------------------------------------------- E4
def index_log_sink(log: ChangeLog, to_docs: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """E4 foreachBatch on a change log: the postings of the batch's documents
    are appended as partition b, with one row without a term for each, so a
    document without text left loses its old postings; nothing already written
    is rewritten."""
    def run(batch: DataFrame, batch_id: int) -> None:
        docs = to_docs(batch)
        fresh = ix.build_index(docs, keyword_fields=(), positions=False, by_document=True).postings
        touched = docs.select(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("term"), "doc_id",
                              F.lit(0).cast("long").alias("tf"), F.lit(0).alias("dl"))
        log.append(batch_id, fresh.select("field", "term", "doc_id", "tf", "dl").unionByName(touched))
    return run


def segment_sink(index, to_docs: Callable[[DataFrame], DataFrame], first: int = 0) -> Callable[[DataFrame, int], None]:
    """E4 foreachBatch on a SegmentedIndex: rows whose `change` is deleted take
    their doc_id out of the index, all others are (re)indexed; one segment a batch,
    rewritten when the batch is retried. Of several rows of one doc_id in a
    batch the last version counts."""
    def run(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy("doc_id").agg(F.max_by(F.struct(*batch.columns), F.col("version")).alias("e")).select("e.*")
        last = written(last, "segment-batch")  # read several times below
        docs = to_docs(last.filter("change <> 'deleted'"))
        index.apply(first + batch_id, docs, last.filter("change = 'deleted'").select("doc_id"))
    return run


def current_postings(log: ChangeLog) -> DataFrame:
    """E4 merge-on-read: a document's postings come from the latest batch
    that indexed it (T15 delete + T2 add, without rewriting). Only what later
    batches replaced is looked up, so postings are not shuffled by document."""
    rows = log.read()
    again = rows.groupBy("doc_id").agg(F.min("batch").alias("first"), F.max("batch").alias("last")).filter("first < last")
    live = rows.filter(F.col("term").isNotNull() & F.col("doc_id").isNotNull()).join(written(again.select("doc_id", "last"), "e4-again"), "doc_id", "left")
    return live.filter("last is null or batch = last").select("doc_id", "field", "term", "tf", "dl")


def empty_postings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "field string, term string, doc_id bigint, tf bigint, dl int")


# ----------------------------------------------------------------------------- E5 / E9
def watch_stats(events: DataFrame) -> DataFrame:
    """E5: events per type and the time of the last one (complete output)."""
    return events.groupBy("type").agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_update"))


def running_totals(metrics: DataFrame) -> DataFrame:
    """Running sum and count per metric name."""
    return metrics.groupBy("name").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("increments"))


def overwrite_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Complete-mode results as a table rewritten each batch (idempotent)."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)
    return run


# ----------------------------------------------------------------------------- E6 / E7
def live_search_sink(index: ix.Index, out: str, k: int = 10, min_chars: int = 2) -> Callable[[DataFrame, int], None]:
    """E6 foreachBatch: every incoming query of at least `min_chars` chars is
    answered from the index (top k per query); the batch id partitions the
    output so a retried batch replaces its own part."""
    def run(batch: DataFrame, batch_id: int) -> None:
        q = batch.filter(F.char_length(F.trim("text")) >= min_chars)
        res = srch.search_many(index, q, k=k)
        res.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")
    return run


def topic_feed(changes: DataFrame, subscriptions: DataFrame, topic: str = "document_update") -> DataFrame:
    """Change rows become JSON messages on a topic, delivered to the
    subscribers of that topic and user (stream-static equi-join)."""
    msg = changes.select("event_id", "user_id", F.lit(topic).alias("topic"),
                         F.to_json(F.struct("type", "path", "event_id")).alias("message"))
    return msg.join(subscriptions, ["topic", "user_id"])


# ----------------------------------------------------------------------------- runner
def run_available_now(df: DataFrame, name: str, fmt: str = "parquet", output_mode: str = "append",
                      foreach_batch: Callable | None = None, base: str | None = None) -> str:
    """Run a stream over everything available now, with its checkpoint and
    (for file sinks) its output under the shared checkpoint folder, or below
    `base` to go on where an earlier run ended. Returns the output path."""
    spark = df.sparkSession
    base = base or scratch_path(spark, name)
    w = df.writeStream.option("checkpointLocation", f"{base}/_checkpoint").outputMode(output_mode) \
        .trigger(availableNow=True)
    if foreach_batch is not None:
        q: StreamingQuery = w.foreachBatch(foreach_batch).start()
    else:
        q = w.format(fmt).option("path", f"{base}/out").start()
    q.awaitTermination()
    return f"{base}/out"
