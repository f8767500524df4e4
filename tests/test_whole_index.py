"""Readers of a whole index: no job while a plan is built, no shuffle of postings, compaction that grows in files."""

import glob

from pyspark.sql import functions as F

from folio.operators import blocks as B
from folio.operators import index as ix
from folio.session import scratch_path, spread


def frame(spark, n=60):
    rows = [(i, f"Title {i % 7}", " ".join(f"w{(i * j) % 23}" for j in range(i % 9))) for i in range(n)] + [(3, "Title x", "w1 w1 w2"), (None, None, "w5"), (None, "t9", None)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, content string")
    return docs.select("*", *[F.lit("V").alias(c) for c in ("format", "category", "status")], F.array(F.lit("a"), F.lit("B")).alias("tags"))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_spread_runs_no_job(spark):
    joined = frame(spark).repartition(2).join(spark.range(30).withColumnRenamed("id", "doc_id"), "doc_id")
    spark.sparkContext.setJobGroup("spread", "spread")
    try:
        spread(joined, 64)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("spread")
    finally:
        spark.sparkContext.setJobGroup("other", "other")


def test_by_document_equals_and_shuffles_documents_only(spark):
    docs = frame(spark)
    a, b = ix.build_index(docs), ix.build_index(docs, by_document=True)
    assert rows_of(a.postings) == rows_of(b.postings) and rows_of(a.vocab) == rows_of(b.vocab) and rows_of(a.stats) == rows_of(b.stats)
    plan = ix.build_index(docs, by_document=True).postings._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION" in plan


def test_deleting_takes_lengths_from_the_documents(spark):
    docs, gone = frame(spark), frame(spark).filter("doc_id % 3 = 1").select("doc_id")
    known = ix.build_index(docs)
    unknown = ix.Index(known.postings, known.vocab, known.stats, known.docs, fields=known.fields, text_fields=known.text_fields)
    a, b = ix.delete_from_index(known, gone), ix.delete_from_index(unknown, gone)
    assert rows_of(a.stats) == rows_of(b.stats) and rows_of(a.vocab) == rows_of(b.vocab)
    assert "tf" not in a.stats._jdf.queryExecution().optimizedPlan().toString()


def test_compaction_grows_in_files(spark, monkeypatch):
    src, dst = scratch_path(spark, "src"), scratch_path(spark, "dst")
    docs = frame(spark)
    ix.write_index(ix.build_index(docs), src)
    monkeypatch.setattr(ix, "FILE_POSTINGS", 40, raising=False)
    idx = ix.compact_index(spark, src, dst, 2, docs)
    n = idx.postings.count()
    assert len(glob.glob(f"{dst.removeprefix('file:')}/postings/part-*.parquet")) > n // 80
    assert rows_of(idx.postings) == rows_of(ix.read_index(spark, src, docs).postings)


def test_unrouted_queries_read_lists_once(spark):
    docs = frame(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    path = scratch_path(spark, "blocks")
    ix.write_index(ix.build_index(docs), path, shard_docs=5)
    idx = ix.read_index(spark, path, docs)
    asked = spark.createDataFrame([(f"q{i}", [f"w{i % 23}", f"w{(i * 5) % 23}", "none"]) for i in range(40)], "query string, terms array<string>")
    for k in (1, 3, 500):
        some = B.best_documents(idx, asked, k, ("title", "content"))
        every = B.best_documents(idx, asked, k, ("title", "content"), routed=0)
        assert rows_of(some) == rows_of(every) and some.count()
    plan = every._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan  # lists are not copied for blocks of queries
