"""Category edits, completions, bundles and the streaming debounce."""

import datetime as dt
import os

from pyspark.sql import functions as F

from folio.operators import export as O
from folio.operators import suggest as G
from folio.operators import taxonomy as T
from folio.streaming import stream_ops as E

T0 = dt.datetime(2024, 1, 1)


def cats(spark):
    return spark.createDataFrame([("r", "Root", None, 0), ("a", "A", "r", 1), ("b", "B", "a", 2)],
                                 "id string, name string, parent_id string, ord int")


def test_category_counts_subtree(spark):
    edges = spark.createDataFrame([(1, "b"), (2, "b"), (3, "a"), (4, "r")], "doc_id long, category_id string")
    got = {r["id"]: (r["direct"], r["subtree"]) for r in T.category_counts(spark, cats(spark), edges).collect()}
    assert got == {"r": (1, 4), "a": (1, 3), "b": (2, 2)}


def test_delete_category_frees_children_and_moves_docs(spark):
    edges = spark.createDataFrame([(1, "a"), (1, "r"), (2, "a")], "doc_id long, category_id string")
    c2, e2 = T.delete_category(cats(spark), edges, "a", reassign_to="r")
    assert {r["id"]: r["parent_id"] for r in c2.collect()} == {"r": None, "b": None}
    assert sorted(map(tuple, e2.collect())) == [(1, "r"), (2, "r")]


def test_prefix_completion_ranks_by_frequency(spark):
    sugg = spark.createDataFrame([("python", "tag", 5), ("pytest", "tag", 9), ("java", "tag", 7)],
                                 "term string, type string, frequency long")
    pre = spark.createDataFrame([("py",), ("ja",)], "prefix string")
    got = [(r["prefix"], r["term"], r["rank"]) for r in
           G.prefix_completion(sugg, pre, k=5).orderBy("prefix", "rank").collect()]
    assert got == [("ja", "java", 1), ("py", "pytest", 1), ("py", "python", 2)]


def test_bundle_numbering(spark):
    docs = spark.createDataFrame([(i, f"T{i:02d}", f"/p{i}", "c", ["x"], "body") for i in range(25)],
                                 "doc_id long, title string, path string, category string, tags array<string>, content string")
    b = O.bundle(docs).orderBy("n").collect()
    assert [r["n"] for r in b] == list(range(1, 26))
    assert b[0]["toc_line"] == "1. [T00](#t00)" and b[0]["body"].startswith("## T00 {#t00}")


def test_debounce_stream_matches_batch(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "ev")
    rows = [(i, "modified", f"/f{i % 3}.md", None, T0 + dt.timedelta(seconds=i * 20), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, type string, path string, old_path string, ts timestamp_ntz, value double")
    df.coalesce(1).write.parquet(os.path.join(src, "events.parquet"))
    stream = E.table_stream(spark, src, "events")
    out = spark.read.parquet(E.run_available_now(E.debounce(stream, "1 minute", "10 seconds"), "test-debounce"))
    from folio.operators import stats as S
    batch = S.latest_per_key(df, "path", "1 minute")
    max_ts = T0 + dt.timedelta(seconds=59 * 20)
    closed = batch.filter(F.col("tick") + F.expr("INTERVAL 1 MINUTE") <= F.lit(max_ts - dt.timedelta(seconds=10)))
    assert sorted(r["event_id"] for r in out.collect()) == sorted(r["event_id"] for r in closed.collect())
