"""No depth, leaf or prefix bound; rules of paths and of emptied documents."""

from folio.operators import index as ix
from folio.operators import search as s
from folio.operators import suggest as G
from folio.operators import taxonomy as T
from folio.session import scratch_path
from folio.sources import files as S
from folio.streaming import stream_ops as E
from pyspark.sql import functions as F


def test_deep_tree_and_cycle(spark):
    chain = [(str(i), f"n{i}", str(i - 1) if i else None, i) for i in range(70)]
    cats = spark.createDataFrame(chain, "id string, name string, parent_id string, ord int")
    assert T.category_tree(spark, cats).agg(F.max("depth")).first()[0] == 69
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent_id string")
    pairs = {tuple(r) for r in T.category_closure(spark, ring).collect()}
    assert pairs == {("a", "a"), ("a", "b"), ("b", "b"), ("b", "a")}


def test_fallback_of_many_words(spark):
    docs = spark.createDataFrame([(1, "t", "w5 w99"), (2, "t", "other")], "doc_id long, title string, content string")
    idx = ix.build_index(docs, keyword_fields=())
    many = " ".join(f"w{i}" for i in range(130))
    assert [r["doc_id"] for r in s.evaluate(idx, s.fallback(many)).collect()] == [1]
    both = s.any_of(*[s.phrase(f"w{i} w{i + 94}") for i in range(70)])
    assert [r["doc_id"] for r in s.evaluate(idx, both).collect()] == [1]


def test_tag_values(spark):
    docs = spark.createDataFrame([("md", "c", "ok", ["alpha", "alpha", "beta"]), ("md", "c", "ok", ["alpha"])],
                                 "format string, category string, status string, tags array<string>")
    req = spark.createDataFrame([("tags:al",)], "request string")
    assert [(r["text"], r["count"]) for r in G.field_values(docs, req).collect()] == [("tags:alpha", 2)]


def test_paths(spark):
    df = spark.createDataFrame([("/a/node_modules/x/y.md",), ("/r/.h/in/b.md",), ("/c.md",)], "path string")
    hit = {r["path"] for r in df.filter(S.ignored("path", ["*/node_modules/*"])).collect()}
    assert hit == {"/a/node_modules/x/y.md"}
    kept = {r["path"] for r in df.filter(~S.ignored("path", [".*"], root=["/r/.h/in", "/a"])).collect()}
    assert "/r/.h/in/b.md" in kept
    assert S.prefix_facets(df.filter(F.col("path") == "/c.md")).count() == 0


def test_emptied_document_loses_its_postings(spark):
    log = E.ChangeLog(spark, scratch_path(spark, "emptied"), E.empty_postings(spark))
    sink = E.index_log_sink(log, lambda d: d)
    schema = "doc_id long, title string, content string"
    sink(spark.createDataFrame([(1, "one", "word"), (2, "two", "word")], schema), 0)
    sink(spark.createDataFrame([(1, "", "")], schema), 1)
    assert {r["doc_id"] for r in E.current_postings(log).collect()} == {2}


def test_cleared_index_finds_nothing(spark):
    docs = spark.createDataFrame([(1, "one", "word")], "doc_id long, title string, content string")
    idx = ix.clear_index(ix.build_index(docs, keyword_fields=()))
    assert idx.fields and s.evaluate(idx, s.term("word", ("title", "content"))).count() == 0
