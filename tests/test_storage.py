"""Store, tags and category contract (P*, L*, J*, M*, G*, A*)."""

import datetime as dt

from pyspark.sql import functions as F

from folio.operators import relational as R
from folio.operators import stats as S
from folio.operators import taxonomy as G

NOW = dt.datetime(2024, 6, 1, 12, 0, 0)


def docs10(spark):
    rows = [(i, f"id{i}", f"/d/{i}.{'md' if i < 5 else 'txt'}", f"T{i}", "markdown" if i < 5 else "text",
             NOW - dt.timedelta(hours=i), NOW - dt.timedelta(days=30), "indexed" if i < 3 else "pending",
             f"h{i % 3}" if i < 6 else f"u{i}", 100 + i, "c")
            for i in range(10)]
    return spark.createDataFrame(rows, "doc_id long, id string, path string, title string, format string, "
                                       "modified_at timestamp_ntz, created_at timestamp_ntz, status string, "
                                       "content_hash string, size long, category string")


def test_list_page_sort(spark):
    d = docs10(spark)
    assert R.list_documents(d).count() == 10
    srt = R.sort_documents(d, "modified_at", descending=False)
    assert R.page(srt, 1, 5).count() == 5 and R.page(srt, 2, 5).count() == 5
    assert R.list_documents(d, format="markdown").count() == 5
    mods = [r["modified_at"] for r in srt.collect()]
    assert mods == sorted(mods)
    assert R.page_info(d, 3).first()["pages"] == 4


def test_count_with_filters(spark):
    d = docs10(spark)
    assert R.count_documents(d).first()["count"] == 10
    assert R.count_documents(d, {"status": "indexed"}).first()["count"] == 3


def test_duplicates(spark):
    dup = R.duplicates(docs10(spark))
    groups = dup.groupBy("content_hash").count().collect()
    assert len(groups) == 3 and all(g["count"] == 2 for g in groups)


def test_since_is_strict(spark):
    rows = [(i, NOW - dt.timedelta(days=i)) for i in range(5)]
    d = spark.createDataFrame(rows, "doc_id long, modified_at timestamp_ntz")
    assert R.modified_since(d, NOW - dt.timedelta(days=2)).count() == 2


def test_categories(spark):
    cats = spark.createDataFrame([("root", "Parent Category", None, 0), ("a", "Child Category", "root", 1),
                                  ("b", "Other Child", "root", 2)], "id string, name string, parent_id string, ord int")
    assert G.roots(cats).count() == 1 and G.children(cats, "root").count() == 2
    paths = {r["id"]: r["path"] for r in G.category_tree(spark, cats).collect()}
    assert paths["a"] == "Parent Category/Child Category"


def test_tags_reuse_and_merge(spark):
    docs = spark.createDataFrame([(1, ["python", "javascript"]), (2, ["python"])], "doc_id long, tags array<string>")
    assert G.tags_from_documents(docs).count() == 2
    edges = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "doc_id long, tag string")
    m = spark.createDataFrame([("a", "b")], "src string, dst string")
    merged = G.merge_tags(edges, m)
    assert sorted((r["doc_id"], r["tag"]) for r in merged.collect()) == [(1, "b"), (2, "b")]


def test_upsert_keeps_id(spark):
    old = spark.createDataFrame([("/a.md", "ID1", "old", NOW - dt.timedelta(days=3), NOW - dt.timedelta(days=3))],
                                "path string, id string, title string, created_at timestamp_ntz, modified_at timestamp_ntz")
    new = spark.createDataFrame([("/a.md", "ID2", "new", NOW, NOW), ("/b.md", "ID3", "b", NOW, NOW)],
                                "path string, id string, title string, created_at timestamp_ntz, modified_at timestamp_ntz")
    out = {r["path"]: r for r in R.upsert(old, new).collect()}
    assert out["/a.md"]["id"] == "ID1" and out["/a.md"]["title"] == "new"
    assert out["/a.md"]["created_at"] == NOW - dt.timedelta(days=3) and len(out) == 2
    # idempotent: applying the same batch twice gives the same snapshot
    again = {r["path"]: tuple(r) for r in R.upsert(R.upsert(old, new), new).collect()}
    assert again == {k: tuple(v) for k, v in out.items()}


def test_stats_per_format(spark):
    d = spark.createDataFrame([("markdown",)] * 3 + [("text",)] * 2, "format string")
    got = {r["format"]: r["count"] for r in S.per_value_counts(d).collect()}
    assert got == {"markdown": 3, "text": 2}
