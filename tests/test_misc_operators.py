"""Highlighting, corpus profile, integrity checks, relative dates, labels."""

import datetime as dt

from pyspark.sql import functions as F

from folio.functions.text import age_label, size_label, ntz
from folio.operators import relational as R
from folio.operators import search as s
from folio.operators import stats as S

NOW = dt.datetime(2024, 3, 1, 0, 0, 0)


def test_highlight_marks_terms_case_insensitively(spark):
    df = spark.createDataFrame([("Install the Toolkit, then install again",)], "snippet string")
    got = s.highlight_page(df, "install toolkit").first()["highlights"]
    assert got == "<mark>Install</mark> the <mark>Toolkit</mark>, then <mark>install</mark> again"


def test_corpus_profile_one_pass(spark):
    d = spark.createDataFrame([("md", "indexed", "en", 10), ("md", "failed", "de", 5), ("txt", "indexed", "en", 1)],
                              "format string, status string, category string, size long")
    got = {(r["dimension"], r["value"]): (r["count"], r["total_size"]) for r in S.corpus_profile(d).collect()}
    assert got[("total", "all")] == (3, 16) and got[("format", "md")] == (2, 15)
    assert got[("status", "failed")] == (1, 5) and got[("category", "en")] == (2, 11)


def test_integrity_checks(spark):
    docs = spark.createDataFrame([(1, "/a", "A"), (2, "/a", ""), (3, "/c", "C")], "doc_id long, path string, title string")
    tags = spark.createDataFrame([(1, "x"), (9, "y"), (1, "x"), (2, " X"), (3, " ")], "doc_id long, tag string")
    cats = spark.createDataFrame([("r", "Root", None), ("k", "Kid", "zz")], "id string, name string, parent_id string")
    edges = spark.createDataFrame([(1, "r"), (2, "nope")], "doc_id long, category_id string")
    got = {r["check"]: r["violations"] for r in S.integrity(docs, tags, cats, edges).collect()}
    assert got == {"duplicate_path": 2, "duplicate_category_name": 0, "orphan_tag_edges": 1,
                   "orphan_category_edges": 1, "missing_parent": 1, "missing_title": 1,
                   "duplicate_tag_edges": 2, "duplicate_category_edges": 0, "unclear_tag_names": 3}


def test_relative_dates(spark):
    rows = [(i, NOW - dt.timedelta(hours=h)) for i, h in enumerate([1, 20, 30, 24 * 6, 24 * 10])]
    d = spark.createDataFrame(rows, "doc_id long, modified_at timestamp_ntz")
    assert [r["doc_id"] for r in R.relative_dates(d, "yesterday", NOW).collect()] == [0, 1]
    assert R.relative_dates(d, "last 7 days", NOW).count() == 4
    assert R.relative_dates(d, "last week", NOW).count() == 4


def test_labels(spark):
    ago = lambda **k: NOW - dt.timedelta(**k)
    d = spark.createDataFrame([(0, ago(seconds=30)), (500, ago(minutes=1)), (2048, ago(minutes=5)), (1126, ago(hours=1)), (3 * 1024 ** 2 + 1024 ** 2 // 4, ago(hours=23)),
                               (5 * 1024 ** 3, ago(days=1)), (1023, ago(days=7, hours=23)), (1536, ago(days=8))], "size long, ts timestamp_ntz")
    got = [(r[0], r[1]) for r in d.select(size_label("size"), age_label(F.col("ts"), ntz("2024-03-01 00:00:00"))).collect()]
    assert got == [("0 Bytes", "Just now"), ("500 Bytes", "1 minute ago"), ("2 KB", "5 minutes ago"), ("1.1 KB", "1 hour ago"), ("3.25 MB", "23 hours ago"),
                   ("5 GB", "1 day ago"), ("1023 Bytes", "7 days ago"), ("1.5 KB", "2/22/2024")]
