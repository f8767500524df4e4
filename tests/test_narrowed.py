"""Searches over an index built from documents read and tokenise the texts once."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from folio.operators import index as ix
from folio.operators import search as s


def frame(spark):
    rows = [(1, "Rope splices", "splicing ropes and a rope"), (2, "Tide", "slack tide, splice"), (2, "Tide again", "rope rope"), (None, None, "spliced"),
            (None, "rope", None), (5, "", ""), (6, "Rope tide", "slack. tide slack tide splicer")]
    docs = spark.createDataFrame(rows, "doc_id long, title string, content string")
    return docs.select("*", F.lit("V").alias("format"), F.lit("c,Rope").alias("category"), F.lit("s").alias("status"), F.array(F.lit("rope"), F.lit("B")).alias("tags"))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


QUERIES = {
    "terms": lambda: s.any_of(s.term("rope"), s.term("splice"), s.term("c", ["category"])),
    "not": lambda: s.all_of(s.none_of(s.term("rope")), s.match_all()),
    "phrase": lambda: s.all_of(s.phrase("slack tide"), s.term("rope")),
    "pattern": lambda: s.any_of(s.wildcard("spli*"), s.term("rope")),
    "several tokens": lambda: s.term("tide rope", ["title", "category"]),
    "nothing": lambda: s.term("zzz"),
}


@pytest.mark.parametrize("name,stem", [(n, False) for n in QUERIES] + [("terms", True), ("phrase", True)])
def test_results_are_those_of_the_whole_index(spark, name, stem):
    idx = ix.build_index(frame(spark), stem=stem)
    whole = replace(idx, texts=None)
    assert rows_of(s.evaluate(idx, QUERIES[name]())) == rows_of(s.evaluate(whole, QUERIES[name]()))


@pytest.mark.parametrize("stem", [False, True])
def test_a_search_and_its_explanation_share_one_reading(spark, stem):
    idx = ix.build_index(frame(spark), stem=stem)
    q = QUERIES["terms"]()
    page = s.evaluate(idx, q)
    told = s.explain_scores(idx, q, page)
    for df in (s.evaluate(idx, q), told):
        assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert len(idx.narrow) == 1
    assert rows_of(told) == rows_of(s.explain_scores(replace(idx, texts=None), q, page))


def test_a_phrase_reads_its_own_field_only(spark):
    docs = frame(spark).select("doc_id", "title", F.col("content").alias("body"), F.concat(F.lit("kept "), F.coalesce("title", F.lit("rope"))).alias("description"))
    idx = ix.build_index(docs, text_fields=("title", "body", "description"), keyword_fields=())
    found = s.evaluate(idx, s.phrase("kept rope", ["description"]))
    assert "body" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert rows_of(found.select("doc_id")) == rows_of(s.evaluate(replace(idx, texts=None), s.phrase("kept rope", ["description"])).select("doc_id"))


def test_the_stemmer_sees_distinct_words_only(spark):
    from folio.functions import stem

    many = spark.range(40).select(F.explode(F.split(F.lit("splicing spliced ropes rope tide"), " ")).alias("term"))
    assert stem.surface_forms(many, {"splice", "rope"}) == {"splicing": "splice", "spliced": "splice", "ropes": "rope", "rope": "rope"}
    assert stem.surface_forms(many, set()) == {}


def test_related_tags_count_tokens_among_the_terms_only(spark):
    from folio.operators import suggest as G

    idx = ix.build_index(frame(spark))
    tags = spark.createDataFrame([(1, "a"), (2, "a"), (2, "rope"), (2, "b"), (6, "b"), (None, "c")], "doc_id long, tag string")
    terms = spark.createDataFrame([("rope",), ("tide",), ("tide",), ("zzz",), (None,)], "term string")
    got = G.related_tags(idx, tags, terms, k=None)
    assert rows_of(got) == rows_of(G.related_tags(idx.postings, tags, terms, k=None)) != []
    assert "posexplode" not in got._jdf.queryExecution().optimizedPlan().toString()  # which lists all postings


def test_suggestions_and_first_completions_are_worked_out_once(spark):
    from folio.operators import suggest as G

    log = spark.createDataFrame([("rope tide", 1), ("rope splice", 2)], "query string, at long").select("query", F.timestamp_seconds("at").cast("timestamp_ntz").alias("searched_at"))
    tags = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, tag string")
    asked = spark.createDataFrame([("rop",), ("format:v",)], "prefix string")
    out = G.suggestions_for(asked, G.from_query_log(log), ix.build_index(frame(spark)), tags, frame(spark), k=5)
    assert "searched_at" not in out._jdf.queryExecution().optimizedPlan().toString()  # of the log, read when its counts are written
    assert {r["prefix"] for r in out.collect()} == {"rop", "format:v"}


def test_postings_of_a_log_are_not_shuffled_by_document(spark):
    from folio.session import scratch_path
    from folio.streaming import stream_ops as E

    log = E.ChangeLog(spark, scratch_path(spark, "e4-test"), E.empty_postings(spark))
    rows = lambda *r: spark.createDataFrame(list(r), "field string, term string, doc_id long, tf long, dl int")
    log.append(0, rows(("title", "a", 1, 1, 1), (None, None, 1, 0, 0), ("title", "b", 2, 1, 1), (None, None, 2, 0, 0), ("title", "n", None, 1, 1)))
    log.append(1, rows(("title", "c", 1, 2, 2), (None, None, 1, 0, 0), ("title", "d", 3, 1, 1), (None, None, 3, 0, 0)))
    log.append(2, rows((None, None, 2, 0, 0)))
    held = E.current_postings(log)
    assert rows_of(held.select("doc_id", "term", "tf")) == [(1, "c", 2), (3, "d", 1)]
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_a_folder_is_listed_in_chunks(spark, tmp_path, monkeypatch):
    from pyarrow import fs

    from folio.sources import folders

    monkeypatch.setattr(folders, "CHUNK", 4)
    for i in range(10):
        (tmp_path / f"{i}.md").write_bytes(b"x" * i)
    (tmp_path / "sub").mkdir()
    (tmp_path / "ring").symlink_to(tmp_path)
    (tmp_path / "gone").symlink_to(tmp_path / "nothing")
    chunks = list(folders._chunks(fs.LocalFileSystem(), str(tmp_path)))
    assert max(map(len, chunks)) <= 4
    assert sorted(x.base_name for c in chunks for x in c) == [f"{i}.md" for i in range(10)] + ["sub"]
    assert not list(folders._chunks(fs.LocalFileSystem(), str(tmp_path / "missing")))
