"""Search contract on a five-document corpus (T*, P*)."""

import pytest
from pyspark.sql import functions as F

from folio.operators import index as ix
from folio.operators import search as s
from tests.fixtures import AS_OF, search_docs


@pytest.fixture(scope="module")
def idx(spark):
    return ix.build_index(search_docs(spark))


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_empty_query_matches_all(idx):
    assert s.search(idx, s.match_all(), limit=None).count() == 5


def test_filter_format(idx):
    assert s.search(idx, s.match_all(), filters={"format": "text"}, limit=None).count() == 2


def test_filter_tags(idx):
    assert "harbour" in ids(s.search(idx, s.match_all(), filters={"tags": "harbour"}, limit=None))


def test_phrase(idx):
    assert ids(s.search(idx, s.phrase("slack tide"), limit=None)) == ["knots"]


def test_phrase_needs_adjacency(idx):
    assert s.search(idx, s.phrase("tide slack"), limit=None).count() == 0


def test_title_field(idx):
    assert ids(s.search(idx, s.term("notes", ["title"]), limit=None)) == ["harbour"]


def test_keyword_field_exact(idx):
    assert s.search(idx, s.term("yaml", ["format"]), limit=None).count() == 1


def test_boolean(idx):
    assert s.search(idx, s.all_of(s.term("rope"), s.term("splice")), limit=None).count() >= 1
    assert s.search(idx, s.any_of(s.term("rope"), s.term("skipper")), limit=None).count() >= 2
    res = ids(s.search(idx, s.all_of(s.match_all(), s.none_of(s.term("chart", ["title"]))), limit=None))
    assert "harbour" not in res and len(res) == 4


def test_wildcards(idx):
    assert s.search(idx, s.wildcard("dep*"), limit=None).count() > 0
    assert s.search(idx, s.wildcard("*scope"), limit=None).count() > 0


def test_fuzzy(idx):
    assert "knots" in ids(s.search(idx, s.fuzzy("splic", 1), limit=None))


def test_paging_disjoint_and_complete(idx):
    a = ids(s.search(idx, s.match_all(), sort="title", offset=0, limit=2))
    b = ids(s.search(idx, s.match_all(), sort="title", offset=2, limit=2))
    assert not set(a) & set(b) and len(a + b) == 4


def test_exact_offset(idx):
    full = [r["id"] for r in s.search(idx, s.match_all(), sort="title", limit=None).collect()]
    page = [r["id"] for r in s.search(idx, s.match_all(), sort="title", offset=1, limit=2).collect()]
    assert page == full[1:3]


def test_title_sort(idx):
    titles = [r["title"] for r in s.search(idx, s.match_all(), sort="title", limit=None).collect()]
    assert titles == sorted(titles)


def test_facets(idx):
    f = {(r["field"], r["value"]): r["count"] for r in s.facets(idx, s.match_all()).collect()}
    assert f[("format", "text")] == 2 and f[("format", "yaml")] == 1
    assert sum(c for (fld, _), c in f.items() if fld == "format") == 5


def test_delete(idx):
    gone = idx.docs.filter(F.col("id") == "knots").select("doc_id")
    idx2 = ix.delete_from_index(idx, gone)
    assert "knots" not in ids(s.search(idx2, s.term("guide"), limit=None))


def test_unknown_term_hints(spark, idx):
    assert s.search(idx, s.term("zzzunknown"), limit=None).count() == 0
    log = spark.createDataFrame([("zzzunknown", 0)], "query string, results_count int")
    assert len(s.hints(log).first()["hints"]) >= 1


def test_more_like_this(idx):
    seed = idx.docs.filter(F.col("id") == "knots").select("doc_id")
    sim = s.more_like_this(idx, seed, k_terms=30, limit=10).join(idx.docs.select("doc_id", "title", "tags"), "doc_id")
    assert sim.filter(F.col("doc_id") == 1).count() == 0
    assert sim.count() >= 1


def test_scores_descending(idx):
    sc = [r["score"] for r in s.search(idx, s.any_of(s.term("rope"), s.term("skipper")), limit=None).collect()]
    assert sc == sorted(sc, reverse=True) and all(x > 0 for x in sc)


def test_rerank_recency(spark, idx):
    page = s.search(idx, s.term("rope"), limit=None).join(idx.docs.select("doc_id", "modified_at"), "doc_id")
    rr = s.rerank(page, "rope", AS_OF).collect()
    for r in rr:
        assert r["rerank_score"] >= r["score"]


def test_stemmed_index(spark):
    idx = ix.build_index(search_docs(spark), stem=True)
    assert idx.stemmed
    assert ids(s.search(idx, s.term("splicing"), limit=None)) == ["knots"]


def test_search_many_matches_single(idx, spark):
    qs = spark.createDataFrame([(1, "rope splice"), (2, "skipper mate")], "qid long, text string")
    many = {(r["qid"], r["doc_id"]): r["score"] for r in s.search_many(idx, qs, k=None).collect()}
    one = {r["doc_id"]: r["score"] for r in s.evaluate(idx, s.any_of(s.term("rope", ["title", "content"]),
                                                                     s.term("splice", ["title", "content"]))).collect()}
    assert {d: v for (q, d), v in many.items() if q == 1} == one


def test_positional_index_phrase(spark):
    pidx = ix.build_index(search_docs(spark), positions=True)
    assert "positions" in pidx.postings.columns
    assert ids(s.search(pidx, s.phrase("slack tide"), limit=None)) == ["knots"]
    assert s.search(pidx, s.phrase("tide slack"), limit=None).count() == 0


def test_two_phase_fetch_equals_join(idx):
    q = s.any_of(s.term("rope"), s.term("skipper"), s.term("guide"))
    a = [tuple(r) for r in s.search(idx, q, limit=2).collect()]
    b = [tuple(r) for r in s.search(idx, q, limit=2, fetch="ids").select(*s.search(idx, q, limit=2).columns).collect()]
    assert a == b


def test_document_store_fetch(spark, tmpdir_path, idx):
    import os
    store = os.path.join(tmpdir_path, "store")
    ix.write_store(idx.docs, store, rows_per_file=2)
    idx2 = ix.Index(idx.postings, idx.vocab, idx.stats, ix.read_store(spark, store))
    q = s.any_of(s.term("rope"), s.term("skipper"))
    a = [tuple(r) for r in s.search(idx, q, limit=3, fetch="ids").collect()]
    b = [tuple(r) for r in s.search(idx2, q, limit=3, fetch="ids").collect()]
    assert a == b


def test_regex_and_range_leaves(idx):
    assert ids(s.search(idx, s.regex("splic+e"), limit=None)) == ["knots"]
    q = s.all_of(s.match_all(), s.between("size", 500, 1100))
    assert ids(s.search(idx, q, limit=None)) == ["knots", "tides"]


def test_scoring_methods(idx):
    q = s.any_of(s.term("rope"), s.term("splice"))
    freq = {r["doc_id"]: r["score"] for r in s.evaluate(idx, q, method="frequency").collect()}
    assert freq[1] == 4.0  # "splice" twice, "rope" once in the text and once as a tag
    tfidf = {r["doc_id"]: r["score"] for r in s.evaluate(idx, q, method="tfidf").collect()}
    assert set(tfidf) == set(freq) and all(v > 0 for v in tfidf.values())


def test_explain_scores(idx):
    q = s.any_of(s.term("rope"), s.term("guide"))
    page = s.search(idx, q, limit=None, with_snippet=False)
    ex = {r["doc_id"]: r for r in s.explain_scores(idx, q, page).collect()}
    assert ex[1]["matched_terms"] == ["guide", "rope"] and ex[1]["title_match"] and ex[1]["content_match"]


def test_relevance_feedback(spark):
    import math
    clicks = spark.createDataFrame([(1, 1, "clicked"), (2, 3, "ignored"), (3, 2, "none")],
                                   "doc_id long, rank int, action string")
    got = {r["doc_id"]: r["feedback"] for r in s.relevance_feedback(clicks).collect()}
    assert got == {1: round(1 / math.log2(2), 6), 2: round(-math.log2(4), 6), 3: 0.0}


def test_sort_by_document_attribute(idx):
    got = [r["id"] for r in s.search(idx, s.match_all(), sort="-modified", limit=None, with_snippet=False).collect()]
    assert got == ["log", "harbour", "knots", "tides", "crew"]  # modified 2, 4, 9, 12, 30 days ago
    sized = [r["size"] for r in s.search(idx, s.match_all(), sort="size", limit=3).collect()]
    assert sized == [310, 450, 640]


def test_facets_respect_filters(idx):
    f = {(r["field"], r["value"]): r["count"] for r in s.facets(idx, s.match_all(), filters={"tags": "chart"}).collect()}
    assert f[("format", "html")] == 1 and ("format", "yaml") not in f


def test_keyword_value_of_several_words(idx):
    assert ids(s.search(idx, s.term("deck hands", ["tags"]), limit=None)) == ["crew"]


def test_stop_word_under_and(idx):
    assert ids(s.search(idx, s.all_of("the", "splice"), limit=None)) == ["knots"]
