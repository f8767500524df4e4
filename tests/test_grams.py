"""Gram lookups return what a reading of the whole vocabulary returns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folio.operators import grams as G
from folio.operators import index as ix
from folio.operators import search as s
from folio.operators import blocks as B
from folio.session import scratch_path

WORDS = ["harbour", "harbor", "harbours", "arbour", "har", "ab", "tide", "tides", "tidal", "title", "stide", "größe", "a_b", "x1", "ébauche", "harbourharbour"]


@pytest.fixture(scope="module")
def built(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(WORDS), " ".join(rng.sample(WORDS, 6)) + f" {rng.choice('abc')}{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, content string").select(
        "*", *[F.lit(None).cast("string").alias(c) for c in ("format", "category", "status")], F.array().cast("array<string>").alias("tags"))
    path = scratch_path(spark, "grams-index")
    ix.write_index(ix.build_index(docs), path, shard_docs=25, grams=True)
    return ix.read_index(spark, path, docs)


def without(index):
    return ix.Index(index.postings, index.vocab, index.stats, index.docs, index.stemmed, index.fields, index.stats_values, True)


LEAVES = [s.wildcard("harb*"), s.wildcard("*bour"), s.wildcard("?ide*"), s.wildcard("h*r"), s.wildcard("*"), s.wildcard("t?t*e"), s.regex("tid(e|al)s?"), s.regex("har.*our"),
          s.regex("(?i)HARBOUR"), s.regex("[ab]+.*"), s.regex("gr.ße"), s.fuzzy("harbour", 1), s.fuzzy("harbour", 2), s.fuzzy("tide", 1), s.fuzzy("tide", 2), s.fuzzy("ab", 1),
          s.fuzzy("ébauch", 2), s.wildcard("a_b")]


@pytest.mark.parametrize("leaf", LEAVES, ids=lambda x: f"{type(x).__name__} {getattr(x, 'pattern', None) or x.text}")
def test_equals_reading_the_vocabulary(built, leaf):
    got = sorted(map(tuple, leaf.resolve(built).select("field", "term", "df").collect()))
    assert got == sorted(map(tuple, leaf.resolve(without(built)).select("field", "term", "df").collect()))


def test_plan_reads_grams_only(built, capsys):
    s.wildcard("harb*").resolve(built).explain("formatted")
    plan = capsys.readouterr().out
    assert "/grams" in plan and "/vocab" not in plan and "In(gram" in plan


def test_grams_hold_for_every_match():
    rng = random.Random(4)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    for pattern in ("a*b", "*ab*", "?b?c*", "abc", "*c"):
        rx = re.compile("^" + pattern.replace("*", ".*").replace("?", ".") + "$")
        assert all(G.of_wildcard(pattern) <= G.grams_of("^" + w + "$") for w in words if rx.match(w))
    for pattern in ("ab+c", "(ab)+c?", "a(b|c)a", "a{2,3}b", "abc|cba", "^ab", "a.c$"):
        assert all(G.of_regex(pattern) <= G.grams_of("^" + w + "$") for w in words if re.fullmatch(pattern, w))


def test_similar_documents_equal_seed_by_seed(built):
    got = sorted(map(tuple, B.similar_documents(built, 5, 4).select("seed_id", "doc_id", "score").collect()))
    want = sorted(map(tuple, s.more_like_this(without(built), built.docs.select("doc_id"), 5, limit=4).select("seed_id", "doc_id", "score").collect()))
    assert got == want and len(got) > 100


def test_other_text_fields(spark):
    docs = spark.createDataFrame([(1, "/a/B/x.md", "Deep blue tide", ["k one"], None), (2, "/a/y.md", "blue deep", None, None)],
                                 "doc_id long, path string, description string, keywords array<string>, created_at timestamp_ntz")
    idx = ix.build_index(ix.with_search_fields(docs), text_fields=("description",), keyword_fields=("ancestors", "keywords", "year"))
    ids = lambda q: sorted(r["doc_id"] for r in s.evaluate(idx, q).collect())
    assert ids(s.phrase("deep blue", ["description"])) == [1]
    assert ids(s.term("blue deep", ["description"])) == [1, 2]
    assert ids(s.term("/a", ["ancestors"])) == [1, 2] and ids(s.term("/a/b", ["ancestors"])) == [1] and ids(s.term("k one", ["keywords"])) == [1]
    assert ids(s.phrase("deep blue", ["title"])) == []
