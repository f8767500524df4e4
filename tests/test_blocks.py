"""Batch search over score blocks equals the plain plan, and reads less."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.operators import blocks as B
from folio.operators import index as ix
from folio.operators import search as s
from folio.session import scratch_path


@pytest.fixture(scope="module")
def built(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, f"title {rng.choice(words)}", " ".join(rng.choices(words, weights, k=rng.randint(0, 60)))) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, content string").repartition(3)
    docs = docs.select("*", *[F.lit(None).cast("string").alias(c) for c in ("format", "category", "status")],
                       F.array().cast("array<string>").alias("tags"))
    path = scratch_path(spark, "blocks-index")
    ix.write_index(ix.build_index(docs), path, shard_docs=60)
    return ix.read_index(spark, path, docs)


def plain(index):
    return ix.Index(index.postings, index.vocab, index.stats, index.docs, index.stemmed, index.fields, index.stats_values, True)


def test_equals_plain_plan(spark, built):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(1, 12))) for _ in range(60)]
    texts += [texts[0], "the of", "", "nothing here", "w0 w0 w0"]
    qs = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "qid long, text string")
    for k in (1, 5, 10, 700):
        got = sorted(map(tuple, s.search_many(built, qs, k=k).select("qid", "doc_id", "score", "rank").collect()))
        want = sorted(map(tuple, s.search_many(plain(built), qs, k=k).select("qid", "doc_id", "score", "rank").collect()))
        assert got == want and len(got) > 0


def test_single_search_from_blocks(built):
    q = s.all_of(s.term("w1"), s.any_of(s.term("w2"), s.term("w3")), s.none_of(s.term("w4")))
    both = [sorted(map(tuple, s.evaluate(i, q).collect())) for i in (built, plain(built))]
    assert both[0] == both[1] and both[0]


def test_shards_below_the_floor_are_not_routed(spark, built):
    asked = spark.createDataFrame([("a", ["w0", "w250"]), ("b", ["w299"])], "query string, terms array<string>")
    route = B.routes(built, asked, ("title", "content"), 1)
    every = built.blocks.filter("term in ('w0', 'w250') and field in ('title', 'content')").select("shard").distinct().count()
    assert 0 < route.filter("query = 'a'").count() < every


def test_fewer_entries_are_read():
    """A rare term settles the top: the lists of common terms are not walked."""
    rng = np.random.default_rng(1)
    n = 20_000
    lists = [("rare", np.arange(0, n, 200), rng.uniform(9, 10, n // 200))]
    lists += [(f"common{j}", np.sort(rng.choice(n, n // 2, replace=False)), rng.uniform(0, 0.5, n // 2)) for j in range(6)]
    offsets = np.cumsum([0] + [len(d) for _, d, _ in lists])
    shard = B.Lists(["f"] * 7, [t for t, *_ in lists], offsets, np.concatenate([d for _, d, _ in lists]), np.concatenate([p for *_, p in lists]))
    keys = [("f", t) for t, *_ in lists]
    want = np.zeros(n)
    for _, d, p in lists:
        want[d] += p
    for k in (10, 50):
        shard.entries_read = 0
        ids, value = shard.best(keys, k, -np.inf)
        top = np.argsort(-want, kind="stable")[:k]
        assert set(top) <= set(ids.tolist()) and np.allclose(value, want[ids])
        assert shard.entries_read * 5 < offsets[-1]
        assert not shard.score.any()
