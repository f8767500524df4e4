"""Lists of a whole index and answers to batches of queries (F1, F2): equal to the plain plans, whatever way the index was written."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.operators import batch, lists
from folio.operators import blocks as B
from folio.operators import index as ix
from folio.operators import search as s
from folio.session import scratch_path


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, title string, content string").repartition(3)
    return docs.select("*", F.lit("V,w").alias("format"), *[F.lit(None).cast("string").alias(c) for c in ("category", "status")],
                       F.array(F.lit(" A"), F.lit(None)).alias("tags"))


def some_rows(n=400):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    return [(i * 7 - 900, f"title {rng.choice(words)}", " ".join(rng.choices(words, weights, k=rng.randint(0, 40)))) for i in range(n)] + [(5_000_000_000, None, None)]


def rows_of(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect()), key=str)


def both(spark, rows, **kw):
    """The index as written from its documents and as written from its postings."""
    docs, out = frame(spark, rows), []
    for known in (True, False):
        index, path = ix.build_index(docs), scratch_path(spark, "batch-index")
        if not known:
            index.texts = None
        ix.write_index(index, path, shard_docs=20, **kw)
        out.append(ix.read_index(spark, path, docs))
    return out


@pytest.mark.parametrize("partitions", [None, 60])  # with 60 parts, frequent terms fill several
def test_index_from_lists_equals_index_from_postings(spark, partitions):
    a, b = both(spark, some_rows(), partitions=partitions)
    assert a.lists is not None and b.lists is None and bool(a.wide) == (partitions == 60)
    assert rows_of(a.postings) == rows_of(b.postings) and rows_of(a.vocab) == rows_of(b.vocab) and rows_of(a.stats) == rows_of(b.stats)
    assert a.postings.dtypes == b.postings.dtypes and a.blocks.dtypes == b.blocks.dtypes
    entries = lambda i: rows_of(i.blocks.select("field", "term", "df", F.explode(F.arrays_zip("docs", "parts", "tfs")).alias("e")).select("field", "term", "df", "e.*"))
    assert entries(a) == entries(b)
    one = a.blocks.groupBy("field", "term", "shard").count().agg(F.max("count")).first()[0]
    falling = a.blocks.filter("parts != sort_array(parts, false) or parts[0] != top").count()
    assert one == 1 and falling == 0
    asked = spark.createDataFrame([(f"q{i}", [f"w{i}", f"w{(i * 5) % 23}", "none"]) for i in range(40)], "query string, terms array<string>")
    for k in (3, 500):
        got = [rows_of(B.best_documents(i, asked, k, ("title", "content"), routed=0).select("query", "doc_id", "score", "rank")) for i in (a, b)]
        assert got[0] == got[1] == rows_of(B.best_documents(b, asked, k, ("title", "content")).select("query", "doc_id", "score", "rank"))


def test_repeated_and_null_ids_are_counted_as_before(spark):
    rows = some_rows(60) + [(-900, "title w1", "w1 w2 w2"), (None, "t9", "w3 w3"), (None, None, "w3")]
    a, b = both(spark, rows)
    assert a.lists is None and rows_of(a.postings) == rows_of(b.postings) and rows_of(a.stats) == rows_of(b.stats)
    asked = spark.createDataFrame([("q", ["w3"]), ("r", ["w2", "w1"])], "query string, terms array<string>")
    got = rows_of(B.best_documents(a, asked, 99, ("content",), routed=0))
    assert got == rows_of(B.best_documents(a, asked, 99, ("content",))) and any(r[1] is None for r in got)


def test_similar_documents_equals_one_by_one(spark):
    for index in both(spark, some_rows(150)):
        got = rows_of(B.similar_documents(index, 6, 4).select("seed_id", "doc_id", "score"))
        plain = ix.Index(index.postings, index.vocab, index.stats, index.docs, index.stemmed, index.fields, index.stats_values, True)
        want = rows_of(s.more_like_this(plain, index.docs.select("doc_id"), 6, limit=4).select("seed_id", "doc_id", "score"))
        assert got == want and got


def test_shard_answers_with_and_without_floors():
    rng = np.random.default_rng(3)
    n, many = 3000, 40
    size = [2500, 1800, 900, *rng.integers(1, 400, many - 3)]
    docs = [np.sort(rng.choice(n, x, replace=False)) * 3 for x in size]
    parts = [rng.uniform(0.1, 1, x) * 8 / (1 + x) ** 0.4 for x in size]
    offsets = np.concatenate(([0], np.cumsum(size)))
    shards = [batch.Shard(["f"] * many, [str(i) for i in range(many)], offsets, np.concatenate(docs), np.concatenate(parts), wide) for wide in (10 ** 6, 0)]
    assert len(shards[0].rows) >= 3 and not len(shards[1].rows)
    asked = [rng.choice(many, rng.integers(0, 9), replace=False).astype(np.int32) for _ in range(200)] + [np.array([4, 4], np.int32)]
    terms, at, length = [str(i) for i in range(many)], np.concatenate(asked), np.array([len(x) for x in asked], np.int32)
    want = np.zeros((len(asked), 3 * n))
    for q, codes in enumerate(asked):
        for c in codes:
            want[q, docs[c]] += parts[c]
    kth = np.sort(want, axis=1)[:, -10]
    for floors in (np.full(len(asked), -np.inf), kth, kth * 0.9):
        for shard in shards:
            q, d, v = shard.answer(("f", "g"), terms, at, length, floors, 10)
            assert np.allclose(v, want[q, d]) and len(set(zip(q.tolist(), d.tolist(), strict=True))) == len(q)
            for i in range(len(asked)):
                assert {x for x in np.flatnonzero(want[i] >= max(kth[i], 1e-9))} <= set(d[q == i].tolist())


def test_cuts_deal_every_term_once():
    cuts = lists.Cuts([("a", "m"), ("b", "c"), ("b", "k"), ("b", "k"), ("b", "k")], 4)
    assert cuts.parts_of("a", pa.array(["a", "l", "m", "z"])).tolist() == [0, 0, 1, 1]
    assert cuts.parts_of("b", pa.array(["a", "c", "d", "k", "x"])).tolist() == [1, 2, 2, 5, 5] and cuts.spread == {("b", "k"): (2, 5)}
    assert cuts.parts_of("c", pa.array(["a"])).tolist() == [5] and cuts.parts_of("0", pa.array(["z"])).tolist() == [0]
