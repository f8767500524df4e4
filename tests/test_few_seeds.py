"""Similar documents of few seeds (F3): the texts are read for the seeds' terms, postings are not shuffled."""

import pytest
from pyspark.sql import functions as F

from folio.operators import index as ix
from folio.operators import search as s

ROWS = [(i, f"t{i}", " ".join(f"w{(i * j) % 17}" for j in range(i % 11))) for i in range(80)]


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, title string, content string").repartition(3)
    return docs.select("*", *[F.lit(None).cast("string").alias(c) for c in ("format", "category", "status")], F.array(F.lit("A")).alias("tags"))


def rows_of(df):
    return sorted(map(tuple, df.select("seed_id", "doc_id", "score").collect()), key=str)


def general(index):
    return ix.Index(index.postings, index.vocab, index.stats, index.docs, fields=index.fields)


@pytest.mark.parametrize("more", [[], [(7, "again", "w1 w1 w2"), (None, "none", "w3 w4")]])  # repeated and null ids go the general way
@pytest.mark.parametrize("limit", [4, None])
def test_equals_the_general_plan(spark, more, limit):
    index = ix.build_index(frame(spark, ROWS + more))
    seeds = spark.createDataFrame([(7,), (19,), (19,), (22,), (999,), (None,)], "doc_id long")
    for k, field in ((3, "content"), (50, "content"), (2, "title"), (2, "tags")):
        got = rows_of(s.more_like_this(index, seeds, k, field, limit))
        assert got == rows_of(s.more_like_this(general(index), seeds, k, field, limit))
        assert field == "title" or got


def test_only_scores_are_shuffled(spark):
    index = ix.build_index(frame(spark, ROWS))
    plan = s.more_like_this(index, spark.createDataFrame([(19,)], "doc_id long")).\
        _jdf.queryExecution().optimizedPlan().toString()
    assert "title" not in plan.split("Aggregate", 1)[0] and plan.count("Aggregate") == 1  # no counting of postings


def test_many_seeds_or_terms_go_the_general_way(spark, monkeypatch):
    index = ix.build_index(frame(spark, ROWS))
    seeds = spark.createDataFrame([(7,), (19,)], "doc_id long")
    want = rows_of(s.more_like_this(index, seeds))
    for name in ("FEW_SEEDS", "SEED_TERMS"):
        with monkeypatch.context() as m:
            m.setattr(s, name, 1)
            assert s._few_seeds(index, seeds, 10, "content") is None and rows_of(s.more_like_this(index, seeds)) == want != []


def test_documents_without_their_labels_are_read(spark):
    index = ix.build_index(frame(spark, ROWS))
    seeds = spark.createDataFrame([(19,)], "doc_id long")
    want = rows_of(s.more_like_this(index, seeds))
    index.plain = frame(spark, ROWS).select("doc_id", "title", "content")
    assert rows_of(s.more_like_this(index, seeds)) == want != []
