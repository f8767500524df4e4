"""The pipeline's stages on empty tables, odd columns, repeated and null ids and texts longer than a slice."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from folio.llm import op5_pack, op6_ann, op9_exact
from folio.llm.common import stored

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, __row string, __copy long, __copies long, __content string, __salt string"


def some_docs(spark, ids, long=0):
    rng = random.Random(7)
    words = ["water", "house", "under", "night", "brother", "walking", "thing", "other", "garden", "winter"]
    rows = [(i, " ".join(rng.choices(words, k=40)) + f" number{n}", "en", f"s{n % 3}", 1, f"r{n}", n, 5, "c", "salt") for n, i in enumerate(ids)]
    if long:
        rows.append((10_000, " ".join(rng.choices([f"{w}{j}" for w in words for j in range(900)], k=long)), "en", "s0", 1, "long", 1, 1, "c", "salt"))
    return spark.createDataFrame(rows, COLUMNS).withColumn("extra", F.create_map(F.lit("k"), F.col("doc_id")))


def through(spark, docs):
    seen = []
    for name, stage in P.STAGES:
        docs = stored(stage(spark, docs, None), f"case-{name}")
        seen.append(docs)
    return seen


@pytest.mark.parametrize("ids", [range(12), [1, 1, 2, None, None, 3, 3, 3, 4, 5, 6, 7]], ids=["own ids", "repeated and null ids"])
def test_columns_of_internal_names_stay(spark, ids):
    docs = some_docs(spark, list(ids))
    *kept, mixed, packed = through(spark, docs)
    for d in kept:
        assert d.columns == docs.columns and {r["__row"] for r in d.collect()} == {f"r{n}" for n in range(12)}
    assert mixed.columns == docs.columns and packed.count() >= mixed.count() > 6
    assert {r["__row"] for r in mixed.collect()} <= {f"r{n}" for n in range(12)}


def test_empty_table(spark):
    docs = some_docs(spark, []).limit(0)
    assert [d.count() for d in through(spark, docs)] == [0] * 5


def test_text_longer_than_a_slice(spark):
    docs = some_docs(spark, list(range(5)), long=700_000)
    assert docs.agg(F.max(F.length("text"))).first()[0] > 4 << 20
    *kept, _, _ = through(spark, docs)
    assert all(d.filter("doc_id = 10000").count() == 1 for d in kept)
    packed = op5_pack.pack(kept[-1]).filter("doc_id = 10000").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of")).first()
    assert packed["n"] == packed["of"] > 700_000
    assert op9_exact.exact_groups(docs.select("doc_id", "text")).filter("kept").count() == 6


def test_pack_and_neighbours_with_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "d e"), (None, None)], "doc_id long, text string")
    rows = op5_pack.pack(docs).collect()
    assert sum(r["length"] for r in rows) == 12 and sum(r["length"] for r in rows if r["doc_id"] is None) == 4
    vectors = [(i if i < 40 else None, [float(i % 7), 1.0, float(i % 3)]) for i in range(42)] + [(5, [5.0, 1.0, 2.0])]
    got = op6_ann.nearest(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"))
    assert {r["query_id"] for r in got.collect()} == {0, 20}
