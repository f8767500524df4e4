"""A segmented index equals one built from the current documents."""

import random

import pytest


from folio.operators import index as ix
from folio.operators import search as s
from folio.operators.segments import SegmentedIndex
from folio.session import scratch_path


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, title string, content string, category string")


def counts(index):
    return sorted(map(tuple, index.vocab.select("field", "term", "df", "cf").collect()))


def test_upserts_deletes_and_compaction(spark):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(rng.randint(0, 9)))
    now = {i: (i, text(), text(), rng.choice(["x", "y", None])) for i in range(40)}
    index = SegmentedIndex(spark, scratch_path(spark, "segments"), keyword_fields=("category",))
    index.apply(0, frame(spark, list(now.values())))
    for n in (1, 2, 4, 5):
        changed = [(i, text(), text(), "z") for i in rng.sample(range(50), 6)]
        gone = [i for i in rng.sample(range(50), 5) if i not in {c[0] for c in changed}]
        index.apply(n, frame(spark, changed), spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        now = {i: d for i, d in now.items() if i not in gone} | {d[0]: d for d in changed}
        if n == 2:
            index.compact(3)
            with pytest.raises(ValueError):
                index.apply(3, frame(spark, changed))
    docs = frame(spark, list(now.values()))
    want = ix.build_index(docs, keyword_fields=("category",))
    got = index.open(docs)
    assert counts(got) == counts(want)
    assert sorted(map(tuple, got.postings.select("field", "term", "doc_id", "tf", "dl").collect())) == \
        sorted(map(tuple, want.postings.select("field", "term", "doc_id", "tf", "dl").collect()))
    assert {r["field"]: (r["n_docs"], r["sum_dl"]) for r in got.stats.collect()} == {r["field"]: (r["n_docs"], r["sum_dl"]) for r in want.stats.collect()}
    q = s.any_of(s.term("alpha", ["title", "content"]), s.term("omega", ["title", "content"]))
    assert sorted(map(tuple, s.evaluate(got, q).collect())) == sorted(map(tuple, s.evaluate(want, q).collect()))


def test_delete_only_and_its_plan(spark, capsys):
    index = SegmentedIndex(spark, scratch_path(spark, "segments"), keyword_fields=())
    index.apply(0, frame(spark, [(i, f"title{i}", "shared words", None) for i in range(20)]))
    index.apply(1, deleted=spark.createDataFrame([(3,), (4,), (99,)], "doc_id long"))
    got = index.open(frame(spark, []))
    assert got.vocab.filter("term = 'shared'").first()["df"] == 18 and not got.vocab.filter("term = 'title3'").count()
    index.forward_of(spark.createDataFrame([(7,)], "doc_id long")).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)" in plan or "In(doc_id, [7])" in plan
    assert "postings" not in plan


def test_a_retried_batch_replaces_its_segment(spark):
    index = SegmentedIndex(spark, scratch_path(spark, "segments"), keyword_fields=())
    index.apply(0, frame(spark, [(1, "one", "text", None)]))
    for _ in range(2):
        index.apply(1, frame(spark, [(2, "two", "text", None), (1, "uno", "text", None)]))
    got = index.open(frame(spark, []))
    assert {r["term"]: r["df"] for r in got.vocab.collect()} == {"uno": 1, "two": 1, "text": 2}
