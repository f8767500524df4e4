"""The pipeline's stages decide on rows, not on ids."""

from collections import Counter

import pytest

import corpus_pipeline as P
from folio.llm import op4_mix
from folio.llm.common import stored
from tests.llm.test_operators import DOC, docs, rows  # noqa: F401


@pytest.fixture(scope="module")
def repeated(spark, rows):  # noqa: F811
    """The first 40 documents under their ids, under ids that stand for two texts each, and under null; empty rows of those ids between."""
    some = [r for r in rows[:40]]
    out = [(*r, None, "x", "y", 1) for r in some]
    words = lambda r, i: " ".join(f"{w}{'abcdefghij'[i % 10]}" for w in r[1].split()[::-1])
    for i, r in enumerate(some):
        out.append((r[0], words(r, i), *r[2:], None, "x", "y", 2))
        out.append((r[0], None, *r[2:], None, "x", "y", 3))
        out.append((None, " ".join(sorted(r[1].split())) + f" {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}", *r[2:], None, "x", "y", 4))
    return spark.createDataFrame(out, DOC).repartition(5)


def kinds(df):
    return Counter(r["keys"] for r in df.collect())


def test_rows_of_one_id_and_of_none_stay(spark, repeated):
    stage = dict(P.STAGES)
    told = stored(stage["language_id"](spark, repeated, None), "r1")
    assert kinds(told) == {1: 40, 2: 40, 4: 40}
    once = stored(stage["exact_dedup"](spark, told, None), "r2")
    assert sorted(map(str, once.collect())) == sorted(map(str, told.collect()))
    near = stored(stage["near_dedup"](spark, once, None), "r3")
    assert sorted(map(str, near.collect())) == sorted(map(str, once.collect()))
    copies = op4_mix.mix_counts(near).agg({"copies": "sum"}).first()[0]
    assert stage["mix"](spark, near, None).count() == copies > 0


def test_equal_rows_of_one_id_stay_once(spark, repeated):
    twice = repeated.unionByName(repeated)
    assert kinds(dict(P.STAGES)["exact_dedup"](spark, twice, None)) == {1: 40, 2: 40, 3: 1, 4: 40}
    texts = repeated.filter("keys = 2")
    near = dict(P.STAGES)["near_dedup"](spark, texts.unionByName(texts), None)
    assert kinds(near) == {2: 40} and sorted(map(str, near.collect())) == sorted(map(str, texts.collect()))
