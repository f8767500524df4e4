"""The stages in a row: each decision takes effect on its own input."""

import corpus_pipeline as P
from folio.llm import op1_near, op9_exact
from folio.llm.common import stored, table
from tests.conftest import SF


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, stage = docs.columns, dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix", "pack"]
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    told = stored(stage["language_id"](spark, docs, SF), "t1")
    once = stored(stage["exact_dedup"](spark, told, SF), "t2")
    assert ids(once) == ids(op9_exact.exact_groups(told).filter("kept")) and once.count() < told.count()
    near = stored(stage["near_dedup"](spark, once, SF), "t3")
    assert ids(near) == ids(op1_near.near_classes(once).filter("kept"))
    mixed = stored(stage["mix"](spark, near, SF), "t4")
    assert ids(mixed) <= ids(near) and all(d.columns == columns for d in (told, once, near, mixed))
    pieces = stage["pack"](spark, mixed, SF)
    assert ids(pieces) == ids(mixed)
