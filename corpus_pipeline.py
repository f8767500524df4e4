"""A corpus pipeline of the training-data operators: language ID, exact dedup,
near dedup, mixing, packing. Each stage takes (spark, docs, sf_dir), works on
all rows of its predecessor and returns a DataFrame that run() writes to the
shared folder and rereads as the next stage's documents.

Defined cases: those of the operators; every row is a document of its own in all
stages, also where its doc_id is null or repeats (near dedup keeps all rows of
null doc_id), and the mix repeats rows by design."""

from __future__ import annotations

from folio.llm import op1_near, op4_mix, op5_pack, op7_language, op9_exact
from folio.llm.common import stored, table


def language_stage(spark, docs, sf_dir):
    """Documents without a letter, or no likelier in the languages than as letters at random, go."""
    return op7_language.language_filter(docs)


def exact_stage(spark, docs, sf_dir):
    """One document of each group of equal texts stays."""
    return op9_exact.exact_dedup(docs)


def near_stage(spark, docs, sf_dir):
    """One document of each class of near duplicates stays."""
    return op1_near.near_dedup(docs)


def mix_stage(spark, docs, sf_dir):
    """Each document as often as its source's target asks."""
    return op4_mix.mix(docs)


def pack_stage(spark, docs, sf_dir):
    """Pieces of full sequences."""
    return op5_pack.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mix", mix_stage),
    ("pack", pack_stage),
]


def run(spark, sf_dir):
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The language ID and the near-duplicate classes are not expressible in SQL.
ORACLE_SQL = None
