"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from folio.llm import op1_near, op2_repeats, op3_tokens, op4_mix, op5_pack, op6_ann, op7_language, op8_lines, op9_exact, op10_license, op11_spelling, op12_align, op13_toxicity
from folio.llm.common import table


def op1_near_query(spark, sf_dir):
    return op1_near.near_classes(table(spark, sf_dir, "documents"))


def op2_repeats_query(spark, sf_dir):
    return op2_repeats.mark_repeats(table(spark, sf_dir, "documents"))


def op3_tokens_query(spark, sf_dir):
    return op3_tokens.token_files(table(spark, sf_dir, "documents"))


def op4_mix_query(spark, sf_dir):
    return op4_mix.mix_counts(table(spark, sf_dir, "documents")).drop("copies")


def op5_pack_query(spark, sf_dir):
    return op5_pack.pack(table(spark, sf_dir, "documents"))


def op6_ann_query(spark, sf_dir):
    return op6_ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_language_query(spark, sf_dir):
    return op7_language.identify(table(spark, sf_dir, "documents"))


def op8_lines_query(spark, sf_dir):
    return op8_lines.line_dedup(table(spark, sf_dir, "documents"))


def op9_exact_query(spark, sf_dir):
    return op9_exact.exact_groups(table(spark, sf_dir, "documents"))


def op10_license_query(spark, sf_dir):
    return op10_license.scan(table(spark, sf_dir, "documents"))


def op11_spelling_query(spark, sf_dir):
    return op11_spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_align_query(spark, sf_dir):
    return op12_align.align(table(spark, sf_dir, "documents"), digest=True)


def op13_toxicity_query(spark, sf_dir):
    return op13_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_near_dedup": op1_near_query,
    "op2_suffix_dedup": op2_repeats_query,
    "op3_token_files": op3_tokens_query,
    "op4_source_mix": op4_mix_query,
    "op5_sequence_packing": op5_pack_query,
    "op6_nearest_neighbours": op6_ann_query,
    "op7_language_id": op7_language_query,
    "op8_line_dedup": op8_lines_query,
    "op9_exact_dedup": op9_exact_query,
    "op10_license_scan": op10_license_query,
    "op11_spelling_variants": op11_spelling_query,
    "op12_token_alignment": op12_align_query,
    "op13_toxicity": op13_toxicity_query,
}

ORACLE = {"op4_source_mix": op4_mix.ORACLE, "op9_exact_dedup": op9_exact.ORACLE}
