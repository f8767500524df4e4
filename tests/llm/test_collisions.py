"""Texts made to collide under polynomial hashes modulo 2^64 (Thue-Morse strings)."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from folio.llm import op1_near, op2_repeats, op3_tokens, op5_pack, op7_language, op8_lines, op9_exact, tokens
from folio.llm.common import SpanHash
from tests.llm.test_operators import DOC, by_id


def thue_morse(units, a, b, flip=False):
    return [(a, b)[(bin(i).count("1") + flip) % 2] for i in range(units)]


PAIR = ["".join(thue_morse(2048, "a", "b", f)) for f in (False, True)]
WORDS = [" ".join(thue_morse(2048, "ab", "cd", f)) for f in (False, True)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", 1) for i, t in enumerate(texts)], DOC)


def test_span_hash():
    data = np.frombuffer("".join(PAIR).encode(), np.uint8)
    a, b = SpanHash(data)(np.array([0, 2048]), np.array([2048, 4096]))
    assert a != b
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    data[1000:1300] = data[4000:4300]
    h = SpanHash(data, seed=9)
    start = rng.integers(0, 4900, 2000)
    end = start + rng.integers(0, 60, 2000)
    got = h(start, end)
    spans = [data[s:e].tobytes() for s, e in zip(start, end, strict=True)]
    seen = {}
    for x, g in zip(spans, got.tolist(), strict=True):
        assert seen.setdefault(x, g) == g
    assert len(set(seen.values())) == len(seen)
    assert h(np.array([1000]), np.array([1300])) == h(np.array([4000]), np.array([4300]))
    drop = np.array([1005])
    short = np.delete(data[1000:1300], 5)
    assert h.without(np.array([1000]), drop, np.array([1300])) == SpanHash(short, seed=9)(np.array([0]), np.array([299]))


@pytest.mark.parametrize("op", [op3_tokens.token_files, op5_pack.pack])
def test_ids(spark, op):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.vocabulary_path())
    got = {}
    for r in op(frame(spark, PAIR + WORDS)).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + (r["n_tokens"] if "n_tokens" in r.asDict() else r["length"])
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(PAIR + WORDS)}
    enc = tokens.Encoder(tokens.vocabulary_path())
    for t in PAIR + WORDS:
        assert enc.encode(pa.array([t]))[0].tolist() == tok.encode(t, add_special_tokens=False).ids + [2]


def test_repeats(spark):
    """Bytes removed are those of 50-byte strings that start in an earlier text."""
    texts = PAIR + WORDS
    want = {}
    for i, t in enumerate(texts):
        b = t.encode()
        before = {e[j:j + 50] for e in (x.encode() for x in texts[:i]) for j in range(len(e) - 49)}
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 49):
            if b[j:j + 50] in before:
                gone[j:j + 50] = True
        want[i] = (int(gone.sum()), hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    got = by_id(op2_repeats.mark_repeats(frame(spark, texts)))
    assert {i: (r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == want


def test_lines(spark):
    got = by_id(op8_lines.line_dedup(frame(spark, WORDS), text=True))
    assert [got[i]["kept"] for i in (0, 1)] == [w.encode() if isinstance(got[0]["kept"], (bytes, bytearray)) else w for w in WORDS]


def test_step_groups_are_full(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50, n)) for n in rng.integers(1, 900, 400)]
    rows = op5_pack.pack(frame(spark, texts).coalesce(1), pool_ids=2000, step_ids=8192).select("step_id", "sequence_id", "window").distinct().collect()
    size = {}
    for r in rows:
        size[r["step_id"]] = size.get(r["step_id"], 0) + r["window"]
    assert len(size) > 3 and [size[k] for k in sorted(size)][:-1] == [8192] * (len(size) - 1)


def test_one_row_of_a_group_stays(spark):
    rows = [(5, "a b c"), (5, "a  b  c"), (5, "a  b  c"), (7, "a b  c "), (None, "x"), (None, " x"), (None, " x")]
    got = op9_exact.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    kept = [(r["doc_id"], r["keep_id"], r["group_size"]) for r in got if r["kept"]]
    assert len(got) == 7 and sorted(kept, key=str) == [(5, 5, 4), (None, None, 3)]


def test_near_copies_under_null_ids(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(None, text + f" end{i}", "en", "s", 0, "x", "y", 1) for i in range(3)] + [(4, "other text " * 5, "en", "s", 0, "x", "y", 1)]
    assert op1_near.near_dedup(spark.createDataFrame(rows, DOC)).count() == 2


def test_language_stage_without_labels(spark):
    rows = [(i, t, None, "s", 0, "x", "y", 1) for i, t in enumerate(["clean words here", "", None, "12 .", "more words"])]
    assert sorted(r["doc_id"] for r in op7_language.language_filter(spark.createDataFrame(rows, DOC)).collect()) == [0, 4]
