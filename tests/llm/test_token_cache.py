"""The encoder's cache: bounded, exact where hashes meet, and light."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from folio.llm import tokens


def words(n, seed=1):
    rng = np.random.default_rng(seed)
    return [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, k)) for k in rng.integers(1, 14, 50)) for _ in range(n // 50)]


def direct(enc, texts):
    return [i for t in texts for i in [*enc.tok.encode(t or "", add_special_tokens=False).ids, tokens.END_ID]]


TEXTS = ["Some words, some more.", None, "", "a " * 70, "<|x|> y", "x" * 300 + " z", "naïve Été", "a\x00 a a\x00\x00"]


@pytest.mark.parametrize("limits", [(600_000, 16 << 20), (40, 16 << 20), (600_000, 300)])
def test_ids_with_any_bounds(limits):
    enc = tokens.Encoder(tokens.vocabulary_path(), *limits)
    for texts in (TEXTS, words(500), TEXTS[::-1], words(500, 2) + TEXTS):
        assert enc.encode(pa.array(texts))[0].tolist() == direct(enc, texts)


def test_chunks_of_one_hash_keep_their_own_ids(monkeypatch):
    monkeypatch.setattr(tokens, "prints", lambda data, start, end, seeds: [np.full(len(start), 7, np.uint64)])
    enc = tokens.Encoder(tokens.vocabulary_path())
    for texts in (["one two six"], ["six two ten one"], ["three"]):
        assert enc.encode(pa.array(texts))[0].tolist() == direct(enc, texts)


def test_a_cached_chunk_takes_less_than_80_bytes():
    enc = tokens.Encoder(tokens.vocabulary_path())
    column = pa.array(words(40_000))
    tracemalloc.start()
    enc.encode(column)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(enc.n) > 30_000 and held < 80 * len(enc.n)
