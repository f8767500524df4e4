"""The subsequence kernel against its definition, and held-out accuracy on invented documents."""

import random
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from folio.llm import op13_toxicity as T

DOC = "doc_id long, text string, lang string, score double, toxic long, held_out string"
SYLLABLES = ["ka", "lo", "mi", "ren", "tu", "sal", "vo", "den", "pi", "gar", "é", "nor", "ti", "es"]
INSULTS = ["blorg", "snarfel", "quzzit", "dimwhop", "faglio"]


def symbols(word):
    return pa.array([bytes(T.SYMBOL[b] for b in word.encode())], pa.large_binary())


def naive(a, b):
    """Kernel of two strings: shared subsequences of three symbols over at most five places, by their gaps."""
    def phi(word):
        s = [T.FIRST, *(int(T.SYMBOL[x]) for x in word.encode()), T.LAST]
        out = {}
        for i, j, k in combinations(range(len(s)), 3):
            if k - i <= 4:
                out[s[i], s[j], s[k]] = out.get((s[i], s[j], s[k]), 0) + T.GAP ** (k - i - 2)
        return out
    x, y = phi(a), phi(b)
    return sum(v * y.get(u, 0) for u, v in x.items()) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5


def test_kernel():
    words = ["stupid", "stxupid", "stuupid", "aaaa", "ababab", "ñandú", "x", "STUPID", "st0pid"]
    for a in words:
        for b in words:
            got = T._kernel(symbols(a), symbols(b))[0, 0]
            assert abs(got - naive(a, b)) < 1e-9, (a, b)
    assert naive("stupid", "stxupid") > 0.4 > naive("stupid", "walking")


def test_strings():
    texts = pa.array(["It's s t u p i d, a b. c!", None, "", "...", "x" * 60, "a b cd"])
    words, place, doc = T.strings(texts)
    back = {v: c for c, v in zip("abcdefghijklmnopqrstuvwxyz", range(26), strict=True)}
    found = ["".join(back[x] for x in w) for w in words.to_pylist()]
    listed = [(int(d), found[p]) for d, p in zip(doc, place, strict=True)]
    assert listed == [(0, "its"), (0, "stupidabc"), *[(4, "x" * 24)] * 4, (5, "a"), (5, "b"), (5, "cd")]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(420):
        words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(INSULTS))
        rows.append((i, " ".join(words) + "."))
        if i % 10 != 9:
            labels.append((i, 0, int(toxic)))
    return rows, labels


def run(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, "en", 0.0, 1, "x") for i, t in rows], DOC).repartition(3)
    return T.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out_and_misspelt(spark, corpus):
    rows, labels = corpus
    extra = [(1000, "kalo miren t u b l o r g vo"), (1001, "miren snar-fel vo"), (1002, "miren quzzzit vo"), (1003, "lotu BLORG"), (1004, "lotu " * 3000 + "dimwhop")]
    clean = [(2000, None), (2001, ""), (2002, " \n."), (2003, "12 34"), (None, "kalo miren"), (5, rows[6][1]), (5, rows[6][1])]
    got = run(spark, rows + extra + clean, labels).collect()
    assert len(got) == len(rows) + len(extra) + len(clean)
    by_id = {r["doc_id"]: r for r in got}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    for i, _ in rows:
        if i != 5 and zlib.crc32(str(i).encode()) % 3 == 1:
            assert by_id[i]["predicted"] == int(i % 5 == 0), i
    assert all(by_id[i]["predicted"] == 1 for i, _ in extra[1:])
    assert all(r["predicted"] == 0 for r in got if r["doc_id"] is None or r["doc_id"] >= 2000)


def test_rerun_agrees(spark, corpus):
    rows, labels = corpus
    one, two = (sorted(map(tuple, run(spark, rows[:150], labels).collect())) for _ in range(2))
    assert one == two


def test_odd_labels(spark, corpus):
    rows, labels = corpus
    for some in ([], [x for x in labels if not x[2]], [(None, 0, 1), (1, 0, None)]):
        assert {(r["score"], r["predicted"]) for r in run(spark, rows[:20], some).collect()} == {(0.0, 0)}
    assert run(spark, [], labels).count() == 0


def test_logistic_is_monotone():
    slope, offset = T._logistic(np.array([-1.0, -0.5, 1.0, 2.0]), np.array([False, False, True, True]))
    assert slope > 0 and abs(offset) < 10
