"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from folio.llm import op11_spelling

DOC = "doc_id long, text string, lang string, word string, n long, form string"


def near(a, b):
    """Exactly one inserted, deleted or replaced code point, by trying all of them."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 7:
                count[run] += 1
    count = {w: n for w, n in count.items() if n >= 2}
    out = {}
    for w, n in count.items():
        others = [v for v in count if near(w, v)]
        best = min(others, key=lambda v: (-count[v], v), default=None)
        form = best if best is not None and count[best] >= 10 * n else None
        out[w] = [form, w, n, len(others), count[form] if form else None]
    for w in out:
        last = w
        while out[last][0]:
            last = out[last][0]
        out[w][1] = last
    return {w: tuple(x) for w, x in out.items()}


def table_rows(seed, letters, words, size):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 10))) for _ in range(words)]
    pool = list(stems)
    for s in stems:
        for _ in range(4):
            i, c = rng.randrange(len(s)), rng.choice(letters)
            pool.append(rng.choice([s[:i] + c + s[i:], s[:i] + s[i + 1:], s[:i] + c + s[i + 1:]]))
    weights = [rng.choice([1, 1, 5, 60, 900]) for _ in pool]
    return [(i, " ".join(w.title() if rng.random() < 0.1 else w for w in rng.choices(pool, weights, k=size)) + " x1y2, Thé.") for i in range(30)]


def result(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "en", "clash", 7, "clash") for i, t in rows], DOC).repartition(3)
    got = op11_spelling.spelling_variants(docs, **options).collect()
    assert len(got) == len({r["word"] for r in got})
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}


@pytest.mark.parametrize("seed,letters,group", [(1, "ab", 60_000), (2, "abcé", 60_000), (3, "aeiourstlñ×", 60_000), (4, "abc", 40)])
def test_against_all_pairs(spark, seed, letters, group):
    rows = table_rows(seed, letters, 25, 400)
    want = brute(rows)
    assert any(x[0] for x in want.values()) and any(x[3] for x in want.values())
    assert result(spark, rows, group_words=group) == want


def test_odd_rows(spark):
    long = "lengthy" * 2_000
    rows = [(None, "Separate separate seperate"), (None, "separate " * 30), (5, None), (5, ""), (6, "a b c 1234567"), (7, long), (7, long),
            (8, long + "x"), (8, long + "x"), (9, "seperate separte separte"), (9, "seperate separte separte"), (10, "ÀÉÎÕÜÑß àéîõüñß ÀÉÎÕÜÑß")]
    assert result(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert op11_spelling.spelling_variants(spark.createDataFrame([], DOC)).count() == 0


def test_chain_of_forms(spark):
    rows = [(1, "abcdefgh " * 3000 + "abcdefg " * 250 + "abcdefx " * 22 + "abcdxfx abcdxfx ")]
    got = result(spark, rows)
    assert got == brute(rows)
    assert {x[1] for x in got.values()} == {"abcdefgh"}


def test_group_finds_first_halves_once():
    """A pair whose halves both agree with an edit between them is counted on one side."""
    words = ["aaaaaaaa", "aaaaaaa", "aaaaaaab"]
    found = Counter()
    for side in (0, 1):
        rows = [{"side": side, "asks": k, "word": w, "n": 5} for k in (False, True) for w in words]
        for r in op11_spelling.near_words(pa.Table.from_pylist(rows)).to_pylist():
            found[r["word"]] += r["near"]
    assert found == {w: sum(near(w, v) for v in words) for w in words}
