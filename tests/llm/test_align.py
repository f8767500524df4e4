"""Alignment of two tokenizers against whole-text encodings."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from folio.llm import op12_align

DOC = "doc_id long, text string, lang string, n_a string, groups string, part long, code string"


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = op12_align.tokenizer_paths()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    letters, spare = {}, 0  # the byte alphabet, by its rule
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE:
            letters[chr(b)] = b
        else:
            letters[chr(0x100 + spare)] = b
            spare += 1
    return a, letters, sentencepiece.SentencePieceProcessor(model_file=b_path)


def tokens(tools, text):
    """[(id, end)] of A and B, or None."""
    a, letters, b = tools
    if not text:
        return None
    spaced = (" " + text).encode()
    out = []
    e = a.encode(" " + text, add_special_tokens=False)
    sides = ([(i, bytes(letters[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)], [])
    for i in b.encode(text):
        p = b.id_to_piece(i)
        sides[1].append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    for side in sides:
        if b"".join(x for _, x in side) != spaced:
            return None
        at, ends = 0, []
        for i, x in side:
            at += len(x)
            ends.append((i, at))
        out.append(ends)
    return out


def brute(tools, rows):
    seen, pairs = [], Counter()
    for doc_id, text in rows:
        t = tokens(tools, text)
        if t is None:
            seen.append((doc_id, None, [], ""))
            continue
        a, b = t
        links = [(i, j) for i, x in a for j, y in b if x == y] if len(a) < 300 else [(i, dict((y, j) for j, y in b)[x]) for i, x in a if x in {y for _, y in b}]
        pairs.update(links)
        cuts = sorted({x for _, x in a} & {y for _, y in b})
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for i, x in a if low < x <= c) + "|" + ",".join(str(j) for j, y in b if low < y <= c))
            low = c
        seen.append((doc_id, (len(a), len(b), len(cuts)), links, ";".join(groups)))
    most = defaultdict(int)
    for (_, b), n in pairs.items():
        most[b] = max(most[b], n)
    return sorted((str(d), *(c or (0, 0, 0)), len(links), sum(pairs[p] == most[p[1]] for p in links), sum(pairs[p] for p in links),
                   hashlib.sha256(g.encode()).hexdigest() if g else "") for d, c, links, g in seen)


def got(spark, rows, parts=3):
    docs = spark.createDataFrame([(i, t, "en", "x", "y", 1, "z") for i, t in rows], DOC).repartition(parts)
    return sorted((str(r["doc_id"]), r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"])
                  for r in op12_align.align(docs, digest=True).collect())


ODD = ["", None, " ", "\n", "  ", " \n", "\n\n", " \n\n x", "a▁b", "▁", "<|endoftext|> and <s> </s> <unk> <0x41>", "it's I'M we'll 'x", "tab\there\r\nand \r x",
       "nbsp x  y  z　w \u0085v\n u", "ünïcödé façade ñandú Straße", "日本語 の テキスト。\n改行", "emoji 👩‍👩‍👧 ok", "\x00\x01 ctl", "ﬁ é", "{ }\r};\r\n", "1234 567,89",
       " lead", "trail ", "a  b   c    d", "x\n\n\ny", "﻿text", "don't  stop\n \nnow"]


def test_odd_texts(spark, tools):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, "twice over"), (3, "twice over")]
    assert got(spark, rows) == brute(tools, rows)


def test_random_texts(spark, tools):
    rng = random.Random(3)
    signs = list(" \n\n  \t\r.,'abcde1é日 ▁") + [" the", " water", "ing", "\n", " ", "Ab"]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 60)))) for i in range(600)]
    assert got(spark, rows) == brute(tools, rows)


def test_small_cache_and_long_text(spark, tools, monkeypatch):
    rng = random.Random(5)
    words = ["the", "house", "walking", "Straße", "niño", "42", "it's"]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", ".", "s", "x"]) for _ in range(150))) for i in range(40)]
    rows += [(100, "longword" * 500), (101, " ".join(rng.choice(words) for _ in range(3000)))]
    want = brute(tools, rows)
    assert got(spark, rows) == want
    tool = op12_align.Aligner(*op12_align.tokenizer_paths(), cache=20)
    import pyarrow as pa

    for _, t in rows[:20]:
        entry, off = tool.slice(pa.array([t, None, t]))
        assert off[1] == off[2] and len(tool.known) <= 40
        assert np.array_equal(tool.stats[0][entry[:off[1]]].sum(), len(tokens(tools, t)[0]))


def test_real_groups(spark):
    row = op12_align.align(spark.createDataFrame([(1, "hello world")], "doc_id long, text string")).first()
    assert row["groups"].count(";") == row["n_groups"] - 1 and "|" in row["groups"]


def test_empty_table(spark):
    assert op12_align.align(spark.createDataFrame([], DOC), digest=True).count() == 0
