"""Licence scan: tables where a licence is common, files with many licences."""

import random
import re

from folio.llm import op10_license
from tests.llm.test_operators import DOC, by_id

BODY = {label: body for label, (body, _) in op10_license.TEMPLATES.items()}


def scan(spark, texts):
    return by_id(op10_license.scan(spark.createDataFrame([(i, t, None, None, 0, "", "", 0) for i, t in enumerate(texts)], DOC)))


def test_op10_common_licence_is_found(spark):
    got = scan(spark, [f"file{i} does thing{i}\n{BODY['mit-text'] if i % 3 == 0 else 'nothing of note'}" for i in range(30)])
    assert [got[i]["labels"] for i in range(30)] == ["mit-text" if i % 3 == 0 else "" for i in range(30)]
    assert all(got[i]["score"] > 0.99 for i in range(0, 30, 3))


def test_op10_licence_of_every_file_and_of_one(spark):
    for n in (1, 2, 7):
        got = scan(spark, [BODY["bsd-text"] for _ in range(n)])
        assert [(r["labels"], r["score"]) for r in got.values()] == [("bsd-text", 1.0)] * n


def test_op10_file_of_all_templates(spark):
    rare = [f"file{i} does thing{i}" for i in range(60)]
    common = [f"{i} {BODY['unlicense']}" for i in range(15)]
    got = scan(spark, rare + common + ["notices " + "\nnext notice\n".join(BODY.values()), "\n".join(reversed(BODY.values()))])
    assert got[75]["labels"] == got[76]["labels"] == ",".join(sorted({*BODY, "apache", "gpl"}))


def test_op10_departing_text_and_lone_phrase(spark):
    words = BODY["bsd-text"].split()
    near, far = words[:20] + ["and", "so", "on"] + words[20:], words[:20] + ["x"] * 60 + words[20:]
    got = scan(spark, [" ".join(near), " ".join(far), "a Creative Commons Attribution is this", "a work in the public domain of this"])
    assert [got[i]["labels"] for i in range(4)] == ["bsd-text", "", "cc-by-notice", ""]


def plainly(texts):
    """Labels by trying every relative position of every template in every text."""
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) for t in texts]
    out = []
    for w in words:
        labels = {label for phrase, label in op10_license.BASE.items() if any(w[i:i + len(phrase.split())] == phrase.split() for i in range(len(w)))}
        for label, (body, keys) in op10_license.TEMPLATES.items():
            body, keys = body.split(), [(k.split(), body.split().index(k.split()[0])) for k in keys]
            at = [[i - q for i in range(len(w)) if w[i:i + len(k)] == k] for k, q in keys]
            need = min(op10_license.MIN_VOTES, *(len(set(k)) for k, _ in keys))
            s = op10_license.SLACK
            for place in range(-len(body) // s - 4, len(w) // s + 5) if all(at) else ():
                if all(any((place - 1) * s <= x < (place + 3) * s for x in xs) for xs in at):
                    agree = {t for j, t in enumerate(body) if any(0 <= place * s + j + e < len(w) and w[place * s + j + e] == t for e in range(2 * s))}
                    if len(agree) >= need:
                        labels.add(label)
        out.append(",".join(sorted(labels)))
    return out


def test_op10_against_every_position(spark):
    """Licences cut, shifted, interleaved and repeated among words of the same vocabulary."""
    rng = random.Random(12)
    vocabulary = sorted({w for body in BODY.values() for w in body.split()})
    texts = []
    for _ in range(80):
        parts = []
        for body in rng.sample(list(BODY.values()), rng.randint(0, 3)):
            w = body.split()
            for _ in range(rng.randint(0, 4)):
                i = rng.randrange(len(w))
                w[i:i + rng.randint(0, 2)] = rng.choices(vocabulary, k=rng.randint(0, 3))
            parts += w[rng.choice([0, 0, 3]):] + rng.choices(vocabulary, k=rng.randint(0, 40))
        texts.append(" ".join(rng.choices(vocabulary, k=rng.randint(0, 30)) + parts))
    want = plainly(texts)
    got = scan(spark, texts)
    assert [got[i]["labels"] for i in range(80)] == want and len(set(want)) > 10
