"""Training-data operators against brute force on small tables: nulls, empty
texts, ties, repeated rows, empty tables, extra columns of clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from folio.llm import exchange, op1_near, op2_repeats, op3_tokens, op4_mix, op5_pack, op6_ann, op7_language, op8_lines, op9_exact, op10_license

DOC = "doc_id long, text string, lang string, source string, n_chars long, gid string, size string, keys int"


def text(rng, words, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(words))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    en = ["the", "thing", "other", "water", "with", "house", "walking", "under", "brother", "night"]
    de = ["der", "nicht", "schön", "straße", "über", "wasser", "zwischen", "auch", "lichkeit", "haus"]
    out = []
    for i in range(60):
        out.append((i, text(rng, 40, en if i % 2 else de), "en" if i % 2 else "de", f"s{i % 4}"))
    passage = text(rng, 30, [f"w{k}" for k in range(500)])
    out += [(60 + i, f"{text(rng, 12, en)} {passage} {text(rng, 12, en)}", "en", "s0") for i in range(4)]
    long = out[3][1].split()
    out += [(70, out[3][1], "en", "s1"), (71, "  " + out[3][1] + " \n", "en", "s1"), (72, " ".join(long[:20] + ["changed"] + long[21:]), "en", "s1")]
    lines = "one two three four five six\nanother line of seven words stands here"
    out += [(80, lines, "en", None), (81, lines.replace("four", "4") + "\n\nshort", "en", None), (82, "one two three four five six seven\n", "en", "s2")]
    out += [(90, None, None, None), (91, "", "en", "s2"), (92, " \n\t", "de", "s2"), (93, "123 456!", "en", None), (94, "<|endoftext|> It's A.B, don't ..x!", "en", "s3"),
            (95, text(rng, 3000, en + de), "en", "s3"), (96, "under the MIT License and CC BY or the Apache License. cc by", "en", "s3")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, None, "x", "y", 1) for r in rows], DOC).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_empty_tables(spark, empty):
    for f in (op1_near.near_classes, op2_repeats.mark_repeats, op3_tokens.token_files, op4_mix.mix_counts, op5_pack.pack, op7_language.identify,
              op8_lines.line_dedup, op9_exact.exact_groups, op10_license.scan):
        assert f(empty).count() == 0, f
    assert op6_ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_repeated_rows_and_null_ids(spark, rows):
    twice = spark.createDataFrame([(1, rows[3][1], "en", "s0", 0, "x", "y", 1)] * 2 + [(None, "a b c", "en", None, 0, "x", "y", 1), (None, None, None, None, 0, "x", "y", 1)], DOC)
    for f in (op1_near.near_classes, op2_repeats.mark_repeats, op3_tokens.token_files, op4_mix.mix_counts, op7_language.identify,
              op8_lines.line_dedup, op9_exact.exact_groups, op10_license.scan):
        assert f(twice).count() == 4, f
    assert op9_exact.exact_dedup(twice.filter("doc_id = 1")).count() == 1
    assert op2_repeats.mark_repeats(twice).agg({"n_removed": "sum"}).first()[0] == 0


def test_op1_against_all_pairs(docs, rows):
    texts = [r[1] for r in rows]
    table = np.zeros(1 << op1_near.SKETCH_BITS, np.int64)
    for t in texts:
        np.add.at(table, op1_near.cell(op1_near.shingles(pa.array([t], pa.string()))[0]), 1)
    idf, n, label = op1_near.idf_table(table, len(texts)), len(texts), {r[0]: r[0] for r in rows}
    for i in range(n):
        s = op1_near.similarities(pa.array([texts[i]] * n, pa.string()), pa.array(texts, pa.string()), idf)
        for j in np.flatnonzero(s >= op1_near.SIMILARITY).tolist():
            a, b = label[rows[i][0]], label[rows[j][0]]
            label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    got = by_id(op1_near.near_classes(docs))
    assert {k: r["class_id"] for k, r in got.items()} == label
    assert all(r["kept"] == (r["class_id"] == k) for k, r in got.items())
    assert got[71]["class_id"] == 3 and not got[70]["kept"]


def test_op1_sampler_collides_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(0)
    shingle = np.sort(rng.choice(1 << 40, 300, replace=False).astype(np.uint64))
    wa, wb = rng.gamma(2, 1, 300), rng.gamma(2, 1, 300)
    sampler = op1_near.Sampler(3000)
    a, b = (sampler(shingle, np.log(w).astype(np.float32), np.array([0, 300])) for w in (wa, wb))
    assert abs((a == b).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.04


def test_op2_against_brute_force(docs, rows):
    seen, got = set(), by_id(op2_repeats.mark_repeats(docs, group_bytes=2000, text=True))
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        starts = [s for s in range(len(b) - 49) if b[s:s + 50] in seen]
        gone = np.zeros(len(b), bool)
        for s in starts:
            gone[s:s + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        seen |= {b[s:s + 50] for s in range(len(b) - 49)}
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)


def test_op2_longest_previous_factor():
    data = np.frombuffer(b"abcabcabdabcab", np.uint8)
    start, doc = np.arange(10), np.array([5, 4, 3, 2, 2, 1, 9, 9, 9, 9])
    for length in (2, 3, 5):
        got = op2_repeats.longest_previous_factor(data, start, doc, length)
        want = [length if any(doc[q] < doc[p] and bytes(data[q:q + length]) == bytes(data[p:p + length]) for q in start) else 0 for p in start]
        assert got.tolist() == want


def test_op3_and_op5_against_the_library(docs, rows):
    from tokenizers import Tokenizer

    from folio.llm.tokens import vocabulary_path

    tok = Tokenizer.from_file(vocabulary_path())
    want = {r[0]: np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4") for r in rows}
    got, place = by_id(op3_tokens.token_files(docs)), 0
    for i in sorted(want):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (place, len(want[i]), zlib.crc32(want[i].tobytes()))
        place += len(want[i])
    pieces = op5_pack.pack(docs, longest=256, shortest=16, pool_ids=2000).collect()
    where, fill = {i: 0 for i in want}, {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        i, a = p["doc_id"], p["start"]
        assert a == where[i] and p["ids_crc32"] == zlib.crc32(want[i][a:a + p["length"]].tobytes()) and p["doc_tokens"] == len(want[i])
        where[i] = a + p["length"]
    assert where == {i: len(x) for i, x in want.items()}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == fill.get(p["sequence_id"], 0)
        fill[p["sequence_id"]] = p["offset"] + p["length"]
    assert all(n <= 256 and n & (n - 1) == 0 for n in fill.values())


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_op3_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    v = np.where(rng.random(n) < 0.05, rng.integers(0, 2**32, n), rng.integers(1000, 1300, n)).astype(np.uint32)
    got, end = op3_tokens.unpack(op3_tokens.pack(v))
    assert np.array_equal(got, v) and end == len(op3_tokens.pack(v))


def test_op4_targets_and_counts(spark, docs, rows):
    got, n = by_id(op4_mix.mix_counts(docs)), {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    size = {s: sum(n[r[0]] for r in rows if r[3] == s) for s in sources}
    weight, target = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}, dict.fromkeys(sources, 0.0)
    left, open_ = 1.5 * sum(size.values()), set(sources)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * size[s]}
        for s in full or open_:
            target[s] = 2.0 * size[s] if full else level * weight[s]
            left -= target[s]
        open_ -= full or open_
    for i, _, _, s in rows:
        assert got[i]["size"] == n[i] and got[i]["source_size"] == size[s] and got[i]["target"] == pytest.approx(target[s])
        assert got[i]["taken"] in (0, n[i], 2 * n[i])
    copies = {i: r["copies"] for i, r in got.items()}
    for s in sources:
        own = [r[0] for r in rows if r[3] == s]
        assert abs(sum(copies[i] for i in own) - len(own) * target[s] / max(size[s], 1)) <= 1
    assert op4_mix.mix(docs).count() == sum(copies.values())


def test_op6_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 32)).astype(np.float32) + 2 * rng.normal(size=(12, 32)).astype(np.float32)[rng.integers(0, 12, 600)]
    x[100:140] = x[100]
    table = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (720, [0.0] * 32), (740, [float("nan")] * 32), (760, [1.0, 2.0])]
    got = op6_ann.nearest(spark.createDataFrame(table, "vec_id long, embedding array<float>"), block=150).collect()
    d, hit, total = x.astype(float), 0, 0
    for q in range(0, 600, 20):
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        s = d @ d[q]
        best = [i for i in np.lexsort((np.arange(600), -s)).tolist() if i != q][:20]
        assert [r["rank"] for r in own] == list(range(1, 21)) and all(r["vec_id"] != q and abs(r["score"] - s[r["vec_id"]]) < 1e-9 for r in own)
        assert own == sorted(own, key=lambda r: (-r["score"], r["vec_id"]))
        hit, total = hit + len({r["vec_id"] for r in own} & set(best)), total + 20
    assert len(got) == total and hit >= 0.9 * total


def test_op6_pigeonhole():
    for radius in range(0, 40):
        radii = op6_ann.probe_radii(radius, 8)
        assert sum(t + 1 for t in radii) == radius + 1  # a code that misses every probe differs in radius + 1 bits at least


def test_op7_accuracy_and_gradients(docs, rows):
    got = by_id(op7_language.identify(docs))
    told = {r[0]: r[2] for r in rows[:60]}
    held = [i for i in told if got[i]["held_out"]]
    assert held and all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in told)
    assert np.mean([got[i]["lang_pred"] == told[i] for i in held]) >= 0.9
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (90, 91, 92, 93))
    net, x, y = op7_language.ByteGRU(3, hidden=4), np.array([[32, 97, 98, 32], [32, 99, 97, 32]], np.uint8), np.array([0, 2])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    loss = lambda: -net.log_probabilities(x)[:, np.arange(2), y].mean()
    for k, g in net.gradients(x, y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep = net.p[k][at]
        net.p[k][at] = keep + 1e-3
        up = loss()
        net.p[k][at] = keep - 1e-3
        assert g[at] == pytest.approx((up - loss()) / 2e-3, rel=0.05, abs=1e-5), k
        net.p[k][at] = keep


def test_op8_against_all_pairs(docs, rows):
    lines, got = [], by_id(op8_lines.line_dedup(docs, group_bytes=3000, text=True))
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        for j, line in enumerate(t.split("\n") if t else []):
            lines.append((i, j, line, np.array(re.findall(r"[^\x20\x09-\x0D]+", line), object)))
    count = {r[0]: [0, 0, 0, []] for r in rows}
    for k, (i, _, line, w) in enumerate(lines):
        before = [v for _, _, _, v in lines[:k]]
        equal = len(w) and any(len(v) == len(w) and (v == w).all() for v in before)
        near = len(w) >= 5 and any(len(v) >= 5 and op8_lines.within_one(v, w) for v in before)
        c = count[i]
        c[0] += 1
        c[1 if equal else 2] += bool(equal or near)
        if not (equal or near):
            c[3].append(line)
    for i, (a, b, c, kept) in count.items():
        assert (got[i]["n_lines"], got[i]["n_equal"], got[i]["n_near"], bytes(got[i]["kept"]).decode()) == (a, b, c, "\n".join(kept))


def test_op9_against_a_dictionary(docs, rows):
    norm = {r[0]: re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows}
    got = by_id(op9_exact.exact_groups(docs, group_rows=20))
    for i, t, *_ in rows:
        same = [r for r in rows if norm[r[0]] == norm[i]]
        keep = min(same, key=lambda r: (-len(r[1] or ""), r[0]))[0]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (keep, len(same), keep == i, hashlib.sha256(norm[i].encode()).hexdigest())


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_golomb_round_trip(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << exchange.BITS, n, dtype=np.uint64))
    assert np.array_equal(exchange.golomb_decode(exchange.golomb_encode(keys)), keys)


def test_op10_base_and_templates(spark, docs, rows):
    got = by_id(op10_license.scan(docs))
    assert (got[96]["n_base"], got[96]["first_word"], got[96]["last_word"], got[96]["base_labels"]) == (4, 2, 11, "apache,cc-by,mit")
    assert got[0]["labels"] == "" and got[0]["score"] == 0 and got[90]["n_words"] == 0
    body, keys = op10_license.TEMPLATES["bsd-text"]
    some = spark.createDataFrame([(i, r[1], None, None, 0, "", "", 0) for i, r in enumerate(rows)] + [(900, "x y z\n" + body.upper(), None, None, 0, "", "", 0)], DOC)
    r = by_id(op10_license.scan(some))[900]
    assert r["labels"] == "bsd-text" and r["base_labels"] == "" and r["score"] > 0.9
