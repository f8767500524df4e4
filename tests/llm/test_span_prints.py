"""Hashes of short spans: right, and cheaper than prefix hashes over every byte."""

import time

import numpy as np
import pyarrow as pa

from folio.llm import common, op2_repeats, op8_lines


def sample(docs=300, words=800):
    rng = np.random.default_rng(5)
    known = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(2, 12, 3000)]
    texts = ["\n".join(" ".join(known[w] for w in rng.integers(0, 3000, 20)) for _ in range(words // 20)) for _ in range(docs)]
    return pa.table({"doc_id": pa.array(range(docs), pa.int64()), "text": pa.array(texts)})


def cpu(call):
    def once():
        t = time.process_time()
        call()
        return time.process_time() - t
    return min(once() for _ in range(3))


def test_prints_follow_content():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 5000, dtype=np.uint8)
    data[1003:1300] = data[4000:4297]
    start = np.concatenate((rng.integers(0, 4900, 4000), [1003, 4000, 5000, 4999]))
    end = np.concatenate((start[:4000] + rng.integers(0, 60, 4000), [1300, 4297, 5000, 5000]))
    for h in common.prints(data, start, end, (1, 2)):
        seen = {}
        for s, e, x in zip(start.tolist(), end.tolist(), h.tolist(), strict=True):
            assert seen.setdefault(data[s:e].tobytes(), x) == x
        assert len(set(seen.values())) == len(seen)
    a, b = common.prints(data, start, end, (1, 2))
    assert not (a == b).any()
    assert [len(h) for h in common.prints(data[:0], start[:0], end[:0], (1, 2))] == [0, 0]
    zero = np.zeros(40, np.uint8)
    assert len(set(common.prints(zero, np.zeros(41, np.int64), np.arange(41), (1,))[0].tolist())) == 41


def test_a_deletion_hashes_as_the_shorter_line():
    words = "one two two three four five six".split()
    lines = [words, *(words[:i] + words[i + 1:] for i in range(len(words)))]
    g = op8_lines._Lines(pa.table({"doc_id": [3], "text": ["\n".join(" ".join(x) for x in lines)]}))
    v1, line, pos = g.variants(np.array([0]))
    assert v1.tolist() == g.k1.tolist() and g.second(line, pos).tolist() == g.k2.tolist()
    assert g.new_at(line, pos).tolist() == [True, True, True, False, True, True, True, True]


def test_lines_cost_less_than_prefix_hashes_of_their_bytes():
    table = sample()
    data, _ = common.text_buffers(table["text"].combine_chunks())
    assert cpu(lambda: op8_lines._Lines(table)) < cpu(lambda: common.SpanHash(data))


def test_stretches_cost_less_than_two_prefix_hashes_of_their_bytes():
    table = sample()
    data, _ = common.text_buffers(table["text"].combine_chunks())
    assert cpu(lambda: op2_repeats._Group(table)) < 2 * cpu(lambda: common.SpanHash(data))


def test_stretches_hold_every_string_and_its_bytes():
    """Each place that starts a string of 50 bytes within its text lies in one stretch; texts shorter than that in none."""
    texts = ["", "x" * 49, "y" * 50, None, "".join(chr(97 + i * i % 23) for i in range(400)), "z" * 51]
    g = op2_repeats._Group(pa.table({"doc_id": pa.array(range(6), pa.int64()), "text": pa.array(texts)}))
    got = sorted(common.ragged(g.start, g.n).tolist())
    assert got == [49] + list(range(99, 99 + 351)) + [499, 500]
    size = g.n + op2_repeats.LENGTH - 1
    assert g.content(np.arange(len(g.n)), 3).tobytes() == g.data[common.ragged(g.start, size)].tobytes()
