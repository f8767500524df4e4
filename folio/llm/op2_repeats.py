"""Repeated passages by longest-previous-factor arrays over suffix order.

A byte is removed if a string of LENGTH bytes that covers it also starts in a
document of smaller doc_id. Equal strings must meet in one task without
shuffling every position, so strings are routed by minimisers: the k-gram of
smallest hash inside a string is its anchor, equal strings have equal anchors
at equal places, and neighbouring strings share theirs. A run of strings with
one anchor is a stretch of text, about 60 bytes for 14 strings.

1. Documents are dealt into groups (the one shuffle of the texts). The groups
   exchange Golomb-coded anchor hashes; stretches whose anchor occurs in one
   document only are done.
2. Each group sends the distinct remaining stretches, with the smallest
   doc_id that has them, to the owner of the anchor. A passage of any
   frequency is sent once by a group.
3. An owner puts the strings of all stretches of an anchor in suffix order and
   computes the longest previous factor of each: the larger common prefix with
   the previous and the next position of smaller doc_id. LENGTH or more means
   an earlier match.
4. The groups get the answers back and cut their texts.

Defined cases: null text is empty; a null doc_id is below all others; rows of
one doc_id are no earlier matches for each other; texts under LENGTH bytes
stay whole; other columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import exchange as X
from folio.llm.common import GOLDEN, eights, mix64, prints, ragged, slices, text_buffers

LENGTH, GRAM, GROUP_BYTES = 50, 24, 4 << 20
_NULL = -(1 << 63)
U = np.uint64
_ODD = U(0xD1B54A32D192ED03)
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


# --- suffix order ----------------------------------------------------------

def _nearest_smaller(doc: np.ndarray, lcp: np.ndarray, need: int) -> np.ndarray:
    """Common prefix with the nearest position before of smaller doc, where
    that is at least `need`, else 0. lcp[i]: with position i - 1. Pointers jump
    over positions that are not smaller, so their paths shorten by powers of two."""
    at, best = np.arange(len(doc)) - 1, lcp.copy()
    todo = np.flatnonzero((at >= 0) & (best >= need))
    while True:
        todo = todo[(at[todo] >= 0) & (best[todo] >= need)]
        todo = todo[doc[at[todo]] >= doc[todo]]
        if not len(todo):
            break
        over = at[todo]
        best[todo], at[todo] = np.minimum(best[todo], best[over]), at[over]
    best[(at < 0) | (best < need)] = 0
    return best


def longest_previous_factor(data: np.ndarray, start: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each position of `start`, in a document `doc`: the longest common
    prefix, up to `length`, with any position of a smaller document, where it
    reaches `length`; else 0."""
    first = np.argsort(doc, kind="stable")
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[start[first]])
    order = np.argsort(rows.view(f"S{length}").ravel(), kind="stable")
    rows, smaller = rows[order], doc[first][order]
    differ = rows[1:] != rows[:-1]
    lcp = np.zeros(len(start) + 1, np.int64)
    lcp[1:-1] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    before = _nearest_smaller(smaller, lcp[:-1], length)
    after = _nearest_smaller(smaller[::-1], lcp[1:][::-1], length)[::-1]
    out = np.empty(len(start), np.int64)
    out[first[order]] = np.maximum(before, after)
    return out


# --- stretches -------------------------------------------------------------

def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x, n = np.minimum(x[:-n], x[n:]), 2 * n
    return np.minimum(x[:len(x) - width + n], x[width - n:]) if width > n else x


def stretches(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, number of strings, anchor hash) of the maximal runs of strings with one anchor."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    eight = mix64(eights(data)[:n])
    m = n - GRAM + 1
    grams = eight[:m] + eight[8:m + 8] * GOLDEN + eight[16:m + 16] * _ODD   # GRAM is three eights
    place = _sliding_min((grams >> U(32) << U(32)) | np.arange(m, dtype=U), LENGTH - GRAM + 1) & U((1 << 32) - 1)
    inside = np.ones(n, bool)
    last = np.maximum(off[:-1], off[1:] - (LENGTH - 1))    # from here on, strings would cross the document's end
    inside[ragged(last, off[1:] - last)] = False
    inside = inside[:n - LENGTH + 1]
    change = np.ones(len(place) + 1, bool)
    change[1:-1] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])
    edges = np.flatnonzero(change)
    start = edges[:-1]
    ok = inside[start]
    # a document's first string starts a run even where the one before has the same anchor hash: places differ
    return start[ok], np.diff(edges)[ok], grams[place[start[ok]].astype(np.int64)]


class _Group:
    """All stretches of one group of documents, in the order of the table."""

    def __init__(self, table: pa.Table):
        ids, base, at, parts, data, off = [], 0, 0, [], [], [np.zeros(1, np.int64)]
        for b in slices(iter(table.combine_chunks().to_batches()), "text", 1 << 20):
            some, ends = text_buffers(b["text"])
            start, n, key = stretches(some, ends)
            parts.append((start + at, n, key, np.searchsorted(ends, start, "right") - 1 + base))
            data.append(some)
            off.append(ends[1:] + at)
            base, at = base + b.num_rows, at + len(some)
            ids.append(b["doc_id"].fill_null(_NULL).to_numpy(zero_copy_only=False))
        self.start, self.n, self.key, self.row = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 4
        self.data, self.off = np.concatenate(data) if parts else np.zeros(0, np.uint8), np.concatenate(off)
        self.ids = np.concatenate(ids) if base else np.zeros(0, np.int64)
        self.doc = self.ids[self.row]

    def prints(self, some: np.ndarray) -> list[np.ndarray]:
        start = self.start[some]
        return _prints(self.data, start, start + self.n[some] + LENGTH - 1)

    def distinct(self, some: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Of the stretches `some`, the places of one of each content, that of the smallest doc_id, in order of (key, content)."""
        cols = [self.key[some], h1, h2]
        order = np.lexsort((self.doc[some], *cols[::-1]))
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in cols])
        return order[new]

    def content(self, some: np.ndarray, part: int = 20_000) -> np.ndarray:
        """The bytes of stretches, one after another."""
        x, width, out = eights(self.data), np.arange(-(-(2 * LENGTH - GRAM) // 8) * 8), [np.zeros(0, np.uint8)]
        for a in range(0, len(some), part):
            s = some[a:a + part]
            rows = x[np.minimum(self.start[s][:, None] + width[::8], len(self.data))].view(np.uint8).reshape(len(s), -1)
            out.append(rows[width < (self.n[s] + LENGTH - 1)[:, None]])
        return np.concatenate(out)


def _payload(key, n, doc, content) -> bytes:
    """Sorted keys, strings, doc_ids and bytes of stretches, compressed; keys as differences."""
    raw = b"".join(x.tobytes() for x in (np.diff(key, prepend=U(0)), n.astype("<u2"), doc, content))
    return struct.pack("<II", len(key), len(raw)) + pa.compress(raw, "zstd", asbytes=True)


def _open(blob: bytes):
    k, size = struct.unpack_from("<II", blob)
    raw, at, out = pa.decompress(blob[8:], size, "zstd", asbytes=True), 0, []
    for kind, width in (("<u8", 8), ("<u2", 2), ("<i8", 8)):
        out.append(np.frombuffer(raw, kind, k, at))
        at += k * width
    content = np.frombuffer(raw, np.uint8, -1, at)
    begin, width = _spans(out[1])
    return np.cumsum(out[0], dtype=U), out[1], out[2], *_prints(content, begin, begin + width), content


def _prints(data: np.ndarray, start: np.ndarray, end: np.ndarray, part: int = 1 << 16) -> list[np.ndarray]:
    """Two hashes of the bytes of each stretch, some stretches at a time."""
    got = [prints(data, start[a:a + part], end[a:a + part], (3, 4)) for a in range(0, max(len(start), 1), part)]
    return [np.concatenate(h) for h in zip(*got, strict=True)]


def _spans(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = n.astype(np.int64) + LENGTH - 1
    return np.cumsum(size) - size, size


def _owner(table: pa.Table) -> pa.Table:
    """The answers of one owner: for each stretch sent, a bit for each of its strings that an earlier document has."""
    got = [_open(x.as_py()) for x in table["payload"]]
    key, n, doc, h1, h2, content = (np.concatenate(c) for c in zip(*got, strict=True))
    n = n.astype(np.int64)
    begin, _ = _spans(n)
    order = np.lexsort((doc, h2, h1, key))
    new = np.ones(len(key), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    of = np.empty(len(key), np.int64)
    of[order] = np.cumsum(new) - 1
    head = order[new]                              # of each content, the stretch of the smallest doc_id
    flag_at = np.cumsum(n) - n
    flags = np.repeat(doc > doc[head][of], n)      # a copy: its strings all start in an earlier document
    hk = key[head]
    same = np.zeros(len(head), bool)
    same[1:] |= hk[1:] == hk[:-1]
    same[:-1] |= hk[1:] == hk[:-1]
    several = np.flatnonzero(same)                 # contents that share their anchor with another content
    many = n[head[several]]
    total, a = np.cumsum(many), 0
    earlier = np.zeros(int(many.sum()), bool)
    while a < len(several):                        # whole anchors, some hundred thousand strings at a time
        z = int(np.searchsorted(total, (total[a - 1] if a else 0) + 200_000, "right"))
        z = max(a + 1, z)
        while z < len(several) and hk[several[z]] == hk[several[z - 1]]:
            z += 1
        part = head[several[a:z]]
        earlier[(total[a - 1] if a else 0):total[z - 1]] = longest_previous_factor(
            content, ragged(begin[part], n[part]), np.repeat(doc[part], n[part])) >= LENGTH
        a = z
    first_of = np.full(len(head), -1)
    first_of[several] = total - many
    own = np.flatnonzero((doc == doc[head][of]) & (first_of[of] >= 0))
    flags[ragged(flag_at[own], n[own])] = earlier[ragged(first_of[of[own]], n[own])]
    out, at, bit = [], 0, 0
    for g in got:
        k, bits = len(g[0]), int(g[1].astype(np.int64).sum())
        out.append(struct.pack("<I", k) + g[3].tobytes() + g[4].astype("<u4").tobytes() + g[1].tobytes() + np.packbits(flags[bit:bit + bits]).tobytes())
        at, bit = at + k, bit + bits
    return pa.table({"gid": table["gid"], "answer": pa.array(out, pa.binary())})


def _answers(table: pa.Table):
    """(h1 in order, low half of h2, strings, first bit, bits) of all that came back to a group."""
    h1, h2, n, bits = [], [], [], []
    for raw in (x.as_py() for x in table["answer"]):
        (k,) = struct.unpack_from("<I", raw)
        h1.append(np.frombuffer(raw, "<u8", k, 4))
        h2.append(np.frombuffer(raw, "<u4", k, 4 + 8 * k))
        n.append(np.frombuffer(raw, "<u2", k, 4 + 12 * k).astype(np.int64))
        bits.append(np.unpackbits(np.frombuffer(raw, np.uint8, -1, 4 + 14 * k), count=int(n[-1].sum())).astype(bool))
    h1, h2, n, bits = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((h1, U), (h2, np.uint32), (n, np.int64), (bits, bool)))
    order = np.argsort(h1, kind="stable")
    return h1[order], h2[order], (np.cumsum(n) - n)[order], bits


def _before(mask: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many of the mask are set before each place."""
    sums = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=sums[1:])
    return sums[places]


def mark_repeats(docs: DataFrame, group_bytes: int = GROUP_BYTES, text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per document; with `text`, the kept bytes as `kept` too."""
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    groups = max(16, -(-total // group_bytes))
    dealt = docs.select(X.group_of("doc_id", groups), "doc_id", "text").groupBy("gid")

    def anchors(key, table):
        g = _Group(table)
        pairs = np.lexsort((g.doc, g.key))
        new = np.ones(len(pairs), bool)
        new[1:] = (g.key[pairs][1:] != g.key[pairs][:-1]) | (g.doc[pairs][1:] != g.doc[pairs][:-1])
        return pa.Table.from_pandas(X.send(key[0].as_py(), g.key[pairs[new]], groups), schema=pa.schema(
            [("owner", pa.int32()), ("gid", pa.int64()), ("keys", pa.binary()), ("multi", pa.binary())]), preserve_index=False)

    def send(key, table, back):
        schema = pa.schema([("owner", pa.int32()), ("gid", pa.int64()), ("payload", pa.binary())])
        if not table.num_rows or not back.num_rows:
            return schema.empty_table()
        g = _Group(table)
        some = np.flatnonzero(X.shared(g.key, back.to_pandas(), groups))
        some = some[g.distinct(some, *g.prints(some))]
        cut = X.owner_cuts(g.key[some], groups)
        rows = []
        for o in np.flatnonzero(np.diff(cut)).tolist():
            s = some[cut[o]:cut[o + 1]]
            rows.append((o, key[0].as_py(), _payload(g.key[s], g.n[s], g.doc[s], g.content(s))))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 3, schema, strict=True)], schema=schema)

    def cut_texts(key, table, back):
        g = _Group(table)
        h1, h2, bit, bits = _answers(back)
        p1, p2 = g.prints(np.arange(len(g.start)))
        at = np.minimum(np.searchsorted(h1, p1), max(len(h1) - 1, 0))
        s = np.flatnonzero((h1[at] == p1) & (h2[at] == p2.astype(np.uint32))) if len(h1) else np.zeros(0, np.int64)
        at, p1, p2 = at[s], p1[s], p2[s]
        # the smallest doc_id of the group with this content is what was sent
        lead = g.distinct(s, p1, p2)
        lead = lead[np.argsort(p1[lead], kind="stable")]
        least = g.doc[s[lead]][np.searchsorted(p1[lead], p1)]
        n, data, off = g.n[s], g.data, g.off
        flags = np.repeat(g.doc[s] > least, n) | bits[ragged(bit[at], n)]
        starts = np.zeros(len(data), bool)
        starts[ragged(g.start[s], n)[flags]] = True
        covers = _before(starts, slice(None))            # strings that go and start before here
        gone = covers[1:] > 0
        gone[LENGTH:] = covers[LENGTH + 1:] > covers[1:-LENGTH]
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        firsts = off[:-1][np.diff(off) > 0]
        opens[firsts] = gone[firsts]
        count, runs = _before(gone, off), _before(opens, off)
        kept, to, out = data[~gone].tobytes(), off - count, []
        for d in range(len(off) - 1):
            own = kept[to[d]:to[d + 1]]
            out.append((int(off[d + 1] - off[d]), int(count[d + 1] - count[d]), int(runs[d + 1] - runs[d]), hashlib.sha256(own).hexdigest())
                       + ((own,) if text else ()))
        cols = list(zip(*out, strict=True)) if out else [()] * (5 if text else 4)
        names, kinds = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64()] * 4 + [pa.string()]
        arrays = [pa.array(g.ids, pa.int64(), mask=g.ids == _NULL), *(pa.array(c, t) for c, t in zip(cols[:4], kinds[1:], strict=True))]
        return pa.Table.from_arrays(arrays + ([pa.array(cols[4], pa.binary())] if text else []), names=names + (["kept"] if text else []))

    back = X.answers(dealt.applyInArrow(anchors, X.SENT))
    sent = dealt.cogroup(back.groupBy("gid")).applyInArrow(send, "owner int, gid long, payload binary")
    answers = sent.groupBy("owner").applyInArrow(_owner, "gid long, answer binary")
    return dealt.cogroup(answers.groupBy("gid")).applyInArrow(cut_texts, RESULT + (", kept binary" if text else ""))
