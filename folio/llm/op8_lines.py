"""Line dedup by a deletion-neighbourhood join.

Lines are their words (runs without white space). The bound is one edit: a
word replaced, inserted or deleted. A line emits the hash of itself and of each
variant with one word deleted; equal variants at one position mean a replaced
word, a variant equal to a whole line an inserted one. A line goes if an equal
line or, for lines of MIN_WORDS words or more, one within the bound stands
earlier, in order of (doc_id, line number), judged on the input.

1. Documents are dealt into groups (the one shuffle of the texts); groups send
   the hashes of their distinct lines, with the first place of each, to
   owners, and learn which lines they are first to have.
2. Only those emit variants. The groups exchange Golomb-coded variant hashes;
   a variant that occurs once is done.
3. Of the shared variants a group sends the earliest line of each variant and
   position, with its words' hashes, to the owner, which verifies the edit
   distance to the earliest line there. A line with any number of near copies
   is sent once by a group; later ones of the group fall to it at home.
4. The groups get the contents that go, by their rank among the group's own,
   and cut their texts.

Defined cases: null text is empty; an empty text has no line; lines without a
word always stay; a null doc_id is below all others; repeated rows stand at
the same places, so neither is earlier; other columns are ignored; an empty
table gives an empty result."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import exchange as X
from folio.llm.common import GOLDEN, SPACE, mix64, prints, ragged, runs, slices, text_buffers

MIN_WORDS, GROUP_BYTES = 5, 4 << 20
_NULL, _WHOLE = -(1 << 63), 0xFFFFFFFF
U = np.uint64
RESULT = "doc_id long, n_lines long, n_equal long, n_near long, kept_sha256 string"


def within_one(a: np.ndarray, b: np.ndarray) -> bool:
    """Is the edit distance of two word sequences at most 1?"""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    differ = np.flatnonzero(a != b[:len(a)])
    if not len(differ):
        return True
    i = int(differ[0])
    return np.array_equal(a[i + (len(a) == len(b)):], b[i + 1:])


class _Lines:
    """The lines of one group of documents, in the order of the table."""

    def __init__(self, table: pa.Table):
        self.parts, ids, words, lines, doc0, word0 = [], [], [], [], 0, 0
        for b in slices(iter(table.combine_chunks().to_batches()), "text", 1 << 20):
            data, off = text_buffers(b["text"])
            begin, doc = _line_starts(data, off)
            start, end = runs(~SPACE[data], off)
            (h,) = prints(data, start, end, (1,))
            first = np.searchsorted(start, begin)
            last = np.append(first[1:], len(start))
            number = np.arange(len(begin)) - np.searchsorted(doc, doc)
            lines.append((first + word0, last + word0, doc + doc0, number))
            words.append(h)
            self.parts.append((data, off, begin, doc))
            ids.append(b["doc_id"].fill_null(_NULL).to_numpy(zero_copy_only=False))
            doc0, word0 = doc0 + b.num_rows, word0 + len(h)
        self.ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        self.h = np.concatenate(words) if words else np.zeros(0, U)
        self.a, self.z, self.row, self.number = (np.concatenate(c) for c in zip(*lines, strict=True)) if lines else [np.zeros(0, np.int64)] * 4
        self.doc = self.ids[self.row]
        self.n = self.z - self.a
        self.sum1, self.sum2 = _Sums(self.h, self.a, self.n, 0), _Sums(self.h, self.a, self.n, 0x2545F4914F6CDD1D)
        self.k1, self.k2 = self.sum1.whole(self.a, self.z), self.sum2.whole(self.a, self.z)
        some = np.flatnonzero(self.n > 0)
        order = some[np.lexsort((self.number[some], self.doc[some], self.k2[some], self.k1[some]))]
        new = np.ones(len(order), bool)
        new[1:] = (self.k1[order][1:] != self.k1[order][:-1]) | (self.k2[order][1:] != self.k2[order][:-1])
        self.head = order[new]                       # of each distinct line the first, in order of (k1, k2)
        self.of = np.full(len(self.a), -1)
        self.of[order] = np.cumsum(new) - 1

    def variants(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, line, position) of the lines themselves and of their deletions."""
        lines = lines[self.n[lines] >= MIN_WORDS]
        n = self.n[lines]
        at, line = ragged(self.a[lines], n), np.repeat(lines, n)
        a = self.a[line]
        return (np.concatenate((self.k1[lines], self.sum1.without(a, at, self.z[line]))), np.concatenate((lines, line)),
                np.concatenate((np.full(len(lines), _WHOLE, np.int64), at - a)))

    def second(self, line: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """The second hash of variants."""
        out = self.k2[line]
        cut = np.flatnonzero(pos != _WHOLE)
        x = line[cut]
        out[cut] = self.sum2.without(self.a[x], self.a[x] + pos[cut], self.z[x])
        return out

    def new_at(self, line: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Is a variant the first of its line with this content? To delete either of two equal neighbours is the same."""
        at = self.a[line] + np.where(pos == _WHOLE, 0, pos)
        return (at == self.a[line]) | (self.h[at] != self.h[at - 1])


class _Sums:
    """Hashes of the word sequences of lines, and of these with one word deleted, as differences of prefix sums over
    the words, each mixed with its place in the line."""

    def __init__(self, h: np.ndarray, a: np.ndarray, n: np.ndarray, seed: int):
        self.h, self.place = h ^ U(seed), (np.arange(len(h)) - np.repeat(a, n)).astype(U) * GOLDEN
        self.here, self.moved = self._sum(self.place), None

    def _sum(self, place: np.ndarray) -> np.ndarray:
        return np.concatenate((np.zeros(1, U), np.cumsum(mix64(self.h + place), dtype=U)))

    def whole(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64(self.here[end] - self.here[start])

    def without(self, start: np.ndarray, drop: np.ndarray, end: np.ndarray) -> np.ndarray:
        """What the line without its word `drop` would have: the words after it move forward by one place."""
        if self.moved is None:
            self.moved = self._sum(self.place - GOLDEN)
        return mix64(self.here[drop] - self.here[start] + self.moved[end] - self.moved[drop + 1])


def _line_starts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, document) of every line: each non-empty text starts one, so does each line break."""
    full = np.flatnonzero(np.diff(off) > 0)
    brk = np.flatnonzero(data == 10)
    begin = np.concatenate((off[full], brk + 1))
    doc = np.concatenate((full, np.searchsorted(off, brk, "right") - 1))
    order = np.lexsort((begin, doc))
    return begin[order], doc[order]


def _earliest(groups: list[np.ndarray], doc: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first of its run of equal keys) in order of (keys, doc, number)."""
    order = np.lexsort((number, doc, *groups[::-1]))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([g[order][1:] != g[order][:-1] for g in groups])
    return order, np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else np.zeros(0, np.int64)


def _first_places(table: pa.Table) -> pa.Table:
    """For each line sent: does no group have it at an earlier place?"""
    got = [np.frombuffer(x.as_py(), "<u8").reshape(4, -1) for x in table["lines"]]
    k1, k2, doc, number = np.concatenate(got, axis=1)
    doc, number = doc.view(np.int64), number.astype(np.int64)
    order, head = _earliest([k1, k2], doc, number)
    first = np.empty(len(order), bool)
    lead = order[head]
    first[order] = (doc[order] == doc[lead]) & (number[order] == number[lead])
    cut = np.cumsum([g.shape[1] for g in got])[:-1]
    return pa.table({"gid": table["gid"], "owner": table["owner"], "bits": pa.array([np.packbits(x).tobytes() for x in np.split(first, cut)], pa.binary())})


def _judge(table: pa.Table) -> pa.Table:
    """Of the lines sent, the contents of those within the bound of an earlier line that shares a variant, and of those
    that fell to one at home."""
    got = []
    for x in table["rows"]:
        raw = pa.decompress(x.as_py()[4:], struct.unpack_from("<I", x.as_py())[0], "zstd", asbytes=True)
        k, m = struct.unpack_from("<QQ", raw)
        cols = np.frombuffer(raw, "<u8", 7 * k, 16).reshape(7, k)
        got.append((cols, np.frombuffer(raw, "<u8", m, 16 + 56 * k), np.frombuffer(raw, "<u8", -1, 16 + 56 * k + 8 * m)))
    v1, v2, pos, doc, number, size, content = np.concatenate([c for c, _, _ in got], axis=1)
    words = np.concatenate([w for _, _, w in got])
    pos, doc, number, size = (x.astype(np.int64) if i != 1 else x.view(np.int64) for i, x in enumerate((pos, doc, number, size)))
    begin = np.cumsum(size) - size
    gone = np.zeros(len(v1), bool)

    def verify(late: np.ndarray, early: np.ndarray) -> None:
        later = (doc[late] > doc[early]) | ((doc[late] == doc[early]) & (number[late] > number[early]))
        for i, j in zip(late[later].tolist(), early[later].tolist(), strict=True):
            gone[i] |= within_one(words[begin[i]:begin[i] + size[i]], words[begin[j]:begin[j] + size[j]])

    order, head = _earliest([v1, v2, pos], doc, number)        # a word replaced: same variant, same position
    verify(order, order[head])
    whole = np.flatnonzero(pos == _WHOLE)
    cut = np.flatnonzero(pos != _WHOLE)
    for mine, other in ((cut, whole), (whole, cut)):           # a word inserted: a variant is a whole line
        both = np.concatenate((other, mine))
        kind = np.concatenate((np.zeros(len(other), np.int64), np.ones(len(mine), np.int64)))
        order = np.lexsort((number[both], doc[both], kind, v2[both], v1[both]))
        run = both[order]
        new = np.ones(len(run), bool)
        new[1:] = (v1[run][1:] != v1[run][:-1]) | (v2[run][1:] != v2[run][:-1])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(run) else run
        meets = (kind[order] == 1) & (kind[order][lead] == 0) if len(run) else np.zeros(0, bool)
        verify(run[meets], run[lead[meets]])
    cut = np.cumsum([c.shape[1] for c, _, _ in got])[:-1]
    back = [np.concatenate((np.unique(x[y]), fall)).tobytes() for x, y, (_, fall, _) in zip(np.split(content, cut), np.split(gone, cut), got, strict=True)]
    return pa.table({"gid": table["gid"], "owner": table["owner"], "bits": pa.array(back, pa.binary())})


def _bits(back: pa.Table, cut: np.ndarray) -> np.ndarray:
    """The bits that came back for what was cut by owner, in that order."""
    got = dict(zip(back["owner"].to_pylist(), back["bits"].to_pylist(), strict=True))
    size = np.diff(cut)
    return np.concatenate([np.unpackbits(np.frombuffer(got[o], np.uint8), count=int(size[o])) for o in np.flatnonzero(size).tolist()] or [np.zeros(0, np.uint8)]).astype(bool)


def line_dedup(docs: DataFrame, group_bytes: int = GROUP_BYTES, text: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_equal, n_near, kept_sha256), one row per document: its lines, those that go as equal and
    as near copies, and the hash of the others joined by line breaks; with `text`, these as `kept` too."""
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    groups = max(16, -(-total // group_bytes))
    dealt = docs.select(X.group_of("doc_id", groups), "doc_id", "text").groupBy("gid")
    bits = "gid long, owner int, bits binary"

    def places(key, table):
        g = _Lines(table)
        cut = X.owner_cuts(g.k1[g.head], groups)
        rows = []
        for o in np.flatnonzero(np.diff(cut)).tolist():
            s = g.head[cut[o]:cut[o + 1]]
            rows.append((o, key[0].as_py(), np.stack((g.k1[s], g.k2[s], g.doc[s].view(U), g.number[s].astype(U))).tobytes()))
        return _table(rows, [("owner", pa.int32()), ("gid", pa.int64()), ("lines", pa.binary())])

    def first_heads(g, back):
        """The distinct lines that no other group has earlier."""
        return g.head[_bits(back, X.owner_cuts(g.k1[g.head], groups))]

    def deletions(key, table, back):
        g = _Lines(table)
        v1, line, pos = g.variants(first_heads(g, back))
        return pa.Table.from_pandas(X.send(key[0].as_py(), v1[g.new_at(line, pos)], groups), preserve_index=False, schema=pa.schema(
            [("owner", pa.int32()), ("gid", pa.int64()), ("keys", pa.binary()), ("multi", pa.binary())]))

    def suspects(g, back):
        """Of the shared variants of the group's first lines: (line, hash, second hash, position), the earliest line of
        each variant and position; and the lines that fall to an earlier one of the group."""
        kind = np.array(back["kind"].to_pylist())
        v1, line, pos = g.variants(first_heads(g, back.filter(pa.array(kind == 0))))
        hit = np.flatnonzero(X.shared(v1, back.filter(pa.array(kind == 1)).to_pandas(), groups))
        v1, line, pos = v1[hit], line[hit], pos[hit]
        v2 = g.second(line, pos)
        order, head = _earliest([v1, v2, pos], g.doc[line], g.number[line])
        late = order[(line[order] != line[order[head]]) & (head != np.arange(len(order)))]
        early = np.empty(len(order), np.int64)
        early[order] = order[head]
        fall = [i for i, j in zip(line[late].tolist(), line[early[late]].tolist(), strict=True)
                if (g.doc[j], g.number[j]) < (g.doc[i], g.number[i]) and within_one(g.h[g.a[i]:g.z[i]], g.h[g.a[j]:g.z[j]])]
        keep = order[head == np.arange(len(order))]
        return line[keep], v1[keep], v2[keep], pos[keep], np.array(fall, np.int64)

    def send(key, table, back):
        g = _Lines(table)
        line, v1, v2, pos, fall = suspects(g, back)
        fall = np.unique(g.of[fall]).astype(U)       # with the first of the rows
        cut = X.owner_cuts(v1, groups)
        rows = []
        for o in np.flatnonzero(np.diff(cut)).tolist():
            s = slice(cut[o], cut[o + 1])
            x = line[s]
            cols = np.stack((v1[s], v2[s], pos[s].astype(U), g.doc[x].view(U), g.number[x].astype(U), g.n[x].astype(U), g.of[x].astype(U)))
            raw = struct.pack("<QQ", len(x), len(fall)) + cols.tobytes() + fall.tobytes() + g.h[ragged(g.a[x], g.n[x])].tobytes()
            rows.append((o, key[0].as_py(), struct.pack("<I", len(raw)) + pa.compress(raw, "zstd", asbytes=True)))
            fall = fall[:0]
        return _table(rows, [("owner", pa.int32()), ("gid", pa.int64()), ("rows", pa.binary())])

    def cut_texts(key, table, back):
        g = _Lines(table)
        kind = np.array(back["kind"].to_pylist())
        near = np.zeros(len(g.head), bool)
        for x in back.filter(pa.array(kind == 2))["bits"]:
            near[np.frombuffer(x.as_py(), "<u8").astype(np.int64)] = True
        # a line stays if it stands at the first place of its content, and that has no earlier near line
        first = np.zeros(len(g.a), bool)
        first[first_heads(g, back.filter(pa.array(kind == 0)))] = True
        lead = np.where(g.of >= 0, g.head[np.maximum(g.of, 0)], -1) if len(g.head) else np.full(len(g.a), -1)
        at_first = (lead >= 0) & first[lead] & (g.doc == g.doc[lead]) & (g.number == g.number[lead])
        equal = (lead >= 0) & ~at_first
        near = at_first & near[np.maximum(g.of, 0)] if len(g.head) else at_first
        return _cut(g, equal, near, text)

    def _kind(df, k):
        return df.withColumn("kind", F.lit(k))

    firsts = dealt.applyInArrow(places, "owner int, gid long, lines binary").groupBy("owner").applyInArrow(_first_places, bits)
    shared = X.answers(dealt.cogroup(firsts.groupBy("gid")).applyInArrow(deletions, X.SENT))
    both = _kind(firsts, 0).unionByName(_kind(shared, 1))
    verdicts = dealt.cogroup(both.groupBy("gid")).applyInArrow(send, "owner int, gid long, rows binary").groupBy("owner").applyInArrow(_judge, bits)
    every = _kind(firsts, 0).unionByName(_kind(verdicts, 2))
    return dealt.cogroup(every.groupBy("gid")).applyInArrow(cut_texts, RESULT + (", kept binary" if text else ""))


def _table(rows: list[tuple], fields: list[tuple]) -> pa.Table:
    schema = pa.schema(fields)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(fields), schema, strict=True)], schema=schema)


def _cut(g: _Lines, equal: np.ndarray, near: np.ndarray, text: bool) -> pa.Table:
    docs = len(g.ids)
    count = lambda x: np.bincount(g.row[x], minlength=docs)
    keep, out, line = ~(equal | near), [], 0
    for data, off, begin, doc in g.parts:
        raw = data.tobytes()
        k = len(begin)
        end = np.append(begin[1:] - 1, 0)
        tail = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) if k else np.zeros(0, np.int64)
        end[tail] = off[doc[tail] + 1]
        at = np.searchsorted(doc, np.arange(len(off)))
        some = keep[line:line + k]
        for d in range(len(off) - 1):
            a, z = int(at[d]), int(at[d + 1])
            out.append(raw[off[d]:off[d + 1]] if some[a:z].all() else b"\n".join(raw[begin[i]:end[i]] for i in range(a, z) if some[i]))
        line += k
    arrays = [pa.array(g.ids, pa.int64(), mask=g.ids == _NULL), pa.array(count(np.arange(len(g.a))), pa.int64()), pa.array(count(equal), pa.int64()),
              pa.array(count(near), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string())]
    return pa.Table.from_arrays(arrays + ([pa.array(out, pa.binary())] if text else []), names=["doc_id", "n_lines", "n_equal", "n_near", "kept_sha256"] + (["kept"] if text else []))
