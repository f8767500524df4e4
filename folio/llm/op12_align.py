"""Cross-tokenizer alignment by interval coalescing.

A text's tokens of two tokenizers, A (byte-level BPE) and B (sentencepiece
BPE), are byte intervals. All tokens are lexsorted by start and the running
maximum of their ends is accumulated: a group breaks where a start reaches that
maximum. Inside the groups overlapping A and B tokens are expanded into pairs;
pairs that end together are the links.

No token of either tokenizer reaches across a lone space or line feed before a
visible character, so a text's tokens are those of its chunks, cut there; the
tokenizers' files are checked for what this needs, else whole texts are taken.
Each distinct chunk is compared as bytes, encoded once and held in a cache of
bounded size. Tasks write one row for each slice of texts: digests, its
distinct linked id pairs and which of them each document holds. Spark adds up
the pairs over all slices and sends each slice the counts of its own pairs, so
a pair that every document holds weighs one row a slice.

Defined cases: a null or empty text has no tokens, nor does one that either
tokenizer does not give back byte for byte (a literal U+2581): zeros and an
empty digest; special tokens in texts are plain text; a null doc_id and
repeated rows are documents of their own; other columns are ignored; an empty
table gives an empty result; a text longer than a slice is a slice alone."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import ragged, slices, stored, text_buffers

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
CACHE_CHUNKS = 300_000
SLICE_BYTES = 8 << 20
SPACE, FEED, MARK = 32, 10, "▁"
#: First bytes of characters that are not white space, ASCII or not.
VISIBLE = np.zeros(256, bool)
VISIBLE[0x21:0x7F] = VISIBLE[0xC3:0xE1] = VISIBLE[0xE4:] = True


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE)


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves, the others
    follow from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def coalesce(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The group of each interval, for intervals sorted by start: a group breaks where a start reaches the running
    maximum of the ends before it."""
    reach = np.maximum.accumulate(end)
    return np.cumsum(np.concatenate(([0], start[1:] >= reach[:-1]))) if len(start) else np.zeros(0, np.int64)


def overlaps(start_a, end_a, start_b, end_b) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (A interval, B interval) that share a byte; both lists are sorted and free of overlaps in themselves."""
    first = np.searchsorted(end_b, start_a, "right")
    count = np.maximum(np.searchsorted(start_b, end_a, "left") - first, 0)
    return np.repeat(np.arange(len(start_a)), count), ragged(first, count)


class Aligner:
    """Aligned tokens of chunks of text, each distinct chunk once."""

    def __init__(self, a_path: str, b_path: str, cache: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b, self.most = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path), cache
        self.a.encode_special_tokens = True
        letters = byte_alphabet()
        self.a_bytes = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.lead = self.b.piece_to_id(MARK)
        self.a_size = np.zeros(max(self.a_bytes) + 1, np.int64)
        for i, x in self.a_bytes.items():
            self.a_size[i] = len(x)
        self.b_size = np.fromiter(map(len, self.b_bytes), np.int64, len(self.b_bytes))
        self.cuttable = self._cuttable(pieces)
        self._clear()

    def _cuttable(self, pieces: list[str]) -> bool:
        """Do the files keep tokens inside chunks? B: the space mark only leads a piece, or the piece holds nothing
        else, no piece holds a line feed, and texts are not normalised. A: byte-level with the usual split pattern."""
        form = json.loads(self.a.to_str())
        before = form["pre_tokenizer"] or {}
        marks = all(MARK not in p[1:] or not p.strip(MARK) for p in pieces)
        feeds = not any("\n" in p for p in pieces)
        same = self.b.encode("\n\n  ﬁ ", out_type=str) == [MARK, "<0x0A>", "<0x0A>", MARK * 2, "ﬁ", MARK]
        return (marks and feeds and same and form["normalizer"] is None and before.get("type") == "ByteLevel"
                and before.get("use_regex", True) and not before.get("add_prefix_space"))

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.groups_text: list[str] = []
        self.stats = np.zeros((4, 0), np.int64)  # A tokens, B tokens, groups, links
        self.valid = np.zeros(0, bool)
        self.at, self.codes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _b_ids(self, texts: list[str]) -> list[list[int]]:
        """B writes a space before every text: it stands for a chunk's own one, or goes again."""
        out = self.b.encode([t[1:] if t[0] == " " else t for t in texts])
        return [ids if t[0] == " " and len(t) > 1 else [self.lead] if t == " " else ids[1:] for t, ids in zip(texts, out, strict=True)]

    def _learn(self, chunks: list[bytes]) -> None:
        texts = [c.decode() for c in chunks]
        ids_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        ids_b = self._b_ids(texts)
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        valid = np.fromiter((b"".join([a_bytes[i] for i in x]) == c == b"".join([b_bytes[i] for i in y])
                             for c, x, y in zip(chunks, ids_a, ids_b, strict=True)), bool, len(chunks))
        sides = []
        for ids, size in ((ids_a, self.a_size), (ids_b, self.b_size)):
            count = np.where(valid, np.fromiter(map(len, ids), np.int64, len(ids)), 0)
            flat = np.fromiter((i for x, ok in zip(ids, valid, strict=True) if ok for i in x), np.int64, int(count.sum()))
            end = np.cumsum(size[flat])  # the chunks one after another: no interval reaches into the next chunk
            sides.append((flat, end - size[flat], end, np.repeat(np.arange(len(chunks)), count), count))
        (a, start_a, end_a, chunk_a, n_a), (b, start_b, end_b, chunk_b, n_b) = sides
        start, end = np.concatenate((start_a, start_b)), np.concatenate((end_a, end_b))
        kind = np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((kind, start))
        group = np.empty(len(order), np.int64)
        group[order] = coalesce(start[order], end[order])
        left, right = overlaps(start_a, end_a, start_b, end_b)
        linked = end_a[left] == end_b[right]
        code, owner = (a[left] << 32 | b[right])[linked], chunk_a[left][linked]
        chunk = np.concatenate((chunk_a, chunk_b))
        n_groups = np.bincount(chunk[np.unique(group, return_index=True)[1]], minlength=len(chunks)) if len(group) else np.zeros(len(chunks), np.int64)
        n_links = np.bincount(owner, minlength=len(chunks))
        self.stats = np.concatenate((self.stats, np.stack((n_a, n_b, n_groups, n_links))), axis=1)
        self.at = np.concatenate((self.at, len(self.codes) + np.cumsum(n_links) - n_links))
        self.codes, self.valid = np.concatenate((self.codes, code)), np.concatenate((self.valid, valid))
        self.groups_text += self._written(np.concatenate((a, b)), group, kind, start, chunk, valid)
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks)), strict=True))

    @staticmethod
    def _written(ids, group, kind, start, chunk, valid) -> list[str]:
        """`a1,a2|b1;a3|b2` for every chunk; an invalid one has no tokens."""
        order = np.lexsort((start, kind, group))
        ids, group, kind, chunk = ids[order], group[order], kind[order], chunk[order]
        after = np.full(len(ids), ",", object)
        after[:-1][kind[1:] != kind[:-1]] = "|"
        after[:-1][group[1:] != group[:-1]] = ";"
        after[:-1][chunk[1:] != chunk[:-1]] = "\n"
        if len(ids):
            after[-1] = ""
        texts = iter("".join([x for pair in zip(map(str, ids.tolist()), after.tolist(), strict=True) for x in pair]).split("\n"))
        return [next(texts) if ok else "" for ok in valid]

    def slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(entry of every chunk of all texts, offsets of the texts in it)."""
        spaced = pc.if_else(pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0), pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type)), None)
        data, off = text_buffers(spaced)
        begins = np.zeros(len(data) + 1, bool)
        begins[off] = True
        if self.cuttable and len(data) > 2:
            mid, visible = data[1:-1], VISIBLE[data[2:]]
            begins[1:-2] |= visible & ((mid == FEED) | (mid == SPACE) & (data[:-2] != SPACE))
        begins[-1] = False
        begin = np.flatnonzero(begins)
        offsets = np.append(begin, len(data))
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        distinct = chunks.dictionary.to_pylist()
        new = [c for c in distinct if c not in self.known]
        if new and len(self.known) + len(new) > self.most and self.known:
            self._clear()
            new = distinct
        for i in range(0, len(new), 50_000):
            self._learn(new[i:i + 50_000])
        entry = np.fromiter((self.known[c] for c in distinct), np.int64, len(distinct))
        return entry[chunks.indices.to_numpy()], np.searchsorted(begin, off)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(paths: tuple[str, str]) -> Aligner:
    """One for each worker process, so its cache serves later tasks too."""
    if paths not in _aligners:
        _aligners[paths] = Aligner(*paths)
    return _aligners[paths]


# --- the job ---------------------------------------------------------------

COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
SLICE = pa.schema([("doc_id", pa.list_(pa.int64())), *[(c, pa.list_(pa.int64())) for c in COUNTS], ("groups", pa.list_(pa.string())),
                   ("codes", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), ("held", pa.binary())])
SLICE_DDL = ("doc_id array<long>, " + ", ".join(f"{c} array<long>" for c in COUNTS) + ", groups array<string>, codes array<long>, times array<long>, held binary")


def _pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(np.array([len(x)], np.int64).tobytes() + x.astype(np.uint32).tobytes() for x in arrays)
    return np.array([len(raw)], np.int64).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw, out, at = pa.decompress(blob[8:], int(np.frombuffer(blob, np.int64, 1)[0]), "zstd", asbytes=True), [], 0
    while at < len(raw):
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(np.frombuffer(raw, np.uint32, n, at + 8).astype(np.int64))
        at += 8 + 4 * n
    return out


def _slice_row(tool: Aligner, ids: pa.Array, texts: pa.Array, digest: bool) -> list:
    entry, off = tool.slice(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(off))
    bad = np.bincount(doc[~tool.valid[entry]], minlength=len(texts)) > 0
    if bad.any():  # texts that do not come back byte for byte have no tokens
        keep = ~bad[doc]
        entry, doc = entry[keep], doc[keep]
        off = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(texts)))))
    stats = [np.bincount(doc, tool.stats[i][entry], len(texts)).astype(np.int64) for i in range(4)]
    written, named, bound = tool.groups_text, entry.tolist(), off.tolist()
    groups = [";".join([written[i] for i in named[a:z]]) for a, z in zip(bound[:-1], bound[1:], strict=True)]
    if digest:
        groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
    used, place, count = np.unique(entry, return_inverse=True, return_counts=True)
    links = tool.stats[3][used]
    spread = tool.codes[ragged(tool.at[used], links)]
    codes, which = np.unique(spread, return_inverse=True)
    times = np.bincount(which, np.repeat(count, links), len(codes)).astype(np.int64)
    order = np.lexsort((place, doc))
    gaps = np.diff(place[order], prepend=0)
    first = off[:-1][np.diff(off) > 0]
    gaps[first] = place[order][first]  # inside a document the chunks ascend
    return [ids.to_pylist(), *[x.tolist() for x in stats], groups, codes, times, _pack(np.diff(off), gaps, links, which)]


def _slices_of(paths: tuple[str, str], digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE_BYTES):
            row = _slice_row(aligner(paths), b["doc_id"], b["text"], digest)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, SLICE, strict=True)], schema=SLICE)
    return run


def _answered(_, told: pa.Table, rows: pa.Table) -> pa.Table:
    """The documents of a slice with the counts of their links."""
    order = np.argsort(told["code"].to_numpy())
    n, best = told["n"].to_numpy()[order], told["best"].to_numpy()[order]
    row = {c: rows[c][0].as_py() for c in ["doc_id", *COUNTS, "groups"]}
    chunks, gaps, links, which = _unpack(rows["held"][0].as_py())
    owner = np.repeat(np.arange(len(links)), links)
    each_sum = np.zeros(len(links), np.int64)
    each_best = np.zeros(len(links), np.int64)
    np.add.at(each_sum, owner, n[which])
    np.add.at(each_best, owner, best[which].astype(np.int64))
    doc = np.repeat(np.arange(len(chunks)), chunks)
    total = np.cumsum(gaps)
    lead = np.cumsum(chunks) - chunks
    some = chunks > 0
    base = np.zeros(len(chunks), np.int64)
    base[some] = total[lead[some]] - gaps[lead[some]]
    place = total - base[doc]
    out = [np.zeros(len(chunks), np.int64) for _ in range(2)]
    np.add.at(out[0], doc, each_best[place])
    np.add.at(out[1], doc, each_sum[place])
    return pa.table({**{c: pa.array(row[c], pa.int64()) for c in ["doc_id", *COUNTS]}, "n_best": out[0], "count_sum": out[1], "groups": pa.array(row["groups"], pa.string())})


def align(docs: DataFrame, paths: tuple[str, str] | None = None, digest: bool = False) -> DataFrame:
    """One row a document of `docs(doc_id, text)`: numbers of tokens, groups and links, n_best, count_sum, and its
    groups written out, or with `digest` their SHA-256."""
    paths = paths or tokenizer_paths()
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = stored(told.mapInArrow(_slices_of(paths, digest), SLICE_DDL).withColumn("part", F.monotonically_increasing_id()), "align-slices")
    held = parts.select("part", F.explode(F.arrays_zip("codes", "times")).alias("c")).select("part", F.col("c.codes").alias("code"), F.col("c.times").alias("times"))
    counts = held.groupBy("code").agg(F.sum("times").alias("n"))
    of_b = Window.partitionBy(F.col("code").bitwiseAND(0xFFFFFFFF))  # at most A's vocabulary in a window
    counts = counts.withColumn("best", F.col("n") == F.max("n").over(of_b))
    told = held.select("part", "code").join(counts, "code").select(F.col("part").alias("of"), "code", "n", "best")
    slim = parts.drop("codes", "times")
    out = told.groupBy("of").cogroup(slim.groupBy("part")).applyInArrow(
        _answered, "doc_id long, " + ", ".join(f"{c} long" for c in [*COUNTS, "n_best", "count_sum"]) + ", groups string")
    return out.withColumnRenamed("groups", "groups_sha256") if digest else out
