"""Token ids in files of patched frame-of-reference blocks.

A segment is a file image of at most SEGMENT_IDS ids or one document: a
header, the documents' ids and token counts, an index of block starts, and
blocks of 256 ids. A block subtracts its minimum, packs the low bits of the
differences at the width that holds PERCENTILE of them (as bit planes), and
keeps the others' places and high parts in an exception list. Segments are
rows of a Parquet table in the shared folder: Spark's commit makes the files
safe against lost tasks, and any store that Spark reads will do.

Defined cases: null text is empty and has the end id alone; a null doc_id
sorts first; repeated rows are documents of their own, in either order; other
columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import slices
from folio.llm.tokens import encoder, vocabulary_path
from folio.session import scratch_path

BLOCK, PERCENTILE, SEGMENT_IDS = 256, 90, 1 << 20
MAGIC = b"PFR1"
_EMPTY = -(1 << 63)  # in a segment, the doc_id null


def pack(values: np.ndarray) -> bytes:
    """uint32 values -> count, index of block starts, blocks."""
    n = len(values)
    blocks = -(-n // BLOCK)
    v = np.concatenate((values, np.full(blocks * BLOCK - n, values[-1] if n else 0, np.uint32))).reshape(blocks, BLOCK).astype(np.uint32)
    low = v.min(axis=1, initial=0xFFFFFFFF) if blocks else np.zeros(0, np.uint32)
    diff = v - low[:, None]
    bits = np.ceil(np.log2(diff.astype(np.float64) + 1)).astype(np.uint8)
    width = np.sort(bits, axis=1)[:, BLOCK * PERCENTILE // 100 - 1] if blocks else np.zeros(0, np.uint8)
    odd = bits > width[:, None]
    many = odd.sum(axis=1)
    size = 7 + width.astype(np.int64) * (BLOCK // 8) + many * 5
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    head = np.zeros((blocks, 7), np.uint8)
    head[:, :4] = low.astype("<u4").view(np.uint8).reshape(blocks, 4)
    head[:, 4] = width
    head[:, 5:] = many.astype("<u2").view(np.uint8).reshape(blocks, 2)
    out[start[:, None] + np.arange(7)] = head
    for j in range(int(width.max(initial=0))):
        has = width > j
        plane = np.packbits(((diff[has] >> np.uint32(j)) & 1).astype(np.uint8), axis=1)
        out[(start[has] + 7 + j * (BLOCK // 8))[:, None] + np.arange(BLOCK // 8)] = plane
    row, col = np.nonzero(odd)
    if len(row):
        nth = np.arange(len(row)) - (np.cumsum(many) - many)[row]
        place = (start + 7 + width.astype(np.int64) * (BLOCK // 8))[row] + nth * 5
        out[place] = col
        out[place[:, None] + np.arange(1, 5)] = (diff[row, col] >> width[row]).astype("<u4").view(np.uint8).reshape(-1, 4)
    return struct.pack("<QQ", n, len(out)) + start.astype("<u8").tobytes() + out.tobytes()


def unpack(raw: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """(values, place after them)."""
    n, size = struct.unpack_from("<QQ", raw, at)
    blocks = -(-n // BLOCK)
    start = np.frombuffer(raw, "<u8", blocks, at + 16).astype(np.int64)
    data = np.frombuffer(raw, np.uint8, size, at + 16 + 8 * blocks)
    head = data[start[:, None] + np.arange(7)] if blocks else np.zeros((0, 7), np.uint8)
    low = np.ascontiguousarray(head[:, :4]).view("<u4").ravel()
    width, many = head[:, 4].astype(np.int64), np.ascontiguousarray(head[:, 5:]).view("<u2").ravel().astype(np.int64)
    diff = np.zeros((blocks, BLOCK), np.uint32)
    for j in range(int(width.max(initial=0))):
        has = np.flatnonzero(width > j)
        plane = data[(start[has] + 7 + j * (BLOCK // 8))[:, None] + np.arange(BLOCK // 8)]
        diff[has] |= np.unpackbits(plane, axis=1).astype(np.uint32) << np.uint32(j)
    row = np.repeat(np.arange(blocks), many)
    if len(row):
        nth = np.arange(len(row)) - (np.cumsum(many) - many)[row]
        place = (start + 7 + width * (BLOCK // 8))[row] + nth * 5
        high = np.ascontiguousarray(data[place[:, None] + np.arange(1, 5)]).view("<u4").ravel()
        diff[row, data[place]] |= high << width[row].astype(np.uint32)
    return (diff + low[:, None]).ravel()[:n], at + 16 + 8 * blocks + size


def segment(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    return MAGIC + struct.pack("<Q", len(doc_ids)) + doc_ids.astype("<i8").tobytes() + pack(counts.astype(np.uint32)) + pack(ids)


def read_segment(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if raw[:4] != MAGIC:
        raise ValueError("not a token segment")
    (n,) = struct.unpack_from("<Q", raw, 4)
    counts, at = unpack(raw, 12 + 8 * n)
    return np.frombuffer(raw, "<i8", n, 12), counts.astype(np.int64), unpack(raw, at)[0]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode `docs(doc_id, text)` and write their segments, in ascending doc_id order, to `path`."""

    def encode(batches):
        from pyspark import TaskContext

        tok, part, seg = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for b in slices(batches, "text", 4 << 20):
            ids, n = tok.encode(b["text"])
            doc_ids = b["doc_id"].fill_null(_EMPTY).to_numpy(zero_copy_only=False)
            ends, a, rows = np.cumsum(n), 0, []
            while a < len(n):
                begin = int(ends[a - 1]) if a else 0
                z = max(a + 1, int(np.searchsorted(ends, begin + segment_ids, "right")))
                rows.append((part, seg, int(ends[z - 1]) - begin, segment(doc_ids[a:z], n[a:z], ids[begin:int(ends[z - 1])])))
                seg, a = seg + 1, z
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                                             ["part", "seg", "n_ids", "image"])

    (docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
     .mapInArrow(encode, "part int, seg long, n_ids long, image binary").write.parquet(path))


def read_tokens(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document from written segments."""
    files = spark.read.schema("part int, seg long, n_ids long, image binary").parquet(path)
    small = files.select("part", "seg", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per written partition
    parts = small.groupBy("part").agg(F.sum("n_ids").alias("n")).select(F.col("part").alias("__part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    segs = small.select(F.col("part").alias("__p"), F.col("seg").alias("__seg"), F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("ahead"))
    place = segs.join(parts, F.col("__p") == F.col("__part")).select("__p", "__seg", (F.col("base") + F.col("ahead")).alias("place"))

    def decode(batches):
        for b in slices(batches, "image", 4 << 20):
            for raw, part, seg in zip(b["image"], b["part"], b["seg"], strict=True):
                doc_ids, n, ids = read_segment(raw.as_py())
                start, view = np.cumsum(n) - n, memoryview(ids.astype("<u4").tobytes())
                crc = np.array([zlib.crc32(view[4 * x:4 * (x + y)]) for x, y in zip(start.tolist(), n.tolist(), strict=True)], np.int64)
                k = len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64(), mask=doc_ids == _EMPTY), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()),
                     pa.array(np.full(k, part.as_py()), pa.int32()), pa.array(np.full(k, seg.as_py()), pa.int64())],
                    ["doc_id", "at", "n_tokens", "ids_crc32", "part", "seg"])

    rows = files.select("part", "seg", "image").mapInArrow(decode, "doc_id long, at long, n_tokens long, ids_crc32 long, part int, seg long")
    return (rows.join(place, (F.col("part") == F.col("__p")) & (F.col("seg") == F.col("__seg")))
            .select("doc_id", (F.col("place") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))


def token_files(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write, then read back."""
    path = scratch_path(docs.sparkSession, "op3-tokens")
    write_tokens(docs, path, vocabulary or vocabulary_path())
    return read_tokens(docs.sparkSession, path)
