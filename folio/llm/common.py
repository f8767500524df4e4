"""Helpers shared by the training-data operators: tables in the shared folder,
Arrow text buffers, vectorised hashes of byte spans, connected components.

Python tasks work on Arrow buffers, a few MB at a time, so their memory does
not follow the number of rows in a partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.session import scratch_path

SLICE_BYTES = 4 << 20
U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table written to the shared folder and read back: its lineage
    ends there, and losing an executor later costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spare(docs: DataFrame, name: str) -> str:
    """`name`, or with underscores after it where `docs` has such a column."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def own_ids(docs: DataFrame) -> DataFrame:
    """`docs` and, as last column, an id of each row's own in the order of doc_id, null first: doc_id itself where none
    repeats, else a number written once with the rows, so that decisions fall on rows and not on ids."""
    name = spare(docs, "__row")
    row = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    if not docs.groupBy(row.alias("r")).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        return docs.withColumn(name, row)
    hashable = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    content = F.xxhash64(*[x for c in hashable for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())])
    by, salt = spare(docs, "__content"), spare(docs, "__salt")
    dealt = (docs.withColumn(by, content).withColumn(salt, F.rand(7))
             .repartitionByRange(F.col("doc_id").asc_nulls_first(), by, salt)
             .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), by))
    return stored(dealt.drop(by, salt).withColumn(name, F.monotonically_increasing_id()), "own-ids")


def under_row(rows: DataFrame) -> DataFrame:
    """The rows of own_ids() as documents whose doc_id is their own id."""
    row = rows.columns[-1]
    return rows.withColumn("doc_id", F.col(row)).drop(row)


def keep_rows(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of own_ids() whose own id is a doc_id of `ids`, as they came in."""
    row = rows.columns[-1]
    return rows.join(ids.select(F.col("doc_id").alias(row)), row, "left_semi").drop(row)


# --- Arrow buffers ---------------------------------------------------------

def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0]:off[-1]] if buf is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds about `limit` bytes of `column`
    (always one row at least, however long)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + limit, "right")))
            yield b.slice(a, z - a)
            a = z


# --- hashes of byte spans --------------------------------------------------

def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(29))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(32))


class SpanHash:
    """Polynomial hashes of any spans of a byte array, from prefix sums: two lanes modulo the prime 2^31 - 1 with bases
    of their own, so no fixed strings collide for all words; bytes are first mapped to random words. Two different
    spans of n units collide with a chance of about (n / 2^31)^2."""

    PRIME = (1 << 31) - 1
    BASES = (1_203_947_261, 1_799_264_803)
    _pow = [np.ones(1, np.uint32), np.ones(1, np.uint32)]
    _inv = [np.ones(1, np.uint32), np.ones(1, np.uint32)]

    def __init__(self, data: np.ndarray, fold: np.ndarray | None = None, seed: int = 1):
        words = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
        if fold is not None:
            words = words[fold]
        lanes = [self._lane(words, lane) for lane in (0, 1)]
        self._sum(len(data), lambda lane, a, z: lanes[lane][data[a:z]])

    @classmethod
    def of_values(cls, values: np.ndarray) -> SpanHash:
        """Over 64-bit values in place of bytes."""
        out = cls.__new__(cls)
        out._sum(len(values), lambda lane, a, z: cls._lane(values[a:z], lane))
        return out

    @staticmethod
    def _lane(values: np.ndarray, lane: int) -> np.ndarray:
        return values >> U(33) if lane == 0 else values & U(SpanHash.PRIME)

    @staticmethod
    def _mod(x: np.ndarray) -> np.ndarray:
        """x modulo the prime, for x up to 2^63."""
        p = U(SpanHash.PRIME)
        x = (x & p) + (x >> U(31))
        x = (x & p) + (x >> U(31))
        x = (x & p) + (x >> U(31))
        return np.where(x == p, U(0), x)

    @classmethod
    def _powers(cls, base: int, known: np.ndarray, n: int) -> np.ndarray:
        while len(known) < n:
            more = min(len(known), n - len(known), 1 << 20)
            known = np.concatenate((known, cls._mod(known[:more].astype(U) * U(pow(base, len(known), cls.PRIME))).astype(np.uint32)))
        return known

    def _sum(self, n: int, lane_values, part: int = 1 << 18) -> None:
        """Prefix sums, a part at a time, so that what numpy holds in between stays small."""
        cls, self.prefix = SpanHash, []
        for lane, base in enumerate(cls.BASES):
            cls._pow[lane] = cls._powers(base, cls._pow[lane], n + 1)
            cls._inv[lane] = cls._powers(pow(base, -1, cls.PRIME), cls._inv[lane], n + 1)
            prefix = np.zeros(n + 1, np.uint32)
            for a in range(0, n, part):
                z = min(n, a + part)
                sums = np.cumsum(cls._mod(lane_values(lane, a, z) * cls._pow[lane][a:z]), dtype=U)
                prefix[a + 1:z + 1] = cls._mod(sums + U(prefix[a]))
            self.prefix.append(prefix)

    def _between(self, lane: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        p = self.prefix[lane]
        return p[end].astype(U) + U(self.PRIME) - p[start]

    def _mixed(self, sums: list, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        a, b = (self._mod(self._mod(x) * SpanHash._inv[lane][start]) for lane, x in enumerate(sums))
        return mix64(((a << U(31)) | b) + (length.astype(U) << U(40)) * U(0x9E3779B97F4A7C15))

    def without(self, start: np.ndarray, drop: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the span [start, end) with the position `drop` taken out: what the shorter span itself would have."""
        sums = [self._between(lane, start, drop) + self._mod(self._mod(self._between(lane, drop + 1, end)) * U(pow(base, -1, self.PRIME)))
                for lane, base in enumerate(self.BASES)]
        return self._mixed(sums, start, end - start - 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._mixed([self._between(lane, start, end) for lane in (0, 1)], start, end - start)


GOLDEN = U(0x9E3779B97F4A7C15)
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], U)


def eights(data: np.ndarray) -> np.ndarray:
    """At each place of a byte array and at its end: the eight bytes from there on as one number, with zeros past the end."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))


def prints(data: np.ndarray, start: np.ndarray, end: np.ndarray, seeds: tuple[int, ...]) -> list[np.ndarray]:
    """64-bit hashes of byte spans, one for each seed: sums of the mixed eights of a span, each mixed again with its place
    in it. What SpanHash does for any spans of a text, at a fraction of its cost where spans are short or far apart."""
    size, x = end - start, eights(data)
    head = mix64(x[start] & _FIRST[np.minimum(size, 8)])
    some = np.flatnonzero(size > 8)
    n = (size[some] - 1) // 8
    at = ragged(np.ones(len(n), np.int64), n)
    part = mix64(x[np.repeat(start[some], n) + 8 * at] & _FIRST[np.minimum(np.repeat(size[some], n) - 8 * at, 8)])
    place, out = at.astype(U) * GOLDEN, []
    for seed in seeds:
        h = mix64(head + U(seed)) + size.astype(U)
        if len(some):
            h[some] += np.add.reduceat(mix64(part + (place ^ U(seed))), np.cumsum(n) - n)
        out.append(mix64(h))
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Letters, digits and every byte of a non-ASCII character.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


def runs(member: np.ndarray, offsets: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes; a run also ends at
    a document boundary and before every position in the mask `cut`."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    brk = np.zeros(n + 1, bool)
    brk[offsets] = True
    if cut is not None:
        brk[:n] |= cut
    first, last = member.copy(), member.copy()
    first[1:] &= ~member[:-1] | brk[1:n]
    last[:-1] &= ~member[1:] | brk[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[0], start[0]+1, ... of all spans, one after another."""
    length = length.astype(np.int64)
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()), dtype=np.int64)


# --- connected components --------------------------------------------------

def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label): the smallest node that each node of `edges(a, b)` is
    linked to. Every round takes the smallest label among neighbours and then
    the label of that label, so paths shorten by powers of two; rounds are
    tables in the shared folder, and only a count of changes reaches the
    driver."""
    edges = edges.filter("a is not null and b is not null and a <> b")
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                  .distinct(), f"{name}-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                    .select("node", F.least("node", "m").alias("label")), f"{name}-0")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("m")))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = stored(step.join(up, "label").select("node", "was", F.least("label", "up").alias("label")), f"{name}-step")
        labels = new.select("node", "label")
        if not new.filter("label <> was").limit(1).count():
            return labels
