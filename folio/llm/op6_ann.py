"""Nearest neighbours by multi-index hashing.

Codes of BITS bits come from learned rotations (PCA followed by iterative
quantisation, fitted on SAMPLE vectors of smallest hash; several rotations
side by side where BITS exceeds the dimension). A code is split into 8-bit
substrings, each indexed by its value. If two codes differ in at most r bits,
pigeonhole says that one of the first (r mod m) + 1 substrings differs in at
most r div m bits, or one of the others in at most (r div m) - 1; probing
those values finds every code within r. The floats of these codes give the
exact inner products in double precision. r is the distance that covers
COVER of the true neighbours inside the sample; a block that finds too few
within r takes its nearest codes instead.

Equal vectors are indexed once, with their smallest ids: as many as one query
can return, so a vector of any frequency costs one entry. Index blocks of
BLOCK vectors are one row each, so are query blocks; the pairs of blocks are an
equi-join on the block number, and each gives a query's best few.

Defined cases: vectors null, zero, or with null or non-finite components take
no part, nor do vectors of another length than the most frequent one; a
query's own row is every row of its vec_id; repeated rows count once; ties go
to the smaller vec_id; rows of null vec_id take no part; other columns are
ignored; an empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import stored

BITS, SAMPLE, COVER, BLOCK, QUERY_BLOCK = 128, 8192, 0.985, 8192, 512
_COUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: _NEAR[t, v]: the values within t bits of v.
_NEAR = np.stack([_COUNT[np.arange(256)[:, None] ^ np.arange(256)] <= t for t in range(9)])


def fit_rotations(x: np.ndarray, bits: int = BITS, rounds: int = 30, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection of shape (dimension, bits)) of iterative quantisation."""
    mean = x.mean(axis=0)
    c, dim, rng = x - mean, x.shape[1], np.random.default_rng(seed)
    _, _, axes = np.linalg.svd(c, full_matrices=False)
    axes = np.vstack((axes, np.linalg.qr(rng.normal(size=(dim, dim)))[0]))[:dim].T
    parts = []
    for _ in range(-(-bits // dim)):
        r = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        v = c @ axes
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ w).T
        parts.append(axes @ r)
    return mean, np.hstack(parts)[:, :bits]


def codes(x: np.ndarray, projection: np.ndarray) -> np.ndarray:
    return np.packbits(x @ projection > 0, axis=1)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _COUNT[a ^ b].sum(axis=-1, dtype=np.int64)


def probe_radii(radius: int, parts: int) -> list[int]:
    """The bits to probe in each substring so that every code within `radius` is met."""
    each, extra = divmod(radius, parts)
    return [each if j <= extra else each - 1 for j in range(parts)]


def learn_radius(x: np.ndarray, mean: np.ndarray, projection: np.ndarray, k: int, cover: float = COVER, queries: int = 256) -> int:
    """The distance that covers `cover` of the k nearest of some sample vectors inside the sample."""
    q = x[:queries]
    sims = q @ x.T
    sims[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = np.argsort(-sims, axis=1)[:, :min(k, len(x) - 1)]
    if not near.size:
        return projection.shape[1]
    return int(np.quantile(hamming(codes(q, projection)[:, None], codes(x - mean, projection)[near]), cover))


class Block:
    """Vectors, codes, and for each substring the vectors in order of its value."""

    def __init__(self, x: np.ndarray, mean: np.ndarray, projection: np.ndarray):
        self.x, self.codes = x, codes(x - mean, projection)
        self.order = np.argsort(self.codes, axis=0, kind="stable").T.astype(np.int32)
        self.count = np.stack([np.bincount(c, minlength=256) for c in self.codes.T])

    def search(self, q: np.ndarray, code: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, inner products) of the k best among the codes within `radius`."""
        seen = np.zeros(len(self.x), bool)
        for j, t in enumerate(probe_radii(radius, len(code))):
            if t >= 0:
                seen[self.order[j][np.repeat(_NEAR[min(t, 8), code[j]], self.count[j])]] = True
        rows = np.flatnonzero(seen)
        rows = rows[hamming(self.codes[rows], code) <= radius]
        if len(rows) < min(k, len(self.x)):
            rows = np.argsort(hamming(self.codes, code), kind="stable")[:k]
        score = self.x[rows] @ q
        if len(rows) > k:  # all rows as good as the k-th, for ties
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[keep], score[keep]
        return rows, score


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): distinct rows that take part, as doubles."""
    v = F.col("embedding").cast("array<double>")
    ok = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = vectors.select("vec_id", v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(ok)
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.filter(F.size("v") == (top[0]["d"] if top else 0)).distinct()


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries vec_id % every = 0."""
    spark = vectors.sparkSession
    rows = stored(valid_vectors(vectors), "op6-rows")
    schema = "query_id long, rank int, vec_id long, score double"
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    some = (rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1)
            .groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))  # k + 1 at most
    queries = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    wanted = queries.groupBy("v").agg(F.min("vec_id").alias("q"))
    distinct = stored(some.join(wanted, "v", "left").withColumn("rep", F.element_at("ids", 1)), "op6-distinct")
    n = distinct.count()
    if not n:
        return spark.createDataFrame([], schema)
    sample = distinct.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect()
    x = np.array([r["v"] for r in sample])
    mean, projection = fit_rotations(x, bits)
    radius = learn_radius(x, mean, projection, k)
    blocks = -(-n // block)

    def gather(key, pdf):
        v = np.stack(pdf["v"].to_numpy())
        ids = pdf["ids"] if "ids" in pdf else pdf["q"].map(lambda i: [i])
        return pd.DataFrame({"block": [int(key[0])], "n": [len(v)], "x": [v.astype("<f8").tobytes()],
                             "ids": [np.concatenate([np.asarray(i, "<i8") for i in ids]).tobytes()], "per": [np.array([len(i) for i in ids], "<i4").tobytes()]})

    row = "block int, n int, x binary, ids binary, per binary"
    number = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int").alias("block")
    index = distinct.select(number("rep", blocks), "v", "ids").groupBy("block").applyInPandas(gather, row)
    n_queries = distinct.filter("q is not null").count()
    asked = (distinct.filter("q is not null").select(number("q", max(1, -(-n_queries // QUERY_BLOCK))), "v", "q")
             .groupBy("block").applyInPandas(gather, row)
             .select(F.col("x").alias("qx"), F.col("ids").alias("qids"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")))

    def search(batches):
        held, held_block = -1, None
        for b in batches:
            for r in b.to_pylist():
                if r["block"] != held:
                    held, held_block = r["block"], Block(np.frombuffer(r["x"], "<f8").reshape(r["n"], -1), mean, projection)
                ids, per = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["per"], "<i4")
                first = np.cumsum(per) - per
                qid = np.frombuffer(r["qids"], "<i8")
                q = np.frombuffer(r["qx"], "<f8").reshape(len(qid), -1)
                out = []
                for i, (v, c) in enumerate(zip(q, codes(q, projection), strict=True)):
                    found, score = held_block.search(v, c, radius, k + 1)
                    members = np.concatenate([ids[first[f]:first[f] + per[f]] for f in found]) if len(found) else np.zeros(0, np.int64)
                    score = np.repeat(score, per[found])
                    best = np.lexsort((members, -score))[:k + 1]
                    out.append((int(qid[i]), members[best].tolist(), score[best].tolist()))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.int64())),
                                                  pa.array([o[2] for o in out], pa.list_(pa.float64()))], ["q", "ids", "scores"])

    found = asked.join(index, "block").select("block", "n", "x", "ids", "per", "qx", "qids").mapInArrow(
        search, "q long, ids array<long>, scores array<double>")
    each = found.select("q", F.explode(F.arrays_zip("ids", "scores")).alias("e")).select("q", F.col("e.ids").alias("vec_id"), F.col("e.scores").alias("score"))
    order = (F.desc("score"), F.asc("vec_id"))
    best = stored(each.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(*order))).filter(F.col("r") <= k + 1).drop("r"), "op6-best")
    # every query of an equal vector shares the answer, without its own row
    asks = queries.join(wanted, "v").select(F.col("vec_id").alias("query_id"), "q")
    pairs = asks.join(best, "q").filter(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
