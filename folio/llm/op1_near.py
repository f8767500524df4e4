"""Near-duplicate documents: consistent weighted samples of TF-IDF shingles.

A document is its shingles of five lower-cased words (all words, if fewer),
weighted tf x idf. Document frequencies of all documents are counted in a
table of 2^SKETCH_BITS cells indexed by shingle hash: a cell holds the sum of
its shingles' frequencies, so a frequent shingle is never taken for a rare
one, and the excess is the same share of the documents at every size.

1. Improved consistent weighted sampling draws BANDS x ROWS samples; two
   documents share a sample with probability equal to their weighted Jaccard
   similarity. Documents of equal word sequence are one from here on.
2. Documents that share a band are candidates. Each is first paired with the
   band's most central one, whose bands hold the most documents; pairs of
   enough equal samples are verified by the weighted Jaccard similarity of
   their whole texts, and links form components.
3. In bands that still hold several components, the documents outside the
   central one's component (strays) are paired with those of other components:
   with all of them in bands of up to SMALL_BAND documents, with two that
   change from try to try in larger ones, until a try finds no link. So a
   group of any size gives a number of pairs in proportion to its size.
4. Larger bands that still hold strays are split: in each of TREES random
   orders of the samples, their documents go into cells of equal first
   samples, as many as it takes for a cell to hold SMALL_BAND documents or
   fewer, and all pairs of a cell between components are verified; so are
   those of documents that share one of their rarest shingles with up to
   SMALL_BAND of them.
5. What still lies in different components and shares one of its rarest
   shingles with more documents than that is compared in full, in blocks of
   CELL_BLOCK by CELL_BLOCK documents. Similar documents share a rarest shingle,
   so no pair of a band is left out by the size of its band or cell.

One row per document comes back: its class (smallest doc_id) and whether it
stays (it is that document).

Defined cases: null text or text without words is a class of its own; rows of
one doc_id are marked text by text; in near_classes() a null doc_id is a class of its
own (null) and stays, near_dedup() compares all rows under ids of their own;
other columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import WORD, SpanHash, components, keep_rows, mix64, own_ids, ragged, runs, slices, stored, text_buffers, under_row

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 10, 3
#: Candidates with fewer equal samples than this share have a similarity of 0.8 with a chance of about 1 in 4000.
LIKELY = 0.5
#: Bands of up to so many documents verify all candidate pairs between components.
SMALL_BAND = 32
#: Orders of the samples by which what is left of larger bands is split, and how many of them a split compares.
TREES, DEPTHS = 24, (2, 4, 6, 8, 10, 13, 17, 22, 30)
#: Cells of more documents are compared in blocks of so many by so many.
CELL_BLOCK = 2048
SKETCH_BITS, SKETCH_PARTS = 18, 16
SHINGLE_BITS = 44
U = np.uint64
_MASK = U((1 << SHINGLE_BITS) - 1)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every text as (text << 44 | shingle), sorted, and
    their counts; the words of each text; two hashes of its word sequence."""
    data, off = text_buffers(pc.utf8_lower(column.cast(pa.large_string())))
    start, end = runs(WORD[data], off)
    h = SpanHash(data)(start, end)
    first = np.searchsorted(start, off)
    words = np.diff(first)
    seq = [SpanHash.of_values(mix64(h ^ U(s)))(first[:-1], first[1:]) for s in (0, 0x5BD1E995)]
    count = np.where(words >= WORDS, words - WORDS + 1, np.minimum(words, 1))
    at = ragged(first[:-1], count)
    doc = np.repeat(np.arange(len(words)), count)
    size = np.minimum(words[doc], WORDS)
    s = SpanHash.of_values(h)(at, at + size) & _MASK
    keys, n = np.unique((doc.astype(U) << U(SHINGLE_BITS)) | s, return_counts=True)
    return keys, n, words, np.stack(seq)


def cell(keys: np.ndarray) -> np.ndarray:
    return (keys & U((1 << SKETCH_BITS) - 1)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The table of document frequencies, and the number of documents."""

    def count(batches):
        table, n = np.zeros(1 << SKETCH_BITS, np.int64), 0
        for b in slices(batches, "text", 4 << 20):
            table += np.bincount(cell(shingles(b["text"])[0]), minlength=len(table))
            n += b.num_rows
        parts = [zlib.compress(x.astype("<u4").tobytes(), 1) for x in np.split(table, SKETCH_PARTS)] if n else []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary()), pa.array([n] * len(parts), pa.int64())], ["part", "counts", "n"])

    def add(key, pdf):
        total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.int64)
        for x in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(x), "<u4")
        return pd.DataFrame({"part": [int(key[0])], "counts": [zlib.compress(total.tobytes(), 1)], "n": [int(pdf["n"].sum())]})

    schema = "part int, counts binary, n long"
    rows = docs.select("text").mapInArrow(count, schema).groupBy("part").applyInPandas(add, schema).orderBy("part").collect()  # SKETCH_PARTS rows
    if not rows:
        return np.zeros(1 << SKETCH_BITS, np.int64), 0
    return np.concatenate([np.frombuffer(zlib.decompress(r["counts"]), np.int64) for r in rows]), rows[0]["n"]


def idf_table(df: np.ndarray, n: int) -> np.ndarray:
    """ln(1 + n / (df + n / 20)): shingles of all documents weigh a quarter of rare ones, no more, so
    the copies in a very large group stay near each other though their own shingles are frequent."""
    return np.log1p(n / (df + max(n, 1) / 20)).astype(np.float32) if n else np.ones(len(df), np.float32)


class Sampler:
    """Improved consistent weighted sampling. Per shingle and sample: r and c
    from Gamma(2, 1), b uniform; t = floor(ln w / r + b), ln y = r (t - b),
    ln a = ln c - ln y - r; the sample is (shingle, t) of least a. Variates come
    from tables of 4096 quantiles, indexed by bits of a hash."""

    def __init__(self, samples: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        draws = np.sort(-np.log(rng.random(4096 * 64)) - np.log(rng.random(4096 * 64)))
        self.r = draws.reshape(4096, 64).mean(axis=1).astype(np.float32)
        self.inv, self.ln_c = 1 / self.r, np.log(self.r)
        self.b = ((np.arange(4096) + 0.5) / 4096).astype(np.float32)
        self.odd = rng.integers(1, 2**62, samples, dtype=np.uint64) * U(2) + U(1)
        self.add = rng.integers(0, 2**63, samples, dtype=np.uint64)

    def __call__(self, shingle: np.ndarray, ln_w: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(sets, samples) uint32; set i has the shingles from first[i] up to first[i + 1], sorted, and none is empty."""
        size = np.diff(first)
        out = np.empty((len(size), len(self.odd)), np.uint32)
        for i, (odd, add) in enumerate(zip(self.odd, self.add, strict=True)):
            x = (shingle + add) * odd
            x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
            j, k, m = (x >> U(52)).astype(np.int64), ((x >> U(40)) & U(4095)).astype(np.int64), ((x >> U(28)) & U(4095)).astype(np.int64)
            r, b = self.r[j], self.b[k]
            t = np.floor(ln_w * self.inv[j] + b)
            a = self.ln_c[m] - r * (t - b) - r
            hit = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, first[:-1]), size))
            of = np.searchsorted(first, hit, "right") - 1
            hit = hit[np.concatenate(([True], of[1:] != of[:-1]))]
            out[:, i] = (mix64(shingle[hit] ^ (t[hit].astype(np.int64).astype(U) << U(44))) >> U(32)).astype(np.uint32)
        return out


def signatures(docs: DataFrame, idf, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, k1, k2, sig, bands): word sequence hashes, samples and band keys (null without words); idf: broadcast table."""

    def run(batches):
        sampler, table = Sampler(bands * rows), idf.value
        for b in slices(batches, "text", 2 << 20):
            keys, n, words, seq = shingles(b["text"])
            some = np.flatnonzero(words)
            sig = np.zeros((b.num_rows, bands * rows), np.uint32)
            if len(some):
                first = np.append(np.searchsorted(keys, some.astype(U) << U(SHINGLE_BITS)), len(keys))
                sig[some] = sampler(keys & _MASK, np.log(n * table[cell(keys)]).astype(np.float32), first)
            band = np.zeros((b.num_rows, bands), U)
            for i in range(bands):
                band[:, i] = i + 1
                for j in range(rows):
                    band[:, i] = mix64(band[:, i] * U(0x9E3779B97F4A7C15) + sig[:, i * rows + j])
            none = words == 0
            lists = lambda x, t: pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), t))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], *(pa.array(s.view(np.int64), pa.int64(), mask=none) for s in seq),
                 lists(sig.view(np.int32), pa.int32()), lists(band.view(np.int64), pa.int64())], ["doc_id", "k1", "k2", "sig", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, k1 long, k2 long, sig array<int>, bands array<long>")


def similarities(a: pa.Array, b: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    (ka, na, _, _), (kb, nb, _, _) = shingles(a), shingles(b)
    wa, wb = na * idf[cell(ka)], nb * idf[cell(kb)]
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    pair = lambda k: (k >> U(SHINGLE_BITS)).astype(np.int64)
    low = np.bincount(pair(ka[i]), np.minimum(wa[i], wb[j]), len(a))
    high = np.bincount(pair(ka), wa, len(a)) + np.bincount(pair(kb), wb, len(a)) - low
    return np.where(high > 0, low / np.where(high > 0, high, 1), 0.0)


def _likely(likely: float):
    equal = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda e: e))
    return equal >= likely * F.size("sig_a")


def _across(placed: DataFrame, tries: int, small: int = SMALL_BAND) -> DataFrame:
    """Candidate pairs (a, b) of one band and different components. Bands of up
    to `small` documents give all of them, in the first try. In larger ones each
    stray document meets two others of the band, which differ from try to try:
    a stray and one of the main component."""
    stray = placed.filter("label <> main").select("band", "n", F.col("rep").alias("a"), F.col("label").alias("la"))
    pick = lambda on, by: F.min(F.when(on, F.struct(by.alias("by"), "rep", "label")))
    out, turn = F.col("label") != F.col("main"), lambda i: F.xxhash64(F.lit(2 * tries + i), "rep")
    leads = (placed.filter(F.col("n") > small).groupBy("band").agg(
        F.array(pick(out, -F.col("central") if not tries else turn(0)), pick(~out, turn(1))).alias("leads"))
        .select("band", F.explode("leads").alias("x")).select("band", F.col("x.rep").alias("b"), F.col("x.label").alias("lb")))
    pairs = stray.filter(F.col("n") > small).join(leads, "band").filter("la <> lb").select("a", "b")
    if not tries:
        few = placed.filter(F.col("n") <= small).select("band", F.col("rep").alias("b"), F.col("label").alias("lb"), (F.col("label") == F.col("main")).alias("is_main"))
        near = stray.filter(F.col("n") <= small).join(few, "band").filter((F.col("la") != F.col("lb")) & (F.col("is_main") | (F.col("a") < F.col("b"))))
        pairs = pairs.unionByName(near.select("a", "b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _prefixes(batches, idf: np.ndarray, similarity: float):
    """(rep, label, stray, cell, left, total) of the rarest shingles of each text, as many as hold more than 1 - similarity
    of its weight: the weight from this shingle on, and that of the text. Texts that share none of these, in one order
    of all shingles, are less similar than that."""
    for b in slices(batches, "text", 2 << 20):
        keys, n, _, _ = shingles(b["text"])
        doc, s = (keys >> U(SHINGLE_BITS)).astype(np.int64), keys & _MASK
        rarity = idf[cell(keys)]
        order = np.lexsort((s, -rarity, doc))
        doc, s, w = doc[order], s[order], (n * rarity)[order].astype(np.float64)
        total = np.bincount(doc, w, b.num_rows)
        before = np.cumsum(w) - w
        before -= before[np.searchsorted(doc, doc)]
        some = before <= (1 - similarity + 1e-6) * total[doc]
        at = pa.array(doc[some])
        yield pa.RecordBatch.from_arrays([b["doc_id"].take(at), b["label"].take(at), b["stray"].take(at), pa.array(s[some].view(np.int64), pa.int64()),
                                          pa.array((total[doc] - before)[some], pa.float64()), pa.array(total[doc[some]], pa.float64())], ["rep", "label", "stray", "cell", "left", "total"])


def _enough(similarity: float) -> float:
    """The share of the sum of two texts' weights that their common shingles weigh at this similarity. Texts whose first
    common shingle, in the order of the prefixes, is a given one have no more in common than the lesser `left` there."""
    return (similarity - 1e-6) / (1 + similarity)


def _split(placed: DataFrame, sig: DataFrame, texts: DataFrame, idf, similarity: float, samples: int, small: int = SMALL_BAND) -> tuple[DataFrame, DataFrame]:
    """(pairs, rare): candidate pairs (a, b) of different components, one a stray, in the cells of bands larger than `small` that hold strays.
    Documents of a cell of all samples equal, if that is larger still, are paired with its smallest. rare(rep, cell) are
    the rarest shingles of these documents."""
    large = placed.filter(F.col("n") > small).withColumn("stray", F.col("label") != F.col("main"))
    docs = (large.join(large.filter("stray").select("band").distinct(), "band", "left_semi")
            .groupBy("rep").agg(F.first("label").alias("label"), F.max("stray").alias("stray")).join(sig, "rep"))
    rng = np.random.default_rng(5)
    orders = [rng.permutation(samples) for _ in range(TREES)]
    depths = sorted({min(d, samples) for d in DEPTHS} | {samples})

    def run(batches):
        for b in batches:
            x = b["sig"].flatten().to_numpy().astype(np.uint32).reshape(b.num_rows, samples).astype(U)
            for t, order in enumerate(orders):
                h, keys = np.full(b.num_rows, t + 1, U), []
                for i, j in enumerate(order.tolist(), 1):
                    h = mix64(h * U(0x9E3779B97F4A7C15) + x[:, j])
                    if i in depths:
                        keys.append(h)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(depths), pa.int32()), pa.array(np.stack(keys, axis=1).ravel().view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([b["rep"], b["label"], b["stray"], lists], ["rep", "label", "stray", "keys"])

    tree = docs.select("rep", "label", "stray", "sig").mapInArrow(run, "rep long, label long, stray boolean, keys array<long>")
    every = stored(tree.select("rep", "label", "stray", F.posexplode(F.zip_with("keys", F.concat(F.array(F.lit(None).cast("long")), F.slice("keys", 1, len(depths) - 1)),
                                                                               lambda x, y: F.struct(x.alias("cell"), y.alias("parent")))).alias("depth", "x"))
                   .select("rep", "label", "stray", "depth", "x.cell", "x.parent"), "op1-cells")
    last = len(depths) - 1
    size = stored(every.groupBy("cell").agg(F.count("*").alias("m"), F.max("stray").alias("some"), F.min("rep").alias("least"),
                                            F.first("depth").alias("depth"), F.first("parent").alias("parent")).filter("m > 1 and some"), "op1-sizes")
    # a document's cell in a tree is the first that fits: its parent doesn't. Cells of one document or without strays give no pair
    fits = size.filter((F.col("m") <= small) | (F.col("depth") == last)).drop("depth")
    chosen = fits.filter("parent is null").unionByName(
        fits.join(size.filter(F.col("m") > small).select(F.col("cell").alias("parent")), "parent", "left_semi")).select("cell", "m", "least")
    cells = stored(every.select("rep", "label", "stray", "cell").join(chosen, "cell"), "op1-split")
    b = cells.filter(F.col("m") <= small).select("cell", F.col("rep").alias("b"), F.col("label").alias("lb"), F.col("stray").alias("sb"))
    pairs = (cells.filter(F.col("m") <= small).filter("stray").select("cell", F.col("rep").alias("a"), F.col("label").alias("la")).join(b, "cell")
             .filter((F.col("la") != F.col("lb")) & (~F.col("sb") | (F.col("a") < F.col("b")))).select("a", "b"))
    # and in the cells of one shingle of their prefixes: similar documents share one of those
    rare = stored(texts.join(docs.select(F.col("rep").alias("doc_id"), "label", "stray"), "doc_id").mapInArrow(
        lambda batches: _prefixes(batches, idf.value, similarity), "rep long, label long, stray boolean, cell long, left double, total double"), "op1-prefixes")
    few = (rare.join(rare.groupBy("cell").agg(F.count("*").alias("m"), F.max("stray").alias("some")).filter(f"m > 1 and m <= {small} and some"), "cell"))
    side = lambda z: few.select("cell", *(F.col(c).alias(f"{c}_{z}") for c in ("rep", "label", "stray", "left", "total")))
    near = (side("a").filter("stray_a").join(side("b"), "cell")
            .filter((F.col("label_a") != F.col("label_b")) & (~F.col("stray_b") | (F.col("rep_a") < F.col("rep_b")))
                    & (F.least("left_a", "left_b") >= _enough(similarity) * (F.col("total_a") + F.col("total_b"))))
            .select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    pairs = pairs.unionByName(near).unionByName(cells.filter((F.col("m") > small) & (F.col("rep") != F.col("least"))).select(F.col("rep").alias("a"), F.col("least").alias("b")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), rare.select("rep", "cell", "left", "total")


def _crowded(rare: DataFrame, labels: DataFrame, sig: DataFrame, likely: float = LIKELY, small: int = SMALL_BAND, block: int = CELL_BLOCK, similarity: float = SIMILARITY) -> DataFrame:
    """Candidate pairs (a, b) of different components in the cells of `rare(rep, cell)` that hold more than `small` documents:
    all of them with enough equal samples and, where `rare` has `left` and `total`, enough weight from the cell's shingle on.
    A cell's documents outside its largest component meet all others, in blocks dealt over the tasks, so a task holds two
    blocks however large the cell."""
    if "left" not in rare.columns:
        rare = rare.withColumns({"left": F.lit(1.0), "total": F.lit(1.0)})
    held = stored(rare.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
                  .select("rep", "cell", "left", "total", F.coalesce("label", "rep").alias("label")), "op1-held")
    parts = held.groupBy("cell", "label").agg(F.count("*").alias("c"))
    cells = (parts.groupBy("cell").agg(F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("x"), F.count("*").alias("labels")).filter(f"m > {small} and labels > 1")
             .select("cell", F.col("x.label").alias("main"), F.ceil(F.col("m") / block).cast("int").alias("wide"), F.ceil((F.col("m") - F.col("x.c")) / block).cast("int").alias("high")))
    rows = held.join(cells, "cell").join(sig, "rep").withColumn("h", F.xxhash64("rep"))
    own = lambda n: F.pmod("h", F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    said = ["rep", "label", "sig", "left", "total", (F.col("label") == F.col("main")).alias("is_main")]
    strays = rows.filter("label <> main").select("cell", own("high").alias("i"), upto("wide").alias("j"), F.lit(True).alias("stray"), *said)
    every = rows.select("cell", upto("high").alias("i"), own("wide").alias("j"), F.lit(False).alias("stray"), *said)

    enough = _enough(similarity)

    def compare(t: pa.Table) -> pa.Table:
        stray = t["stray"].to_numpy()
        x, y = t.filter(pa.array(stray)), t.filter(pa.array(~stray))
        a, b, la, lb, fa, fb, ta, tb, main = (c.to_numpy() for c in (x["rep"], y["rep"], x["label"], y["label"], x["left"], y["left"], x["total"], y["total"], y["is_main"]))
        matrix = lambda z: z["sig"].combine_chunks().flatten().to_numpy().reshape(z.num_rows, -1) if z.num_rows else np.zeros((0, 1), np.int32)
        sa, sb = matrix(x), matrix(y)
        hit = []
        for i, row in enumerate(sa if len(b) else []):
            some = np.flatnonzero((np.minimum(fa[i], fb) >= enough * (ta[i] + tb)) & (lb != la[i]) & (main | (b > a[i])))
            hit.append(some[(sb[some] == row).sum(axis=1) >= likely * sb.shape[1]])
        at = np.concatenate(hit) if hit else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(np.repeat(a, [len(h) for h in hit]) if hit else a[:0], pa.int64()), "b": pa.array(b[at], pa.int64())})

    pairs = strays.unionByName(every).groupBy("cell", "i", "j").applyInArrow(compare, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, kept), one row per document."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    df, n = document_frequencies(docs)
    idf = spark.sparkContext.broadcast(idf_table(df, n))  # 2^SKETCH_BITS floats
    marks = stored(signatures(docs, idf, bands, rows), "op1-marks")
    one = stored(marks.filter("k1 is not null and doc_id is not null").groupBy("k1", "k2")
                 .agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "op1-texts")
    sig = one.select("rep", "sig").dropDuplicates(["rep"])
    members = one.select("rep", F.explode("bands").alias("band")).distinct()
    several = members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = stored(members.join(several, "band"), "op1-crowded")
    # the document whose bands hold the most others is the likeliest centre of its group
    central = crowded.groupBy("rep").agg(F.sum("n").alias("central"))
    lead = crowded.join(central, "rep").groupBy("band").agg((-F.max(F.struct("central", (-F.col("rep")).alias("r")))["r"]).alias("lead"))
    shared = stored(crowded.join(central, "rep").join(lead, "band"), "op1-bands")
    # all texts that any candidate pair needs; merged, since their number has no bound
    wanted = shared.select(F.col("rep").alias("doc_id")).distinct().hint("merge")
    texts = stored(docs.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "op1-candidates")

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose texts are similar, from pairs with many equal samples."""
        some = (pairs.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")
                .join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b").filter(_likely(LIKELY)).select("a", "b"))
        some = stored(some, f"{name}-pairs")

        def measure(batches):
            for x in slices(batches, "ta", 2 << 20):
                for y in slices(iter([x]), "tb", 4 << 20):
                    yield pa.RecordBatch.from_arrays([y["a"], y["b"], pa.array(similarities(y["ta"], y["tb"], idf.value))], ["a", "b", "sim"])

        both = (some.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
                .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")).hint("merge"), "b"))
        return stored(both.mapInArrow(measure, "a long, b long, sim double").filter(F.col("sim") >= similarity), f"{name}-links")

    first = shared.filter("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct()
    links = verify(first, "op1-first")
    tries = 0
    while True:
        labels = components(links, f"op1-{tries}")
        name = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))  # noqa: B023, E731
        placed = stored(shared.join(name("rep"), "rep", "left").join(name("lead"), "lead", "left")
                        .select("band", "n", "rep", "central", F.coalesce("rep_label", "rep").alias("label"), F.coalesce("lead_label", "lead").alias("main")), f"op1-placed-{tries}")
        new = verify(_across(placed, tries), f"op1-{tries}")
        if not new.limit(1).count():
            break
        links, tries = stored(links.select("a", "b").unionByName(new.select("a", "b")), f"op1-links-{tries}"), tries + 1
    if placed.filter((F.col("n") > SMALL_BAND) & (F.col("label") != F.col("main"))).limit(1).count():
        pairs, rare = _split(placed, sig, texts, idf, similarity, bands * rows)
        links = stored(links.select("a", "b").unionByName(verify(pairs, "op1-rest").select("a", "b")), "op1-links")
        labels = components(links, "op1-all")
        new = verify(_crowded(rare, labels, sig, similarity=similarity), "op1-crowded-cells")
        if new.limit(1).count():
            labels = components(stored(links.unionByName(new.select("a", "b")), "op1-links-all"), "op1-last")
    labels = labels.select(F.col("node").alias("rep"), "label")
    of_text = one.select("k1", "k2", "rep").join(labels, "rep", "left").select("k1", "k2", F.coalesce("label", "rep").alias("class"))
    out = (marks.select("doc_id", "k1", "k2").join(of_text, ["k1", "k2"], "left")
           .select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("class_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row of each class of near duplicates, with all columns; rows of one doc_id, and those of null doc_id, are
    rows of their own."""
    rows = own_ids(docs)
    return keep_rows(rows, near_classes(under_row(rows)).filter("kept"))
