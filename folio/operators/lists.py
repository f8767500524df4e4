"""A whole index written from documents, with the postings of a term handled as one list.

lists(field, terms, size, cfs, docs, tfs, dls)   many terms a row, in order


Documents are tokenised once; a task counts its documents' tokens in arrays and sends each part a row of lists. Parts are ranges of (field, term), cut by a sample of the documents; a term that fills more than
a part of its own is dealt over several by shard. A part's lists are merged and stored in order, and postings,
vocabulary, statistics and score blocks are read off them without another exchange of postings."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from folio import constants as C
from folio.session import spread

#: Documents that the cuts of the parts are worked out from, about.
SAMPLE_DOCS = 2000
#: Postings of a part, about, and tokens that a task counts at a time.
PART_POSTINGS = 2_000_000
FLUSH_TOKENS = 3_000_000

#: Many lists lie in one row, their numbers as bytes: `size` entries of each term in `docs`, `tfs` and `dls`.
SENT = "part int, field string, terms array<string>, size binary, docs binary, tfs binary, dls binary"
LISTS = "field string, terms array<string>, size binary, cfs binary, docs binary, tfs binary, dls binary"
VOCAB = "field string, term string, df long, cf long"
POSTINGS = "field string, term string, doc_id long, tf long, dl int"
BLOCKS = "field string, term string, shard int, df long, top double, docs array<bigint>, parts array<double>, tfs array<int>"


def shard_of(docs: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each document id."""
    x = docs.astype(np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(shards)).astype(np.int32)


def names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def numbers(value, kind) -> np.ndarray:
    """The numbers of a blob."""
    return np.frombuffer(value.as_py() or b"", kind)


def blob(values: np.ndarray) -> pa.Array:
    return pa.array([values.tobytes()], pa.binary())


def one_list(terms) -> pa.Array:
    """One row that holds all of an array."""
    return pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms)


def row_of(schema: str, *values) -> pa.RecordBatch:
    """One row: plain values, arrays of strings and numbers as bytes."""
    columns = [one_list(v) if isinstance(v, pa.Array) else blob(v) if isinstance(v, np.ndarray) else pa.nulls(1, pa.binary()) if v is None
               else pa.array([v], pa.int32() if isinstance(v, int) else pa.string()) for v in values]
    return pa.RecordBatch.from_arrays(columns, names(schema))


def opened(b: pa.RecordBatch):
    """(field, terms, size, docs, tfs, dls) of each row."""
    for i in range(b.num_rows):
        yield (b["field"][i].as_py(), b["terms"][i].values, numbers(b["size"][i], np.int32).astype(np.int64), numbers(b["docs"][i], np.int64),
               numbers(b["tfs"][i], np.int32), numbers(b["dls"][i], np.int32))


def listed(docs: np.ndarray, offsets: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(docs, kind))


class Cuts:
    """Where parts of the (field, term) pairs begin. Pairs that stand for several parts in a row are spread over them."""

    def __init__(self, pairs: list, shards: int):
        self.pairs, self.shards, self.parts = pairs, shards, len(pairs) + 1
        self.spread = {p: (bisect_left(pairs, p), bisect_right(pairs, p)) for p in set(pairs) if bisect_right(pairs, p) - bisect_left(pairs, p) > 1}

    def parts_of(self, field: str, ordered: pa.Array) -> np.ndarray:
        """The part of each of a field's terms, which are in order."""
        begun = np.zeros(len(ordered) + 1, np.int32)
        begun[0] = bisect_left(self.pairs, (field, ""))
        for f, t in self.pairs[begun[0]:]:
            if f != field:
                break
            begun[bisect_left(range(len(ordered)), t, key=lambda i: ordered[i].as_py())] += 1
        return np.cumsum(begun)[:-1]


def _count(fields: tuple, cuts: Cuts):
    """The lists of documents (doc_id, tokens of each field), a row for each part and field."""
    def of(t: pa.Table):
        ids, n = t["doc_id"].combine_chunks().to_numpy(), t.num_rows
        for f in fields:
            toks = pa.concat_arrays(t[f].chunks)
            size = pc.fill_null(pc.list_value_length(toks), 0).to_numpy().astype(np.int64)
            if not size.sum():
                continue
            coded = toks.flatten().dictionary_encode()
            order = pc.sort_indices(coded.dictionary)
            terms, rank = coded.dictionary.take(order), np.empty(len(order), np.int64)
            rank[order.to_numpy()] = np.arange(len(order))
            key, tf = np.unique(rank[coded.indices.to_numpy()] * n + np.repeat(np.arange(n), size), return_counts=True)
            code, at = key // n, key % n
            part = cuts.parts_of(f, terms)[code]
            for (field, term), (a, z) in cuts.spread.items():
                if field == f and (c := pc.index(terms, term).as_py()) >= 0:
                    mine = slice(*np.searchsorted(code, [c, c + 1]))
                    part[mine] = a + 1 + shard_of(ids[at[mine]], cuts.shards) % (z - a)
            if cuts.spread:
                order = np.argsort(part, kind="stable")
                code, at, tf, part = code[order], at[order], tf[order], part[order]
            docs, tf, dl = ids[at], tf.astype(np.int32), size[at].astype(np.int32)
            ends = np.append(np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))), len(part))
            for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                first = np.flatnonzero(np.concatenate(([True], code[a + 1:z] != code[a:z - 1])))
                yield row_of(SENT, int(part[a]), f, terms.take(pa.array(code[a:z][first])), np.diff(np.append(first, z - a)).astype(np.int32), docs[a:z], tf[a:z], dl[a:z])

    def run(batches):
        held, tokens = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            tokens += sum(len(b[f].flatten()) for f in fields)
            if tokens >= FLUSH_TOKENS:
                yield from of(pa.Table.from_batches(held))
                held, tokens = [], 0
        if held:
            yield from of(pa.Table.from_batches(held))
    return run


def _merge(batches):
    """The lists of one part in order of field and term, one for each, their documents in order."""
    fields = {}
    for b in batches:
        for field, *row in opened(b):
            fields.setdefault(field, []).append(row)
    for field in sorted(fields):
        held = fields.pop(field)
        terms = pa.concat_arrays([r[0] for r in held])
        size, docs, tfs, dls = (np.concatenate([r[i] for r in held]) for i in range(1, 5))
        del held
        coded = terms.dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        terms, rank = coded.dictionary.take(order), np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        group = np.repeat(rank[coded.indices.to_numpy()], size)
        order = np.lexsort((docs, group))
        docs, tfs, dls = docs[order], tfs[order], dls[order]
        ends = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=len(terms)))))
        cfs = np.add.reduceat(tfs.astype(np.int64), ends[:-1])
        for x, y in slices(ends):
            a, z = ends[x], ends[y]
            yield row_of(LISTS, field, terms[x:y], np.diff(ends[x:y + 1]).astype(np.int32), cfs[x:y], docs[a:z], tfs[a:z], dls[a:z])


def _vocab(batches):
    """Rows of the vocabulary from lists."""
    for b in batches:
        for i in range(b.num_rows):
            terms = b["terms"][i].values
            yield pa.RecordBatch.from_arrays([pa.repeat(b["field"][i], len(terms)), terms, pa.array(numbers(b["size"][i], np.int32).astype(np.int64)),
                                              pa.array(numbers(b["cfs"][i], np.int64))], names(VOCAB))


def _postings(batches):
    """Posting rows from lists."""
    for b in batches:
        for field, terms, size, docs, tfs, dls in opened(b):
            of = np.repeat(np.arange(len(size)), size)
            for x in range(0, len(of), 50_000):
                y = slice(x, x + 50_000)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(field), len(of[y])), terms.take(pa.array(of[y])), pa.array(docs[y]), pa.array(tfs[y].astype(np.int64)),
                                                  pa.array(dls[y])], names(POSTINGS))


def slices(ends: np.ndarray, values: int = 400_000, rows: int = 20_000):
    """Row ranges of lists with about so many values, at most so many rows."""
    x, n = 0, len(ends) - 1
    while x < n:
        y = min(max(int(np.searchsorted(ends, ends[x] + values)), x + 1), x + rows, n)
        yield x, y
        x = y


def bm25_parts(field: str, tf, dl, df, n_docs: int, avgdl: float) -> np.ndarray:
    """`contribution("bm25")` over arrays."""
    boost, b = C.FIELD_WEIGHTS.get(field, (1.0, C.BM25_B))
    tf, dl, df = (np.asarray(x, np.float64) for x in (tf, dl, df))
    idf = np.log(1.0 + (n_docs - df + 0.5) / (df + 0.5))
    return boost * idf * (tf * (C.BM25_K1 + 1.0) / (tf + C.BM25_K1 * (1.0 - b + b * dl / avgdl)))


def whole_df(field: str, terms: pa.Array, size: np.ndarray, wide: dict) -> np.ndarray:
    """The document frequency of each list's term; `wide` has those of terms that lie in several parts."""
    df = size.copy()
    for (f, t), n in wide.items():
        if f == field and (i := pc.index(terms, t).as_py()) >= 0:
            df[i] = n
    return df


def _blocks(shards: int, stats: dict, wide: dict):
    """Score blocks from lists in order: those of a list, shard by shard, best documents first."""
    def run(batches):
        for b in batches:
            for field, terms, size, docs, tfs, dls in opened(b):
                df, row = whole_df(field, terms, size, wide), np.repeat(np.arange(len(size)), size)
                parts, shard = bm25_parts(field, tfs, dls, df[row], *stats[field]), shard_of(docs, shards)
                order = np.lexsort((docs, -parts, row * shards + shard))
                row, shard, docs, parts, tfs = (x[order] for x in (row, shard, docs, parts, tfs))
                first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (shard[1:] != shard[:-1]))))
                ends = np.append(first, len(docs))
                for x, y in slices(ends):
                    a, z = ends[x], ends[y]
                    mine, own = first[x:y], ends[x:y + 1] - a
                    yield pa.RecordBatch.from_arrays([
                        pa.repeat(pa.scalar(field), y - x), terms.take(pa.array(row[mine])), pa.array(shard[mine]), pa.array(df[row[mine]]), pa.array(parts[mine]),
                        listed(docs[a:z], own, pa.int64()), listed(parts[a:z], own, pa.float64()), listed(tfs[a:z], own, pa.int32())], names(BLOCKS))
    return run


def _tokens(docs, index):
    """(doc_id, tokens of each field of the index)."""
    from folio.operators.index import field_terms

    return docs.select("doc_id", *[field_terms(docs, f, f in index.text_fields).alias(f) for f in index.fields])


def one_row_each(index) -> int | None:
    """The number of documents, if each has an id of its own."""
    ids = index.texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    n, most, known = ids.agg(F.count(F.lit(1)), F.max("rows"), F.count("doc_id")).first()
    return n if n == known and (most or 0) <= 1 else None


def cuts_of(index, n: int, shard_docs: int | None, partitions: int | None) -> Cuts:
    """Cuts and shards from the terms of about SAMPLE_DOCS documents."""
    from folio.operators.blocks import shard_count

    every = max(1, n // SAMPLE_DOCS)
    some = index.texts.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(every)) == 0)
    toks = _tokens(some, index)
    counted = (toks.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.array_distinct(f).alias("toks")) for f in index.fields])).alias("x"))
               .select("x.field", F.explode("x.toks").alias("term")).groupBy("field", "term").count().toArrow())
    counted = counted.take(pc.sort_indices(counted, [("field", "ascending"), ("term", "ascending")]))
    total = np.cumsum(counted["count"].to_numpy())
    held = int(total[-1]) * every if len(total) else 0
    parts = partitions or max(index.texts.sparkSession.sparkContext.defaultParallelism, -(-held // PART_POSTINGS))
    at = np.searchsorted(total, np.arange(1, parts) * (total[-1] / parts)) if len(total) else []
    pairs = [(counted["field"][i].as_py(), counted["term"][i].as_py()) for i in at]
    return Cuts(pairs, shard_count(index, n, held, shard_docs) if shard_docs else 1)


def write_whole(index, path: str, n: int, partitions: int | None, shard_docs: int | None) -> None:
    """`write_index` for an index of n documents that was built from them, each with an id of its own."""
    spark = index.texts.sparkSession
    cuts = cuts_of(index, n, shard_docs, partitions)
    sent = _tokens(spread(index.texts), index).mapInArrow(_count(index.fields, cuts), SENT)
    made = sent.repartitionById(cuts.parts, "part").drop("part").mapInArrow(_merge, LISTS)
    made.write.mode("overwrite").parquet(f"{path}/lists")
    lists = spark.read.schema(made.schema).parquet(f"{path}/lists")
    lists.mapInArrow(_postings, POSTINGS).write.mode("overwrite").parquet(f"{path}/postings")
    own = lists.select("field", "terms", "size", "cfs").mapInArrow(_vocab, VOCAB)
    if cuts.spread:
        own = own.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).repartitionByRange("field", "term").sortWithinPartitions("field", "term")
    own.write.mode("overwrite").parquet(f"{path}/vocab")
    vocab = spark.read.parquet(f"{path}/vocab")
    sums = {r["field"]: r["s"] for r in vocab.groupBy("field").agg(F.sum("cf").alias("s")).collect()}
    rows = [F.struct(F.lit(f).alias("field"), F.lit(n).cast("long").alias("n_docs"), F.lit(sums.get(f, 0)).cast("long").alias("sum_dl")) for f in index.fields]
    (spark.range(0, 1, 1, 1).select(F.explode(F.array(*rows)).alias("x")).select("x.*").withColumn("avgdl", F.try_divide("sum_dl", "n_docs"))
     .write.mode("overwrite").parquet(f"{path}/stats"))
    spread_terms = sorted({t for _, t in cuts.spread})
    vocab.filter(F.col("term").isin(spread_terms) if spread_terms else F.lit(False)).select("field", "term", "df").write.mode("overwrite").parquet(f"{path}/wide")
    if shard_docs:
        stats = {f: (n, sums.get(f, 0) / n if n else 0.0) for f in index.fields}
        lists.mapInArrow(_blocks(cuts.shards, stats, read_wide(spark, path)), BLOCKS).write.mode("overwrite").parquet(f"{path}/blocks")


def read_wide(spark, path: str) -> dict:
    """Document frequencies of the terms whose lists lie in several parts, which are fewer than the parts."""
    return {(r["field"], r["term"]): r["df"] for r in spark.read.parquet(f"{path}/wide").collect()}
