"""Answers to large batches of queries from score blocks.

Queries are packed in chunks: a chunk names each of its terms once. A task holds the lists of one shard and answers the
chunks as they stream by. The lists of most postings also lie there as rows with a place for every document; of these, a query leaves
out those whose bounds sum to less than its floor, and looks them up for the documents that can still reach it. A few
shards answer first; the k-th score of a query there is its floor in the others."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio import constants as C
from folio.operators.lists import LISTS, bm25_parts, blob, names, numbers, opened, row_of, shard_of, whole_df
from folio.session import written

#: Queries of a chunk.
CHUNK = 4096
#: Bytes of a shard's rows with a place for every document.
ROW_BYTES = 96_000_000
#: Places whose best score stands for them when the k-th score is bounded from below.
STRIDE = 64
#: Stands for the null document id.
NO_ID = -2 ** 63
#: Scores are compared after rounding, so bounds leave this much room.
SLACK = 10.0 ** -C.SCORE_DECIMALS

CHUNKS = "chunk long, names array<string>, terms array<string>, at binary, size binary"
FOUND = "chunk long, floors binary, query binary, docs binary, scores binary"
#: The lists of one shard in some row of lists. Where field lengths are not known, the parts are.
SHARDED = "shard int, field string, terms array<string>, size binary, dfs binary, docs binary, tfs binary, dls binary, parts binary"
#: What a task reads: lists (kind 0), then chunks of queries (kind 1).
DEALT = "deal int, kind int, field string, terms array<string>, size binary, dfs binary, docs binary, tfs binary, dls binary, parts binary, chunk long, at binary, floors binary"


def _shard_lists(shards: int, wide: dict, low: int, high: int):
    """Lists dealt to the shards from `low` to below `high`."""
    def run(batches):
        for b in batches:
            for field, terms, size, docs, tfs, dls in opened(b):
                df, row, shard = whole_df(field, terms, size, wide), np.repeat(np.arange(len(size)), size), shard_of(docs, shards)
                if high - low < shards:
                    mine = np.flatnonzero((shard >= low) & (shard < high))
                    row, shard, docs, tfs, dls = (x[mine] for x in (row, shard, docs, tfs, dls))
                order = np.argsort(shard.astype(np.uint16) if shards < 65_536 else shard, kind="stable")
                row, docs, tfs, dls = (x[order] for x in (row, docs, tfs, dls))
                ends = np.concatenate(([0], np.cumsum(np.bincount(shard, minlength=shards)))).tolist()
                for s, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    if z > a:
                        n = np.bincount(row[a:z], minlength=len(size))
                        here = np.flatnonzero(n)
                        yield row_of(SHARDED, s, field, terms.take(pa.array(here)), n[here].astype(np.int32), df[here], docs[a:z], tfs[a:z], dls[a:z], None)
    return run


def _shard_blocks(batches):
    """Score blocks gathered by shard and field."""
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]).combine_chunks()
        t = t.take(pc.sort_indices(t, [("shard", "ascending"), ("field", "ascending")])).combine_chunks()
        shard, field = t["shard"].to_pylist(), t["field"].to_pylist()
        cuts = [0, *(i for i in range(1, len(shard)) if shard[i] != shard[i - 1] or field[i] != field[i - 1]), len(shard)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            r = t.slice(x, y - x).combine_chunks()
            docs, parts, tfs = (r[c].chunk(0) for c in ("docs", "parts", "tfs"))
            yield row_of(SHARDED, shard[x], field[x], r["term"].chunk(0), pc.list_value_length(docs).to_numpy(), r["df"].to_numpy(),
                         pc.fill_null(docs.flatten(), NO_ID).to_numpy(), tfs.flatten().to_numpy(), None, parts.flatten().to_numpy())


def shard_lists(index, fields: tuple, shards: int, low: int, high: int) -> DataFrame:
    """The lists of some fields, dealt to the shards from `low` to below `high` of `shards`."""
    some = F.col("field").isin(list(fields))
    if index.lists is not None:
        return index.lists.filter(some).select(*names(LISTS)).mapInArrow(_shard_lists(shards, index.wide, low, high), SHARDED)
    return index.blocks.filter(some & (F.col("shard") >= low) & (F.col("shard") < high)).mapInArrow(_shard_blocks, SHARDED)


def _pack(batches):
    """Chunks of rows (query, terms)."""
    from pyspark import TaskContext

    first, n = TaskContext.get().partitionId() << 32, 0

    def of(t: pa.Table) -> pa.RecordBatch:
        terms = pa.concat_arrays(t["terms"].chunks)
        size = pc.fill_null(pc.list_value_length(terms), 0).to_numpy().astype(np.int32)
        coded = terms.flatten().dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array([first + n]), *row_of(CHUNKS[12:], t["query"].combine_chunks(), coded.dictionary, at, size).columns], names(CHUNKS))

    held, rows = [], 0
    for b in batches:
        for x in range(0, b.num_rows, CHUNK):
            part = b.slice(x, CHUNK)
            if rows and rows + part.num_rows > CHUNK:
                yield of(pa.Table.from_batches(held))
                held, rows, n = [], 0, n + 1
            held.append(part)
            rows += part.num_rows
    if rows:
        yield of(pa.Table.from_batches(held))


class Shard:
    """The lists of one shard in one task."""

    def __init__(self, field: list, term: list, offsets: np.ndarray, docs: np.ndarray, parts: np.ndarray, row_bytes: int = ROW_BYTES):
        self.row = {key: i for i, key in enumerate(zip(field, term, strict=True))}
        self.ids = np.unique(docs)
        self.place, self.parts, self.offsets = np.searchsorted(self.ids, docs), parts, offsets.tolist()
        size = np.diff(offsets)
        self.top = np.maximum.reduceat(parts, offsets[:-1])
        wide = np.argsort(-size, kind="stable")[:row_bytes // (8 * len(self.ids))]
        wide = wide[size[wide] * 16 >= len(self.ids)]
        self.wide, self.rows = np.full(len(size), -1), np.zeros((len(wide), len(self.ids)))
        self.wide[wide] = np.arange(len(wide))
        for j, i in enumerate(wide.tolist()):
            a, z = self.offsets[i], self.offsets[i + 1]
            self.rows[j, self.place[a:z]] = self.parts[a:z]

    def answer(self, fields: tuple, terms: list, at: np.ndarray, size: np.ndarray, floors: np.ndarray, k: int):
        """(query, document, score) of the documents that may be among the k best of a query, which is a run of `size`
        codes `at` of terms. `floors` are known lower bounds of the k-th scores."""
        n, get = len(size), self.row.get
        rows = np.concatenate([np.array([get((f, t), -1) for t in terms], np.int64)[at] for f in fields])
        query = np.tile(np.repeat(np.arange(n), size), len(fields))
        query, rows = query[rows >= 0], rows[rows >= 0]
        tops, wide = self.top[rows], self.wide[rows] >= 0
        order = np.lexsort((-tops, wide, query))
        rows, tops, wide, query = rows[order], tops[order], wide[order], query[order]
        ends = np.searchsorted(query, np.arange(n + 1))
        total = np.concatenate(([0.0], np.cumsum(tops)))
        rest = total[ends[query + 1]] - total[:-1] + SLACK  # what a list and those after it can add up to
        least = floors - 2 * SLACK
        late = wide & (rest < least[query])
        begin, end = ends[:-1], ends[1:]
        middle = end - np.bincount(query, late, n).astype(np.int64)
        over = total[end] - total[middle]
        alive = np.flatnonzero((total[end] - total[begin] + SLACK >= least) & (middle > begin))
        row_list, wide_row = rows.tolist(), self.wide[rows].tolist()
        begin, middle, end, over, least = (x.tolist() for x in (begin, middle, end, over, least))
        place, parts, offsets, many = self.place, self.parts, self.offsets, len(self.ids)
        out = [], [], []
        for q in alive.tolist():
            score, ps, vs, lists = None, [], [], []
            for j in range(begin[q], middle[q]):
                if wide_row[j] >= 0:
                    lists.append(wide_row[j])
                else:
                    a, z = offsets[row_list[j]], offsets[row_list[j] + 1]
                    ps.append(place[a:z])
                    vs.append(parts[a:z])
            if ps:
                score = np.bincount(np.concatenate(ps), np.concatenate(vs), many) if len(ps) > 1 else np.bincount(ps[0], vs[0], many)
            for w in lists:
                score = self.rows[w].copy() if score is None else np.add(score, self.rows[w], out=score)
            floor = least[q]
            if floor <= 0:
                floor = self._bound(score, k)
            found = np.flatnonzero(score >= max(floor - over[q], SLACK * SLACK))
            value, left = score[found], over[q]
            for j in range(middle[q], end[q]):
                if len(found) > STRIDE:
                    keep = value >= floor - left
                    found, value = found[keep], value[keep]
                if not len(found):
                    break
                value = value + self.rows[wide_row[j]][found]
                left -= self.top[row_list[j]]
            keep = value >= floor
            found, value = found[keep], value[keep]
            if len(value) > k:
                keep = value >= np.partition(value, len(value) - k)[len(value) - k] - 2 * SLACK
                found, value = found[keep], value[keep]
            if len(found):
                out[0].append(np.full(len(found), q, np.int32))
                out[1].append(found)
                out[2].append(value)
        if not out[0]:
            return np.zeros(0, np.int32), self.ids[:0], np.zeros(0)
        query, found, value = (np.concatenate(x) for x in out)
        return query, self.ids[found], value

    @staticmethod
    def _bound(score: np.ndarray, k: int) -> float:
        """A lower bound of the k-th best score, 0 where there are fewer."""
        best = np.maximum.reduceat(score, np.arange(0, len(score), STRIDE))
        if len(best) < k:
            best = score
        return max(0.0, float(np.partition(best, len(best) - k)[len(best) - k]) - 2 * SLACK) if len(best) >= k else 0.0


def _answer(fields: tuple, k: int, stats: dict):
    """Over rows of whole deals, lists first."""
    def build(held: list) -> Shard:
        field, term, size, docs, parts = [], [], [], [], []
        for b in held:
            for i in range(b.num_rows):
                f, n, d = b["field"][i].as_py(), numbers(b["size"][i], np.int32), numbers(b["docs"][i], np.int64)
                field += [f] * len(n)
                term += b["terms"][i].as_py()
                size.append(n)
                docs.append(d)
                parts.append(numbers(b["parts"][i], np.float64) if b["parts"][i].is_valid else bm25_parts(
                    f, numbers(b["tfs"][i], np.int32), numbers(b["dls"][i], np.int32), np.repeat(numbers(b["dfs"][i], np.int64), n), *stats[f]))
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(size), dtype=np.int64)))
        return Shard(field, term, offsets, np.concatenate(docs), np.concatenate(parts))

    def run(batches):
        deal, held, shard = None, [], None
        for b in batches:
            of, kind = b["deal"].to_numpy(), b["kind"].to_numpy()
            cuts = [0, *(np.flatnonzero((of[1:] != of[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), b.num_rows]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x == y:
                    continue
                if of[x] != deal:
                    deal, held, shard = of[x], [], None
                if kind[x] == 0:
                    held.append(b.slice(x, y - x))
                    continue
                if held:
                    shard, held = build(held), []
                if shard is None:
                    continue
                for i in range(x, y):
                    at, size = (numbers(b[c][i], np.int32) for c in ("at", "size"))
                    floors = np.full(len(size), -np.inf)
                    known = numbers(b["floors"][i], np.float64)
                    floors[:len(known)] = known
                    query, docs, scores = shard.answer(fields, b["terms"][i].as_py(), at, size, floors, k)
                    if len(query):
                        yield pa.RecordBatch.from_arrays([b["chunk"].slice(i, 1), pa.nulls(1, pa.binary()), blob(query), blob(docs), blob(scores)], names(FOUND))
    return run


def _best(k: int):
    """One row for each chunk from rows in order of chunk: its queries' k best documents (and those next to the k-th score), and the k-th scores."""
    def of(chunk: int, rows: list) -> pa.RecordBatch:
        query, docs, scores = (np.concatenate([np.frombuffer(r[c], kind) for r in rows]) for c, kind in enumerate((np.int32, np.int64, np.float64)))
        order = np.lexsort((-scores, query))
        query, docs, scores = query[order], docs[order], scores[order]
        ends = np.searchsorted(query, np.arange(query[-1] + 2))
        full = np.diff(ends) >= k
        floors = np.full(len(full), -np.inf)
        floors[full] = scores[ends[:-1][full] + k - 1]
        keep = scores >= floors[query] - 2 * SLACK
        return pa.RecordBatch.from_arrays([pa.array([chunk]), blob(floors), blob(query[keep]), blob(docs[keep]), blob(scores[keep])], names(FOUND))

    def run(batches):
        chunk, rows = None, []
        for b in batches:
            for c, *row in zip(*(b[x].to_pylist() for x in ("chunk", "query", "docs", "scores")), strict=True):
                if c != chunk and rows:
                    yield of(chunk, rows)
                    rows = []
                chunk = c
                rows.append(row)
        if rows:
            yield of(chunk, rows)
    return run


def _rows(batches):
    """Rows (query, doc_id, score) from rows of chunks with their names."""
    for b in batches:
        for i in range(b.num_rows):
            query, docs, scores = (np.frombuffer(b[c][i].as_py(), kind) for c, kind in (("query", np.int32), ("docs", np.int64), ("scores", np.float64)))
            told = b["names"][i].values
            for x in range(0, len(query), 50_000):
                y = x + 50_000
                ids = docs[x:y]
                yield pa.RecordBatch.from_arrays([told.take(pa.array(query[x:y])), pa.array(ids, mask=ids == NO_ID), pa.array(scores[x:y])], ["query", "doc_id", "score"])


def _wave(index, chunks: DataFrame, shards: int, low: int, high: int, copies: int, fields: tuple, k: int) -> DataFrame:
    """What the shards from `low` to below `high` find for the chunks. Each shard's lists go to `copies` tasks, each of which answers
    its share of the chunks."""
    own = (F.col("shard") - low) * copies
    deal = F.explode(F.sequence(own, own + (copies - 1))) if copies > 1 else own
    lists = shard_lists(index, fields, shards, low, high).select(deal.alias("deal"), F.lit(0).alias("kind"), *names(SHARDED)[1:])
    sent = chunks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(high - low - 1))))
    sent = sent.select((F.col("shard") * copies + F.pmod(F.xxhash64("chunk"), F.lit(copies))).cast("int").alias("deal"), F.lit(1).alias("kind"),
                       "chunk", "terms", "at", "size", "floors")
    dealt = lists.unionByName(sent, allowMissingColumns=True).select(*names(DEALT))
    return dealt.repartitionById((high - low) * copies, "deal").sortWithinPartitions("deal", "kind").mapInArrow(_answer(fields, k, index.stats_values), FOUND)


def _merged(found: DataFrame, k: int) -> DataFrame:
    return found.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_best(k), FOUND)


def answer_batch(index, asked: DataFrame, k: int, fields: tuple, shards: int) -> DataFrame:
    """(query, doc_id, score): the k best documents for every row of `asked(query, terms)`, and those whose scores
    are next to the k-th."""
    chunks = written(asked.select("query", "terms").mapInArrow(_pack, CHUNKS), "chunks")
    cores = asked.sparkSession.sparkContext.defaultParallelism
    first = shards // 8 if shards >= 8 else 0
    none = chunks.withColumn("floors", F.lit(None).cast("binary"))
    if first:
        early = written(_merged(_wave(index, none, shards, 0, first, -(-cores // first), fields, k), k), "early")
        known = chunks.join(early.select("chunk", "floors"), "chunk", "left")
        found = _merged(_wave(index, known, shards, first, shards, 1, fields, k).unionByName(early), k)
    else:
        found = _merged(_wave(index, none, shards, 0, shards, max(1, -(-cores // shards)), fields, k), k)
    return found.join(chunks.select("chunk", "names"), "chunk").mapInArrow(_rows, "query string, doc_id long, score double")


def _heavy(k: int, n_docs: int):
    """(query, terms): the k heaviest terms of each document, from the lists of whole shards."""
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = [(b["terms"][i].values, *(numbers(b[c][i], kind) for c, kind in (("size", np.int32), ("dfs", np.int64), ("docs", np.int64), ("tfs", np.int32)))) for b in held for i in range(b.num_rows)]
        term = pa.concat_arrays([r[0] for r in rows])
        size, df, docs, tfs = (np.concatenate([r[i] for r in rows]) for i in range(1, 5))
        del held, rows
        order, rank = pc.sort_indices(term), np.empty(len(term), np.int64)
        rank[order.to_numpy()] = np.arange(len(term))
        term, row = term.take(order), np.repeat(rank, size)
        weight = tfs * np.repeat(np.log(n_docs / df.astype(np.float64)), size)
        order = np.lexsort((row, -weight, docs))
        docs, row = docs[order], row[order]
        first = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
        size = np.diff(np.append(first, len(docs)))
        row = row[np.arange(len(docs)) - np.repeat(first, size) < k]
        ends = np.concatenate(([0], np.cumsum(np.minimum(size, k))))
        docs = docs[first]
        for x in range(0, len(docs), CHUNK):
            y = min(x + CHUNK, len(docs))
            mine = term.take(pa.array(row[ends[x]:ends[y]]))
            terms = pa.ListArray.from_arrays(pa.array((ends[x:y + 1] - ends[x]).astype(np.int32)), mine)
            yield pa.RecordBatch.from_arrays([pc.cast(pa.array(docs[x:y], mask=docs[x:y] == NO_ID), pa.string()), terms], ["query", "terms"])
    return run


def heavy_terms(index, k: int, field: str, shards: int) -> DataFrame:
    """`top_terms` of every document as rows (query, terms) for a batch: a task reads the lists of one shard."""
    lists = shard_lists(index, (field,), shards, 0, shards).select("shard", "terms", "size", "dfs", "docs", "tfs")
    return lists.repartitionById(shards, "shard").mapInArrow(_heavy(k, index.stats_values[field][0]), "query string, terms array<string>")
