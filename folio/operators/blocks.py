"""Score blocks of a written index, and batch top-k search that prunes by them.

blocks(field, term, shard, df, top, docs, parts, tfs)   one row per (field, term, shard)

A shard is a hash range of documents. A block holds the documents of its shard
that contain the term, best first, with their BM25 parts (tf, field length,
idf and field boost folded in) and the best part as upper bound `top`.

`search_blocks` answers a table of queries: a query's bound in a shard is the
sum of its blocks' tops, and its k-th score is at least the k-th best part of
any one block. Shards that can't reach that are never joined. Inside a shard
the blocks are scored by falling bound; once the bounds of the blocks left sum
to less than the running k-th score, no new document can enter, and what is
left is looked up for the documents still in the race only (MaxScore)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio import constants as C
from folio.functions.text import analyze
from folio.session import written

BLOCK_COLS = ("field", "term", "shard", "df", "top", "docs", "parts", "tfs")
#: Up to so many queries are routed shard by shard before lists are read.
ROUTED = 1000
#: A shard is made larger than asked for until it holds about so many postings, so that queries meet few shards.
SHARD_POSTINGS = 6_000_000
#: Scores are compared after rounding, so bounds leave this much room.
SLACK = 10.0 ** -C.SCORE_DECIMALS


def shard_count(index, n: int, held: int, shard_docs: int) -> int:
    """Shards of n documents with so many postings."""
    few = max(16, 2 * index.docs.sparkSession.sparkContext.defaultParallelism, -(-held // SHARD_POSTINGS))
    return max(1, min(-(-n // shard_docs), few))


def write_blocks(index, path: str, shard_docs: int) -> None:
    """The score blocks of a written index next to its postings. `shard_docs` is
    the least size of a shard. Every query of a batch meets every shard, so beyond two
    shards per core there are only as many as it takes to hold SHARD_POSTINGS each."""
    from folio.operators.search import contribution, with_stats

    n, held = index.docs.count(), index.vocab.agg(F.sum("df")).first()[0] or 0
    shards = shard_count(index, n, held, shard_docs)
    rows = index.postings.join(index.vocab.select("field", "term", "df"), ["field", "term"])
    rows = with_stats(rows, index).select("field", "term", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "df",
                                          F.struct((-contribution("bm25")).alias("p"), "doc_id", F.col("tf").cast("int").alias("tf")).alias("e"))
    lists = rows.groupBy("field", "term", "shard").agg(F.max("df").alias("df"), F.array_sort(F.collect_list("e")).alias("es"))
    out = lists.select("field", "term", "shard", "df", (-F.col("es")[0]["p"]).alias("top"), F.col("es.doc_id").alias("docs"),
                       F.transform("es.p", lambda p: -p).alias("parts"), F.col("es.tf").alias("tfs"))
    (out.repartitionByRange("field", "term", "shard").sortWithinPartitions("field", "term", "shard")
     .write.mode("overwrite").parquet(f"{path.rstrip('/')}/blocks"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/blocks").select(*BLOCK_COLS)


class Lists:
    """The blocks of one shard in one task."""

    def __init__(self, field: list, term: list, offsets: np.ndarray, docs: np.ndarray, parts: np.ndarray):
        self.row = {key: i for i, key in enumerate(zip(field, term, strict=True))}
        self.ids, place = np.unique(docs, return_inverse=True)
        at = np.repeat(np.arange(len(field)), np.diff(offsets))
        order = np.lexsort((place, at))  # by document inside a block, to look single documents up
        self.offsets, self.place, self.parts = offsets, place[order], parts[order]
        self.top = np.maximum.reduceat(parts, offsets[:-1]) if len(parts) else np.zeros(0)
        self.score = np.zeros(len(self.ids))
        self.entries_read = 0

    def best(self, keys: list, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the k best for the given (field, term) keys, and their scores. `floor` is a
        known lower bound of the k-th score."""
        rows = [self.row[x] for x in keys if x in self.row]
        rows.sort(key=lambda i: -self.top[i])
        left = np.append(np.cumsum(self.top[rows][::-1])[::-1], 0.0)
        score, floor = self.score, floor - SLACK
        seen, race = [], None
        for j, i in enumerate(rows):
            a, z = self.offsets[i], self.offsets[i + 1]
            place, part = self.place[a:z], self.parts[a:z]
            if race is None and left[j] < floor:
                race = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
            if race is None:
                score[place] += part
                seen.append(place)
                self.entries_read += z - a
                if len(seen) == 1 or left[j + 1] > floor:
                    floor = max(floor, self._kth(seen, k) - SLACK)
                continue
            race = race[score[race] + left[j] >= floor]
            if not len(race):
                break
            if len(race) * 8 < z - a:
                found = np.minimum(np.searchsorted(place, race), z - a - 1)
                hit = place[found] == race
                score[race[hit]] += part[found[hit]]
                self.entries_read += len(race)
            else:
                score[place] += part
                seen.append(place)
                self.entries_read += z - a
        if not seen:
            return self.ids[:0], score[:0]
        touched = np.unique(np.concatenate(seen))
        final = touched if race is None else race
        value = score[final]
        score[touched] = 0.0
        if len(value) > k:
            keep = value >= np.partition(value, len(value) - k)[len(value) - k] - SLACK
            final, value = final[keep], value[keep]
        return self.ids[final], value

    def _kth(self, seen: list, k: int) -> float:
        """The k-th best score so far of the documents of the newest lists (a lower bound of the k-th of all)."""
        value = self.score[seen[-1]]
        if len(value) < k:
            value = self.score[np.unique(np.concatenate(seen))]
        return float(np.partition(value, len(value) - k)[len(value) - k]) if len(value) >= k else -np.inf


ANSWER = pa.schema([("query", pa.string()), ("doc_id", pa.int64()), ("score", pa.float64())])


#: What a task of best_documents reads: the lists of its shards (kind 0), then the queries sent there (kind 1).
DEALT = "shard int, kind int, field string, term string, docs array<bigint>, parts array<double>, query string, terms array<string>, floor double"


def _answer(fields: tuple, k: int):
    """Over the rows of whole shards, in order of shard and kind: the lists of one shard are held, its queries stream by."""
    from folio.operators.batch import NO_ID

    def build(held: list) -> Lists | None:
        if not held:
            return None
        t = pa.Table.from_batches(held)
        docs, parts = (pa.concat_arrays(t[c].chunks) for c in ("docs", "parts"))
        offsets = docs.offsets.to_numpy().astype(np.int64)
        return Lists(t["field"].to_pylist(), t["term"].to_pylist(), offsets - offsets[0], pc.fill_null(docs.flatten(), NO_ID).to_numpy(), parts.flatten().to_numpy())

    def run(batches):
        shard, held, lists = None, [], None
        for b in batches:
            of, kind = b["shard"].to_numpy(), b["kind"].to_numpy()
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (kind[1:] != kind[:-1])) + 1
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if x == y:
                    continue
                if of[x] != shard:
                    shard, held, lists = of[x], [], None
                if kind[x] == 0:
                    held.append(b.slice(x, y - x).select(["field", "term", "docs", "parts"]))
                    continue
                if held:
                    lists, held = build(held), []
                if lists is None:
                    continue
                asked, out = b.slice(x, y - x), [[], [], []]
                for query, terms, floor in zip(asked["query"].to_pylist(), asked["terms"].to_pylist(), asked["floor"].to_pylist(), strict=True):
                    ids, value = lists.best([(f, t) for t in terms for f in fields], k, -np.inf if floor is None else floor)
                    if floor is not None:  # what is known to be below the k-th
                        above = value >= floor - SLACK
                        ids, value = ids[above], value[above]
                    if len(ids):
                        out[0] += [query] * len(ids)
                        out[1].append(ids)
                        out[2].append(value)
                if out[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(np.concatenate(out[1]).astype(np.int64)), pa.array(np.concatenate(out[2]))], schema=ANSWER)
    return run


def routes(index, asked: DataFrame, fields: tuple, k: int) -> DataFrame:
    """(shard, query, floor): the shards in which a query's bound reaches what its k-th score is known to be at least."""
    terms = asked.select("query", F.explode("terms").alias("term")).select("query", "term", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"))
    kth = F.get("parts", F.lit(k - 1))
    bounds = terms.join(index.blocks.select("field", "term", "shard", "top", kth.alias("kth")), ["field", "term"])
    per_shard = bounds.groupBy("query", "shard").agg(F.sum("top").alias("bound"), F.max("kth").alias("kth"))
    floor = per_shard.groupBy("query").agg(F.max("kth").alias("floor"))
    return (per_shard.join(floor, "query").filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - SLACK))
            .select("shard", "query", "floor"))


def best_documents(index, asked: DataFrame, k: int, fields: tuple, routed: int = ROUTED) -> DataFrame:
    """(query, doc_id, score, rank): the k best documents for every row of `asked(query, terms)`. A task holds one
    shard's lists at a time and answers the queries sent there as they stream by, so lists are read once for any number of
    queries. Up to `routed` queries go only to the shards that can reach their floor; more go to all shards, in chunks
    (operators/batch.py)."""
    from folio.operators.batch import NO_ID, answer_batch
    from folio.operators.stats import top_k_per_group

    asked = written(asked, "asked")  # read several times below
    shards = (index.blocks.agg(F.max("shard")).first()[0] or 0) + 1
    if asked.limit(routed + 1).count() <= routed:
        sent = routes(index, asked, fields, k).join(asked, "query")
        wanted = asked.select(F.explode("terms").alias("term")).distinct()
        lists = index.blocks.filter(F.col("field").isin(list(fields))).join(wanted, "term", "left_semi").withColumn("kind", F.lit(0))
        sent = sent.withColumn("kind", F.lit(1))
        names = [f.split(" ")[0] for f in DEALT.split(", ")]
        dealt = lists.unionByName(sent.select("shard", "kind", "query", "terms", "floor"), allowMissingColumns=True).select(*names)
        found = dealt.repartition(4 * shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_answer(tuple(fields), k), "query string, doc_id long, score double")
        found = found.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
    else:
        found = answer_batch(index, asked, k, tuple(fields), shards)
    return top_k_per_group(found.withColumn("score", F.round("score", C.SCORE_DECIMALS)), ["query"], [F.col("score").desc(), F.col("doc_id")], k)


def search_blocks(index, queries: DataFrame, k: int, fields: tuple, qid: str = "qid", text: str = "text") -> DataFrame:
    """(qid, doc_id, score, rank): the k best documents of every query, the OR of its words over `fields`. Equal texts
    are answered once."""
    said = queries.select(F.col(qid).alias("qid"), F.md5(F.col(text)).alias("query"), F.col(text).alias("text"))
    asked = said.groupBy("query").agg(F.any_value("text").alias("text")).select("query", F.array_distinct(analyze("text")).alias("terms"))
    best = best_documents(index, asked, k, fields)
    return said.select("qid", "query").join(best, "query").select("qid", "doc_id", "score", "rank")


def similar_documents(index, k_terms: int = 10, k: int = 10, field: str = "content") -> DataFrame:
    """T11 for all documents: (seed_id, doc_id, score, rank), the k documents most like each one, by BM25 over its
    `k_terms` heaviest terms. Each document is a query to the score blocks, so pairs below its k-th score are not summed."""
    from folio.operators.batch import heavy_terms
    from folio.operators.search import top_terms

    if index.stats_values and field in index.stats_values:
        asked = heavy_terms(index, k_terms, field, (index.blocks.agg(F.max("shard")).first()[0] or 0) + 1)
    else:
        asked = top_terms(index, k_terms, field).groupBy(F.col("doc_id").cast("string").alias("query")).agg(F.collect_list("term").alias("terms"))
    best = best_documents(index, asked.filter("query is not null"), k + 2, (field,))  # the document itself and the null id may be among them
    rest = best.withColumn("seed_id", F.col("query").cast("long")).filter("seed_id <> doc_id")
    rank = F.row_number().over(Window.partitionBy("seed_id").orderBy("rank"))
    return rest.select("seed_id", "doc_id", "score", rank.alias("rank")).filter(F.col("rank") <= k)
