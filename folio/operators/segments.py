"""An index as segments: upserts and deletes by id that read only the documents
they touch (T2, T15, E4).

base/seg=N/postings   field, term, doc_id, tf, dl            of the segment's documents
base/seg=N/forward    doc_id, terms(field, term, tf), lengths(field, dl)   the same, a row a document
base/seg=N/vocab      field, term, df, cf                     what the segment adds to the counts, or takes away
base/seg=N/stats      field, n_docs, sum_dl                   the same for the field statistics
base/seg=N/dead       doc_id                                  documents whose rows in earlier segments count no more

A batch writes one segment. The terms of a document that goes or is replaced
come from its forward row, found by a pushed-down filter on doc_id, so no posting
list is read. Readers add the segments up; compact() folds them into one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import index as ix
from folio.session import written

#: A batch of up to so many documents looks its forward rows up by id; a larger one is joined.
LOOKUP_IDS = 1000
_FORWARD = "terms array<struct<field:string,term:string,tf:bigint>>, lengths array<struct<field:string,dl:int>>"


class SegmentedIndex:
    """An index below `base` in the shared folder. The type of doc_id is that of the first segment's documents."""

    def __init__(self, spark: SparkSession, base: str, text_fields=ix.TEXT_FIELDS, keyword_fields=ix.KEYWORD_FIELDS):
        self.spark, self.base = spark, base.rstrip("/")
        self.text_fields, self.keyword_fields = tuple(text_fields), tuple(keyword_fields)

    # --- segments on disk
    def _has(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}/_SUCCESS")
        return bool(path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path))

    def segments(self) -> list[int]:
        """Numbers of the committed segments that are read: from the last compaction on."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.base)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = sorted(int(s.getPath().getName()[4:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("seg="))
        found = [n for n in found if self._has(f"seg={n}/done")]
        whole = [n for n in found if self._has(f"seg={n}/whole")]
        return [n for n in found if n >= max(whole, default=-1)]

    def _read(self, part: str, numbers: list[int]) -> DataFrame:
        """A part of several segments, with the segment's number."""
        out = None
        for n in numbers:
            one = self.spark.read.parquet(f"{self.base}/seg={n}/{part}").withColumn("seg", F.lit(n))
            out = one if out is None else out.unionByName(one)
        return out

    def _alive(self, rows: DataFrame, numbers: list[int]) -> DataFrame:
        """Rows of documents that no later segment has touched."""
        dead = self._read("dead", numbers).groupBy("doc_id").agg(F.max("seg").alias("since"))
        return rows.join(dead, "doc_id", "left").filter(F.col("since").isNull() | (F.col("seg") >= F.col("since"))).drop("since", "seg")

    # --- writing
    def apply(self, number: int, docs: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
        """Segment `number`: `docs` are indexed, in place of what was indexed under their ids, and the ids of
        `deleted(doc_id)` go. Writing a number again replaces that segment. An id in both is indexed."""
        before = [n for n in self.segments() if n < number]
        here = f"{self.base}/seg={number}"
        if self._has(f"seg={number}/whole"):
            raise ValueError(f"segment {number} is a compaction; batches go above it")
        touched = None
        if docs is not None:
            # one row a document from the tokens on: nothing below shuffles postings
            postings = ix.build_index(docs, self.text_fields, self.keyword_fields, by_document=True).postings
            held = written(postings.groupBy("doc_id").agg(F.collect_list(F.struct("field", "term", "tf")).alias("terms"), F.collect_set(F.struct("field", "dl")).alias("lengths")), "segment-rows")
            of = F.map_from_entries("lengths")
            (held.select("doc_id", F.explode("terms").alias("t"), of.alias("l")).select("t.field", "t.term", "doc_id", "t.tf", F.col("l")[F.col("t.field")].alias("dl"))
             .write.mode("overwrite").parquet(f"{here}/postings"))
            bare = docs.select("doc_id").distinct().join(held.select("doc_id"), "doc_id", "left_anti")
            bare = bare.select("doc_id", *[F.array().cast(t).alias(c) for c, t in (x.split(" ", 1) for x in _FORWARD.split(", "))])
            (held.filter("doc_id is not null").unionByName(bare)
             .repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").option("parquet.block.size", 1 << 20).parquet(f"{here}/forward"))
            touched = self.spark.read.parquet(f"{here}/forward").select("doc_id")
        if deleted is not None:
            gone = deleted.select("doc_id").distinct()
            touched = gone if touched is None else touched.unionByName(gone).distinct()
        touched.write.mode("overwrite").parquet(f"{here}/dead")
        touched = self.spark.read.parquet(f"{here}/dead")
        old = self.forward_of(touched, before) if before else None
        new = self.spark.read.parquet(f"{here}/forward") if docs is not None else None
        sides = [(x, sign) for x, sign in ((new, 1), (old, -1)) if x is not None]
        self._counts(sides).write.mode("overwrite").parquet(f"{here}/vocab")
        self._sizes(sides).write.mode("overwrite").parquet(f"{here}/stats")
        if docs is None:  # a segment of deletes has empty lists
            self._read("postings", before[:1]).drop("seg").limit(0).write.mode("overwrite").parquet(f"{here}/postings")
            self._read("forward", before[:1]).drop("seg").limit(0).write.mode("overwrite").parquet(f"{here}/forward")
        self.spark.range(0).write.mode("overwrite").parquet(f"{here}/done")

    def forward_of(self, ids: DataFrame, numbers: list[int] | None = None) -> DataFrame:
        """The live forward rows of some documents. The ids of a small batch are pushed into the scan."""
        numbers = self.segments() if numbers is None else numbers
        some = [r[0] for r in ids.select("doc_id").limit(LOOKUP_IDS + 1).collect()]
        rows = self._read("forward", numbers)
        rows = rows.filter(F.col("doc_id").isin(some)) if len(some) <= LOOKUP_IDS else rows.join(ids, "doc_id", "left_semi")
        return self._alive(rows, numbers)

    @staticmethod
    def _counts(sides) -> DataFrame:
        """(field, term, df, cf) that forward rows add (sign 1) or take away (-1)."""
        out = None
        for rows, sign in sides:
            one = rows.select(F.explode("terms").alias("t")).groupBy("t.field", "t.term").agg(F.count(F.lit(1)).alias("df"), F.sum("t.tf").alias("cf"))
            one = one.select("field", "term", (F.col("df") * sign).alias("df"), (F.col("cf") * sign).alias("cf"))
            out = one if out is None else out.unionByName(one)
        return out.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df <> 0 or cf <> 0")

    def _sizes(self, sides) -> DataFrame:
        """(field, n_docs, sum_dl), one row a field and a '' row for documents."""
        fields = F.array(*[F.lit(f) for f in (*self.text_fields, *self.keyword_fields)])
        out = None
        for rows, sign in sides:
            held = F.map_from_entries("lengths")
            one = rows.select(F.explode(F.transform(fields, lambda f: F.struct(f.alias("field"), F.coalesce(F.element_at(held, f), F.lit(0)).alias("dl")))).alias("x"))
            one = one.groupBy("x.field").agg((F.count(F.lit(1)) * sign).alias("n_docs"), (F.sum("x.dl") * sign).alias("sum_dl"))
            out = one if out is None else out.unionByName(one)
        return out.groupBy("field").agg(F.sum("n_docs").alias("n_docs"), F.sum("sum_dl").alias("sum_dl"))

    # --- reading
    def open(self, docs: DataFrame) -> ix.Index:
        """The index of all segments over the current documents, for the search operators."""
        numbers = self.segments()
        postings = self._alive(self._read("postings", numbers), numbers)
        vocab = (self._read("vocab", numbers).groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df > 0"))
        stats = self._read("stats", numbers).groupBy("field").agg(F.sum("n_docs").alias("n_docs"), F.sum("sum_dl").alias("sum_dl")) \
            .withColumn("avgdl", F.col("sum_dl") / F.col("n_docs"))
        values = {r["field"]: (r["n_docs"], r["avgdl"]) for r in stats.collect()}  # one row per field
        return ix.Index(postings, vocab, stats, docs, False, (*self.text_fields, *self.keyword_fields), values, True)

    def compact(self, number: int) -> None:
        """All segments folded into segment `number` (above all others); readers start from it."""
        before = self.segments()
        here = f"{self.base}/seg={number}"
        folded = self.open(self._read("dead", before))
        folded.postings.repartitionByRange("field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id").write.mode("overwrite").parquet(f"{here}/postings")
        self._alive(self._read("forward", before), before).repartitionByRange("doc_id").sortWithinPartitions("doc_id") \
            .write.mode("overwrite").option("parquet.block.size", 1 << 20).parquet(f"{here}/forward")
        folded.vocab.write.mode("overwrite").parquet(f"{here}/vocab")
        folded.stats.drop("avgdl").write.mode("overwrite").parquet(f"{here}/stats")
        self._read("dead", before).select("doc_id").limit(0).write.mode("overwrite").parquet(f"{here}/dead")
        for mark in ("whole", "done"):
            self.spark.range(0).write.mode("overwrite").parquet(f"{here}/{mark}")
