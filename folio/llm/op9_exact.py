"""Exact dedup by Golomb-coded fingerprint exchange.

Texts are equal when identical after deleting every character of
[\\x20\\x09-\\x0D]. Groups of documents send their sorted, compressed
fingerprints to owners and receive bitmaps of duplicates; only documents with
a duplicate fingerprint (suspects) are shuffled with their text, grouped by
the very bytes, with partial aggregation before that shuffle.

Defined cases: null text is empty, and all empty texts are equal; repeated
rows are equal texts; a null doc_id is a doc_id below all others; other
columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import exchange as X
from folio.llm.common import SPACE, keep_rows, own_ids, slices, stored, text_buffers, under_row

GROUP_ROWS = 50_000


def _normalised(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes without white space, their offsets, code points of the original texts)."""
    data, off = text_buffers(batch["text"])
    keep = ~SPACE[data]
    at = np.concatenate(([0], np.cumsum(keep)))[off]
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[off]
    return data[keep], at, np.diff(points)


def _fingerprints(batches):
    for b in slices(batches, "text"):
        data, off, points = _normalised(b)
        raw = memoryview(data.tobytes())
        digest = [hashlib.sha256(raw[x:y]) for x, y in zip(off[:-1], off[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b["doc_id"], b["gid"], pa.array([int.from_bytes(d.digest()[:8], "big", signed=True) for d in digest], pa.int64()),
             pa.array(points, pa.int64()), pa.array([d.hexdigest() for d in digest], pa.string())],
            ["doc_id", "gid", "fp", "points", "text_sha256"])


def _texts(batches):
    for b in slices(batches, "text"):
        data, off, points = _normalised(b)
        norm = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(points, pa.int64()), norm.cast(pa.binary())], ["doc_id", "points", "norm"])


def _unsigned(s: pd.Series) -> np.ndarray:
    return s.to_numpy(np.int64).view(np.uint64)


def exact_groups(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per document.
    Of equal texts the one with the most code points stays, then the smallest
    doc_id."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    n = docs.select(F.count("*")).first()[0]
    groups = max(4, -(-n // group_rows))
    prints = stored(docs.select("doc_id", X.group_of("doc_id", groups), "text").mapInArrow(
        _fingerprints, "doc_id long, gid long, fp long, points long, text_sha256 string").withColumn("row", F.monotonically_increasing_id()), "op9-prints")

    def send(key, pdf):
        return X.send(int(key[0]), _unsigned(pdf["fp"]), groups)

    def receive(key, pdf, back):
        pdf = pdf[["doc_id", "points", "text_sha256", "row", "fp"]]
        return pdf.assign(suspect=X.shared(_unsigned(pdf["fp"]), back, groups)).drop(columns="fp")

    back = X.answers(prints.groupBy("gid").applyInPandas(send, X.SENT))
    marked = stored(prints.groupBy("gid").cogroup(back.groupBy("gid")).applyInPandas(
        receive, "doc_id long, points long, text_sha256 string, row long, suspect boolean"), "op9-marked")
    suspects = marked.filter("suspect").select(F.col("doc_id").alias("__id")).distinct()
    order = F.struct((-F.col("points")).alias("p"), "doc_id")
    same = (docs.join(suspects, docs["doc_id"].eqNullSafe(suspects["__id"]), "left_semi")
            .mapInArrow(_texts, "doc_id long, points long, norm binary")
            .groupBy("norm").agg(F.min(order)["doc_id"].alias("keep_id"), F.count("*").alias("group_size"))
            .select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"))
    # one row stays also where a doc_id repeats with equal texts: the first as written
    first = F.struct((-F.col("points")).alias("p"), "doc_id", "row")
    firsts = marked.filter("suspect").groupBy("text_sha256").agg(F.min(first)["row"].alias("keep_row"))
    told = stored(same.join(firsts, "text_sha256"), "op9-groups")
    rest = marked.filter("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    found = marked.filter("suspect").join(told, "text_sha256").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
    return rest.unionByName(found)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, one of each group of equal texts, with all their columns; rows of one doc_id
    are rows of their own."""
    rows = own_ids(docs)
    return keep_rows(rows, exact_groups(under_row(rows)).filter("kept"))


ORACLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
      FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS FIRST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r"""
