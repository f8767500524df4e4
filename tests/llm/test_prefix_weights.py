"""The weight from the first common shingle on bounds what two texts have in common."""

import random

import numpy as np
import pyarrow as pa
from folio.llm import op1_near as m
from pyspark.sql import functions as F


def _texts(n):
    rng, word = random.Random(9), iter(range(10**6))
    fresh = lambda k: [f"w{next(word)}" for _ in range(k)]
    template, texts = fresh(160), []
    for i in range(n):  # about 0.6 to all others; every tenth has a near copy
        own = fresh(rng.randrange(36, 44))
        texts.append(" ".join(template + own))
        if i % 10 == 0:
            texts.append(" ".join(template + own[:-rng.randrange(1, 5)] + fresh(2)))
    return texts


def _similar(texts, idf):
    a, b = np.triu_indices(len(texts), 1)
    column = pa.array(texts, pa.string())
    sim = m.similarities(column.take(pa.array(a)), column.take(pa.array(b)), idf)
    return {(int(x), int(y)) for x, y in zip(a[sim >= 0.8], b[sim >= 0.8])}


def test_few_candidates_of_a_template_and_all_links(spark, monkeypatch):
    texts = _texts(100)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    idf = m.idf_table(*m.document_frequencies(docs))
    links = _similar(texts, idf)
    assert len(links) == 10
    rows = docs.withColumns({"label": F.col("doc_id"), "stray": F.lit(True)}).select("doc_id", "label", "stray", "text")
    share = spark.sparkContext.broadcast(idf)
    schema = "rep long, label long, stray boolean, cell long, left double, total double"
    rare = rows.mapInArrow(lambda batches: m._prefixes(batches, share.value, 0.8), schema).drop("label", "stray")
    sig = m.signatures(docs, share).select(F.col("doc_id").alias("rep"), "sig")
    labels = spark.createDataFrame([], "node long, label long")
    got = [tuple(r) for r in m._crowded(rare, labels, sig, small=1).collect()]
    assert set(got) >= links and len(got) == len(set(got))
    assert len(got) <= 2 * len(texts)  # of 5995 pairs
