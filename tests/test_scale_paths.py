"""The scale-safe forms agree with brute force on small inputs."""

import itertools

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.operators import export as O
from folio.operators import stats as S
from folio.operators import suggest as G


def test_salted_topk_equals_window(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 1000).alias("v"), "id")
    fast = S.top_k_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], 7, salt_buckets=16)
    w = Window.partitionBy("g").orderBy(F.col("v").desc(), F.col("id"))
    slow = df.withColumn("rank", F.row_number().over(w)).filter("rank <= 7")
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.select(*fast.columns).collect()))


def test_global_row_number(spark):
    df = spark.range(500).select(((F.col("id") * 31) % 500).alias("k"))
    n = O.global_row_number(df, [F.col("k")], partitions=7).collect()
    assert sorted((r["n"], r["k"]) for r in n) == [(i + 1, i) for i in range(500)]


def test_typo_completion_equals_brute_force(spark):
    terms = ["the", "thy", "tha", "tie", "abc", "xthe", "them", "she", "ghe", "te", "t"]
    sugg = spark.createDataFrame([(t, "title", 1) for t in terms], "term string, type string, frequency long")
    pre = spark.createDataFrame([("the",), ("ab",)], "prefix string")
    got = {(r["prefix"], r["term"]) for r in G.typo_completion(sugg, pre, k=100).collect()}

    def one_edit(a, b):
        less = lambda s: {s[:i] + s[i + 1:] for i in range(len(s))}
        same = len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
        return same or b in less(a) or a in less(b)

    want = {(p, t) for p, t in itertools.product(["the", "ab"], terms)
            if not t.startswith(p) and any(one_edit(t[:n], p) for n in range(1, len(t) + 1))}
    assert got == want
