"""Mixing sources to target weights by systematic sampling.

A document's expected number of copies is its source's target over its
source's size. Within a source, documents in order of (size, doc_id) lay their
expected copies end to end; one random offset is added per source, and a copy
is emitted for each integer boundary crossed. All on DataFrame functions: the
prefix sums are range partitions of (source, size, doc_id) plus one row of
counts for each partition and source, so a hot source spreads over many tasks.

Defined cases: null text has size 0; null source is a source of its own, last
in order; a source without words has target 0 and its documents no copies;
repeated rows are documents of their own; a null doc_id sorts first; other
columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import own_ids, spare, stored, under_row

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0


def _null_safe(a: DataFrame, b: DataFrame, key: str) -> Column:
    return a[key].eqNullSafe(b[key])


def offset(source: Column, seed: str) -> Column:
    """A number in [0, 1) that follows from the source and the seed."""
    code = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(source, F.lit("\x01null")))), 1, 8)
    return F.conv(code, 16, 10).cast("long") / F.lit(4294967296.0)


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target): `share` of all sizes dealt by weight,
    none above `most` times its source. Pouring the excess of full sources
    over the others by weight ends at one water level: in order of
    (cap / weight), a source is full if its cap is below the level that the
    rest would reach. One row per source, so the windows are small."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    by_level = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    below = by_level.rowsBetween(Window.unboundedPreceding, -1)
    s = (sources.select("source", "source_size", w.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
         .withColumn("ratio", F.col("cap") / F.col("weight")))
    every = Window.partitionBy()
    s = (s.withColumn("all_size", F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
         .withColumn("level", (F.col("all_size") * F.lit(float(share)) - F.coalesce(F.sum("cap").over(below), F.lit(0.0)))
                     / (F.col("all_weight") - F.coalesce(F.sum("weight").over(below), F.lit(0.0))))
         .withColumn("full", F.col("ratio") <= F.col("level")))
    # past the first source that is not full the level only falls
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * level).alias("target"))


def mix_counts(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies), one row per document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    rows = stored(docs.select("doc_id", "source", size.alias("size")), "op4-sizes")
    # range partitions split a source of any size; written, so that both passes see the same ones
    dealt = stored(rows.repartitionByRange(F.col("source").asc_nulls_last(), "size", "doc_id")
                   .withColumn("part", F.spark_partition_id()), "op4-dealt")
    per_part = dealt.groupBy("part", "source").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("part", "source", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    goal = targets(per_part.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    plan = stored(base.join(goal, _null_safe(base, goal, "source")).select(
        F.col("part").alias("__part"), base["source"].alias("__source"), "base", "source_size", "target"), "op4-plan")
    inside = Window.partitionBy("part", "source").orderBy("size", "doc_id")
    ranked = dealt.withColumn("at", F.row_number().over(inside))
    both = ranked.join(plan, (F.col("part") == F.col("__part")) & F.col("source").eqNullSafe(F.col("__source")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u, at = offset(F.col("source"), seed), (F.col("base") + F.col("at")).cast("double")
    copies = F.floor(u + each * at) - F.floor(u + each * (at - 1.0))
    return (both.withColumn("copies", copies.cast("long"))
            .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies"))


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mixture: each row of `docs` once per copy, with its columns."""
    rows = own_ids(docs)
    row, copies, copy = rows.columns[-1], spare(rows, "__copies"), spare(rows, "__copy")
    n = mix_counts(under_row(rows), seed).filter("copies > 0").select(F.col("doc_id").alias(row), F.col("copies").alias(copies))
    return (rows.join(n, row)
            .withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*[F.col(f"`{c}`") for c in docs.columns]))


ORACLE = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
      CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0.0)) /
      ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0.0)) AS level FROM w
      WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN cap / weight <= level THEN cap
      ELSE weight * (SELECT max(level) FROM l WHERE cap / weight > level) END AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
      ('0x' || substr(md5('mix' || coalesce(d.source, chr(1) || 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
      CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS f,
      (row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST))::DOUBLE AS rn
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(u + f * rn) - floor(u + f * (rn - 1.0))))::BIGINT AS taken FROM r
"""
