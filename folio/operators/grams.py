"""Gram index of the vocabulary: candidates of wildcard, regex and fuzzy terms
without reading all terms.

grams(gram, field, term, df)   one row per distinct gram of a term

Grams are the two- and three-character parts of the term between its two ends
(`^term$`). What a pattern must hold literally, or what a word within n edits
must still share, is a set of grams; terms with enough of them are candidates,
verified by the pattern itself. A pattern that fixes no gram (`*a*`) has no
candidates to look up, and its leaf reads the vocabulary."""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, END, SIZES = "^", "$", (2, 3)


def grams_of(text: str, sizes=SIZES) -> set[str]:
    return {text[i:i + n] for n in sizes for i in range(len(text) - n + 1)}


def write_grams(index, path: str) -> None:
    """The grams of a written index's vocabulary, in order of the gram."""
    whole = F.concat(F.lit(START), "term", F.lit(END))

    def parts(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.char_length(whole) - (n - 1)), lambda i: F.substring(whole, i, F.lit(n)))

    rows = index.vocab.filter("term <> ''").select(F.explode(F.array_distinct(F.concat(*map(parts, SIZES)))).alias("gram"), "field", "term", "df")
    (rows.repartitionByRange("gram", "field", "term").sortWithinPartitions("gram", "field", "term")
     .write.mode("overwrite").parquet(f"{path.rstrip('/')}/grams"))


def read_grams(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/grams")


def candidates(grams: DataFrame, wanted: set[str], need: int, fields) -> DataFrame:
    """(field, term, df) of the terms that hold at least `need` of the wanted grams."""
    hit = grams.filter(F.col("gram").isin(sorted(wanted)) & F.col("field").isin(list(fields)))
    return hit.groupBy("field", "term").agg(F.count(F.lit(1)).alias("n"), F.max("df").alias("df")).filter(F.col("n") >= need).select("field", "term", "df")


def _largest(pieces: list[str]) -> set[str]:
    """Three-character grams where a piece is long enough, else its two-character one."""
    return set().union(*(grams_of(p, (3,)) if len(p) >= 3 else grams_of(p, (2,)) for p in pieces))


def of_wildcard(pattern: str) -> set[str]:
    """Grams that every match of a `*`/`?` pattern holds."""
    return _largest(re.split(r"[*?]+", START + pattern.lower() + END))


def of_regex(pattern: str) -> set[str]:
    """Grams of the literal runs that every match of a whole-term regular expression holds; none if unsure."""
    try:
        tree = parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return set()
    if tree.state.flags & re.IGNORECASE:
        return set()
    pieces = [START]

    def walk(items) -> None:
        for op, arg in items:
            if op is sre.LITERAL:
                pieces[-1] += chr(arg)
            elif op is sre.SUBPATTERN:
                if arg[1] or arg[2]:  # flags inside the group
                    pieces.append("")
                else:
                    walk(arg[3])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                walk(arg[2])
                pieces.append("")
            else:
                pieces.append("")

    walk(tree)
    pieces[-1] += END
    return _largest(pieces)


def of_edits(word: str, edits: int) -> tuple[set[str], int]:
    """(grams, how many of them any term within so many edits still holds): an edit touches as many grams of a size
    as that size. No number above 0 means that nothing is fixed."""
    best = (set(), 0)
    for n in sorted(SIZES, reverse=True):
        grams = grams_of(START + word + END, (n,))
        if len(grams) - n * edits > 0:
            return grams, len(grams) - n * edits
    return best


def lookup(index, wanted: set[str], need: int, fields, verify: Column) -> DataFrame | None:
    """The verified terms by their grams, or None where the index has none or nothing is fixed."""
    if index.grams is None or not wanted or need < 1:
        return None
    return candidates(index.grams, wanted, need, fields).filter(verify)
