"""Porter stemmer (M. F. Porter, "An algorithm for suffix stripping", 1980)
applied to the distinct vocabulary through a pandas UDF, never per token.

`stem_word` is the per-word helper; `stem_index` maps an index's text-field
terms to their stems and re-aggregates postings by stem."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_VOWELS = frozenset("aeiou")


def _cons(w: str, i: int) -> bool:
    c = w[i]
    if c in _VOWELS:
        return False
    if c == "y":
        return i == 0 or not _cons(w, i - 1)
    return True


def _m(stem: str) -> int:
    """Number of VC sequences in the stem."""
    n, i, L = 0, 0, len(stem)
    while i < L and _cons(stem, i):
        i += 1
    while i < L:
        while i < L and not _cons(stem, i):
            i += 1
        if i >= L:
            break
        n += 1
        while i < L and _cons(stem, i):
            i += 1
    return n


def _has_vowel(stem: str) -> bool:
    return any(not _cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    if len(w) < 3:
        return False
    return (_cons(w, len(w) - 3) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 1)
            and w[-1] not in "wxy")


def _replace(w: str, rules, cond) -> str:
    for suf, rep in rules:
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            return stem + rep if cond(stem) else w
    return w


# --- fixed values: suffix rules of the published algorithm --------------------
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
         ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
         ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
         ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
         ("logi", "log"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
         ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
         "ism", "ate", "iti", "ous", "ive", "ize")


@lru_cache(maxsize=1 << 16)
def stem_word(w: str) -> str:
    if len(w) <= 2:
        return w
    # step 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("ss"):
        pass
    elif w.endswith("s"):
        w = w[:-1]
    # step 1b
    extra = False
    if w.endswith("eed"):
        if _m(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, extra = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, extra = w[:-3], True
    if extra:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double_cons(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _m(w) == 1 and _cvc(w):
            w += "e"
    # step 1c
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    # steps 2 and 3
    w = _replace(w, STEP2, lambda s: _m(s) > 0)
    w = _replace(w, STEP3, lambda s: _m(s) > 0)
    # step 4
    for suf in STEP4:
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            if _m(stem) > 1 and (suf != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    # step 5
    if w.endswith("e"):
        stem = w[:-1]
        if _m(stem) > 1 or (_m(stem) == 1 and not _cvc(stem)):
            w = stem
    if _m(w) > 1 and _double_cons(w) and w.endswith("l"):
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def porter(terms: pd.Series) -> pd.Series:
    """Vectorised over Arrow batches of distinct terms."""
    return terms.map(lambda t: stem_word(t) if isinstance(t, str) else t)


def surface_forms(tokens, stems) -> dict[str, str]:
    """Form -> stem of the words in `tokens(term)` that have one of the stems. The algorithm takes off or rewrites a few
    suffixes only, so the forms of a stem are bounded by the stem, not by the texts; they come to the driver. The words
    are written first: a filter on the stem would move below `distinct`, and the stemmer see every token."""
    from folio.session import written

    if not stems:
        return {}
    vmap = written(tokens.distinct(), "words").withColumn("stem", porter(F.col("term")))
    return dict(vmap.filter(F.col("stem").isin(sorted(stems))).collect())


def stem_index(index, text_fields=("title", "content")):
    """Index with stemmed text-field terms: postings of all surface forms of
    one stem are merged (tf summed, positions united); keyword fields stay.
    The stemmer sees each distinct (field, term) once."""
    from folio.operators.index import Index

    post = index.postings
    is_text = F.col("field").isin(list(text_fields))
    vmap = (index.vocab.filter(is_text).select("term").distinct()
            .withColumn("stem", porter(F.col("term"))))
    txt = post.filter(is_text).join(vmap, "term").drop("term").withColumnRenamed("stem", "term")
    aggs = [F.sum("tf").alias("tf"), F.max("dl").alias("dl")]
    if "positions" in post.columns:
        aggs.append(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    txt = txt.groupBy("field", "term", "doc_id").agg(*aggs)
    merged = txt.unionByName(post.filter(~is_text).select(*txt.columns))
    vocab = merged.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    return Index(merged, vocab, index.stats, index.docs, True, index.fields)
