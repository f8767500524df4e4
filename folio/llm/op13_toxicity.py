"""Toxicity by a support vector machine with a gap-weighted subsequence kernel.

A text is cut into strings of letters: white space ends a string, punctuation
is dropped from it, and three or more single letters in a row are one string,
so spelt-out words are read as words. Two strings are compared by the
subsequences of three symbols that they share, also where up to two symbols
stand between them (each gap symbol weighs GAP), normalised by their lengths in
that feature space: an inserted letter costs a string little.

The machine works on Nystroem features: kernel values with LANDMARKS strings,
whitened. Sentences of clean documents are clean; of a toxic document the
sentence with the string that scores highest is the toxic one, chosen anew in
each training round (multiple-instance learning); clean strings that score
high are added as negatives. As the machine is linear in the landmarks, its
weights fold into one table of subsequence weights, by which tasks score the
distinct strings of a slice. A document scores as its highest string, through
a logistic curve fitted on the training documents.

Bounds, all of the training sample: TOXIC_DOCS and CLEAN_DOCS labelled rows of
at most TRAIN_CHARS characters, by a hash of doc_id. Whole texts are scored.

Defined cases: null and empty texts score as the empty string; without rows of
both labels all scores are 0; a null doc_id is held out; repeated rows are
documents of their own, conflicting labels of one id count as toxic, null
labels as none; other columns are ignored; an empty table gives an empty
result."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import SPACE, ragged, runs, slices, text_buffers

TOXIC_DOCS, CLEAN_DOCS, TRAIN_CHARS = 700, 1800, 10_000
LANDMARKS, ROUNDS, HARD, VARIANTS, RIDGE = 320, 3, 3000, 4, 0.005
CHANCE = 0.01
GAP, WINDOW = 0.7, 24
THRESHOLD = 0.7
SLICE_BYTES = 8 << 20
SYMBOLS = 64
#: Offsets of the second and third symbol of a subsequence, and the weight of its gaps.
SHAPES = [(i, j, GAP ** (j - 2)) for j in (2, 3, 4) for i in range(1, j)]
FIRST, LAST = 28, 29  # the string's borders are symbols too

#: Symbol of each byte: letters without case, digits, the leading and the following bytes of other characters; 255 is dropped.
SYMBOL = np.full(256, 255, np.uint8)
SYMBOL[65:91] = SYMBOL[97:123] = np.arange(26)
SYMBOL[48:58] = 26
SYMBOL[0x80:0xC0] = 32 + (np.arange(0x80, 0xC0) & 31)
SYMBOL[0xC0:] = 30


def strings(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct strings as symbols, string of each place, document of each place) of all texts."""
    data, off = text_buffers(column)
    symbol = SYMBOL[data]
    begin, end = runs(~SPACE[data], off)
    kept = symbol != 255
    before = np.concatenate(([0], np.cumsum(kept)))
    size = before[end] - before[begin]
    begin, end, size = begin[size > 0], end[size > 0], size[size > 0]
    doc = np.searchsorted(off, begin, "right") - 1
    # single symbols in a row belong together from three on
    single = size == 1
    same = np.concatenate(([False], single[1:] & single[:-1] & (doc[1:] == doc[:-1])))
    group = np.cumsum(~same) - 1
    number = np.bincount(group, minlength=1)[group] if len(group) else group
    joined = same & (number >= 3)
    lead = np.flatnonzero(~joined)
    flat = symbol[kept]
    offsets = np.append(before[begin[lead]], len(flat)).astype(np.int64)
    size = np.diff(offsets)
    doc = doc[lead]
    far = np.flatnonzero(size > WINDOW)
    if len(far):  # a long string is read in windows that overlap by half
        half = WINDOW // 2
        count = np.where(size > WINDOW, -(-(size - WINDOW) // half) + 1, 1)
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(offsets[:-1], count) + half * place
        size = np.minimum(WINDOW, np.repeat(offsets[1:], count) - start)
        flat, doc = flat[ragged(start, size)], np.repeat(doc, count)
        offsets = np.concatenate(([0], np.cumsum(size)))
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(flat))]).dictionary_encode()
    return found.dictionary, found.indices.to_numpy(), doc


def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, subsequence, weight) of all strings, sorted, equal subsequences of a string added up, and divided by
    the string's norm. A string without subsequences has no rows."""
    data, off = text_buffers(words)
    n, size = len(off) - 1, np.diff(off) + 2
    begin = np.cumsum(size) - size
    padded = np.empty(int(size.sum()), np.int64)
    padded[begin], padded[begin + size - 1] = FIRST, LAST
    padded[ragged(begin + 1, size - 2)] = data
    owner = np.repeat(np.arange(n), size)
    keys = []
    for shape, (i, j, _) in enumerate(SHAPES):
        inside = owner[:-j] == owner[j:] if len(owner) > j else np.zeros(0, bool)
        at = np.flatnonzero(inside)
        keys.append((((owner[at] * SYMBOLS + padded[at]) * SYMBOLS + padded[at + i]) * SYMBOLS + padded[at + j]) * 8 + shape)
    key = np.sort(np.concatenate(keys))
    if not len(key):
        return key, key, np.zeros(0)
    weight = np.array([w for *_, w in SHAPES] + [0, 0])[key & 7]
    key >>= 3
    lead = np.flatnonzero(np.diff(key, prepend=-1))
    key, weight = key[lead], np.add.reduceat(weight, lead)
    string = key // SYMBOLS**3
    norm = np.sqrt(np.bincount(string, weight**2, n))
    return string, key % SYMBOLS**3, weight / norm[string]


def margins(words: pa.Array, table: np.ndarray, bias: float, part: int = 20_000) -> np.ndarray:
    """The machine's value of every string."""
    out = np.full(len(words), bias)
    for a in range(0, len(words), part):
        string, sub, weight = features(words.slice(a, part))
        out[a:a + part] += np.bincount(string, weight * table[sub], min(part, len(words) - a))
    return out


# --- training --------------------------------------------------------------

def _kernel(words: pa.Array, landmarks: pa.Array, part: int = 2000) -> np.ndarray:
    string, sub, weight = features(landmarks)
    used, column = np.unique(sub, return_inverse=True)
    dense = np.zeros((len(used) + 1, len(landmarks)))
    dense[column, string] = weight
    out = np.zeros((len(words), len(landmarks)))
    for a in range(0, len(words), part):
        string, sub, weight = features(words.slice(a, part))
        at = np.searchsorted(used, sub)
        known = used[np.minimum(at, len(used) - 1)] == sub
        string, at, weight = string[known], at[known], weight[known]
        if len(string):
            lead = np.flatnonzero(np.diff(string, prepend=-1))
            out[a + string[lead]] = np.add.reduceat(dense[at] * weight[:, None], lead, axis=0)
    return out


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Squared hinge loss by Newton steps over the rows inside the margin; the last weight is the bias."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w, ridge = np.zeros(x.shape[1]), RIDGE * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    active = np.ones(len(x), bool)
    for _ in range(30):
        a, c = x[active], cost[active, None]
        w = np.linalg.solve(ridge + a.T @ (a * c), a.T @ (c[:, 0] * y[active]))
        now = y * (x @ w) < 1
        if np.array_equal(now, active):
            break
        active = now
    return w


def _binary(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.large_binary())


def _varied(words: list[bytes], rng: np.random.Generator) -> list[bytes]:
    """The words with one or two letters put in, doubled or replaced."""
    out = []
    for w in words:
        i, letter = int(rng.integers(1, max(2, len(w)))), bytes([int(rng.integers(0, 27))])
        j = int(rng.integers(1, max(2, len(w))))
        out.append([w[:i] + letter + w[i:], w[:i] + w[i - 1:i] + w[i:], w[:i] + letter + w[i + 1:],
                    w[:min(i, j)] + letter + w[min(i, j):max(i, j)] + letter + w[max(i, j):]][int(rng.integers(0, 4))])
    return out


def _odds(words: pa.Array, place: np.ndarray, doc: np.ndarray, toxic: np.ndarray, part: int = 200) -> np.ndarray:
    """Log odds of the subsequences between toxic and clean documents, the machine's first weights."""
    seen = np.zeros((2, SYMBOLS**3))
    for a in range(0, len(toxic), part):
        mine = (doc >= a) & (doc < a + part)
        used, at = np.unique(place[mine], return_inverse=True)
        string, sub, _ = features(words.take(pa.array(used)))
        begin = np.searchsorted(string, np.arange(len(used) + 1))
        length = np.diff(begin)[at]
        held = np.unique(np.repeat(doc[mine], length) * SYMBOLS**3 + sub[ragged(begin[:-1][at], length)])
        np.add.at(seen, (toxic[held // SYMBOLS**3].astype(np.int64), held % SYMBOLS**3), 1)
    rate = (seen + 0.5) / (np.array([[(~toxic).sum()], [toxic.sum()]]) + 1)
    return np.log(rate[1] / rate[0])


def train(texts: pa.Array, toxic: np.ndarray, seed: int = 7) -> dict | None:
    """The subsequence weights, the bias and the logistic curve, or None without both labels."""
    if not toxic.any() or toxic.all():
        return None
    rng = np.random.default_rng(seed)
    words, place, doc = strings(texts)
    pairs = np.unique(doc * len(words) + place) if len(words) else np.zeros(0, np.int64)
    doc, place = pairs // max(1, len(words)), pairs % max(1, len(words))
    if not len(words):
        return None
    bad = toxic[doc]
    in_toxic, in_clean = (np.bincount(place[m], minlength=len(words)) for m in (bad, ~bad))
    table, bias = _odds(words, place, doc, toxic), 0.0
    value = margins(words, table, bias)
    clean = np.flatnonzero(in_clean)
    negative = set(rng.choice(clean, min(len(clean), 2 * HARD), replace=False).tolist()) if len(clean) else set()
    lead = np.flatnonzero(np.diff(doc[bad], prepend=-1))
    listed = words.to_pylist()
    # strings of toxic documents alone that stand in more of them than chance would have it, among all strings
    share = toxic.mean()
    marked = (in_clean == 0) & (in_toxic * np.log(share) < np.log(CHANCE / len(words)))
    for _ in range(ROUNDS):
        best = np.maximum.reduceat(value[place[bad]], lead)
        top = value[place[bad]] >= np.repeat(best, np.diff(lead, append=bad.sum())) - 1e-12
        votes = Counter(place[bad][top].tolist())
        odd = np.flatnonzero(marked | (in_clean == 0) & (in_toxic > 0) & (value >= np.quantile(best, 0.25)))
        positive = sorted((set(votes) | set(odd.tolist())) - set(np.flatnonzero(in_clean > in_toxic).tolist()))
        if not positive:
            return None
        hard = clean[np.argsort(-value[clean], kind="stable")[:HARD]]
        negative |= set(hard.tolist())
        negative -= set(positive)
        told = sorted(negative)
        varied = _varied([listed[i] for i in positive] * VARIANTS, rng)
        rows = [listed[i] for i in positive] + varied + [listed[i] for i in told]
        y = np.repeat([1.0, -1.0], [len(positive) + len(varied), len(told)])
        cost = np.where(y > 0, 1 / (y > 0).sum(), 1 / max(1, len(told))) * 1000
        half = LANDMARKS // 2
        common = sorted(positive, key=lambda i: (-in_toxic[i], listed[i]))[:half]
        other = [int(i) for i in hard[:half // 2]] + [int(i) for i in rng.permutation(told)[:half // 2]]
        marks = _binary(sorted({listed[i] for i in common + other}))
        values, vectors = np.linalg.eigh(_kernel(marks, marks))
        good = values > 1e-6
        whiten = vectors[:, good] / np.sqrt(values[good])
        w = _machine(_kernel(_binary(rows), marks) @ whiten, y, cost)
        alpha, bias = whiten @ w[:-1], float(w[-1])
        mark, sub_m, weight_m = features(marks)
        table = np.bincount(sub_m, alpha[mark] * weight_m, SYMBOLS**3)
        value = margins(words, table, bias)
    top = np.full(len(toxic), bias)
    np.maximum.at(top, doc, value[place])
    # a document may hold a single toxic string, and not the clearest: the curve tells such strings, also misspelt, from clean documents
    alone = np.concatenate((value[positive], margins(_binary(varied), table, bias)))
    return {"table": table, "bias": bias, "curve": _logistic(np.concatenate((top, alone)), np.concatenate((toxic, np.ones(len(alone), bool))))}


def _logistic(value: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of Platt's curve, with his softened targets."""
    n = toxic.sum()
    want = np.where(toxic, (n + 1) / (n + 2), 1 / (len(toxic) - n + 2))
    x, w = np.stack((value, np.ones(len(value))), axis=1), np.zeros(2)
    for _ in range(50):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), x.T @ (p - want) + 1e-4 * w)
        w = w - step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


# --- the job ---------------------------------------------------------------

def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """Texts and labels of the sample: ids are chosen first, without texts; so at most TOXIC_DOCS + CLEAN_DOCS rows
    are broadcast, and as many texts collected."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("is_toxic"))
    rows = docs.filter(~held_out(F.col("doc_id")) & (F.length("text").between(1, TRAIN_CHARS)))
    ids = rows.select("doc_id").distinct().join(known, "doc_id").withColumn("deal", F.xxhash64("doc_id"))
    chosen = [ids.filter(keep).orderBy("deal", "doc_id").limit(n) for keep, n in ((F.col("is_toxic"), TOXIC_DOCS), (~F.col("is_toxic"), CLEAN_DOCS))]
    picked = chosen[0].unionByName(chosen[1])
    sample = (rows.select("doc_id", "text").join(F.broadcast(picked), "doc_id").orderBy("deal", "doc_id", "text")
              .limit(TOXIC_DOCS + CLEAN_DOCS).select("text", "is_toxic").toArrow().combine_chunks())
    if not sample.num_rows:
        return pa.array([], pa.string()), np.zeros(0, bool)
    return sample["text"].combine_chunks(), sample["is_toxic"].to_numpy().astype(bool)


def scorer(model: dict | None):
    """Function of text columns to scores."""
    def scores(texts: pa.Array) -> np.ndarray:
        if model is None:
            return np.zeros(len(texts))
        words, place, doc = strings(texts)
        top = np.full(len(texts), model["bias"])
        np.maximum.at(top, doc, margins(words, model["table"], model["bias"])[place])
        slope, offset = model["curve"]
        return _sigmoid(slope * top + offset)
    return scores


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document of `docs(doc_id, text)`, learnt from `labels(doc_id, toxic)`."""
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    score = scorer(train(*training_rows(told, labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(score(b["text"]))], ["doc_id", "score"])

    out = told.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
