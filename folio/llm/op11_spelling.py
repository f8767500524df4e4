"""Spelling variant grouping by search schemes over FM-indexes.

Two words one edit apart share one half exactly: the search matches the last
half of a word from its delimiter by backward search and extends across the
other half with one replaced, inserted or deleted character; the first half is
matched the same way in the index of the reversed words, so both directions
of the text are indexed. All steps work on intervals of suffix ranks of the
delimited vocabulary, for all words of a group at once.

Spark counts the words, deals indexed words to the groups that their possible
halves name, and every word as a query to the two groups of its own halves.
A half that very many words share is split into blocks of index words and
blocks of queries that all meet. A group answers with one row a query: the
number of near words and the best of them.

Defined cases: null and empty texts have no words; a null doc_id counts as an
empty string in the hash; repeated rows and repeated ids count as often as
they stand; words of any length are indexed whole; other columns are ignored;
an empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import ragged, stored

RUN = "[A-Za-zÀ-ÿ]"
MIN_LENGTH, MIN_COUNT, RATIO, DROP_EVERY = 7, 2, 10, 31
GROUP_WORDS = 60_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the distinct words of all texts that are long and frequent enough."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN + f"{{{MIN_LENGTH},}}"), F.lit(0))).alias("run"))
    low = found.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.translate("run", UPPER, LOWER).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"), F.length("run").alias("size"))
    at = (F.col("h") % F.col("size")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size")))
    word = F.when(F.col("h") % DROP_EVERY == 0, cut).otherwise(F.col("run"))
    return (hashed.select(word.alias("word")).filter(F.length("word") >= MIN_LENGTH)
            .groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT))


# --- the index -------------------------------------------------------------

class SuffixIndex:
    """FM-index of words, each between two delimiters. Codes of letters are 1 and up, the delimiter is 0; delimiters
    rank by their word, so the order of suffixes is total and a word's end is the row of its number."""

    def __init__(self, codes: np.ndarray, length: np.ndarray, letters: int):
        words = len(length)
        self.words, self.letters = words, letters
        text = np.zeros(len(codes) + words, np.int64)
        begin = np.cumsum(length + 1) - (length + 1)  # of each word; its delimiter follows it
        text[ragged(begin, length)] = codes
        size = len(text)
        word = np.repeat(np.arange(words), length + 1)
        rank = np.where(text > 0, words + text, word)
        step, most = 1, int(length.max()) + 1
        order = np.argsort(rank, kind="stable")
        while step < most:  # prefix doubling; a delimiter ends every comparison
            after = np.zeros(size, np.int64)
            after[:-step or size] = rank[step:]
            key = np.where(rank >= words, rank * (size + words + letters + 1) + after, rank)
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            dense = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
            rank = np.empty(size, np.int64)
            rank[order] = dense
            step *= 2
            if dense[-1] == size - 1:
                break
        before = np.where(order > 0, order - 1, size - 1)
        self.size, self.bwt = size, text[before]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=letters + 1))))
        # the rows of each letter one after another: occurrences before a row are found by one sorted search
        self.rows = np.argsort(self.bwt, kind="stable")
        self.keys = self.bwt[self.rows] * (size + 1) + self.rows
        self.word = word[order]

    def occurrences(self, letter: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each letter stands before each row of the transform."""
        return np.searchsorted(self.keys, letter * (self.size + 1) + row) - self.first[letter]

    def step(self, letter: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the suffixes that carry `letter` in front."""
        return self.first[letter] + self.occurrences(letter, lo), self.first[letter] + self.occurrences(letter, hi)

    def children(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All letters in front of all intervals: (interval, letter, lo, hi). Small intervals are read row by row, larger
        ones letter by letter."""
        span = hi - lo
        wide = np.flatnonzero(span > self.letters)
        narrow = np.flatnonzero(span <= self.letters)
        at = np.repeat(narrow, span[narrow])
        letter = self.bwt[ragged(lo[narrow], span[narrow])]
        seen = np.unique(at[letter > 0] * (self.letters + 1) + letter[letter > 0])
        at, letter = seen // (self.letters + 1), seen % (self.letters + 1)
        at = np.concatenate((at, np.repeat(wide, self.letters)))
        letter = np.concatenate((letter, np.tile(np.arange(1, self.letters + 1), len(wide))))
        a, z = self.step(letter, lo[at], hi[at])
        keep = z > a
        return at[keep], letter[keep], a[keep], z[keep]

    def whole(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which intervals hold a suffix that is a whole word, and that word."""
        zero = np.zeros(len(lo), np.int64)
        a, z = self.occurrences(zero, lo), self.occurrences(zero, hi)
        hit = np.flatnonzero(z > a)
        return hit, self.word[self.rows[a[hit]]]


def search(index: SuffixIndex, codes: np.ndarray, length: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) pairs one edit apart whose last `exact` letters agree, without repeats. Letters that the index
    does not hold have the code -1."""
    begin = np.cumsum(length) - length
    query = np.arange(len(length))
    lo, hi = np.zeros(len(length), np.int64), np.full(len(length), index.words, np.int64)
    done = 0
    while len(query):  # the exact half, letter by letter from the end
        ready = exact[query] == done
        if done == 0:
            waiting = []
        waiting.append((query[ready], lo[ready], hi[ready]))
        query, lo, hi = query[~ready], lo[~ready], hi[~ready]
        letter = codes[begin[query] + length[query] - 1 - done]
        known = letter > 0
        query, lo, hi = query[known], lo[known], hi[known]
        lo, hi = index.step(letter[known], lo, hi)
        query, lo, hi = query[hi > lo], lo[hi > lo], hi[hi > lo]
        done += 1
    if not len(length):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    query, lo, hi = (np.concatenate(x) for x in zip(*waiting, strict=True))
    rest = length[query] - exact[query]
    free = [(query[i], lo[i], hi[i]) for i in np.split(np.argsort(rest, kind="stable"), np.searchsorted(np.sort(rest), np.arange(1, int(rest.max(initial=0)) + 1)))]
    none = tuple(np.zeros(0, np.int64) for _ in range(3))
    sound, faulty = none, none  # without and with the edit so far, `left` letters to go
    found = []
    for left in range(len(free) - 1, -1, -1):
        sound = tuple(np.concatenate(x) for x in zip(sound, free[left], strict=True))
        at, letter, a, z = index.children(sound[1], sound[2])
        owner = sound[0][at]
        faulty = tuple(np.concatenate(x) for x in zip(faulty, (owner, a, z), strict=True))  # a letter inserted
        if not left:
            break
        wanted, sought = codes[begin[owner] + left - 1], codes[begin[faulty[0]] + left - 1]
        same = letter == wanted
        q, lo, hi = faulty
        known = sought > 0
        lo, hi = index.step(sought[known], lo[known], hi[known])
        q = q[known]
        faulty = tuple(np.concatenate(x) for x in zip(
            (q[hi > lo], lo[hi > lo], hi[hi > lo]),
            (owner[~same], a[~same], z[~same]),  # replaced
            sound,  # deleted
            strict=True))
        sound = owner[same], a[same], z[same]
    hit, word = index.whole(faulty[1], faulty[2])
    found = np.unique(faulty[0][hit] * index.words + word)
    return found // index.words, found % index.words


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, one after another, and the words' lengths."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64), np.fromiter(map(len, words), np.int64, len(words))


ANSWER = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def near_words(group: pa.Table) -> pa.Table:
    """The answers of one group: rows (side, asks, word, n) -> (word, near, best_n, best)."""
    pdf = group.select(["side", "asks", "word", "n"]).to_pandas()
    asks = pdf["asks"].to_numpy(bool)
    last = int(pdf["side"].iloc[0]) == 1  # the last half of the words agrees here, else the first
    indexed = pdf[~asks].drop_duplicates("word").sort_values(["n", "word"], ascending=[False, True])
    asking = pdf.loc[asks, "word"].tolist()
    if not asking or not len(indexed):
        return ANSWER.empty_table()
    known = indexed["word"].tolist()
    turn = (lambda w: w) if last else (lambda w: w[::-1])
    points, length = _codes([turn(w) for w in known])
    letters = np.unique(points)
    sought, sizes = _codes([turn(w) for w in asking])
    code = np.searchsorted(letters, sought)
    code = np.where(letters[np.minimum(code, len(letters) - 1)] == sought, code + 1, -1)
    first = sizes // 2
    index = SuffixIndex(np.searchsorted(letters, points) + 1, length, len(letters))
    query, word = search(index, code, sizes, sizes - first if last else first)
    if last and len(query):  # pairs whose first halves agree as well belong to the other side
        start, begin = np.cumsum(sizes) - sizes, np.cumsum(length) - length
        reach = np.minimum(first[query], length[word])
        equal = sought[ragged(start[query], reach)] == points[ragged(begin[word], reach)]
        differs = np.add.reduceat(~equal, np.cumsum(reach) - reach) > 0
        query, word = query[differs | (reach < first[query])], word[differs | (reach < first[query])]
    if not len(query):
        return ANSWER.empty_table()
    lead = np.flatnonzero(np.diff(query, prepend=-1))  # pairs are sorted by query, then by rank of the word
    best = word[lead]
    return pa.table([pa.array([asking[i] for i in query[lead]], pa.string()), pa.array(np.diff(lead, append=len(query))),
                     pa.array(indexed["n"].to_numpy()[best]), pa.array([known[i] for i in best], pa.string())], ANSWER)


# --- the job ---------------------------------------------------------------

def near_summary(vocab: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) for the words of `vocab(word, n)` that have near words."""
    size = F.length("word")
    asked = F.col("asked")

    def half(of):  # the first half of a word of length `of`, or the last
        return F.when(F.col("side") == 0, F.substring("word", F.lit(1), F.floor(of / 2).cast("int"))) \
            .otherwise(F.substring("word", (size - (of - F.floor(of / 2)) + 1).cast("int"), size))

    sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    known = (vocab.select("word", "n", sides).select("*", F.explode(F.sequence(F.greatest(size - 1, F.lit(MIN_LENGTH)), size + 1)).alias("asked"))
             .select("word", "n", "side", F.lit(False).alias("asks"), F.xxhash64("side", "asked", half(asked)).alias("key")))
    asking = vocab.select("word", "n", sides).select("word", "n", "side", F.lit(True).alias("asks"), F.xxhash64("side", size, half(size)).alias("key"))
    rows = known.unionByName(asking)
    groups = max(1, -(-6 * vocab.count() // group_words))
    hot = stored(known.groupBy("key").count().filter(F.col("count") > group_words)
                 .select("key", F.ceil(F.col("count") / group_words).cast("int").alias("blocks")), "spelling-hot")
    rows = rows.join(hot, "key", "left")
    block = F.pmod(F.xxhash64("word", F.lit(1)), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("q")))) \
        .when(F.col("asks"), F.transform(every, lambda b: F.struct(b.alias("i"), block.alias("q")))) \
        .otherwise(F.transform(every, lambda b: F.struct(block.alias("i"), b.alias("q"))))
    home = F.when(F.col("blocks").isNull(), F.pmod("key", F.lit(groups))).otherwise(F.col("key"))
    dealt = (rows.select("word", "n", "side", "asks", home.alias("home"), F.col("blocks").isNotNull().alias("apart"), F.explode(pairs).alias("at"))
             .select("home", "apart", "side", F.col("at.i").alias("i"), F.col("at.q").alias("q"), "asks", "word", "n"))
    found = dealt.groupBy("home", "apart", "side", "i", "q").applyInArrow(near_words, "word string, near long, best_n long, best string")
    least = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), least.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def roots(words: DataFrame) -> DataFrame:
    """(word, root) for all words with a form: their forms are followed to the last by pointer jumping. Counts grow at
    least RATIO times a link, so a chain is short and has no ring."""
    links = stored(words.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-links")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        links = step.select("word", "root")
        if not step.filter("moved").limit(1).count():
            return links


def spelling_variants(docs: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of `docs(doc_id, text)`."""
    vocab = stored(word_counts(docs.select("doc_id", "text")), "spelling-words")
    near = near_summary(vocab, group_words)
    formed = F.col("best_n") >= RATIO * F.col("n")
    words = stored(vocab.join(near, "word", "left").select(
        "word", F.when(formed, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(formed, F.col("best_n")).alias("form_n")), "spelling-near")
    return words.join(roots(words), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
