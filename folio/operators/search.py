"""Search over an Index: predicates (P7-P13), BM25F (T3), TF-IDF (T4),
frequency (T5), search page (T6), facets (T12), highlight (T10),
more-like-this (T11), explanation (T9), hints (T16).

A query is a tree of leaves (term, phrase, wildcard, regex, fuzzy, range,
match-all) combined by all_of / any_of / none_of. Evaluation is one plan:

1. every leaf resolves its (field, term, df) rows against the small `vocab`
   first; term and phrase leaves are bounded by the query text and are
   broadcast, vocabulary patterns are left to AQE's runtime size check;
2. resolved terms join `postings` (no shuffle of postings);
3. all leaf rows are hash-partitioned once by doc_id; per-(doc, field, term)
   de-duplication and the per-document boolean + score aggregation then run
   without another exchange.
"""

from __future__ import annotations

from dataclasses import dataclass, field as dfield
from functools import reduce

import regex as _re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio import constants as C
from folio.functions.text import snippet as snippet_col
from folio.operators.index import TEXT_FIELDS, Index, narrowed

#: Seeds, and terms that they hold, up to which similar documents are looked up in the texts.
FEW_SEEDS, SEED_TERMS = 1000, 20_000
DEFAULT_FIELDS = ("title", "content", "tags")
_TOKEN_RX = _re.compile(C.TOKEN_PATTERN)


def analyze_text(s: str, stem: bool = False) -> list[str]:
    """Driver-side twin of `analyze` for query literals (a few words)."""
    toks = _TOKEN_RX.findall(s.lower())
    toks = [t for t in toks if len(t) >= C.MIN_TOKEN_LEN and t not in C.STOP_WORDS]
    if stem:
        from folio.functions.stem import stem_word
        toks = [stem_word(t) for t in toks]
    return toks


# ----------------------------------------------------------------------------- query tree
class Query:
    def leaves(self) -> list["Leaf"]:
        raise NotImplementedError

    def expr(self, flags: dict[int, Column]) -> Column:
        raise NotImplementedError

    def truth(self, flags: dict[int, bool]) -> bool:
        raise NotImplementedError


@dataclass(eq=False)
class Leaf(Query):
    fields: tuple = DEFAULT_FIELDS
    uid: int = dfield(default=-1)
    stem: bool = dfield(default=False)  # set from the index being searched
    text_fields: tuple = TEXT_FIELDS    # as well

    bounded = False  # True: resolved terms are fixed by the query text

    def leaves(self):
        return [self]

    def expr(self, flags):
        return flags[self.uid]

    def truth(self, flags):
        return flags[self.uid]

    def terms(self) -> list[tuple[str, str]]:
        """(field, term) pairs of a bounded leaf."""
        return []

    def resolve(self, index: Index) -> DataFrame:
        """(field, term, df) vocabulary rows of a pattern leaf."""
        raise NotImplementedError

    def rows(self, index: Index, shared: DataFrame | None = None) -> DataFrame:
        """(doc_id, field, term, tf, dl, df) posting rows satisfying the leaf.

        Bounded leaves filter `shared` (postings of every bounded query term,
        scanned once per query); pattern leaves resolve against `vocab` and
        join postings, left to AQE's runtime size check."""
        if self.bounded:
            pairs = self.terms()
            if not pairs:
                return _empty_rows(index)
            return shared.filter(_pairs_cond(pairs)).select(*ROW_COLS)
        v = self.resolve(index)
        return index.postings.join(v, ["field", "term"]).select(*ROW_COLS)


ROW_COLS = ("doc_id", "field", "term", "tf", "dl", "df")


def _is_pattern(leaf: Leaf) -> bool:
    """Does the leaf look its terms up in the vocabulary?"""
    return type(leaf).resolve is not Leaf.resolve


def _empty_rows(index):
    return index.postings.filter(F.lit(False)).withColumn("df", F.lit(0).cast("long")).select(*ROW_COLS)


def _pairs_cond(pairs) -> Column:
    by_field: dict[str, list[str]] = {}
    for f, t in pairs:
        by_field.setdefault(f, []).append(t)
    return reduce(lambda a, b: a | b, [(F.col("field") == f) & F.col("term").isin(sorted(set(ts)))
                                       for f, ts in sorted(by_field.items())])


def shared_postings(index: Index, pairs) -> DataFrame:
    """Postings of the given (field, term) pairs with their document frequency.
    The df table has at most len(pairs) rows, so it is broadcast. A written
    index answers df from its vocabulary (a pushed-down lookup); a lazy one
    counts the filtered postings."""
    cond = _pairs_cond(pairs)
    base = index.postings.filter(cond)
    if index.prebuilt:
        dfs = index.vocab.filter(cond).select("field", "term", "df")
    else:
        dfs = base.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    return base.join(F.broadcast(dfs), ["field", "term"])


def with_stats(rows: DataFrame, index: Index) -> DataFrame:
    """Attach n_docs and avgdl per field: literals for an opened index, a
    broadcast join (one row per field) for a lazy one."""
    if index.stats_values:
        n = F.lit(None).cast("long")
        a = F.lit(None).cast("double")
        for f, (nd, av) in index.stats_values.items():
            n = F.when(F.col("field") == f, F.lit(nd)).otherwise(n)
            a = F.when(F.col("field") == f, F.lit(float(av) if av is not None else None)).otherwise(a)
        return rows.withColumn("n_docs", n).withColumn("avgdl", a)
    return rows.join(F.broadcast(index.stats.select("field", "n_docs", "avgdl")), "field", "left")


def _fields_filter(fields) -> Column:
    return F.col("field").isin(list(fields))


@dataclass(eq=False)
class Term(Leaf):
    text: str = ""
    bounded = True

    def terms(self) -> list[tuple[str, str]]:
        out = []
        for f in self.fields:
            if f in self.text_fields:
                out += [(f, t) for t in analyze_text(self.text, self.stem)]
            else:
                v = self.text.strip().lower()
                if v:
                    out.append((f, v))
        return out

    def rows(self, index, shared=None):
        toks = analyze_text(self.text, self.stem)
        text_fields = tuple(f for f in self.fields if f in self.text_fields)
        if len(toks) > 1 and text_fields:  # several tokens in one term: all must occur in one text field
            out = Phrase(text_fields, text=self.text, uid=self.uid, stem=self.stem, text_fields=self.text_fields, slop=None).rows(index, shared)
            keys = tuple(f for f in self.fields if f not in self.text_fields)
            if keys:  # a keyword value may hold several tokens
                out = out.unionByName(Term(keys, text=self.text, uid=self.uid, stem=self.stem, text_fields=self.text_fields).rows(index, shared))
            return out
        return super().rows(index, shared)


@dataclass(eq=False)
class Phrase(Leaf):
    """Tokens at consecutive positions (slop=None: anywhere in the field)."""
    text: str = ""
    slop: int | None = 0
    bounded = True

    def terms(self):
        toks = analyze_text(self.text, self.stem)
        return [(f, t) for f in self.fields if f in self.text_fields for t in toks]

    def rows(self, index, shared=None):
        toks = analyze_text(self.text, self.stem)
        if not toks:
            return _empty_rows(index)
        if not self.terms():  # no text field among the phrase's fields
            return _empty_rows(index)
        base = shared.filter(_pairs_cond(self.terms()))
        # documents holding every phrase token in the field
        cand = (base.groupBy("doc_id", "field").agg(F.count_distinct("term").alias("n"))
                .filter(F.col("n") == len(set(toks))).select("doc_id", "field"))
        if self.slop is None:
            ok = cand
        elif "positions" in index.postings.columns:
            k = len(toks)
            p = index.postings.filter(_pairs_cond(self.terms())).join(cand, ["doc_id", "field"], "left_semi")
            # a token repeated in the phrase occupies several offsets
            offs = F.filter(F.array(*[F.when(F.col("term") == F.lit(t), F.lit(i))
                                      for i, t in enumerate(toks)]), lambda x: x.isNotNull())
            pos = (p.select("doc_id", "field", "term", F.explode("positions").alias("pos"), offs.alias("offs"))
                   .select("doc_id", "field", "pos", F.explode("offs").alias("i")))
            ok = (pos.groupBy("doc_id", "field", (F.col("pos") - F.col("i")).alias("start"))
                  .agg(F.count_distinct("i").alias("n"))
                  .filter(F.col("n") == k).select("doc_id", "field").distinct())
        else:
            ok = _verify_on_text(index, cand, toks, self.stem, self.fields)
        return base.join(ok, ["doc_id", "field"], "left_semi").select(*ROW_COLS)


def _verify_on_text(index: Index, cand: DataFrame, toks: list[str], stem: bool, asked) -> DataFrame:
    """Adjacency check for index without positions: re-analyse the field
    text of the candidate documents only and look for the token sequence. Fields
    that the phrase doesn't ask for are not read."""
    from folio.functions.text import analyze

    fields = [f for f in index.text_fields if f in index.docs.columns and f in asked]
    txt = F.lit(None).cast("string")
    for f in fields:
        txt = F.when(F.col("field") == f, F.col(f)).otherwise(txt)
    j = cand.join(index.docs.select("doc_id", *fields), "doc_id")
    seq = analyze(txt)
    if stem:
        from folio.functions.stem import porter
        ex = j.select("doc_id", "field", F.posexplode(analyze(txt)).alias("p", "t"))
        ex = ex.withColumn("t", porter(F.col("t")))
        seqs = ex.groupBy("doc_id", "field").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("p", "t"))), lambda x: x["t"]).alias("toks"))
        j, seq = seqs, F.col("toks")
    joined = F.concat(F.lit(" "), F.array_join(seq, " "), F.lit(" "))
    return j.filter(joined.contains(" " + " ".join(toks) + " ")).select("doc_id", "field")


def _glob_regex(pattern: str) -> str:
    out = []
    for ch in pattern.lower():
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        else:
            out.append(_re.escape(ch))
    return "^" + "".join(out) + "$"


@dataclass(eq=False)
class Wildcard(Leaf):
    """P10: `*` any run, `?` one char; leading wildcards allowed."""
    pattern: str = ""
    bounded = False

    def resolve(self, index):
        from folio.operators import grams as G
        fits = F.col("term").rlike(_glob_regex(self.pattern))
        wanted = G.of_wildcard(self.pattern)
        found = G.lookup(index, wanted, len(wanted), self.fields, fits)
        return found if found is not None else index.vocab.filter(_fields_filter(self.fields) & fits).select("field", "term", "df")


@dataclass(eq=False)
class Regex(Leaf):
    """Whole-term regular expression."""
    pattern: str = ""
    bounded = False

    def resolve(self, index):
        from folio.operators import grams as G
        fits = F.col("term").rlike("^(?:" + self.pattern + ")$")
        wanted = G.of_regex(self.pattern)
        found = G.lookup(index, wanted, len(wanted), self.fields, fits)
        return found if found is not None else index.vocab.filter(_fields_filter(self.fields) & fits).select("field", "term", "df")


@dataclass(eq=False)
class Fuzzy(Leaf):
    """Terms within edit distance `n` (default 1)."""
    text: str = ""
    n: int = 1
    bounded = False

    def resolve(self, index):
        q = self.text.lower()
        from folio.operators import grams as G
        fits = (F.char_length("term").between(len(q) - self.n, len(q) + self.n)
                & (F.levenshtein(F.col("term"), F.lit(q), self.n) >= 0))
        found = G.lookup(index, *G.of_edits(q, self.n), self.fields, fits)
        return found if found is not None else index.vocab.filter(_fields_filter(self.fields) & fits).select("field", "term", "df")


@dataclass(eq=False)
class Range(Leaf):
    """P4 inside a query: document attribute between lo and hi (inclusive,
    either end open). Contributes no score."""
    column: str = "modified_at"
    lo: object = None
    hi: object = None

    def rows(self, index, shared=None):
        d = index.docs.filter(range_predicate(self.column, self.lo, self.hi))
        return d.select("doc_id", F.lit(None).cast("string").alias("field"),
                        F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf"),
                        F.lit(0).cast("int").alias("dl"), F.lit(0).cast("long").alias("df"))


@dataclass(eq=False)
class MatchAll(Leaf):
    """Every document."""

    def rows(self, index, shared=None):
        return Range(uid=self.uid, column="doc_id").rows(index)


class _Bool(Query):
    def __init__(self, *qs: Query):
        self.qs = [q if isinstance(q, Query) else Term(text=q) for q in qs]

    def leaves(self):
        return [l for q in self.qs for l in q.leaves()]


class all_of(_Bool):
    def __init__(self, *qs: Query):
        """Terms that analyse to nothing (stop words) don't narrow the others."""
        super().__init__(*qs)
        empty = lambda q: (isinstance(q, Term) and any(f in q.text_fields for f in q.fields)
                           and not analyze_text(q.text, q.stem))
        said = [q for q in self.qs if not empty(q)]
        self.qs = said or self.qs

    def expr(self, flags):
        return reduce(lambda a, b: a & b, [q.expr(flags) for q in self.qs])

    def truth(self, flags):
        return all(q.truth(flags) for q in self.qs)


class any_of(_Bool):
    def expr(self, flags):
        return reduce(lambda a, b: a | b, [q.expr(flags) for q in self.qs])

    def truth(self, flags):
        return any(q.truth(flags) for q in self.qs)


class none_of(_Bool):
    def expr(self, flags):
        return ~reduce(lambda a, b: a | b, [q.expr(flags) for q in self.qs])

    def truth(self, flags):
        return not any(q.truth(flags) for q in self.qs)


def term(text, fields=DEFAULT_FIELDS):
    return Term(tuple(fields), text=text)


def phrase(text, fields=("title", "content")):
    return Phrase(tuple(fields), text=text)


def wildcard(pattern, fields=DEFAULT_FIELDS):
    return Wildcard(tuple(fields), pattern=pattern)


def regex(pattern, fields=DEFAULT_FIELDS):
    return Regex(tuple(fields), pattern=pattern)


def fuzzy(text, n=1, fields=DEFAULT_FIELDS):
    return Fuzzy(tuple(fields), text=text, n=n)


def between(column, lo=None, hi=None):
    return Range(column=column, lo=lo, hi=hi)


def match_all():
    return MatchAll()


def fallback(text: str, fields=("title", "content")):
    """Whitespace split, OR of the words over title/content."""
    words = [w for w in text.split() if w]
    if not words:
        return match_all()
    return any_of(*[term(w, fields) for w in words])


def _positive_leaves(q: Query, negated=False, out=None):
    out = [] if out is None else out
    if isinstance(q, Leaf):
        if not negated:
            out.append(q)
    elif isinstance(q, none_of):
        for s in q.qs:
            _positive_leaves(s, not negated, out)
    else:
        for s in q.qs:
            _positive_leaves(s, negated, out)
    return out


# ----------------------------------------------------------------------------- filters
def range_predicate(column: str, lo=None, hi=None) -> Column:
    """Inclusive range, either end open; ISO strings accepted for times."""
    c = F.col(column)
    conds = []
    if lo is not None:
        conds.append(c >= F.lit(lo).cast(_cast_for(column)) if isinstance(lo, str) else c >= F.lit(lo))
    if hi is not None:
        conds.append(c <= F.lit(hi).cast(_cast_for(column)) if isinstance(hi, str) else c <= F.lit(hi))
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def _cast_for(column: str) -> str:
    return "timestamp_ntz" if column.endswith("_at") else "string"


def filter_predicate(filters: dict | None, columns) -> Column:
    """scalar = equality (array columns: membership), list = OR,
    dict(from/to) = range; fields AND-ed; unknown fields ignored."""
    conds = []
    for k, v in (filters or {}).items():
        if k not in columns:
            continue
        is_array = k == "tags"
        if isinstance(v, dict):
            conds.append(range_predicate(k, v.get("from"), v.get("to")))
        elif isinstance(v, (list, tuple, set)):
            vals = list(v)
            conds.append(F.arrays_overlap(F.col(k), F.array(*[F.lit(x) for x in vals]))
                         if is_array else F.col(k).isin(vals))
        else:
            conds.append(F.array_contains(F.col(k), v) if is_array else F.col(k) == F.lit(v))
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


# ----------------------------------------------------------------------------- scoring
def _weights() -> tuple[Column, Column]:
    boost = F.lit(1.0)
    b = F.lit(C.BM25_B)
    for f, (bo, bb) in C.FIELD_WEIGHTS.items():
        boost = F.when(F.col("field") == f, F.lit(bo)).otherwise(boost)
        b = F.when(F.col("field") == f, F.lit(bb)).otherwise(b)
    return boost, b


def contribution(method: str = "bm25") -> Column:
    """Per (doc, field, term) score part; needs tf, dl, df, n_docs, avgdl, field."""
    tf, dl, df, n, avgdl = (F.col(c).cast("double") for c in ("tf", "dl", "df", "n_docs", "avgdl"))
    boost, b = _weights()
    if method == "bm25":
        idf = F.log(1.0 + (n - df + 0.5) / (df + 0.5))
        norm = tf * (C.BM25_K1 + 1.0) / (tf + C.BM25_K1 * (1.0 - b + b * dl / avgdl))
        return boost * idf * norm
    if method == "tfidf":
        return tf * (F.log(n / (df + 1.0)) + 1.0)
    if method == "frequency":
        return tf
    raise ValueError(method)


#: Leaf flags lie in mask columns m0, m1, ... of so many bits.
MASK_BITS = 62


def _by_masks(rows: DataFrame, leaves, positive, words, masks, part: Column, q: Query, flags) -> DataFrame:
    """(doc_id, score) of a query whose leaves are single terms, from its posting rows."""
    bits = [F.lit(0).cast("long") for _ in words]
    scored = F.lit(False)
    for l in leaves:
        cond = _pairs_cond(l.terms()) if l.terms() else F.lit(False)
        w = l.uid // MASK_BITS
        bits[w] = bits[w].bitwiseOR(F.when(cond, F.lit(1 << l.uid % MASK_BITS)).otherwise(F.lit(0)).cast("long"))
        if l.uid in positive:
            scored = scored | cond
    tagged = (rows.withColumns({f"m{w}": bits[w] for w in words})
              .withColumn("part", F.when(scored, part).otherwise(F.lit(0.0))))
    per_doc = tagged.groupBy("doc_id").agg(F.sum("part").alias("score"), *masks)
    return per_doc.filter(q.expr(flags)).select("doc_id", F.round("score", C.SCORE_DECIMALS).alias("score"))


def evaluate(index: Index, q: Query, method: str = "bm25") -> DataFrame:
    """Matched documents with their score: (doc_id, score). No ordering."""
    leaves = q.leaves()
    for i, leaf in enumerate(leaves):
        leaf.uid = i
        leaf.stem = index.stemmed
        leaf.text_fields = index.text_fields
    positive = {l.uid for l in _positive_leaves(q)}
    pairs = [p for l in leaves if l.bounded for p in l.terms()]
    if not any(_is_pattern(l) for l in leaves):
        index = narrowed(index, pairs)
    shared = shared_postings(index, pairs) if pairs else None
    universe = q.truth({l.uid: False for l in leaves})
    words = range(-(-len(leaves) // MASK_BITS))
    flags = {l.uid: (F.col(f"m{l.uid // MASK_BITS}").bitwiseAND(F.lit(1 << l.uid % MASK_BITS)) != 0) for l in leaves}
    masks = [F.bit_or(f"m{w}").alias(f"m{w}") for w in words]
    simple = all(type(l) is Term and len(analyze_text(l.text, l.stem)) <= 1 for l in leaves) and not universe
    if simple and shared is not None and index.blocks is not None and method == "bm25":
        # the parts lie in the score blocks: no vocabulary and no statistics to join
        hit = index.blocks.filter(_pairs_cond(pairs)).select("field", "term", F.explode(F.arrays_zip("docs", "parts")).alias("e"))
        rows = hit.select("field", "term", F.col("e.docs").alias("doc_id"), F.col("e.parts").alias("value"))
        return _by_masks(rows, leaves, positive, words, masks, F.col("value"), q, flags)
    if simple and shared is not None:
        # every leaf is one term: each posting row is read once, tagged with
        # the bit mask of the leaves it satisfies; one partially aggregated
        # group-by on doc_id gives both the boolean flags and the score
        return _by_masks(with_stats(shared, index), leaves, positive, words, masks, contribution(method), q, flags)
    parts = [leaf.rows(index, shared).withColumn("li", F.lit(leaf.uid)) for leaf in leaves]
    if universe:
        parts.append(index.docs.select(
            "doc_id", F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("term"),
            F.lit(0).cast("long").alias("tf"), F.lit(0).cast("int").alias("dl"),
            F.lit(0).cast("long").alias("df"), F.lit(-1).alias("li")))
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    rows = (with_stats(rows, index)
            .withColumn("part", F.when(F.col("li").isin(list(positive)) & F.col("term").isNotNull(),
                                       contribution(method)).otherwise(F.lit(0.0)))
            .repartition("doc_id"))
    # one exchange: both aggregations below are clustered by doc_id already;
    # the first counts a (doc, field, term) once even when several leaves hit it
    per_term = rows.groupBy("doc_id", "field", "term").agg(
        F.max("part").alias("part"),
        *[F.bit_or(F.expr(f"CASE WHEN li >= 0 AND li DIV {MASK_BITS} = {w} THEN shiftleft(CAST(1 AS BIGINT), li % {MASK_BITS}) "
                          "ELSE CAST(0 AS BIGINT) END")).alias(f"m{w}") for w in words])
    per_doc = per_term.groupBy("doc_id").agg(F.sum("part").alias("score"), *masks)
    return per_doc.filter(q.expr(flags)).select(
        "doc_id", F.round("score", C.SCORE_DECIMALS).alias("score"))


SORT_KEYS = {"relevance": "score", "score": "score", "date": "modified_at",
             "created": "created_at", "modified": "modified_at", "size": "size", "title": "title"}


def _order(sort: str | None) -> list[Column]:
    if not sort or sort in ("relevance", "score", "-relevance", "-score"):
        return [F.col("score").desc(), F.col("doc_id").asc()]
    desc = sort.startswith("-")
    key = SORT_KEYS.get(sort.lstrip("-"), None)
    if key is None:
        return [F.col("score").desc(), F.col("doc_id").asc()]
    c = F.col(key)
    return [c.desc() if desc else c.asc(), F.col("doc_id").asc()]


def search(index: Index, q: Query, filters: dict | None = None, sort: str | None = None,
           offset: int = 0, limit: int | None = 20, method: str = "bm25",
           with_snippet: bool = True, fetch: str = "join") -> DataFrame:
    """Predicate + filters + score + sort + exact offset page.

    limit=None returns every hit (batch jobs, D22). fetch="join" keeps the
    whole search one lazy plan (the page joins the documents); fetch="ids"
    is the interactive two-phase form: the ranked page (at most `limit`
    ids) is computed first and only those documents are read, with a
    `doc_id IN (...)` filter pushed into the document scan."""
    scored = evaluate(index, q, method)
    docs = index.docs
    if filters:
        keep = docs.filter(filter_predicate(filters, docs.columns)).select("doc_id")
        scored = scored.join(keep, "doc_id", "left_semi")
    cols = ["doc_id", "id", "title", "path", "format", "category"]
    order = _order(sort)
    needs_docs = any(k in (sort or "") for k in ("date", "created", "modified", "size", "title"))
    if needs_docs:
        extra = [c for c in ("modified_at", "created_at", "size") if c in docs.columns]
        ranked = scored.join(docs.select(*cols, *extra), "doc_id").orderBy(*order)
        page = ranked.offset(offset) if offset else ranked
        page = page.limit(limit) if limit is not None else page
        out = page.join(docs.select("doc_id", "content"), "doc_id") if with_snippet else page
    else:
        ranked = scored.orderBy(*order)
        page = ranked.offset(offset) if offset else ranked
        dcols = cols + (["content"] if with_snippet else [])
        if limit is not None and fetch == "ids":
            # phase 1: the ranked page, at most `limit` (doc_id, score) pairs
            hits = [(r["doc_id"], r["score"]) for r in page.limit(limit).select("doc_id", "score").collect()]
            ids = [h[0] for h in hits]
            # phase 2: only those documents, `doc_id IN (...)` pushed into the scan
            sel = [F.col(c) for c in cols]
            if with_snippet:
                sel.append(snippet_col("content").alias("snippet"))
            got = {r["doc_id"]: r for r in docs.filter(F.col("doc_id").isin(ids)).select(*sel).collect()} if ids else {}
            names = [c for c in cols] + ["score"] + (["snippet"] if with_snippet else [])
            rows = [tuple(got[i][c] for c in cols) + (sc,) + ((got[i]["snippet"],) if with_snippet else ())
                    for i, sc in hits if i in got]
            schema = docs.select(*cols).schema.add("score", "double")
            if with_snippet:
                schema = schema.add("snippet", "string")
            return scored.sparkSession.createDataFrame(rows, schema).select(*names)
        else:
            if limit is not None:
                page = page.limit(limit)
            out = page.join(docs.select(*dcols), "doc_id")
    if with_snippet:
        out = out.withColumn("snippet", snippet_col("content")).drop("content")
    out = out.orderBy(*order)
    return out if limit is None else out.limit(limit)


# ----------------------------------------------------------------------------- facets etc.
def facets(index: Index, q: Query | None, filters: dict | None = None,
           fields=C.DEFAULT_FACET_FIELDS) -> DataFrame:
    """(field, value, count) over the *full* match set."""
    docs = index.docs
    if filters:
        docs = docs.filter(filter_predicate(filters, docs.columns))
    if q is not None and not isinstance(q, MatchAll):
        docs = docs.join(evaluate(index, q).select("doc_id"), "doc_id", "left_semi")
    vals = []
    for f in fields:
        if f == "year":
            v = F.array(F.year("created_at").cast("string"))
        elif f == "month":
            v = F.array(F.month("created_at").cast("string"))
        elif f == "tags":
            v = F.array_distinct(F.col("tags"))
        else:
            v = F.array(F.col(f).cast("string"))
        vals.append(F.struct(F.lit(f).alias("field"), v.alias("vals")))
    ex = docs.select(F.explode(F.array(*vals)).alias("x")).select(
        F.col("x.field").alias("field"), F.explode("x.vals").alias("value"))
    return ex.filter(F.col("value").isNotNull()).groupBy("field", "value").agg(
        F.count(F.lit(1)).alias("count"))


def highlight(text_col, terms: list[str]) -> Column:
    """Wrap case-insensitive occurrences of the terms in <mark>...</mark>."""
    if not terms:
        return text_col
    alt = "|".join(_re.escape(t) for t in sorted(set(terms), key=lambda s: (-len(s), s)))
    return F.regexp_replace(text_col, F.lit("(?i)(" + alt + ")"),
                            F.lit(C.HIGHLIGHT_OPEN + "$1" + C.HIGHLIGHT_CLOSE))


def highlight_page(page: DataFrame, q_text: str, column: str = "snippet") -> DataFrame:
    # highlights mark the query words as typed (surface forms), stemmed or not
    """T10 on a result page only: `highlights` column next to the snippet."""
    return page.withColumn("highlights", highlight(F.col(column), analyze_text(q_text)))


def fragments(page: DataFrame, q_text: str, column: str = "content", width: int = C.FRAGMENT_TOKENS,
              context: int = C.FRAGMENT_CONTEXT, k: int = C.FRAGMENTS) -> DataFrame:
    """T10 over whole texts, on a result page: `fragments`, up to `k` stretches
    of `width` tokens in text order, with the query's words marked.

    A window starts `context` tokens before a hit. Windows with the most
    distinct query words are taken first, then those with the most hits, then the
    earliest; a window that overlaps a taken one is left out."""
    words = sorted(set(analyze_text(q_text)))
    if not words:
        return page.withColumn("fragments", F.array().cast("array<string>"))
    rx = F.lit(C.TOKEN_PATTERN)
    toks = page.select("doc_id", F.posexplode(F.regexp_extract_all(column, rx, 0)).alias("pos", "tok"))
    hits = toks.select("doc_id", "pos", F.lower("tok").alias("word")).filter(F.col("word").isin(words))
    ahead = Window.partitionBy("doc_id").orderBy("pos").rangeBetween(0, width - context - 1)
    seen = hits.select("doc_id", F.greatest(F.col("pos") - context, F.lit(0)).alias("at"), "pos",
                       F.size(F.collect_set("word").over(ahead)).alias("words"), F.count(F.lit(1)).over(ahead).alias("hits"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("words")).alias("w"), (-F.col("hits")).alias("h"), "pos", "at")))
    free = lambda taken, x: ~F.exists(taken, lambda t: F.abs(t - x["at"]) < width)
    picks = F.aggregate("ranked", F.array().cast("array<int>"), lambda taken, x: F.when(
        (F.size(taken) < k) & free(taken, x), F.array_append(taken, x["at"])).otherwise(taken))
    chosen = seen.groupBy("doc_id").agg(ranked.alias("ranked")).select("doc_id", F.array_sort(picks).alias("starts"))
    marked = lambda t: F.when(F.lower(t).isin(words), F.concat(F.lit(C.HIGHLIGHT_OPEN), t, F.lit(C.HIGHLIGHT_CLOSE))).otherwise(t)
    j = (page.join(chosen, "doc_id", "left")
         .withColumn("_t", F.regexp_extract_all(column, rx, 0)).withColumn("_s", F.split(column, C.TOKEN_PATTERN, -1)))
    stretch = lambda a: F.sequence(a, F.least(a + width, F.size("_t")) - 1)
    text = lambda a: F.concat_ws("", F.transform(stretch(a), lambda i: F.concat(
        F.when(i > a, F.get("_s", i)).otherwise(F.lit("")), marked(F.get("_t", i)))))
    return j.withColumn("fragments", F.coalesce(F.transform("starts", text), F.array().cast("array<string>"))).drop("starts", "_t", "_s")


def explain_scores(index: Index, q: Query, hits: DataFrame) -> DataFrame:
    """Per hit, matched terms, per-field match flags and base score."""
    leaves = q.leaves()
    for i, leaf in enumerate(leaves):
        leaf.uid = i
        leaf.stem = index.stemmed
        leaf.text_fields = index.text_fields
    pos = _positive_leaves(q)
    pairs = [p for l in leaves if l.bounded for p in l.terms()]
    if not any(_is_pattern(l) for l in leaves):
        index = narrowed(index, pairs)
    shared = shared_postings(index, pairs) if pairs else None
    rows = reduce(lambda a, b: a.unionByName(b), [l.rows(index, shared) for l in pos])
    rows = rows.join(hits.select("doc_id"), "doc_id", "left_semi")
    agg = rows.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("term")).alias("matched_terms"),
        *[F.max(F.col("field") == f).alias(f"{f}_match") for f in ("title", "content", "tags")])
    return hits.select("doc_id", F.col("score").alias("base_score")).join(agg, "doc_id", "left") \
        .select("doc_id", "base_score", "matched_terms",
                *[F.coalesce(F.col(f"{f}_match"), F.lit(False)).alias(f"{f}_match")
                  for f in ("title", "content", "tags")])


def top_terms(index: Index, k: int = 10, field: str = "content") -> DataFrame:
    """Top-k terms per document by tf-idf weight: (doc_id, term, weight)."""
    p = index.postings.filter(F.col("field") == field).select("field", "doc_id", "term", "tf")
    v = index.vocab.filter(F.col("field") == field).select("field", "term", "df")
    st = index.stats.filter(F.col("field") == field).select("field", "n_docs")  # one row
    w = (p.join(v, ["field", "term"]).join(F.broadcast(st), "field")
         .withColumn("weight", F.col("tf") * F.log(F.col("n_docs") / F.col("df"))))
    from folio.operators.stats import top_k_per_group  # salted: one huge document is split too
    top = top_k_per_group(w.select("doc_id", "term", "weight"), ["doc_id"],
                          [F.col("weight").desc(), F.col("term")], k)
    return top.select("doc_id", "term", F.round("weight", C.SCORE_DECIMALS).alias("weight"))


def more_like_this(index: Index, seeds: DataFrame, k_terms: int = 10,
                   field: str = "content", limit: int | None = 10) -> DataFrame:
    """For each seed document, its top-k terms score all other documents
    with BM25 on that field; the seed itself is excluded.

    Output (seed_id, doc_id, score). Work is a sparse product: seed terms join
    postings on (field, term); the seeds frame carries the bound on seeds. For few seeds, an index
    that was built from documents isn't counted: the texts are read for the terms of the seeds only."""
    scores = _few_seeds(index, seeds, k_terms, field)
    if scores is not None:
        return _best_of(scores, limit)
    seed_terms = top_terms(index.__class__(index.postings.join(seeds.select("doc_id"), "doc_id", "left_semi"),
                                           index.vocab, index.stats, index.docs), k_terms, field) \
        .select(F.col("doc_id").alias("seed_id"), "term")
    p = index.postings.filter(F.col("field") == field)
    v = index.vocab.filter(F.col("field") == field).select("term", "df")
    st = F.broadcast(index.stats.filter(F.col("field") == field).select("field", "n_docs", "avgdl"))
    rows = (seed_terms.join(v, "term").join(p, "term").join(st, "field")
            .filter(F.col("doc_id") != F.col("seed_id"))
            .withColumn("part", contribution("bm25")))
    scores = rows.groupBy("seed_id", "doc_id").agg(
        F.round(F.sum("part"), C.SCORE_DECIMALS).alias("score"))
    return _best_of(scores, limit)


def _best_of(scores: DataFrame, limit: int | None) -> DataFrame:
    if limit is None:
        return scores
    from folio.operators.stats import top_k_per_group  # salted: a seed with huge candidate sets is split
    return top_k_per_group(scores, ["seed_id"], [F.col("score").desc(), F.col("doc_id")], limit)


def _few_seeds(index: Index, seeds: DataFrame, k_terms: int, field: str) -> DataFrame | None:
    """`more_like_this` without its limit for up to FEW_SEEDS seeds with up to SEED_TERMS terms, from documents that each have
    an id of their own. One pass over the texts counts the documents that hold the seeds' terms, another scores the documents
    that hold the heaviest ones; nothing but counts and scores is shuffled."""
    from folio.operators.index import field_terms
    from folio.operators.lists import one_row_each
    from folio.operators.stats import top_k_per_group

    if index.texts is None or index.stemmed or field not in index.fields or index.texts.schema["doc_id"].dataType.simpleString() != "bigint":
        return None
    ids = [r[0] for r in seeds.select("doc_id").distinct().limit(FEW_SEEDS + 1).collect()]
    if len(ids) > FEW_SEEDS or one_row_each(index) is None:
        return None
    texts = index.plain if index.plain is not None and field in index.plain.columns else index.texts  # the same rows, as ids are not repeated
    long = texts.select("doc_id", F.coalesce(field_terms(texts, field, field in index.text_fields), F.array().cast("array<string>")).alias("toks"))
    own = long.filter(F.col("doc_id").isin([i for i in ids if i is not None])).select("doc_id", F.explode("toks").alias("term"))
    counted = own.groupBy("doc_id", "term").count().limit(SEED_TERMS + 1).collect()
    if len(counted) > SEED_TERMS:
        return None
    spark = texts.sparkSession
    among = lambda terms: F.filter("toks", lambda t: t.isin(sorted(terms)))
    one = lambda term, n: F.struct(term.alias("term"), n.cast("long").alias("n"))
    held = F.transform(F.array_distinct(among({r["term"] for r in counted})), lambda t: one(t, F.lit(1)))
    length = F.array(one(F.lit(None).cast("string"), F.size("toks")))  # a row without a term sums up lengths
    sums = long.select(F.explode(F.concat(held, length)).alias("x")).groupBy("x.term").agg(F.sum("x.n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    n_docs, sum_dl = next(((r["rows"], r["n"]) for r in sums if r["term"] is None), (0, 0))
    dfs = {r["term"]: r["n"] for r in sums}
    weights = spark.createDataFrame([(r["doc_id"], r["term"], r["count"], dfs[r["term"]]) for r in counted], "seed_id long, term string, tf long, df long")
    weights = weights.withColumn("weight", F.col("tf") * F.log(F.lit(n_docs) / F.col("df")))
    heavy = top_k_per_group(weights, ["seed_id"], [F.col("weight").desc(), F.col("term")], k_terms).select("seed_id", "term", "df").collect()
    asked = spark.createDataFrame(heavy, "seed_id long, term string, df long")
    hits = long.select("doc_id", F.size("toks").alias("dl"), among({r["term"] for r in heavy}).alias("toks"))
    each = F.transform(F.array_distinct("toks"), lambda t: one(t, F.size(F.filter("toks", lambda x: x == t))))
    rows = (hits.select("doc_id", "dl", F.explode(each).alias("x")).select("doc_id", "dl", "x.term", F.col("x.n").alias("tf"))
            .join(F.broadcast(asked), "term").filter(F.col("doc_id") != F.col("seed_id"))
            .select("*", F.lit(field).alias("field"), F.lit(n_docs).alias("n_docs"), F.lit(sum_dl / n_docs if n_docs else 0.0).alias("avgdl")))
    return rows.withColumn("part", contribution("bm25")).groupBy("seed_id", "doc_id").agg(F.round(F.sum("part"), C.SCORE_DECIMALS).alias("score"))


def hints(log: DataFrame, query_col: str = "query", count_col: str = "results_count") -> DataFrame:
    """Rewrite hints per logged query: zero hits -> `~q~`, unquoted,
    AND->OR; more than 100 -> add a format filter, quote it. At most 5."""
    q = F.col(query_col)
    n = F.col(count_col)
    zero = F.array_compact(F.array(
        F.concat(F.lit("~"), q, F.lit("~")),
        F.when(q.contains('"'), F.replace(q, F.lit('"'), F.lit(""))),
        F.when(q.contains(" AND "), F.replace(q, F.lit(" AND "), F.lit(" OR ")))))
    many = F.array(F.concat(q, F.lit(" format:markdown")), F.concat(F.lit('"'), q, F.lit('"')))
    h = F.when(n == 0, zero).when(n > 100, many).otherwise(F.array().cast("array<string>"))
    return log.withColumn("hints", F.slice(h, 1, 5))


# ----------------------------------------------------------------------------- re-ranking
def rerank(hits: DataFrame, query_text: str, as_of, preferred_formats=None) -> DataFrame:
    """Score x title match (2.0) x exact phrase in title/snippet (3.0)
    x preferred format (1.1) x popularity (>.8: 1.2, >.5: 1.1)
    x recency (<7 d 1.5, <30 d 1.3, <90 d 1.1, >365 d 0.9). `as_of` explicit."""
    words = [w for w in query_text.lower().split() if w]
    clean = query_text.strip('"').lower()
    title = F.lower(F.coalesce(F.col("title"), F.lit("")))
    snip = F.lower(F.coalesce(F.col("snippet"), F.lit("")))
    m_title = F.when(reduce(lambda a, b: a | b, [title.contains(w) for w in words])
                     if words else F.lit(False), C.BOOST_TITLE_MATCH).otherwise(1.0)
    m_exact = F.when(title.contains(clean) | snip.contains(clean), C.BOOST_EXACT_MATCH).otherwise(1.0)
    from folio.functions.text import as_ts
    age = F.timestamp_diff("DAY", F.col("modified_at"), as_ts(as_of))  # whole days elapsed
    m_rec = F.lit(1.0)
    m_rec = F.when(age > C.OLD_DOCUMENT_DAYS, C.OLD_DOCUMENT_FACTOR).otherwise(m_rec)
    for days, fac in reversed(C.RECENCY_BANDS):
        m_rec = F.when(age < days, fac).otherwise(m_rec)
    m_rec = F.when(F.col("modified_at").isNull(), 1.0).otherwise(m_rec)
    pop = F.coalesce(F.col("popularity"), F.lit(0.0)) if "popularity" in hits.columns else F.lit(0.0)
    m_pop = F.lit(1.0)
    for thr, fac in reversed(C.POPULARITY_BANDS):
        m_pop = F.when(pop > thr, fac).otherwise(m_pop)
    m_fmt = (F.when(F.col("format").isin(list(preferred_formats)), C.BOOST_FORMAT_PREFERENCE).otherwise(1.0)
             if preferred_formats else F.lit(1.0))
    return hits.withColumn("rerank_score", F.round(F.col("score") * m_title * m_exact * m_rec * m_pop * m_fmt,
                                                   C.SCORE_DECIMALS))


def relevance_feedback(clicks: DataFrame) -> DataFrame:
    """T8 over a click log (query_id, doc_id, rank, action in clicked/ignored):
    clicked 1/log2(rank+1), ignored -log2(rank+1), else 0; summed per doc."""
    pen = F.log2(F.col("rank").cast("double") + 1.0)
    v = (F.when(F.col("action") == "clicked", 1.0 / pen)
         .when(F.col("action") == "ignored", -pen).otherwise(0.0))
    return clicks.groupBy("doc_id").agg(F.round(F.sum(v), C.SCORE_DECIMALS).alias("feedback"))


def positions(hits: DataFrame, partition_by=None, order=None) -> DataFrame:
    """Rank position (1-based) of hits. Without `partition_by` the window
    spans the whole frame, so call it on a bounded page (a top-k result);
    per query or per group, pass `partition_by` (or use top_k_per_group)."""
    order = order or [F.col("score").desc(), F.col("doc_id")]
    w = Window.partitionBy(*partition_by).orderBy(*order) if partition_by else Window.orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w))



def search_many(index: Index, queries: DataFrame, k: int | None = 10, fields=("title", "content"),
                qid: str = "qid", text: str = "text", method: str = "bm25") -> DataFrame:
    """Batch scoring of a table of queries (E6 and standing queries): each
    query is the OR of its analysed words over `fields`; output the top k
    (qid, doc_id, score, rank) per query.

    Query words are analysed on the executors. An index with score blocks
    answers top-k BM25 from them, pruned by their bounds (operators/blocks.py).
    Otherwise postings of the distinct query terms are joined once and
    document frequencies come from those same rows."""
    from folio.functions.text import analyze
    from folio.operators.stats import top_k_per_group

    if index.blocks is not None and k is not None and method == "bm25":
        from folio.operators.blocks import search_blocks
        return search_blocks(index, queries, k, tuple(fields), qid, text)
    qt = (queries.select(F.col(qid).alias("qid"), F.explode(F.array_distinct(analyze(F.col(text)))).alias("term"))
          .select("qid", "term", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field")))
    terms = qt.select("field", "term").distinct()
    hit = index.postings.join(terms, ["field", "term"]).select("field", "term", "doc_id", "tf", "dl")
    if index.prebuilt:  # document frequencies straight from the written vocabulary
        dfs = index.vocab.join(terms, ["field", "term"]).select("field", "term", "df")
    else:
        dfs = hit.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    # per (field, term): df and its BM25 idf part are joined once, then the
    # posting rows fan out to the queries that asked for the term
    scored_terms = with_stats(hit.join(dfs, ["field", "term"]), index).withColumn("part", contribution(method))
    rows = qt.join(scored_terms.select("field", "term", "doc_id", "part"), ["field", "term"])
    scores = rows.groupBy("qid", "doc_id").agg(F.round(F.sum("part"), C.SCORE_DECIMALS).alias("score"))
    if k is None:
        return scores
    return top_k_per_group(scores, ["qid"], [F.col("score").desc(), F.col("doc_id")], k)
