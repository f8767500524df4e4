"""Suggestions and query-log analytics (Q1-Q11).

suggestions(term, type, frequency, last_used): true counts by groupBy (D8).
Completion requests come as a table of prefixes so many users are served by
one job. No step compares every prefix with every term:

* prefix completion explodes each term into its prefixes up to the longest
  requested length and equi-joins on the prefix;
* typo completion is exact for one edit: every string yields itself and each
  string with one character left out, and two strings within one edit share
  such a key (an equi-join, then a Levenshtein check).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio import constants as C
from folio.operators.index import Index, holders
from folio.operators.stats import top_k_per_group
from folio.session import written

SUGG_COLS = ("term", "type", "frequency", "last_used")


def _count(df: DataFrame, term, typ: str, ts) -> DataFrame:
    return (df.select(term.alias("term"), F.lit(typ).alias("type"), ts.alias("ts"))
            .filter(F.col("term").isNotNull() & (F.col("term") != ""))
            .groupBy("term", "type").agg(F.count(F.lit(1)).alias("frequency"),
                                         F.max("ts").alias("last_used")))


def from_documents(docs: DataFrame) -> DataFrame:
    """Q1: lower-cased titles and tags, counted."""
    titles = _count(docs, F.lower("title"), "title", F.col("modified_at"))
    tags = _count(docs.select(F.explode("tags").alias("tag"), "modified_at"),
                  F.lower("tag"), "tag", F.col("modified_at"))
    return titles.unionByName(tags)


def from_query_log(log: DataFrame, query_col: str = "query", ts_col: str = "searched_at") -> DataFrame:
    """Q2: logged query terms longer than 2 chars and whole queries under 100 chars."""
    terms = (log.select(F.explode(F.regexp_extract_all(F.lower(query_col), F.lit(C.TOKEN_PATTERN), 0)).alias("t"),
                        F.col(ts_col).alias("ts"))
             .filter(F.char_length("t") >= C.LOG_TERM_MIN))
    q_terms = _count(terms, F.col("t"), "query_term", F.col("ts"))
    full = _count(log.filter(F.char_length(query_col) < C.LOG_QUERY_MAX), F.lower(query_col),
                  "full_query", F.col(ts_col))
    return q_terms.unionByName(full)


def _heads(suggestions: DataFrame, p: DataFrame, more: int = 0) -> DataFrame:
    """Each term with its first L characters, for every length of a requested prefix and up to `more` characters longer
    or shorter. The set of lengths is one array, as long as there are different ones."""
    spread = F.explode(F.sequence(F.greatest(F.char_length("prefix") - more, F.lit(1)), F.char_length("prefix") + more))
    asked = p.select(spread.alias("L")).agg(F.collect_set("L").alias("L")).scalar()
    lengths = F.array_intersect(F.sequence(F.lit(1), F.char_length("term")), asked)
    return (suggestions.filter(F.char_length("term") > 0).withColumn("L", F.explode(lengths))
            .withColumn("head", F.substring("term", 1, F.col("L"))))


def prefix_completion(suggestions: DataFrame, prefixes: DataFrame, k: int = 10) -> DataFrame:
    """Q3: for each requested prefix, the k most frequent terms starting with it
    (ties by term, then type). Output (prefix, term, type, frequency, rank)."""
    p = prefixes.select(F.lower("prefix").alias("prefix")).distinct()
    hits = _heads(suggestions, p).withColumnRenamed("head", "prefix").drop("L").join(p, "prefix")
    order = [F.col("frequency").desc(), F.col("term"), F.col("type")]
    return top_k_per_group(hits, ["prefix"], order, k).select("prefix", "term", "type", "frequency", "rank")


def _deletions(s) -> F.Column:
    """The string (not empty) and each string with one of its characters left out."""
    n = F.char_length(s)
    less = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(s, 1, i - 1), F.substring(s, i + 1, n)))
    return F.array_distinct(F.concat(F.array(s), less))


def typo_completion(suggestions: DataFrame, prefixes: DataFrame, k: int = 10) -> DataFrame:
    """Q4: terms that don't start with the prefix, but with a string one edit
    (replaced, inserted or deleted character) away from it, ranked by frequency.
    Output (prefix, term, type, frequency, rank)."""
    p = (prefixes.select(F.lower("prefix").alias("prefix")).distinct()
         .filter(F.col("prefix") != ""))
    tk = _heads(suggestions, p, more=1).select("*", F.explode(_deletions(F.col("head"))).alias("key"))
    pk = p.select("prefix", F.explode(_deletions(F.col("prefix"))).alias("key"))
    cand = (tk.join(pk, "key").filter(~F.startswith(F.col("term"), F.col("prefix")))
            .filter(F.levenshtein("head", "prefix", 1) == 1)
            .dropDuplicates(["prefix", "term", "type"]))
    order = [F.col("frequency").desc(), F.col("term"), F.col("type")]
    return top_k_per_group(cand, ["prefix"], order, k).select("prefix", "term", "type", "frequency", "rank")


def completions(suggestions: DataFrame, prefixes: DataFrame, k: int = 10) -> DataFrame:
    """Q3 + Q4 as served: prefix completions, and typo completions only for
    prefixes with fewer than k prefix hits (source 1 = prefix, 2 = typo).
    Output (prefix, term, type, frequency, source, rank)."""
    pre = prefix_completion(suggestions, prefixes, k).withColumn("source", F.lit(1))
    hits = pre.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    few = (prefixes.select(F.lower("prefix").alias("prefix")).distinct()
           .join(hits, "prefix", "left").filter(F.coalesce(F.col("n"), F.lit(0)) < k).select("prefix"))
    typo = typo_completion(suggestions, few, k).withColumn("source", F.lit(2))
    return pre.unionByName(typo).select("prefix", "term", "type", "frequency", "source", "rank")


def popular(suggestions: DataFrame, k: int = 10, typ: str = "title") -> DataFrame:
    """Q5: top-k suggestions of a type by frequency; the fixed defaults when
    there are none. Output (text, type, frequency, rank)."""
    top = (suggestions.filter(F.col("type") == typ)
           .orderBy(F.col("frequency").desc(), F.col("term")).limit(k)
           .select(F.col("term").alias("text"), F.lit("popular").alias("type"), "frequency"))
    n = top.select(F.count(F.lit(1))).scalar()
    defaults = (suggestions.sparkSession.range(len(C.DEFAULT_SUGGESTIONS))
                .select(F.element_at(F.array(*[F.lit(x) for x in C.DEFAULT_SUGGESTIONS]),
                                     (F.col("id") + 1).cast("int")).alias("text"),
                        F.lit("default").alias("type"), F.lit(0).cast("long").alias("frequency"))
                .filter(n == 0))
    return top.unionByName(defaults)


def related_tags(postings: DataFrame | Index, doc_tags: DataFrame, terms: DataFrame,
                 k: int | None = 3, field: str = "content") -> DataFrame:
    """Q6: tags co-occurring on documents containing each term (the tag equal
    to the term excluded). Output (term, tag, count[, rank]). Given an index
    built from documents, only tokens among the terms are counted."""
    index = postings if isinstance(postings, Index) else Index(postings, None, None, None)
    hit = holders(index, terms, field)
    co = (hit.join(doc_tags, "doc_id").filter(F.col("tag") != F.col("term"))
          .groupBy("term", "tag").agg(F.count(F.lit(1)).alias("count")))
    if k is None:
        return co
    return top_k_per_group(co, ["term"], [F.col("count").desc(), F.col("tag")], k)


def templates(top_terms: DataFrame, related: DataFrame) -> DataFrame:
    """Q7: expand the fixed templates with the top terms (prefix, term, rank)
    and, for two-term templates, their related tags (term, tag, rank).
    Output (prefix, text, t_rank, tpl, r_rank)."""
    single = [(i, t) for i, t in enumerate(C.QUERY_TEMPLATES) if "{term2}" not in t]
    double = [(i, t) for i, t in enumerate(C.QUERY_TEMPLATES) if "{term2}" in t]

    def fmt(tpl: str, term, term2=None):
        spec = tpl.replace("%", "%%").replace("{term2}", "%2$s").replace("{term}", "%1$s")
        return F.format_string(spec, term, term2 if term2 is not None else F.lit(""))

    tpl_arr = F.array(*[F.struct(F.lit(i).alias("tpl"), fmt(t, F.col("term")).alias("text"))
                        for i, t in single])
    one = top_terms.select("prefix", F.col("rank").alias("t_rank"), F.explode(tpl_arr).alias("x")) \
        .select("prefix", "x.text", "t_rank", "x.tpl", F.lit(0).alias("r_rank"))
    rel = top_terms.join(related.select("term", "tag", F.col("rank").alias("r_rank")), "term")
    tpl2 = F.array(*[F.struct(F.lit(i).alias("tpl"), fmt(t, F.col("term"), F.col("tag")).alias("text"))
                     for i, t in double])
    two = rel.select("prefix", F.col("rank").alias("t_rank"), "r_rank", F.explode(tpl2).alias("x")) \
        .select("prefix", "x.text", "t_rank", "x.tpl", "r_rank")
    return one.unionByName(two)


def field_values(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """Q8: `field:partial` completion for format / category / status / tags: values
    containing the partial (case-insensitive) with document counts.
    requests(request). Output (request, text, count)."""
    r = (requests.select("request", F.split_part(F.col("request"), F.lit(":"), F.lit(1)).alias("field"),
                         F.lower(F.trim(F.regexp_extract("request", r":([^:]*)$", 1))).alias("partial"))
         .filter(F.col("request").contains(":")))
    vals = reduce(lambda a, b: a.unionByName(b), [
        docs.groupBy(F.col(f).alias("value")).agg(F.count(F.lit(1)).alias("count"))
        .select(F.lit(f).alias("field"), "value", "count") for f in ("format", "category", "status")])
    if "tags" in docs.columns:
        tags = docs.select(F.explode(F.array_distinct("tags")).alias("value"))
        vals = vals.unionByName(tags.groupBy("value").agg(F.count(F.lit(1)).alias("count"))
                                .select(F.lit("tags").alias("field"), "value", "count"))
    return (r.join(vals, "field")  # both sides small after the group-by
            .filter(F.lower("value").contains(F.col("partial")))
            .select("request", F.concat(F.col("field"), F.lit(":"), F.col("value")).alias("text"), "count"))


def merge(*sources: DataFrame, k: int = 10) -> DataFrame:
    """Q9: union of (prefix, text, source_rank, pos) suggestion lists; the first
    occurrence of each text per prefix by (source_rank, pos) wins; k per prefix."""
    u = reduce(lambda a, b: a.unionByName(b), sources)
    first = top_k_per_group(u, ["prefix", "text"], [F.col("source_rank"), F.col("pos")], 1).drop("rank")
    return top_k_per_group(first, ["prefix"], [F.col("source_rank"), F.col("pos"), F.col("text")], k)


def suggestions_for(prefixes: DataFrame, suggestions: DataFrame, postings: DataFrame | Index, doc_tags: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """Q9 over all four sources, in this order: completions of the prefix (Q3),
    typo completions (Q4), query templates of its first terms (Q7), and field values
    for requests of the form `field:partial` (Q8). prefixes(prefix). Tables that several
    sources read are written once."""
    suggestions, prefixes = written(suggestions, "q9-suggestions"), written(prefixes.select("prefix").distinct(), "q9-prefixes")
    pos = lambda *order: F.row_number().over(Window.partitionBy("prefix").orderBy(*order))
    listed = lambda df, rank, *order: df.select("prefix", "text", F.lit(rank).alias("source_rank"), pos(*order).alias("pos")).filter(F.col("pos") <= k)
    typed = written(prefix_completion(suggestions, prefixes, k).withColumn("text", F.col("term")), "q9-typed")
    near = typo_completion(suggestions, prefixes, k).withColumn("text", F.col("term"))
    first = typed.filter(F.col("rank") <= C.TEMPLATE_TERMS).select("prefix", "term", "rank")
    related = related_tags(postings, doc_tags, first.select("term").distinct(), k=C.TEMPLATE_TERMS)
    made = templates(first, related)
    values = field_values(docs, prefixes.select(F.lower("prefix").alias("request")).distinct()).withColumnRenamed("request", "prefix")
    return merge(listed(typed, 1, "rank"), listed(near, 2, "rank"), listed(made, 3, "t_rank", "tpl", "r_rank", "text"),
                 listed(values, 4, F.col("count").desc(), "text"), k=k)


def recent_searches(log: DataFrame, k: int = 10) -> DataFrame:
    """Q10: last k distinct queries per user (latest use first)."""
    last = log.groupBy("user_id", "query").agg(F.max("searched_at").alias("last_searched"))
    return top_k_per_group(last, ["user_id"], [F.col("last_searched").desc(), F.col("query")], k)


def search_activity(log: DataFrame, since=None) -> DataFrame:
    """Q11: per day since a date: searches, mean result count, mean time."""
    if since is not None:
        log = log.filter(F.col("searched_at") >= F.lit(since).cast("timestamp_ntz"))
    return log.groupBy(F.to_date("searched_at").alias("day")).agg(
        F.count(F.lit(1)).alias("searches"),
        F.round(F.avg("results_count"), 6).alias("avg_results"),
        F.round(F.avg("execution_time"), 6).alias("avg_time"))


def normalize_operators(q) -> F.Column:
    """`&&`, `||`, `!`, `+`, `-` between words become AND / OR / NOT."""
    for a, b in C.OPERATOR_REWRITES:
        q = F.replace(q, F.lit(a), F.lit(b))
    return q


def classify_queries(log: DataFrame, query_col: str = "query") -> DataFrame:
    """Per logged query, its normalised form and one flag per syntax
    feature (phrase, field, wildcard, fuzzy, range, boolean) plus `advanced`
    (field, wildcard, fuzzy or range syntax, or any ':'). The query parser
    itself is not rebuilt; these are column predicates over the log."""
    norm = normalize_operators(F.col(query_col))
    out = log.withColumn("normalized", norm)
    for name, rx in C.QUERY_PATTERNS:
        out = out.withColumn(f"is_{name}", F.col("normalized").rlike(rx))
    adv = F.col("is_field") | F.col("is_wildcard") | F.col("is_fuzzy") | F.col("is_range") | \
        F.col("normalized").contains(":")
    return out.withColumn("is_advanced", adv)


def facet_fields(log: DataFrame, query_col: str = "query") -> DataFrame:
    """The default facet fields plus index fields named as `field:` in
    the query (distinct, sorted after the defaults)."""
    defaults = F.array(*[F.lit(f) for f in C.DEFAULT_FACET_FIELDS])
    known = F.array(*[F.lit(f) for f in C.INDEX_FIELDS])
    named = F.regexp_extract_all(F.col(query_col), F.lit(r"(\w+):"), 1)
    extra = F.array_sort(F.array_distinct(F.filter(named, lambda x: F.array_contains(known, x)
                                                   & ~F.array_contains(defaults, x))))
    return log.withColumn("facet_fields", F.concat(defaults, extra))
