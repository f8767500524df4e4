"""Registered search queries (T*, P7-P13) over the test corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio import constants as C
from folio.operators import index as ix
from folio.operators import search as s
from folio.plans import sql as Q
from folio.plans.registry import register
from folio.sources import testcorpus as tc

# fixed query terms of the registered searches (frequent, non-stop terms)
T6_TERMS = ("tion", "ing", "ther")


def corpus_index(spark, sf_dir, by_document=False):
    docs = tc.documents(spark, sf_dir)
    index = ix.build_index(docs, by_document=by_document)
    index.plain = tc.documents(spark, sf_dir, with_labels=False)
    return index


def _page_cols(df):
    return df.select("doc_id", "id", "title", "path", "format", "category", "score", "snippet")


def bm25_top20(spark, sf_dir):
    idx = corpus_index(spark, sf_dir)
    q = s.any_of(*[s.term(t) for t in T6_TERMS])
    return _page_cols(s.search(idx, q, limit=20))


_in = ", ".join(f"'{t}'" for t in T6_TERMS)
BM25_SQL = f"""
WITH {Q.DOCS}, {Q.tokens_cte()}, {Q.postings_cte(f"term IN ({_in}) AND field IN ('title', 'content', 'tags')")},
sc AS (SELECT doc_id, round(sum({Q.bm25()}), 6) AS score
       FROM post JOIN voc USING (field, term) JOIN st USING (field) GROUP BY doc_id)
SELECT doc_id, id, title, path, format, category, sc.score AS score, {Q.snippet('content')} AS snippet
FROM sc JOIN docs USING (doc_id) ORDER BY sc.score DESC, doc_id LIMIT 20
"""
register("t6_bm25_top20", BM25_SQL)(bm25_top20)


# ----------------------------------------------------------------------------- helpers
FIELDS3 = ("title", "content", "tags")
_F3 = "'title', 'content', 'tags'"
AS_OF = C.TEST_AS_OF


def _sql_scored(term_cond: str, flags: dict[str, str], where: str, positive: str,
                fields=FIELDS3, limit: int | None = 20, method: str = "bm25",
                select: str = "doc_id, score", offset: int = 0, extra_where: str = "TRUE") -> str:
    """Oracle SQL of a term-level boolean query: postings of the candidate
    terms, df over the whole corpus, per-document flags and score."""
    fl = ", ".join(f"bool_or({cond}) AS {name}" for name, cond in flags.items())
    part = {"bm25": Q.bm25(), "tfidf": "tf * (ln(n_docs / (df + 1.0)) + 1.0)", "frequency": "CAST(tf AS DOUBLE)"}[method]
    fin = ", ".join(f"'{f}'" for f in fields)
    lim = f" LIMIT {limit}" if limit is not None else ""
    off = f" OFFSET {offset}" if offset else ""
    return f"""WITH {Q.DOCS}, {Q.tokens_cte()}, {Q.postings_cte(f"({term_cond}) AND field IN ({fin})")},
rws AS (SELECT p.*, v.df, st.n_docs, st.avgdl FROM post p JOIN voc v USING (field, term) JOIN st USING (field)),
agg AS (SELECT doc_id, {fl}, round(sum(CASE WHEN {positive} THEN {part} ELSE 0 END), 6) AS score
        FROM rws GROUP BY doc_id),
hits AS (SELECT agg.doc_id, agg.score, d.* EXCLUDE (doc_id, score) FROM agg JOIN docs d USING (doc_id)
         WHERE ({where}) AND ({extra_where}))
SELECT {select} FROM hits ORDER BY score DESC, doc_id{lim}{off}"""


def _idx(spark, sf_dir):
    return corpus_index(spark, sf_dir)


PAGE = "doc_id, id, title, path, format, category, score"

# ----------------------------------------------------------------------------- T1 / T2 / T13
T1_SQL = f"""WITH {Q.DOCS_BASE}
SELECT doc_id, CAST(len({Q.analyze('content')}) AS INTEGER) AS n_tokens,
       CAST(len(list_distinct({Q.analyze('content')})) AS INTEGER) AS n_distinct,
       CAST(len(regexp_extract_all(lower(content), '{Q.TOKEN}')) AS INTEGER) AS n_raw FROM docs_b"""


@register("t1_analyze", T1_SQL)
def t1(spark, sf_dir):
    from folio.functions.text import analyze
    d = tc.documents(spark, sf_dir, with_labels=False)
    return d.select("doc_id", F.size(analyze("content")).alias("n_tokens"),
                    F.size(F.array_distinct(analyze("content"))).alias("n_distinct"),
                    F.size(analyze("content", stop=False)).alias("n_raw"))


T2_SQL = f"""WITH {Q.DOCS}, {Q.tokens_cte()}, {Q.postings_cte("field IN ('title', 'content')")}
SELECT field, term, df, CAST(cf AS BIGINT) AS cf FROM (
  SELECT field, term, count(*) AS df, sum(tf) AS cf FROM post GROUP BY field, term)"""


@register("t2_vocabulary", T2_SQL)
def t2(spark, sf_dir):
    idx = _idx(spark, sf_dir)
    return idx.vocab.filter(F.col("field").isin("title", "content")).select("field", "term", "df", "cf")


T2P_SQL = f"""WITH {Q.DOCS}, {Q.tokens_cte()}, {Q.postings_cte("TRUE")}
SELECT field, count(*) AS n_postings, CAST(sum(tf) AS BIGINT) AS n_tokens, count(DISTINCT doc_id) AS n_docs FROM post GROUP BY field"""


@register("t2_postings_summary", T2P_SQL)
def t2p(spark, sf_dir):
    p = corpus_index(spark, sf_dir, by_document=True).postings
    return p.groupBy("field").agg(F.count(F.lit(1)).alias("n_postings"), F.sum("tf").alias("n_tokens"),
                                  F.count_distinct("doc_id").alias("n_docs"))


T13_SQL = f"""WITH {Q.DOCS}, {Q.tokens_cte()}, {Q.postings_cte("TRUE")}
SELECT (SELECT count(*) FROM docs) AS n_documents, (SELECT max(modified_at) FROM docs) AS last_modified,
       (SELECT count(DISTINCT field) FROM post) AS n_fields,
       (SELECT count(*) FROM (SELECT DISTINCT field, term FROM post)) AS n_terms,
       (SELECT count(*) FROM post) AS n_postings"""


@register("t13_index_stats", T13_SQL)
def t13(spark, sf_dir):
    return ix.index_stats(corpus_index(spark, sf_dir, by_document=True))


# ----------------------------------------------------------------------------- P7-P13 / T3-T6
@register("p7_title_term", _sql_scored("term = 'tion'", {"f0": "term = 'tion'"}, "f0", "TRUE",
                                       fields=("title",), limit=None, select=PAGE))
def p7(spark, sf_dir):
    return s.search(_idx(spark, sf_dir), s.term("tion", ["title"]), limit=None, with_snippet=False) \
        .select(*PAGE.split(", "))


@register("p7_keyword_field", _sql_scored("term = 'code'", {"f0": "term = 'code'"}, "f0", "TRUE",
                                          fields=("format",), limit=None, select="doc_id, format, score"))
def p7k(spark, sf_dir):
    return s.search(_idx(spark, sf_dir), s.term("code", ["format"]), limit=None, with_snippet=False) \
        .select("doc_id", "format", "score")


_P8_TERMS = "term IN ('tion', 'ing', 'ther', 'ment')"
_P8_FLAGS = {"a": "term = 'tion'", "b": "term = 'ing'", "c": "term = 'ther'", "d": "term = 'ment'"}


@register("p8_boolean", _sql_scored(_P8_TERMS, _P8_FLAGS, "a AND (b OR c) AND NOT d",
                                    "term IN ('tion', 'ing', 'ther')", limit=None, select=PAGE))
def p8(spark, sf_dir):
    q = s.all_of(s.term("tion"), s.any_of(s.term("ing"), s.term("ther")), s.none_of(s.term("ment")))
    return s.search(_idx(spark, sf_dir), q, limit=None, with_snippet=False).select(*PAGE.split(", "))


P8N_SQL = f"""WITH {Q.DOCS}, {Q.tokens_cte()}, {Q.postings_cte("term = 'tion' AND field IN ('title', 'content', 'tags')")}
SELECT doc_id, CAST(0.0 AS DOUBLE) AS score FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM post)"""


@register("p8_not_only", P8N_SQL)
def p8n(spark, sf_dir):
    return s.evaluate(_idx(spark, sf_dir), s.none_of(s.term("tion")))


def _phrase_sql(words: str) -> str:
    toks = words.split()
    inl = ", ".join(f"'{t}'" for t in sorted(set(toks)))
    return f"""WITH {Q.DOCS}, {Q.tokens_cte()}, {Q.postings_cte(f"term IN ({inl}) AND field IN ('title', 'content')")},
ok AS (SELECT doc_id, field FROM tok WHERE field IN ('title', 'content')
       AND (' ' || array_to_string(toks, ' ') || ' ') LIKE '% {words} %'),
rws AS (SELECT p.*, v.df, st.n_docs, st.avgdl FROM post p JOIN voc v USING (field, term) JOIN st USING (field)
        WHERE (doc_id, field) IN (SELECT (doc_id, field) FROM ok))
SELECT doc_id, round(sum({Q.bm25()}), 6) AS score FROM rws GROUP BY doc_id"""


@register("p9_phrase", _phrase_sql("anea eriner"))
def p9(spark, sf_dir):
    return s.evaluate(_idx(spark, sf_dir), s.phrase("anea eriner"))


@register("p9_phrase_repeated_token", _phrase_sql("de de"))
def p9r(spark, sf_dir):
    return s.evaluate(_idx(spark, sf_dir), s.phrase("de de"))


WILD = "thr*n"
_WRX = "^thr.*n$"


@register("p10_wildcard", _sql_scored(f"regexp_full_match(term, '{_WRX}')", {"f0": "TRUE"}, "f0", "TRUE",
                                      limit=None, select="doc_id, score"))
def p10(spark, sf_dir):
    return s.evaluate(_idx(spark, sf_dir), s.wildcard(WILD))


@register("p10_leading_wildcard", _sql_scored("regexp_full_match(term, '^.*eaux$')", {"f0": "TRUE"}, "f0", "TRUE",
                                              limit=None, select="doc_id, score"))
def p10l(spark, sf_dir):
    return s.evaluate(_idx(spark, sf_dir), s.wildcard("*eaux"))


@register("p11_regex", _sql_scored("regexp_full_match(term, 'th[a-e]+n')", {"f0": "TRUE"}, "f0", "TRUE",
                                   limit=None, select="doc_id, score"))
def p11(spark, sf_dir):
    return s.evaluate(_idx(spark, sf_dir), s.regex("th[a-e]+n"))


@register("p12_fuzzy", _sql_scored("regexp_full_match(term, '.hon|t.on|th.n|tho.|hon|ton|thn|tho|.thon|t.hon|th.on|tho.n|thon.')", {"f0": "TRUE"}, "f0", "TRUE",
                                   limit=None, select="doc_id, score"))
def p12(spark, sf_dir):
    return s.evaluate(_idx(spark, sf_dir), s.fuzzy("thon", 1))


def _one_edit(word: str) -> str:
    """Regular expression of the word and everything one edit away."""
    n = range(len(word))
    return "|".join([word, *(word[:i] + "." + word[i + 1:] for i in n), *(word[:i] + word[i + 1:] for i in n), *(word[:i] + "." + word[i:] for i in range(len(word) + 1))])


_LOOKUPS = {"wildcard *eaux": (lambda: s.wildcard("*eaux", FIELDS3), ".*eaux"), "wildcard th?re*on": (lambda: s.wildcard("th?re*on", FIELDS3), "th.re.*on"),
            "wildcard *a*": (lambda: s.wildcard("*a*e", ["title"]), ".*a.*e"), "regex th[a-e]+n": (lambda: s.regex("th[a-e]+n", FIELDS3), "th[a-e]+n"),
            "regex (er|re)tion(s|ed)?": (lambda: s.regex("(er|re)tion(s|ed)?", FIELDS3), "(er|re)tion(s|ed)?"),
            "fuzzy thonereat": (lambda: s.fuzzy("thonereat", 1, FIELDS3), _one_edit("thonereat")), "fuzzy thon": (lambda: s.fuzzy("thon", 1, FIELDS3), _one_edit("thon"))}
GRAMS_SQL = f"WITH {Q.DOCS}, {Q.tokens_cte()}, {Q.postings_cte('TRUE')} " + " UNION ALL ".join(
    f"SELECT '{name}' AS leaf, field, term, df FROM voc WHERE regexp_full_match(term, '{rx}') AND field IN ({chr(39) + 'title' + chr(39) if '*a*' in name else _F3})"
    for name, (_, rx) in _LOOKUPS.items())


@register("p10_p12_gram_lookup", GRAMS_SQL)
def gram_lookup(spark, sf_dir):
    """Terms of wildcard, regex and fuzzy leaves found by the grams of a written index."""
    from functools import reduce

    from folio.session import scratch_path
    path = scratch_path(spark, "p10-index")
    ix.write_index(corpus_index(spark, sf_dir), path, grams=True)
    idx = ix.read_index(spark, path, tc.documents(spark, sf_dir))
    found = [leaf().resolve(idx).select(F.lit(name).alias("leaf"), "field", "term", "df") for name, (leaf, _) in _LOOKUPS.items()]
    return reduce(lambda a, b: a.unionByName(b), found)


FOLDER_SQL = f"""WITH {Q.DOCS_BASE},
tok AS (SELECT doc_id, 'ancestors' AS field, ['/' || lower(source), '/' || lower(source) || '/' || lower(lang)] AS toks FROM docs_b
        UNION ALL SELECT doc_id, 'description', ['collected', lower(lang), 'notes'] FROM docs_b
        UNION ALL SELECT doc_id, 'year', [CAST(year(created_at) AS VARCHAR)] FROM docs_b),
nd AS (SELECT count(*) AS n_docs FROM docs_b),
st AS (SELECT field, sum(len(toks)) / (SELECT n_docs FROM nd) AS avgdl, (SELECT n_docs FROM nd) AS n_docs FROM tok GROUP BY field),
{Q.postings_cte("term IN ('/src1', 'collected', 'en', '2024')")}
SELECT doc_id, round(sum({Q.bm25()}), 6) AS score FROM post JOIN voc USING (field, term) JOIN st USING (field)
GROUP BY doc_id HAVING bool_or(term = '/src1') AND bool_or(term = 'en') AND bool_or(term = '2024')"""


@register("s11_folder_search", FOLDER_SQL)
def folder_search(spark, sf_dir):
    """A folder as a term of its ancestors, a phrase in the description and a year, over an index with these fields."""
    docs = tc.documents(spark, sf_dir, with_labels=False).withColumn("description", F.concat(F.lit("Collected "), F.col("lang"), F.lit(" notes")))
    idx = ix.build_index(ix.with_search_fields(docs), text_fields=("title", "content", "description"), keyword_fields=("ancestors", "year", "month", "keywords"))
    q = s.all_of(s.term("/src1", ["ancestors"]), s.phrase("collected en", ["description"]), s.term("2024", ["year"]))
    return s.evaluate(idx, q)


@register("p13_fallback_or", _sql_scored("term IN ('ouen', 'thorreou')", {"a": "term = 'ouen'", "b": "term = 'thorreou'"},
                                         "a OR b", "TRUE", fields=("title", "content"), limit=None,
                                         select="doc_id, score"))
def p13(spark, sf_dir):
    return s.evaluate(_idx(spark, sf_dir), s.fallback("ouen thorreou"))


@register("t3_bm25_all_hits", _sql_scored("term IN ('tion', 'ther')", {"a": "term = 'tion'", "b": "term = 'ther'"},
                                          "a OR b", "TRUE", limit=None, select="doc_id, score"))
def t3(spark, sf_dir):
    return s.evaluate(_idx(spark, sf_dir), s.any_of(s.term("tion"), s.term("ther")))


@register("t4_tfidf_top20", _sql_scored(f"term IN ({_in})", {"a": "TRUE"}, "a", "TRUE", method="tfidf",
                                        select="doc_id, score"))
def t4(spark, sf_dir):
    q = s.any_of(*[s.term(t) for t in T6_TERMS])
    return s.search(_idx(spark, sf_dir), q, limit=20, method="tfidf", with_snippet=False).select("doc_id", "score")


@register("t5_frequency_top20", _sql_scored(f"term IN ({_in})", {"a": "TRUE"}, "a", "TRUE", method="frequency",
                                            select="doc_id, score"))
def t5(spark, sf_dir):
    q = s.any_of(*[s.term(t) for t in T6_TERMS])
    return s.search(_idx(spark, sf_dir), q, limit=20, method="frequency", with_snippet=False).select("doc_id", "score")


@register("t6_filtered_page", _sql_scored(f"term IN ({_in})", {"a": "TRUE"}, "a", "TRUE", limit=10, offset=5,
                                          extra_where="format IN ('markdown', 'text') AND list_contains(tags, 'en')",
                                          select=PAGE))
def t6f(spark, sf_dir):
    q = s.any_of(*[s.term(t) for t in T6_TERMS])
    return s.search(_idx(spark, sf_dir), q, filters={"format": ["markdown", "text"], "tags": "en"},
                    offset=5, limit=10, with_snippet=False).select(*PAGE.split(", "))


T6S_SQL = _sql_scored(f"term IN ({_in})", {"a": "TRUE"}, "a", "TRUE", limit=None, select="doc_id, size, score") \
    .replace("ORDER BY score DESC, doc_id", "ORDER BY size DESC, doc_id LIMIT 15")


@register("t6_sort_size_desc", T6S_SQL)
def t6s(spark, sf_dir):
    q = s.any_of(*[s.term(t) for t in T6_TERMS])
    return s.search(_idx(spark, sf_dir), q, sort="-size", limit=15, with_snippet=False).select("doc_id", "size", "score")


# ----------------------------------------------------------------------------- T7-T12, T15, T16
_TOP20 = "WITH t AS (" + BM25_SQL.strip() + ")"


def _top20(spark, sf_dir):
    return bm25_top20(spark, sf_dir)


# popularity of a document: its id modulo 11, in tenths
T7_SQL = f"""{_TOP20}, {Q.DOCS_BASE.strip()},
r AS (SELECT t.doc_id, t.score, t.title, t.snippet, t.format, d.modified_at, (t.doc_id % 11) / 10.0 AS popularity,
             date_sub('day', d.modified_at, TIMESTAMP '{AS_OF}') AS age
      FROM t JOIN docs_b d USING (doc_id))
SELECT doc_id, round(score
  * CASE WHEN contains(lower(title), 'tion') OR contains(lower(title), 'ing') OR contains(lower(title), 'ther') THEN 2.0 ELSE 1.0 END
  * CASE WHEN contains(lower(title), 'tion ing ther') OR contains(lower(snippet), 'tion ing ther') THEN 3.0 ELSE 1.0 END
  * CASE WHEN age < 7 THEN 1.5 WHEN age < 30 THEN 1.3 WHEN age < 90 THEN 1.1 WHEN age > 365 THEN 0.9 ELSE 1.0 END
  * CASE WHEN popularity > 0.8 THEN 1.2 WHEN popularity > 0.5 THEN 1.1 ELSE 1.0 END
  * CASE WHEN format IN ('markdown') THEN 1.1 ELSE 1.0 END, 6) AS rerank_score FROM r"""


@register("t7_rerank", T7_SQL)
def t7(spark, sf_dir):
    page = _top20(spark, sf_dir)
    d = tc.documents(spark, sf_dir, with_labels=False).select("doc_id", "modified_at")
    page = F.broadcast(page).join(d, "doc_id").withColumn("popularity", (F.col("doc_id") % 11) / 10.0)
    return s.rerank(page, " ".join(T6_TERMS), AS_OF, preferred_formats=["markdown"]) \
        .select("doc_id", "rerank_score")


T8_SQL = """SELECT user_id AS doc_id, round(sum(CASE WHEN event_type = 'click' THEN 1.0 / log2(event_id % 10 + 2)
            WHEN event_type = 'view' THEN -log2(event_id % 10 + 2) ELSE 0.0 END), 6) AS feedback
FROM events GROUP BY user_id"""


@register("t8_relevance_feedback", T8_SQL)
def t8(spark, sf_dir):
    e = tc.table(spark, sf_dir, "events")
    clicks = e.select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 10 + 1).alias("rank"),
                      F.when(F.col("event_type") == "click", "clicked")
                      .when(F.col("event_type") == "view", "ignored").otherwise("none").alias("action"))
    return s.relevance_feedback(clicks)


T9_SQL = f"""WITH t AS ({BM25_SQL.strip()}), {Q.DOCS.strip()}, {Q.tokens_cte()},
{Q.postings_cte(f"term IN ({_in}) AND field IN ('title', 'content', 'tags')")}
SELECT t.doc_id, t.score AS base_score,
       (SELECT array_to_string(list_sort(list_distinct(list(p.term))), ',') FROM post p WHERE p.doc_id = t.doc_id) AS matched_terms,
       EXISTS (SELECT 1 FROM post p WHERE p.doc_id = t.doc_id AND p.field = 'title') AS title_match,
       EXISTS (SELECT 1 FROM post p WHERE p.doc_id = t.doc_id AND p.field = 'content') AS content_match,
       EXISTS (SELECT 1 FROM post p WHERE p.doc_id = t.doc_id AND p.field = 'tags') AS tags_match
FROM t"""


@register("t9_explain", T9_SQL)
def t9(spark, sf_dir):
    idx = _idx(spark, sf_dir)
    q = s.any_of(*[s.term(t) for t in T6_TERMS])
    page = s.search(idx, q, limit=20, with_snippet=False)
    ex = s.explain_scores(idx, q, page)
    return ex.select("doc_id", "base_score", F.array_join("matched_terms", ",").alias("matched_terms"),
                     "title_match", "content_match", "tags_match")


T10_SQL = f"""{_TOP20}
SELECT doc_id, regexp_replace(snippet, '(?i)(ther|tion|ing)', '<mark>\\1</mark>', 'g') AS highlights FROM t"""


@register("t10_highlight", T10_SQL)
def t10(spark, sf_dir):
    page = _top20(spark, sf_dir)
    return s.highlight_page(page, " ".join(T6_TERMS)).select("doc_id", "highlights")


# windows of 24 tokens that begin 4 before a hit: most distinct words, most hits, earliest; three without overlap
T10F_SQL = f"""{_TOP20}, {Q.DOCS_BASE.strip()},
d AS (SELECT doc_id, regexp_extract_all(content, '{Q.TOKEN}') AS tk, regexp_split_to_array(content, '{Q.TOKEN}') AS sp FROM t JOIN docs_b USING (doc_id)),
p AS (SELECT doc_id, unnest(tk) AS tok, unnest(range(len(tk))) AS pos FROM d),
h AS (SELECT doc_id, pos, lower(tok) AS word, greatest(pos - 4, 0) AS a0 FROM p WHERE lower(tok) IN ('tion', 'ing', 'ther')),
c AS (SELECT a.doc_id, a.pos, any_value(a.a0) AS a0, count(DISTINCT b.word) AS words, count(*) AS hits
      FROM h a JOIN h b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + 19 GROUP BY a.doc_id, a.pos),
p1 AS (SELECT doc_id, first(a0 ORDER BY words DESC, hits DESC, pos) AS a0 FROM c GROUP BY doc_id),
c2 AS (SELECT c.* FROM c JOIN p1 USING (doc_id) WHERE abs(c.a0 - p1.a0) >= 24),
p2 AS (SELECT doc_id, first(a0 ORDER BY words DESC, hits DESC, pos) AS a0 FROM c2 GROUP BY doc_id),
c3 AS (SELECT c2.* FROM c2 JOIN p2 USING (doc_id) WHERE abs(c2.a0 - p2.a0) >= 24),
p3 AS (SELECT doc_id, first(a0 ORDER BY words DESC, hits DESC, pos) AS a0 FROM c3 GROUP BY doc_id),
picks AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3),
n AS (SELECT doc_id, a0, row_number() OVER (PARTITION BY doc_id ORDER BY a0) AS n FROM picks),
w AS (SELECT n.doc_id, n.n, n.a0, unnest(range(n.a0, least(n.a0 + 24, len(d.tk)))) AS i, d.tk, d.sp FROM n JOIN d USING (doc_id))
SELECT doc_id, CAST(n AS INTEGER) AS n, string_agg(CASE WHEN i > a0 THEN sp[i + 1] ELSE '' END
       || CASE WHEN lower(tk[i + 1]) IN ('tion', 'ing', 'ther') THEN '<mark>' || tk[i + 1] || '</mark>' ELSE tk[i + 1] END, '' ORDER BY i) AS fragment
FROM w GROUP BY doc_id, n"""


@register("t10_fragments", T10F_SQL)
def t10_fragments(spark, sf_dir):
    page = _top20(spark, sf_dir).select("doc_id").join(tc.documents(spark, sf_dir, with_labels=False).select("doc_id", "content"), "doc_id")
    f = s.fragments(page, " ".join(T6_TERMS))
    return f.select("doc_id", F.posexplode("fragments").alias("n", "fragment")).select("doc_id", (F.col("n") + 1).alias("n"), "fragment")


T11_SQL = f"""WITH {Q.DOCS}, {Q.tokens_cte()}, {Q.postings_cte("field = 'content'")},
seed AS (SELECT p.term, p.tf * ln(st.n_docs / v.df) AS w FROM post p JOIN voc v USING (field, term) JOIN st USING (field)
         WHERE p.doc_id = 1),
top AS (SELECT term FROM seed ORDER BY w DESC, term LIMIT 10),
sc AS (SELECT p.doc_id, round(sum({Q.bm25('p')}), 6) AS score
       FROM post p JOIN top USING (term) JOIN voc v USING (field, term) JOIN st USING (field)
       WHERE p.doc_id <> 1 GROUP BY p.doc_id)
SELECT 1 AS seed_id, doc_id, score FROM sc ORDER BY score DESC, doc_id LIMIT 10"""


@register("t11_more_like_this", T11_SQL)
def t11(spark, sf_dir):
    idx = _idx(spark, sf_dir)
    seeds = idx.docs.filter(F.col("path") == "/src1/en/1.txt").select("doc_id")
    return s.more_like_this(idx, seeds, k_terms=10, limit=10).select(
        F.col("seed_id").cast("int").alias("seed_id"), "doc_id", "score")


T11A_SQL = f"""WITH {Q.DOCS}, {Q.tokens_cte()}, {Q.postings_cte("field = 'content'")},
seed AS (SELECT p.doc_id AS seed_id, p.term, p.tf * ln(st.n_docs / v.df) AS w FROM post p JOIN voc v USING (field, term) JOIN st USING (field)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY w DESC, term) AS n FROM seed) WHERE n <= 10),
sc AS (SELECT top.seed_id, p.doc_id, round(sum({Q.bm25('p')}), 6) AS score
       FROM post p JOIN top USING (term) JOIN voc v USING (field, term) JOIN st USING (field)
       WHERE p.doc_id <> top.seed_id GROUP BY top.seed_id, p.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, doc_id) AS rank FROM sc)
SELECT seed_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""


@register("t11_all_documents", T11A_SQL)
def t11_all(spark, sf_dir):
    from folio.operators.blocks import similar_documents
    from folio.session import scratch_path
    path = scratch_path(spark, "t11-index")
    ix.write_index(corpus_index(spark, sf_dir), path, shard_docs=2000)
    return similar_documents(ix.read_index(spark, path, tc.documents(spark, sf_dir)))


T12_SQL = f"""WITH {Q.DOCS}, {Q.tokens_cte()}, {Q.postings_cte(f"term IN ({_in}) AND field IN ('title', 'content', 'tags')")},
m AS (SELECT * FROM docs WHERE doc_id IN (SELECT doc_id FROM post)),
v AS (SELECT 'format' AS field, format AS value FROM m
      UNION ALL SELECT 'category', category FROM m
      UNION ALL SELECT 'tags', unnest(list_distinct(tags)) FROM m
      UNION ALL SELECT 'status', status FROM m
      UNION ALL SELECT 'year', CAST(year(created_at) AS VARCHAR) FROM m)
SELECT field, value, count(*) AS count FROM v WHERE value IS NOT NULL GROUP BY field, value"""


@register("t12_facets", T12_SQL)
def t12(spark, sf_dir):
    q = s.any_of(*[s.term(t) for t in T6_TERMS])
    return s.facets(_idx(spark, sf_dir), q)


# the deleted documents are the JSON-format ones (the Spark side deletes by format too)
T15_SQL = BM25_SQL.replace("FROM docs_b b LEFT JOIN labels l USING (doc_id))",
                           "FROM docs_b b LEFT JOIN labels l USING (doc_id) WHERE b.format <> 'json')", 1)
assert T15_SQL != BM25_SQL


@register("t15_delete_then_search", T15_SQL)
def t15(spark, sf_dir):
    idx = _idx(spark, sf_dir)
    gone = idx.docs.filter(F.col("format") == "json").select("doc_id")
    idx2 = ix.delete_from_index(idx, gone)
    q = s.any_of(*[s.term(t) for t in T6_TERMS])
    return _page_cols(s.search(idx2, q, limit=20))


T16_SQL = f"""WITH {Q.HISTORY}
SELECT user_id, turn, query, array_to_string(CASE WHEN results_count = 0 THEN list_filter(['~' || query || '~',
    CASE WHEN contains(query, '"') THEN replace(query, '"', '') END,
    CASE WHEN contains(query, ' AND ') THEN replace(query, ' AND ', ' OR ') END], lambda x: x IS NOT NULL)
  WHEN results_count > 100 THEN [query || ' format:markdown', '"' || query || '"'] ELSE [] END, '|') AS hints
FROM search_history"""


@register("t16_hints", T16_SQL)
def t16(spark, sf_dir):
    h = s.hints(tc.search_history(spark, sf_dir))
    return h.select("user_id", "turn", "query", F.array_join("hints", "|").alias("hints"))


J4_SQL = f"""WITH t AS ({BM25_SQL.strip()}), {Q.DOCS_BASE.strip()}
SELECT t.doc_id, t.score, d.path, d.size, d.modified_at FROM t JOIN docs_b d USING (doc_id)"""


@register("j4_hits_to_documents", J4_SQL)
def j4(spark, sf_dir):
    from folio.operators import relational as R
    hits = bm25_top20(spark, sf_dir)
    return R.hits_to_documents(hits, tc.documents(spark, sf_dir, with_labels=False)) \
        .select("doc_id", "score", "path", "size", "modified_at")


@register("t14_compacted_index", T2P_SQL)
def t14(spark, sf_dir):
    from folio.session import scratch_path
    docs = tc.documents(spark, sf_dir)
    src, dst = scratch_path(spark, "t14-src"), scratch_path(spark, "t14-dst")
    ix.write_index(corpus_index(spark, sf_dir), src)
    idx = ix.compact_index(spark, src, dst, 4, docs)
    p = idx.postings
    return p.groupBy("field").agg(F.count(F.lit(1)).alias("n_postings"), F.sum("tf").alias("n_tokens"),
                                  F.count_distinct("doc_id").alias("n_docs"))


@register("t1_stemmed_search")
def t1_stemmed(spark, sf_dir):
    """Porter-stemmed index (no SQL oracle: rows only)."""
    idx = ix.build_index(tc.documents(spark, sf_dir), stem=True)
    return s.evaluate(idx, s.any_of(s.term("tions"), s.term("theres")))
