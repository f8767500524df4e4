"""Registered suggestion and query-log queries (Q1-Q11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import suggest as G
from folio.plans import sql as Q
from folio.plans.registry import register
from folio.plans.search_plans import corpus_index, T6_TERMS
from folio.sources import testcorpus as tc


def _typo(t: str, p: str) -> str:
    """A head of term `t` is one edit away from the three-character prefix `p`, counted in code points."""
    c = lambda s, i, n=1: f"substring({s}, {i}, {n})"
    return (f"NOT starts_with({t}, {p}) AND ("
            f"(length({t}) >= 3 AND ({c(t, 2, 2)} = {c(p, 2, 2)} OR ({c(t, 1)} = {c(p, 1)} AND {c(t, 3)} = {c(p, 3)}) "
            f"OR {c(t, 1, 2)} = {c(p, 1, 2)})) "
            f"OR {c(t, 1, 2)} IN ({c(p, 2, 2)}, {c(p, 1)} || {c(p, 3)}, {c(p, 1, 2)}) "
            f"OR {p} IN ({c(t, 2, 3)}, {c(t, 1)} || {c(t, 3, 2)}, {c(t, 1, 2)} || {c(t, 4)}))")


def _sugg(spark, sf_dir):
    docs = tc.documents(spark, sf_dir)
    return G.from_documents(docs).unionByName(G.from_query_log(tc.search_history(spark, sf_dir)))


def _prefixes(spark, sf_dir):
    h = tc.search_history(spark, sf_dir).filter(F.char_length("query") >= 3)
    return h.select(F.lower(F.substring("query", 1, 3)).alias("prefix")).distinct()


SUGG_CTE = f"""{Q.DOCS}, {Q.HISTORY},
sugg AS (
  SELECT lower(title) AS term, 'title' AS type, count(*) AS frequency, max(modified_at) AS last_used FROM docs
  WHERE lower(title) <> '' GROUP BY lower(title)
  UNION ALL
  SELECT lower(tag), 'tag', count(*), max(modified_at) FROM (SELECT unnest(tags) AS tag, modified_at FROM docs)
  WHERE tag IS NOT NULL AND lower(tag) <> '' GROUP BY lower(tag)
  UNION ALL
  SELECT t, 'query_term', count(*), max(searched_at) FROM (
    SELECT unnest(regexp_extract_all(lower(query), '{Q.TOKEN}')) AS t, searched_at FROM search_history)
  WHERE length(t) >= 3 GROUP BY t
  UNION ALL
  SELECT lower(query), 'full_query', count(*), max(searched_at) FROM search_history
  WHERE length(query) < 100 AND lower(query) <> '' GROUP BY lower(query)),
pre AS (SELECT DISTINCT lower(substring(query, 1, 3)) AS prefix FROM search_history WHERE length(query) >= 3)"""


@register("q1_suggestions_from_documents", f"WITH {SUGG_CTE} SELECT * FROM sugg WHERE type IN ('title', 'tag')")
def q1(spark, sf_dir):
    return G.from_documents(tc.documents(spark, sf_dir))


@register("q2_suggestions_from_log", f"WITH {SUGG_CTE} SELECT * FROM sugg WHERE type IN ('query_term', 'full_query')")
def q2(spark, sf_dir):
    return G.from_query_log(tc.search_history(spark, sf_dir))


Q3_SQL = f"""WITH {SUGG_CTE},
hits AS (SELECT p.prefix, s.term, s.type, s.frequency FROM sugg s JOIN pre p ON starts_with(s.term, p.prefix)),
r AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY frequency DESC, term, type) AS rank FROM hits)
SELECT prefix, term, type, frequency, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""


@register("q3_prefix_completion", Q3_SQL)
def q3(spark, sf_dir):
    return G.prefix_completion(_sugg(spark, sf_dir), _prefixes(spark, sf_dir), k=5)


Q4_SQL = f"""WITH {SUGG_CTE},
p AS (SELECT prefix FROM pre),
s AS (SELECT * FROM sugg),
c AS (SELECT p.prefix, s.term, s.type, s.frequency FROM s JOIN p
      ON {_typo('s.term', 'p.prefix')}),
r AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY frequency DESC, term, type) AS rank FROM c)
SELECT prefix, term, type, frequency, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""


@register("q4_typo_completion", Q4_SQL)
def q4(spark, sf_dir):
    s = _sugg(spark, sf_dir)
    return G.typo_completion(s, _prefixes(spark, sf_dir), k=5)


@register("q5_popular", f"WITH {SUGG_CTE} SELECT term AS text, 'popular' AS type, frequency FROM sugg "
          "WHERE type = 'title' ORDER BY frequency DESC, term LIMIT 10")
def q5(spark, sf_dir):
    return G.popular(_sugg(spark, sf_dir), 10)


_TERMS_IN = ", ".join(f"'{t}'" for t in T6_TERMS)
Q6_SQL = f"""WITH {Q.DOCS}, {Q.DOC_TAGS}, {Q.tokens_cte()}, {Q.postings_cte(f"field = 'content' AND term IN ({_TERMS_IN})")},
co AS (SELECT p.term, t.tag, count(*) AS count FROM post p JOIN doc_tags t USING (doc_id) WHERE t.tag <> p.term
       GROUP BY p.term, t.tag),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY count DESC, tag) AS rank FROM co)
SELECT term, tag, count, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"""


@register("q6_related_tags", Q6_SQL)
def q6(spark, sf_dir):
    idx = corpus_index(spark, sf_dir)
    terms = idx.vocab.filter((F.col("field") == "content") & F.col("term").isin(*T6_TERMS)).select("term")
    return G.related_tags(idx, tc.doc_tags(spark, sf_dir), terms, k=3)


Q6L_SQL = f"""WITH {Q.LINE_TAGS},
seed AS (SELECT DISTINCT tag AS term, doc_id FROM line_tags WHERE tag IN ('p1', 'p2', 'p3')),
co AS (SELECT s.term, t.tag, count(*) AS count FROM seed s JOIN line_tags t USING (doc_id) WHERE t.tag <> s.term
       GROUP BY s.term, t.tag)
SELECT term, tag, count FROM co"""


@register("q6_related_parts_lineitem", Q6L_SQL)
def q6l(spark, sf_dir):
    lt = tc.line_tags(spark, sf_dir)
    post = lt.select(F.lit("content").alias("field"), F.col("tag").alias("term"), "doc_id").distinct()
    terms = post.select("term").filter(F.col("term").isin("p1", "p2", "p3")).distinct()
    return G.related_tags(post, lt, terms, k=None)


Q7_SQL = f"""WITH {SUGG_CTE}, {Q.DOC_TAGS}, {Q.tokens_cte()}, {Q.postings_cte("field = 'content'")},
top AS (SELECT * FROM (SELECT 'the' AS prefix, term, row_number() OVER (ORDER BY frequency DESC, term, type) AS rank
        FROM sugg WHERE starts_with(term, 'the')) WHERE rank <= 3),
co AS (SELECT p.term, t.tag, count(*) AS count FROM post p JOIN doc_tags t USING (doc_id)
       WHERE t.tag <> p.term AND p.term IN (SELECT term FROM top) GROUP BY p.term, t.tag),
rel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY count DESC, tag) AS r_rank FROM co)
        WHERE r_rank <= 3)
SELECT prefix, 'title:' || term AS text, CAST(rank AS INTEGER) AS t_rank, 0 AS tpl, 0 AS r_rank FROM top
UNION ALL SELECT prefix, 'tags:' || term, CAST(rank AS INTEGER), 1, 0 FROM top
UNION ALL SELECT prefix, 'format:' || term, CAST(rank AS INTEGER), 2, 0 FROM top
UNION ALL SELECT prefix, '"' || term || '"', CAST(rank AS INTEGER), 5, 0 FROM top
UNION ALL SELECT prefix, top.term || ' AND ' || rel.tag, CAST(rank AS INTEGER), 3, CAST(r_rank AS INTEGER) FROM top JOIN rel USING (term)
UNION ALL SELECT prefix, top.term || ' OR ' || rel.tag, CAST(rank AS INTEGER), 4, CAST(r_rank AS INTEGER) FROM top JOIN rel USING (term)"""


@register("q7_query_templates", Q7_SQL)
def q7(spark, sf_dir):
    sugg = _sugg(spark, sf_dir)
    pre = spark.range(1).select(F.lit("the").alias("prefix"))
    top = G.prefix_completion(sugg, pre, k=3).select("prefix", "term", "rank")
    idx = corpus_index(spark, sf_dir)
    rel = G.related_tags(idx, tc.doc_tags(spark, sf_dir), top.select("term"), k=3)
    return G.templates(top, rel)


Q8_SQL = f"""WITH {Q.DOCS},
req AS (SELECT DISTINCT request FROM (VALUES ('format:mark'), ('category:e'), ('status:ind'), ('tags:x'), ('tags: SRC')) v(request)),
vals AS (SELECT 'format' AS field, format AS value, count(*) AS count FROM docs GROUP BY format
         UNION ALL SELECT 'category', category, count(*) FROM docs GROUP BY category
         UNION ALL SELECT 'status', status, count(*) FROM docs GROUP BY status
         UNION ALL SELECT 'tags', tag, count(*) FROM (SELECT unnest(list_distinct(tags)) AS tag FROM docs) GROUP BY tag)
SELECT r.request, v.field || ':' || v.value AS text, v.count FROM req r JOIN vals v
  ON v.field = split_part(r.request, ':', 1) AND contains(lower(v.value), lower(trim(split_part(r.request, ':', 2))))"""


@register("q8_field_value_completion", Q8_SQL)
def q8(spark, sf_dir):
    docs = tc.documents(spark, sf_dir)
    req = spark.createDataFrame([("format:mark",), ("category:e",), ("status:ind",), ("tags:x",), ("tags: SRC",)], "request string")
    return G.field_values(docs, req)


# requests: the first three characters of logged queries, and field requests
Q9_SQL = f"""WITH {SUGG_CTE}, {Q.DOC_TAGS}, {Q.tokens_cte()}, {Q.postings_cte("field = 'content'")},
p AS (SELECT prefix FROM pre UNION SELECT unnest(['format:mark', 'tags:src', 'status:ind'])),
short AS (SELECT prefix FROM pre),
a AS (SELECT * FROM (SELECT p.prefix, s.term, row_number() OVER (PARTITION BY p.prefix ORDER BY s.frequency DESC, s.term, s.type) AS pos
      FROM sugg s JOIN p ON starts_with(s.term, p.prefix)) WHERE pos <= 8),
b AS (SELECT * FROM (SELECT p.prefix, s.term AS text, row_number() OVER (PARTITION BY p.prefix ORDER BY s.frequency DESC, s.term, s.type) AS pos
      FROM sugg s JOIN short p ON {_typo('s.term', 'p.prefix')}) WHERE pos <= 8),
top AS (SELECT prefix, term, pos AS t_rank FROM a WHERE pos <= 3),
co AS (SELECT p.term, t.tag, count(*) AS count FROM post p JOIN doc_tags t USING (doc_id)
       WHERE t.tag <> p.term AND p.term IN (SELECT term FROM top) GROUP BY p.term, t.tag),
rel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY count DESC, tag) AS r_rank FROM co) WHERE r_rank <= 3),
tpl AS (SELECT prefix, 'title:' || term AS text, t_rank, 0 AS tpl, 0 AS r_rank FROM top
        UNION ALL SELECT prefix, 'tags:' || term, t_rank, 1, 0 FROM top
        UNION ALL SELECT prefix, 'format:' || term, t_rank, 2, 0 FROM top
        UNION ALL SELECT prefix, '"' || term || '"', t_rank, 5, 0 FROM top
        UNION ALL SELECT prefix, top.term || ' AND ' || rel.tag, t_rank, 3, r_rank FROM top JOIN rel USING (term)
        UNION ALL SELECT prefix, top.term || ' OR ' || rel.tag, t_rank, 4, r_rank FROM top JOIN rel USING (term)),
c AS (SELECT * FROM (SELECT prefix, text, row_number() OVER (PARTITION BY prefix ORDER BY t_rank, tpl, r_rank, text) AS pos FROM tpl) WHERE pos <= 8),
vals AS (SELECT 'format' AS field, format AS value, count(*) AS count FROM docs GROUP BY format
         UNION ALL SELECT 'status', status, count(*) FROM docs GROUP BY status
         UNION ALL SELECT 'tags', tag, count(*) FROM (SELECT unnest(list_distinct(tags)) AS tag FROM docs) GROUP BY tag),
d AS (SELECT * FROM (SELECT p.prefix, v.field || ':' || v.value AS text, row_number() OVER (PARTITION BY p.prefix ORDER BY v.count DESC, v.field || ':' || v.value) AS pos
      FROM p JOIN vals v ON v.field = split_part(p.prefix, ':', 1) AND contains(p.prefix, ':') AND contains(lower(v.value), split_part(p.prefix, ':', 2))) WHERE pos <= 8),
u AS (SELECT prefix, term AS text, 1 AS source_rank, pos FROM a UNION ALL SELECT prefix, text, 2, pos FROM b
      UNION ALL SELECT prefix, text, 3, pos FROM c UNION ALL SELECT prefix, text, 4, pos FROM d),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prefix, text ORDER BY source_rank, pos) AS rn FROM u) WHERE rn = 1),
r AS (SELECT prefix, text, source_rank, pos, row_number() OVER (PARTITION BY prefix ORDER BY source_rank, pos, text) AS rank FROM f)
SELECT prefix, text, source_rank, CAST(pos AS INTEGER) AS pos, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8"""


@register("q9_merged_suggestions", Q9_SQL)
def q9(spark, sf_dir):
    asked = _prefixes(spark, sf_dir).unionByName(spark.createDataFrame([("format:mark",), ("tags:src",), ("status:ind",)], "prefix string"))
    return G.suggestions_for(asked, _sugg(spark, sf_dir), corpus_index(spark, sf_dir), tc.doc_tags(spark, sf_dir), tc.documents(spark, sf_dir), k=8)


@register("q10_recent_searches", f"WITH {Q.HISTORY}, l AS (SELECT user_id, query, max(searched_at) AS last_searched "
          "FROM search_history GROUP BY user_id, query), r AS (SELECT *, row_number() OVER (PARTITION BY user_id "
          "ORDER BY last_searched DESC, query) AS rank FROM l) "
          "SELECT user_id, query, last_searched, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def q10(spark, sf_dir):
    return G.recent_searches(tc.search_history(spark, sf_dir), 10)


@register("q11_search_activity", f"WITH {Q.HISTORY} SELECT CAST(searched_at AS DATE) AS day, count(*) AS searches, "
          "round(avg(results_count), 6) AS avg_results, round(avg(execution_time), 6) AS avg_time FROM search_history "
          "WHERE searched_at >= TIMESTAMP '2024-01-01 12:00:00' GROUP BY CAST(searched_at AS DATE)")
def q11(spark, sf_dir):
    return G.search_activity(tc.search_history(spark, sf_dir), since="2024-01-01 12:00:00")


# query strings with search syntax, derived from the logged queries
def _syntax_log(spark, sf_dir):
    h = tc.search_history(spark, sf_dir)
    w1 = F.split_part(F.col("query"), F.lit(" "), F.lit(1))
    v = F.col("turn") % 6
    q = (F.when(v == 0, F.concat(F.lit('"'), F.col("query"), F.lit('"')))
         .when(v == 1, F.concat(F.lit("title:"), w1, F.lit(" size:"), F.col("turn").cast("string")))
         .when(v == 2, F.concat(w1, F.lit("*")))
         .when(v == 3, F.concat(w1, F.lit("~2")))
         .when(v == 4, F.concat(w1, F.lit(" && "), F.col("query")))
         .otherwise(F.concat(F.lit("modified_at:[a TO b] "), F.col("query"), F.lit(" - "), w1)))
    return h.select("user_id", "turn", q.alias("query"))


_SYNTAX_SQL = f"""{Q.HISTORY},
syn AS (SELECT user_id, turn, CASE turn % 6
    WHEN 0 THEN '"' || query || '"'
    WHEN 1 THEN 'title:' || split_part(query, ' ', 1) || ' size:' || CAST(turn AS VARCHAR)
    WHEN 2 THEN split_part(query, ' ', 1) || '*'
    WHEN 3 THEN split_part(query, ' ', 1) || '~2'
    WHEN 4 THEN split_part(query, ' ', 1) || ' && ' || query
    ELSE 'modified_at:[a TO b] ' || query || ' - ' || split_part(query, ' ', 1) END AS query
  FROM search_history)"""


def _norm_sql(e: str) -> str:
    from folio import constants as C
    for a, b in C.OPERATOR_REWRITES:
        e = f"replace({e}, '{a}', '{b}')"
    return e


def _flags_sql() -> str:
    from folio import constants as C
    n = _norm_sql("query")
    cols = [f"{n} AS normalized"] + [f"regexp_matches({n}, '{rx}') AS is_{name}" for name, rx in C.QUERY_PATTERNS]
    adv = " OR ".join(f"regexp_matches({n}, '{dict(C.QUERY_PATTERNS)[k]}')" for k in ("field", "wildcard", "fuzzy", "range"))
    cols.append(f"({adv} OR contains({n}, ':')) AS is_advanced")
    return ", ".join(cols)


@register("p14_query_log_classification", f"WITH {_SYNTAX_SQL} SELECT user_id, turn, query, {_flags_sql()} FROM syn")
def p14(spark, sf_dir):
    return G.classify_queries(_syntax_log(spark, sf_dir))


def _p15_sql() -> str:
    from folio import constants as C
    known = "[" + ", ".join(f"'{f}'" for f in C.INDEX_FIELDS) + "]"
    defaults = "[" + ", ".join(f"'{f}'" for f in C.DEFAULT_FACET_FIELDS) + "]"
    extra = (f"list_sort(list_distinct(list_filter(regexp_extract_all(query, '(\\w+):', 1), "
             f"lambda x: list_contains({known}, x) AND NOT list_contains({defaults}, x))))")
    return f"WITH {_SYNTAX_SQL} SELECT user_id, turn, array_to_string(list_concat({defaults}, {extra}), ',') AS facet_fields FROM syn"


@register("p15_facet_fields", _p15_sql())
def p15(spark, sf_dir):
    f = G.facet_fields(_syntax_log(spark, sf_dir))
    return f.select("user_id", "turn", F.array_join("facet_fields", ",").alias("facet_fields"))


Q4F_SQL = f"""WITH {SUGG_CTE},
p AS (SELECT prefix FROM pre),
s AS (SELECT * FROM sugg),
a AS (SELECT * FROM (SELECT p.prefix, s.term, s.type, s.frequency,
        row_number() OVER (PARTITION BY p.prefix ORDER BY s.frequency DESC, s.term, s.type) AS rank
      FROM s JOIN p ON starts_with(s.term, p.prefix)) WHERE rank <= 5),
few AS (SELECT prefix FROM p WHERE prefix NOT IN (SELECT prefix FROM a GROUP BY prefix HAVING count(*) >= 5)),
b AS (SELECT * FROM (SELECT f.prefix, s.term, s.type, s.frequency,
        row_number() OVER (PARTITION BY f.prefix ORDER BY s.frequency DESC, s.term, s.type) AS rank
      FROM s JOIN few f ON {_typo('s.term', 'f.prefix')}) WHERE rank <= 5)
SELECT prefix, term, type, frequency, 1 AS source, CAST(rank AS INTEGER) AS rank FROM a
UNION ALL SELECT prefix, term, type, frequency, 2, CAST(rank AS INTEGER) FROM b"""


@register("q4_typo_when_few_prefix_hits", Q4F_SQL)
def q4f(spark, sf_dir):
    s = _sugg(spark, sf_dir)
    return G.completions(s, _prefixes(spark, sf_dir), k=5)
