"""Registered processor-surface queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions.text import snippet
from folio.operators import extract as X
from folio.operators import processors as U
from folio.plans import sql as Q
from folio.plans.extract_plans import MD_CTE, PY_CTE, md_frame, py_frame, _words
from folio.plans.registry import register
from folio.sources import testcorpus as tc

READING = U.Processor("reading_time", {"reading_time": lambda: X.reading_time(F.col("content"))},
                      condition=lambda: F.col("format") == "markdown")
SNIPPET = U.Processor("snippet", {"snippet": lambda: snippet("content")})

U1_SQL = f"""WITH {Q.DOCS_BASE}
SELECT doc_id, {Q.snippet('content')} AS snippet,
  CASE WHEN format = 'markdown' THEN CAST(greatest(1, round_even({_words(f"regexp_replace(content, '{X.RX_FENCE_ANY}', '', 'g')")} / 225.0, 0)) AS INTEGER) END AS reading_time
FROM docs_b"""


@register("u1_processor_chain", U1_SQL)
def u1(spark, sf_dir):
    d = tc.documents(spark, sf_dir, with_labels=False)
    return U.run_processors(d, [SNIPPET, READING]).select("doc_id", "snippet", "reading_time")


def _registry():
    return (U.ExtractorRegistry()
            .register("md", "markdown", lambda: {"n_headers": F.size(X.headers(F.col("content"))),
                                                 "n_links": F.size(X.links(F.col("content")))})
            .register("py", "code", lambda: {"n_functions": F.size(F.regexp_extract_all(F.col("content"),
                                                                                      F.lit(X.RX_DEF), 1))}))


U2_SQL = f"""WITH {MD_CTE}, {PY_CTE}
SELECT path, 'markdown' AS format, CAST(len(regexp_extract_all(content, '{X.RX_HEADER}', 1)) AS INTEGER) AS n_headers,
  CAST(len(regexp_extract_all(regexp_replace(content, '{X.RX_IMAGE}', '', 'g'), '{X.RX_LINK_ANY}', 2)) AS INTEGER) AS n_links,
  CAST(NULL AS INTEGER) AS n_functions FROM md
UNION ALL
SELECT path, 'code', NULL, NULL, CAST(len(regexp_extract_all(content, '{X.RX_DEF}', 1)) AS INTEGER) FROM py"""


@register("u2_extractor_registry", U2_SQL)
def u2(spark, sf_dir):
    files = md_frame(spark, sf_dir).unionByName(py_frame(spark, sf_dir))
    out = _registry().apply(files)
    return out.select("path", "format", "n_headers", "n_links", "n_functions")


@register("u3_hooks_skip_failing", f"WITH {Q.DOCS_BASE} SELECT doc_id, upper(format) AS fmt_label FROM docs_b")
def u3(spark, sf_dir):
    hooks = U.Hooks()
    hooks.on("before_index", lambda df: df.withColumn("fmt_label", F.upper("format")))
    hooks.on("before_index", lambda df: df.withColumn("broken", F.col("no_such_column") + 1))  # skipped
    d = hooks.run("before_index", tc.documents(spark, sf_dir, with_labels=False))
    return d.select("doc_id", "fmt_label")


U4_SQL = f"""WITH {Q.DOCS_BASE}
SELECT count(*) AS n_documents, CAST(sum(octet_length(encode('## ' || title || chr(10) || chr(10) || content || chr(10) || chr(10) || '---' || chr(10)))) AS BIGINT) AS bytes,
       CAST(sum(CAST(('0x' || substring(md5(trim(title || chr(10) || chr(10) || content, chr(10))), 1, 8)) AS BIGINT)) AS BIGINT) AS text_sum FROM docs_b"""


@register("u4_markdown_data_source", U4_SQL)
def u4(spark, sf_dir):
    """U4: documents written through the custom Python data source (markdown
    files of about 8 MB, committed at the end) and read back through it."""
    from folio.session import scratch_path
    U.register_sources(spark)
    out = scratch_path(spark, "u4-markdown")
    tc.documents(spark, sf_dir, with_labels=False).select("title", "content") \
        .write.format("folio_markdown").mode("overwrite").save(out)
    back = spark.read.format("folio_markdown").load(out)
    # a document ends in a rule of its own line, and the next begins with its header
    docs = back.select(F.explode(F.split(F.regexp_replace("content", r"\n---\n\z", ""), "\n---\n## ")).alias("d"))
    said = F.btrim(F.regexp_replace("d", r"\A## ", ""), F.lit("\n"))
    total = back.agg(F.sum("size").alias("bytes"))
    return docs.agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.conv(F.substring(F.md5(said), 1, 8), 16, 10).cast("long")).alias("text_sum")) \
        .select("n_documents", total.scalar().alias("bytes"), "text_sum")
