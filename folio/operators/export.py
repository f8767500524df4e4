"""Exports (O1-O8): renderings are string columns, written by Spark sinks.

Per-document renderings (markdown, HTML, CSV rows) are column expressions;
bundles number documents with `global_row_number`, which never sorts the
whole table in one task (range partitions + per-partition offsets)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions.text import html_escape

# fixed values: columns, their order and the literals of the renderings below decide the output
PREVIEW = 1000
TRUNCATED = "... (truncated)"
CSV_COLUMNS = ("id", "title", "path", "format", "size", "created_at", "updated_at")
JSON_COLUMNS = ("id", "path", "title", "content", "format", "size", "content_hash", "created_at",
                "modified_at", "tags", "category")


def iso(ts) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def json_rows(docs: DataFrame) -> DataFrame:
    """O1: the 11 exported fields as one JSON object per row."""
    cols = [c for c in JSON_COLUMNS if c in docs.columns]
    return docs.select("doc_id", F.to_json(F.struct(*[
        iso(c).alias(c) if c.endswith("_at") else F.col(c) for c in cols])).alias("json"))


def write_json(docs: DataFrame, path: str) -> None:
    cols = [c for c in JSON_COLUMNS if c in docs.columns]
    docs.select(*cols).write.mode("overwrite").json(path)


def csv_rows(docs: DataFrame) -> DataFrame:
    """O2: 7 fixed columns as strings, blank when missing."""
    src = {"updated_at": "modified_at"}
    out = []
    for c in CSV_COLUMNS:
        name = src.get(c, c)
        if name not in docs.columns:
            out.append(F.lit("").alias(c))
        elif name.endswith("_at"):
            out.append(F.coalesce(iso(name), F.lit("")).alias(c))
        else:
            out.append(F.coalesce(F.col(name).cast("string"), F.lit("")).alias(c))
    return docs.select(*out)


def write_csv(docs: DataFrame, path: str) -> None:
    csv_rows(docs).write.mode("overwrite").option("header", "true").csv(path)


def _preview(content) -> Column:
    c = F.coalesce(F.col(content) if isinstance(content, str) else content, F.lit(""))
    return F.concat(F.substring(c, 1, PREVIEW),
                    F.when(F.char_length(c) > PREVIEW, F.concat(F.lit("\n"), F.lit(TRUNCATED))).otherwise(F.lit("")))


def markdown_render(docs: DataFrame, meta_cols=("category",)) -> Column:
    """O3: header, path, format, size, metadata list, first 1000 chars."""
    meta = [F.concat(F.lit(f"- **{m}**: "), F.coalesce(F.col(m).cast("string"), F.lit(""))) for m in meta_cols]
    lines = [F.concat(F.lit("\n## "), F.coalesce(F.col("title"), F.lit("Untitled")), F.lit("\n")),
             F.concat(F.lit("- **Path**: `"), F.col("path"), F.lit("`")),
             F.concat(F.lit("- **Format**: "), F.col("format")),
             F.concat(F.lit("- **Size**: "), F.col("size").cast("string"), F.lit(" bytes"))]
    if meta:
        lines += [F.lit("\n### Metadata")] + meta
    body = F.when(F.coalesce(F.col("content"), F.lit("")) != "",
                  F.concat(F.lit("\n### Content\n```\n"), _preview("content"), F.lit("\n```")))
    return F.concat_ws("\n", *lines, body)


def html_render(docs: DataFrame, meta_cols=("category",)) -> Column:
    """Escaped title, path, metadata list and 1000-char preview."""
    meta = F.concat(F.lit('<div class="metadata"><h3>Metadata</h3><ul>'),
                    *[F.concat(F.lit(f"<li><strong>{m}:</strong> "), html_escape(F.coalesce(F.col(m).cast("string"), F.lit(""))),
                               F.lit("</li>")) for m in meta_cols], F.lit("</ul></div>")) if meta_cols else F.lit("")
    c = F.coalesce(F.col("content"), F.lit(""))
    prev = F.concat(html_escape(F.substring(c, 1, PREVIEW)),
                    F.when(F.char_length(c) > PREVIEW, F.lit(TRUNCATED)).otherwise(F.lit("")))
    body = F.when(c != "", F.concat(F.lit("<h3>Content Preview</h3><pre>"), prev, F.lit("</pre>"))).otherwise(F.lit(""))
    return F.concat(F.lit('<div class="document"><h2>'), html_escape(F.coalesce(F.col("title"), F.lit("Untitled"))),
                    F.lit('</h2><div class="path">'), html_escape(F.col("path")), F.lit("</div>"), meta, body,
                    F.lit("</div>"))


def global_row_number(df: DataFrame, order: list[Column], partitions: int | None = None,
                      name: str = "n") -> DataFrame:
    """1-based consecutive numbering in `order` without a single-task window:
    range-partition and sort, number rows inside each partition, add the
    running count of the earlier partitions (a table with one row per
    partition, broadcast). The sorted frame is checkpointed to the shared
    checkpoint folder so both uses see the same partitioning."""
    r = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    r = r.sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id())
    r = r.checkpoint(eager=True)
    local = r.withColumn("_ln", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)))
    counts = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    offs = counts.withColumn("_off", F.sum("_c").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
    offs = offs.select("_pid", F.coalesce("_off", F.lit(0)).alias("_off"))  # one row per partition
    return local.join(F.broadcast(offs), "_pid").withColumn(name, F.col("_ln") + F.col("_off")) \
        .drop("_pid", "_ln", "_off")


def anchor(title) -> Column:
    return F.replace(F.lower(F.col(title) if isinstance(title, str) else title), F.lit(" "), F.lit("-"))


def bundle(docs: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Numbered contents line and body block per document:
    (n, toc_line, body). Writing `body` range-sorted by n keeps the order."""
    order = order or [F.col("title"), F.col("doc_id")]
    # numbers are given to the rows without their texts, and the texts join them
    num = docs.join(global_row_number(docs.drop("content"), order).select("doc_id", "n"), "doc_id")
    a = anchor("title")
    toc = F.concat(F.col("n").cast("string"), F.lit(". ["), F.col("title"), F.lit("](#"), a, F.lit(")"))
    tags = F.when(F.size(F.coalesce(F.col("tags"), F.array().cast("array<string>"))) > 0,
                  F.concat(F.lit("\n*Tags: "), F.array_join("tags", ", "), F.lit("*"))).otherwise(F.lit(""))
    cat = F.when(F.col("category").isNotNull(), F.concat(F.lit("\n*Category: "), F.col("category"), F.lit("*"))) \
        .otherwise(F.lit(""))
    body = F.concat(F.lit("## "), F.col("title"), F.lit(" {#"), a, F.lit("}\n\n*Path: "), F.col("path"), F.lit("*"),
                    cat, tags, F.lit("\n\n"), F.coalesce(F.col("content"), F.lit("")), F.lit("\n\n---\n"))
    return num.select("n", "doc_id", toc.alias("toc_line"), body.alias("body"))


def write_bundle(b: DataFrame, path: str) -> None:
    b.repartitionByRange("n").sortWithinPartitions("n").select("body").write.mode("overwrite").text(path)


def report(hits: DataFrame, facets: DataFrame, query: str) -> DataFrame:
    """Search report lines (section, pos, line): header, facets, hits."""
    total = hits.select(F.count(F.lit(1))).scalar()
    head = hits.sparkSession.range(1).select(
        F.lit("header").alias("section"), F.lit(0).cast("long").alias("pos"),
        F.concat(F.lit(f"# Search: {query} ("), total.cast("string"), F.lit(" hits)")).alias("line"))
    fac = facets.select(F.lit("facet").alias("section"), F.col("count").alias("pos"),
                        F.concat(F.col("field"), F.lit(": "), F.col("value"), F.lit(" ("),
                                 F.col("count").cast("string"), F.lit(")")).alias("line"))
    hit = hits.select(F.lit("hit").alias("section"), F.col("rank").cast("long").alias("pos"),
                      F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("title"), F.lit(" ("),
                               F.col("score").cast("string"), F.lit(")")).alias("line"))
    return head.unionByName(fac).unionByName(hit)


# --- fixed values: markdown to HTML rules (O8), applied in this order ----------
MD_HTML_RULES = (
    (r"(?m)^### (.*$)", "<h3>$1</h3>"),
    (r"(?m)^## (.*$)", "<h2>$1</h2>"),
    (r"(?m)^# (.*$)", "<h1>$1</h1>"),
    (r"\*\*(.+?)\*\*", "<strong>$1</strong>"),
    (r"__(.+?)__", "<strong>$1</strong>"),
    (r"\*(.+?)\*", "<em>$1</em>"),
    (r"_(.+?)_", "<em>$1</em>"),
    (r"\[([^\[]+)\]\(([^\)]+)\)", "<a href=\"$2\">$1</a>"),
    (r"```(\w+)?\n([\s\S]*?)```", "<pre><code class=\"language-$1\">$2</code></pre>"),
    (r"`([^`]+)`", "<code>$1</code>"),
    (r"\n\n", "</p><p>"),
)
MD_LIST_RULES = ((r"(?m)^\* (.+)$", "<li>$1</li>"), (r"(?s)(<li>.*</li>)", "<ul>$1</ul>"))


def markdown_to_html(col) -> Column:
    """Escape &, <, >; headers h1-h3, bold, italic, links, fenced and
    inline code, paragraphs, one bullet list."""
    h = F.col(col) if isinstance(col, str) else col
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        h = F.replace(h, F.lit(a), F.lit(b))
    for rx, rep in MD_HTML_RULES:
        h = F.regexp_replace(h, rx, rep)
    h = F.concat(F.lit("<p>"), h, F.lit("</p>"))
    for rx, rep in MD_LIST_RULES:
        h = F.regexp_replace(h, rx, rep)
    return h
