"""Inverted index as ordinary DataFrames.

postings(field, term, doc_id, tf, dl, positions)  one row per (field, term, doc)
vocab(field, term, df, cf)                        one row per (field, term)
stats(field, n_docs, sum_dl, avgdl)               one row per field
docs                                              the document rows

`dl` (field length of the document) is carried on every posting so BM25 needs
no join with a per-document table. Building from documents is lazy: a search
over a freshly built index only shuffles the tokens of the query terms,
because Catalyst pushes `term IN (...)` below the aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import analyze, analyze_keywords

TEXT_FIELDS = ("title", "content")
KEYWORD_FIELDS = ("tags", "format", "category", "status")
#: Postings that a file of a compacted index holds at most, about.
FILE_POSTINGS = 2_000_000


@dataclass
class Index:
    postings: DataFrame
    vocab: DataFrame
    stats: DataFrame
    docs: DataFrame
    stemmed: bool = False
    fields: tuple = ()
    # per-field (n_docs, avgdl) of a written index: at most one row per field,
    # read once when the index is opened and inlined as literals in scoring
    stats_values: dict | None = None
    prebuilt: bool = False
    # score blocks of a written index (operators/blocks.py), if it has them
    blocks: DataFrame | None = None
    # lists of a written index (operators/lists.py), if it has them, and the document frequencies of terms in several of its parts
    lists: DataFrame | None = None
    wide: dict | None = None
    # gram index of a written index's vocabulary (operators/grams.py), if it has one
    grams: DataFrame | None = None
    # which of the fields hold analysed text
    text_fields: tuple = TEXT_FIELDS
    # (doc_id, field, dl) of the fields that hold tokens, where it is known without the postings
    lengths: DataFrame | None = None
    # the documents of an index built from them, as long as nothing else was done to it
    texts: DataFrame | None = None
    # those documents without what was joined to them: the same rows, unless the join repeats some
    plain: DataFrame | None = None
    # what `narrowed` wrote, by (field, term) pairs
    narrow: dict = field(default_factory=dict)

    def n_docs(self):
        """Scalar subquery: number of indexed documents."""
        return self.docs.select(F.count(F.lit(1))).scalar()


def field_terms(docs: DataFrame, f: str, text: bool):
    """The tokens of a field: of analysed text, of a list of keywords or of keywords in one string."""
    if text:
        return analyze(F.col(f))
    if docs.schema[f].dataType.simpleString().startswith("array"):
        return F.filter(F.transform(F.col(f), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return analyze_keywords(F.col(f))


def _field_tokens(docs: DataFrame, text_fields, keyword_fields, stem: bool = False) -> DataFrame:
    """Long form (doc_id, field, toks) with one row per document and field.
    Tokenising is the heavy per-row step, so the input is spread over the
    cores first when it arrives in fewer partitions (one big row group)."""
    from folio.session import spread
    docs = spread(docs)
    parts = []
    for f in text_fields:
        parts.append(F.struct(F.lit(f).alias("field"), analyze(F.col(f)).alias("toks")))
    for f in keyword_fields:
        toks = field_terms(docs, f, False)
        parts.append(F.struct(F.lit(f).alias("field"), F.coalesce(toks, F.array().cast("array<string>")).alias("toks")))
    return docs.select("doc_id", F.explode(F.array(*parts)).alias("x")).select(
        "doc_id", F.col("x.field").alias("field"), F.col("x.toks").alias("toks"))


def with_search_fields(docs: DataFrame, root: str | None = None) -> DataFrame:
    """Document columns that can be indexed as fields besides the usual ones:
    `ancestors` (every folder above the file, as a path, so a folder search is
    one posting lookup), `year` and `month` of creation, and `description` and
    `keywords` where the documents have them."""
    from folio.sources.files import path_components
    comps = path_components("path", root)
    above = F.transform(F.sequence(F.lit(1), F.size(comps)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(comps, F.lit(1), i), "/")))
    out = docs.withColumn("ancestors", F.when(F.size(comps) > 0, above).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("year", F.year("created_at").cast("string")).withColumn("month", F.month("created_at").cast("string"))
    for name, kind in (("description", "string"), ("keywords", "array<string>")):
        if name not in docs.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out


def tokens(docs: DataFrame, text_fields=TEXT_FIELDS, keyword_fields=KEYWORD_FIELDS,
           stem: bool = False) -> DataFrame:
    """T1 analysed token stream (field, doc_id, dl, pos, term); no shuffle.
    (Stemming is applied to the vocabulary by `build_index(stem=True)`.)"""
    long = _field_tokens(docs, text_fields, keyword_fields)
    return long.select("field", "doc_id", F.size("toks").alias("dl"),
                       F.posexplode("toks").alias("pos", "term"))


def build_index(docs: DataFrame, text_fields=TEXT_FIELDS, keyword_fields=KEYWORD_FIELDS,
                positions: bool = False, stem: bool = False, by_document: bool = False) -> Index:
    """Postings with term frequency and field length (and, with
    positions=True, the sorted token positions; phrase queries are exact
    either way: without positions they verify adjacency on the text of the
    candidate documents only).
    stem=True maps text-field terms to Porter stems over the distinct
    vocabulary (a pandas UDF) and merges their postings. by_document=True is for
    readers of all postings: the documents are dealt by doc_id before they are
    tokenised, and counting needs no shuffle of the postings then."""
    dealt = docs
    if by_document:
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = docs.select("doc_id", *dict.fromkeys((*text_fields, *keyword_fields))).repartition(parts, "doc_id")
    tok = tokens(dealt, text_fields, keyword_fields)
    aggs = [F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl")]
    if positions:
        aggs.append(F.array_sort(F.collect_list("pos")).alias("positions"))
    postings = tok.groupBy("field", "term", "doc_id").agg(*aggs)
    vocab = postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"),
                                                  F.sum("tf").alias("cf"))
    # corpus statistics straight from the token arrays: a global aggregate
    # with map-side partial sums, never a shuffle of the postings
    # (one row per document and field, so count = number of documents)
    long = _field_tokens(docs, text_fields, keyword_fields)
    stats = _stats_of(long, F.size("toks"))
    lengths = long.select("doc_id", "field", F.size("toks").alias("dl")).filter("dl > 0")
    idx = Index(postings, vocab, stats, docs, fields=tuple(text_fields) + tuple(keyword_fields), text_fields=tuple(text_fields), lengths=lengths)
    if stem:
        from folio.functions.stem import stem_index
        idx = stem_index(idx, text_fields)
        idx.stemmed = True
    if not positions:
        idx.texts = docs
    return idx


def narrowed(index: Index, pairs) -> Index:
    """An index built from documents with the postings of these (field, term) pairs and the statistics of their fields
    only. The texts are read and tokenised once: for each document and field its length and those of its tokens that are
    asked for are written to the shared folder, and postings, document frequencies and statistics are counted from there.
    Of a stemmed index the surface forms of the stems are looked up first, in the distinct tokens of the texts. An index that was written, or changed since it was built, is returned as it is."""
    from folio.session import written

    asked = frozenset(pairs)
    if index.texts is None or not asked:
        return index
    if asked not in index.narrow:
        by_field: dict[str, set] = {}
        for f, t in asked:
            by_field.setdefault(f, set()).add(t)
        long = _field_tokens(index.texts, [f for f in index.text_fields if f in by_field],
                             [f for f in index.fields if f in by_field and f not in index.text_fields])
        stems = {}
        if index.stemmed:
            from folio.functions.stem import surface_forms
            stems = surface_forms(long.filter(F.col("field").isin(list(index.text_fields))).select(F.explode("toks").alias("term")),
                                  {t for f, t in asked if f in index.text_fields})
        hits = F.array().cast("array<string>")
        for f, terms in sorted(by_field.items()):
            forms = {w for w, stem in stems.items() if stem in terms} if index.stemmed and f in index.text_fields else terms
            hits = F.when(F.col("field") == f, _among(forms)).otherwise(hits)
        rows = written(long.select("doc_id", "field", F.size("toks").alias("dl"), hits.alias("hits")), "narrowed")
        found = rows.select("field", "doc_id", "dl", F.explode("hits").alias("term"))
        if stems:
            told = index.docs.sparkSession.createDataFrame(list(stems.items()), "form string, stem string")
            own = (F.col("term") == F.col("form")) & F.col("field").isin(list(index.text_fields))
            found = found.join(F.broadcast(told), own, "left").select("field", "doc_id", "dl", F.coalesce("stem", "term").alias("term"))
        postings = found.groupBy("field", "term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))
        vocab = postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
        index.narrow[asked] = Index(postings, vocab, _stats_of(rows, F.col("dl")), index.docs, index.stemmed, index.fields, text_fields=index.text_fields)
    return index.narrow[asked]


def holders(index: Index, terms: DataFrame, field: str) -> DataFrame:
    """(term, doc_id) of the documents whose `field` holds a term of the table `terms(term)`, once for each time the table
    has it. From documents, distinct tokens meet the terms before anything is shuffled."""
    if index.texts is None or index.stemmed or field not in index.fields:
        return index.postings.filter(F.col("field") == field).join(terms.select("term"), "term").select("term", "doc_id")
    text = field in index.text_fields
    long = _field_tokens(index.texts, [field] if text else [], [] if text else [field])
    held = long.select("doc_id", F.explode(F.array_distinct("toks")).alias("term"))
    return held.join(terms.select("term").distinct(), "term").select("term", "doc_id").distinct().join(terms.select("term"), "term")


def _among(terms):
    return F.filter("toks", lambda t: t.isin(sorted(terms)))


def _stats_of(rows: DataFrame, length) -> DataFrame:
    """Statistics of fields from one row per document and field."""
    return (rows.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(length).alias("sum_dl"))
            .withColumn("avgdl", F.col("sum_dl") / F.col("n_docs")))


def write_index(index: Index, path: str, partitions: int | None = None, shard_docs: int | None = None,
                grams: bool = False) -> None:
    """Persist the index; the text is tokenised once. With `shard_docs`, score
    blocks for batch search are written as well, with `grams` the gram index
    of the vocabulary.

    An index built from documents that each have an id of their own is
    written from lists (operators/lists.py). Of any other,
    postings are range-partitioned and sorted by (field, term) so Parquet
    min/max statistics skip files and row groups for `term IN (...)`
    lookups (that is also the compaction step, T14). Vocabulary and corpus
    statistics are then derived from the written postings: the sum of tf
    over a field equals the sum of its field lengths, and the document count
    comes from a column-pruned count of the documents."""
    from folio.operators import lists

    spark = index.postings.sparkSession
    whole = index.texts is not None and not index.stemmed and index.texts.schema["doc_id"].dataType.simpleString() == "bigint"
    if whole and (n := lists.one_row_each(index)) is not None:
        lists.write_whole(index, path, n, partitions, shard_docs)
        if grams:
            from folio.operators.grams import write_grams
            write_grams(read_index(spark, path, index.docs), path)
        return
    p = index.postings
    # doc_id in the range key lets a term held by a third of all documents
    # spread over several files instead of landing whole in one task
    keys = ("field", "term", "doc_id")
    p = p.repartitionByRange(partitions, *keys) if partitions else p.repartitionByRange(*keys)
    p.sortWithinPartitions("field", "term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    written = spark.read.parquet(f"{path}/postings")
    vocab = written.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    vocab.repartitionByRange("field", "term").sortWithinPartitions("field", "term") \
        .write.mode("overwrite").parquet(f"{path}/vocab")
    n_docs = index.docs.select(F.count(F.lit(1))).scalar()
    names = index.fields or tuple(r[0] for r in index.stats.select("field").collect())
    fields = spark.createDataFrame([(f,) for f in names], "field string")  # one row per field
    sums = written.groupBy("field").agg(F.sum("tf").alias("sum_dl"))
    stats = (fields.join(sums, "field", "left")
             .select("field", n_docs.alias("n_docs"), F.coalesce("sum_dl", F.lit(0)).cast("long").alias("sum_dl"))
             .withColumn("avgdl", F.col("sum_dl") / F.col("n_docs")))
    stats.repartition(1).write.mode("overwrite").parquet(f"{path}/stats")
    if shard_docs or grams:
        from folio.operators.blocks import write_blocks
        from folio.operators.grams import write_grams
        opened = read_index(spark, path, index.docs)
        if shard_docs:
            write_blocks(opened, path, shard_docs)
        if grams:
            write_grams(opened, path)


def read_index(spark: SparkSession, path: str, docs: DataFrame, stemmed: bool = False, text_fields=TEXT_FIELDS) -> Index:
    """Open a written index. The statistics table (one row per field) is
    read here once; postings and vocabulary stay lazy scans. `text_fields`
    are those it was built with."""
    stats = spark.read.parquet(f"{path}/stats")
    values = {r["field"]: (r["n_docs"], r["avgdl"]) for r in stats.collect()}
    from folio.operators.blocks import read_blocks
    from folio.operators.grams import read_grams
    from folio.operators.lists import read_wide

    def has(part):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}/_SUCCESS")
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    listed = has("lists")
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/vocab"),
                 stats, docs, stemmed, tuple(values), values, True,
                 read_blocks(spark, path) if has("blocks") else None, spark.read.parquet(f"{path}/lists") if listed else None,
                 read_wide(spark, path) if listed else None, read_grams(spark, path) if has("grams") else None, tuple(text_fields))


def compact_index(spark: SparkSession, src: str, dst: str, partitions: int, docs: DataFrame) -> Index:
    """Rewrite postings into `partitions` term-ranged, sorted files, or as
    many more as it takes for one to hold about FILE_POSTINGS rows, so that what a
    task sorts does not follow the size of the index."""
    idx = read_index(spark, src, docs)
    rows = idx.vocab.agg(F.sum("df")).first()[0] or 0  # one number
    write_index(idx, dst, max(partitions, -(-rows // FILE_POSTINGS)))
    return read_index(spark, dst, docs)


def delete_from_index(index: Index, doc_ids: DataFrame) -> Index:
    """Drop documents (doc_id frame) from postings; vocab and stats are
    recomputed from what is left."""
    post = index.postings.join(doc_ids.select("doc_id"), "doc_id", "left_anti")
    docs = index.docs.join(doc_ids.select("doc_id"), "doc_id", "left_anti")
    vocab = post.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    lengths = None if index.lengths is None else index.lengths.join(doc_ids.select("doc_id"), "doc_id", "left_anti")
    per_doc = (post if lengths is None else lengths).groupBy("field", "doc_id").agg(F.max("dl").alias("dl"))
    stats = (per_doc.groupBy("field").agg(F.sum("dl").alias("sum_dl"))
             .select("field", n_docs.alias("n_docs"), "sum_dl", (F.col("sum_dl") / n_docs).alias("avgdl")))
    return Index(post, vocab, stats, docs, index.stemmed, index.fields, text_fields=index.text_fields, lengths=lengths)


def clear_index(index: Index) -> Index:
    """The index without any document."""
    empty = [df.filter(F.lit(False)) for df in (index.postings, index.vocab, index.stats, index.docs)]
    return Index(*empty, index.stemmed, index.fields, text_fields=index.text_fields)


def index_stats(index: Index) -> DataFrame:
    """Documents, fields, terms, postings, last modified (one row)."""
    p = index.postings.agg(F.count(F.lit(1)).alias("n_postings"),
                           F.count_distinct("field").alias("n_fields"))
    v = index.vocab.agg(F.count(F.lit(1)).alias("n_terms"))
    d = index.docs.agg(F.count(F.lit(1)).alias("n_documents"),
                       F.max("modified_at").alias("last_modified"))
    return d.select("n_documents", "last_modified", p.select("n_fields").scalar().alias("n_fields"),
                    v.select("n_terms").scalar().alias("n_terms"),
                    p.select("n_postings").scalar().alias("n_postings"))


def write_store(docs: DataFrame, path: str, rows_per_file: int = 2000, row_group_bytes: int = 1 << 20) -> None:
    """The document store next to the index: the document rows written once,
    range-partitioned and sorted by doc_id with small row groups, so that
    fetching a result page (`doc_id IN (...)`) reads a few row groups
    instead of every text. `rows_per_file` only sizes files; the range
    partitioner keeps doc_id ranges disjoint across them."""
    spark = docs.sparkSession
    n = docs.select(F.count(F.lit(1))).first()[0]
    parts = max(1, -(-n // rows_per_file))
    (docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
     .write.mode("overwrite").option("parquet.block.size", row_group_bytes).parquet(path))
    del spark


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
