"""Folders as tables: a level-by-level listing job, reads and writes of whole
files by path, and the changes between listings as a stream.

A listing starts from its roots. Every level is one Spark job: tasks list the
directories of the level, ignored names are pruned before anything below them is
listed, and the directories found are the next level. Levels are tables in
the shared folder, so the driver only sees whether a level has directories.
Bytes are read later, by path, and only for the rows that are left.

Paths are opened through pyarrow's file systems, on the driver and on
executors alike (file, s3, gs, hdfs, abfs). Local paths are for folders that all
machines share."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from folio.session import scratch_path

#: Rows of file bytes leave a task in batches of about this size.
BATCH_BYTES = 32 << 20
#: Entries of a folder that a listing holds at a time.
CHUNK = 10_000
SCHEMES = ("file", "s3", "s3a", "gs", "gcs", "hdfs", "abfs", "abfss")


def can_open(path: str) -> bool:
    """Is this a path that pyarrow's file systems open?"""
    scheme = re.match(r"^([a-z][a-z0-9+.-]*):", path)
    return scheme is None or scheme.group(1) in SCHEMES


def storage(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    if re.match(r"^(file:|/)", path) or ":" not in path.split("/")[0]:
        return fs.LocalFileSystem(), os.path.abspath(re.sub(r"^file:(//)?", "", path))
    return fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", re.sub(r"^gs:", "gcs:", path)))


# --- listing ---------------------------------------------------------------

ENTRY = pa.schema([("root", pa.string()), ("path", pa.string()), ("name", pa.string()), ("is_dir", pa.bool_()),
                   ("length", pa.int64()), ("modificationTime", pa.timestamp("us", "UTC"))])
ENTRY_DDL = "root string, path string, name string, is_dir boolean, length bigint, modificationTime timestamp"


def _entries(root: str, info, prefix: str) -> dict:
    from pyarrow import fs

    return {"root": root, "path": prefix + info.path, "name": info.base_name, "is_dir": info.type == fs.FileType.Directory,
            "length": info.size or 0, "modificationTime": info.mtime}


def _prefix(path: str) -> str:
    """What Spark writes before a path of this file system."""
    return "file:" if storage(path)[0].type_name == "local" else re.match(r"^[^:]*://[^/]*/?", path).group(0).rstrip("/") + "/"


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for root, path in zip(b["root"].to_pylist(), b["path"].to_pylist(), strict=True):
            system, inner = storage(path)
            prefix = _prefix(path)
            for found in _chunks(system, inner):
                yield pa.RecordBatch.from_pylist([_entries(root, x, prefix) for x in found], ENTRY)


def _chunks(system, folder: str) -> Iterator[list]:
    """The entries of a folder, at most CHUNK at a time; a local folder is read on as they are taken, so a task's memory
    does not follow its size. Links to directories are left out: they may form rings."""
    from pyarrow import fs

    if system.type_name != "local":
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        for a in range(0, len(found), CHUNK):
            yield found[a:a + CHUNK]
        return
    try:
        entries = os.scandir(folder)
    except FileNotFoundError:
        return
    with entries:
        while names := [e.path for e in islice(entries, CHUNK)]:
            found = [x for x in system.get_file_info(names) if x.type != fs.FileType.NotFound]
            if kept := [x for x in found if not (x.type == fs.FileType.Directory and os.path.islink(x.path))]:
                yield kept


def list_tree(spark: SparkSession, roots, recursive: bool = True, ignore=(), parallelism: int | None = None) -> DataFrame:
    """(root, path, length, modificationTime) of all files below the roots,
    each path once. `ignore` globs prune directories before they are listed.
    A root may be a file. A missing root lists nothing; links to directories
    are not followed."""
    from pyarrow import fs

    from folio.sources.files import ignored

    roots = [roots] if isinstance(roots, str) else list(roots)
    start, files = [], []
    for r in roots:
        system, inner = storage(r)
        info = system.get_file_info([inner])[0]
        if info.type == fs.FileType.Directory:
            start.append((r, _prefix(r) + inner))
        elif info.type == fs.FileType.File:
            files.append(_entries(r, info, _prefix(r)))
    tasks = parallelism or spark.sparkContext.defaultParallelism
    keep = ~ignored(F.col("name"), ignore) & ~_whole(ignore) if ignore else F.lit(True)
    level = spark.createDataFrame(sorted(set(start)), "root string, path string")
    found = [spark.createDataFrame(pa.Table.from_pylist(files, ENTRY).to_pylist(), ENTRY_DDL).filter(keep)] if files else []
    while start:
        path = scratch_path(spark, "listing-level")
        level.repartition(tasks).mapInArrow(_listed, ENTRY_DDL).filter(keep).write.parquet(path)
        listed = spark.read.schema(ENTRY_DDL).parquet(path)
        found.append(listed.filter("not is_dir"))
        level = listed.filter("is_dir").select("root", "path").dropDuplicates(["path"])
        if not recursive or not level.limit(1).count():
            break
    if not found:
        return spark.createDataFrame([], ENTRY_DDL).select("root", "path", "length", "modificationTime")
    every = reduce(lambda a, b: a.unionByName(b), found)
    return every.select("root", "path", "length", "modificationTime").dropDuplicates(["path"])


def _whole(globs) -> Column:
    """A glob on the whole path, as on names."""
    from folio.sources.files import ignore_regex, local_path

    return local_path("path").rlike(ignore_regex(globs, across=True))


def with_bytes(listing: DataFrame) -> DataFrame:
    """The listing (batch or stream) with the files' bytes as `content`; rows stream through, one file at a time. A file
    that is gone by now has no content."""
    schema = listing.schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, held, size = 0, [], 0
            for i, path in enumerate(b["path"].to_pylist()):
                system, inner = storage(path)
                try:
                    with system.open_input_stream(inner) as f:
                        held.append(f.read())
                    size += len(held[-1])
                except FileNotFoundError:
                    held.append(None)
                if size >= BATCH_BYTES or i + 1 == b.num_rows:
                    part = b.slice(a, i + 1 - a)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], [*part.schema.names, "content"])
                    a, held, size = i + 1, [], 0

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return listing.mapInArrow(read, f"{ddl}, content binary")


# --- writing ---------------------------------------------------------------

def write_files(files: DataFrame, root: str) -> int:
    """Write `files(path, content)` below `root`, one file a row, and return
    their number. A file appears under its name when it is complete, and a task
    that runs again writes the same files again."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, base = storage(root)
        for b in batches:
            made = set()
            for path, content in zip(b["path"].to_pylist(), b["content"], strict=True):  # one file's bytes at a time
                folder, name = os.path.split(f"{base}/{path.lstrip('/')}")
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                attempt = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(attempt) as f:
                    f.write(content.cast(pa.binary()).as_py() or b"")
                system.move(attempt, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    done = files.select("path", "content").mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0]
    return done or 0


def delete_files(files: DataFrame, root: str) -> int:
    """Delete `files(path)` below `root`; files that are gone already don't matter."""
    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = storage(root)
        for b in batches:
            for path in b["path"].to_pylist():
                full = f"{base}/{path.lstrip('/')}"
                if system.get_file_info([full])[0].type == fs.FileType.File:
                    system.delete_file(full)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return files.select("path").mapInArrow(delete, "n bigint").agg(F.sum("n")).first()[0] or 0


# --- changes between listings ----------------------------------------------

class FolderWatch:
    """Polling watch (E1, J8): every poll() lists the roots, writes the listing
    as the next version and the difference to the last one as its changes.
    `changes()` is a stream whose offsets are these versions."""

    def __init__(self, spark: SparkSession, roots, base: str, ignore=(".*",)):
        self.spark, self.base, self.ignore = spark, base.rstrip("/"), tuple(ignore)
        self.roots = [roots] if isinstance(roots, str) else list(roots)

    def version(self) -> int:
        return last_version(self.base)

    def poll(self) -> int:
        """List once and commit the next version; returns its number. A poll that fails half-way is overwritten by
        the next one, as only the changes' success mark counts."""
        from folio.operators.relational import snapshot_diff

        n = self.version()
        now = list_tree(self.spark, self.roots, ignore=self.ignore).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
        now.write.mode("overwrite").parquet(f"{self.base}/listing/version={n + 1}")
        now = self.spark.read.parquet(f"{self.base}/listing/version={n + 1}")
        before = self.spark.read.parquet(f"{self.base}/listing/version={n}") if n else now.filter("false")
        diff = snapshot_diff(before, now).join(now, "path", "left").select("path", "change", "size", "mtime")
        diff.write.mode("overwrite").parquet(f"{self.base}/changes/version={n + 1}")
        return n + 1

    def changes(self) -> DataFrame:
        """Streaming (version, path, change, size, mtime); change is added, modified or deleted."""
        self.spark.dataSource.register(FolderChanges)
        return self.spark.readStream.format(FolderChanges.name()).load(self.base)


    def documents(self, registry=None) -> DataFrame:
        """Streaming (version, change) and the document of every change; a deleted file, and one that is gone before it
        is read, has its path and id only."""
        from folio.sources.files import to_documents

        seen = self.changes().withColumnsRenamed({"size": "length", "mtime": "modificationTime"})
        return to_documents(with_bytes(seen), registry, keep=("version", "change"))


def last_version(base: str) -> int:
    from pyarrow import fs

    system, inner = storage(base)
    found = system.get_file_info(fs.FileSelector(f"{inner}/changes", allow_not_found=True))
    done = [int(x.base_name.split("=")[1]) for x in found if x.base_name.startswith("version=")
            and system.get_file_info([f"{x.path}/_SUCCESS"])[0].type == fs.FileType.File]
    return max(done, default=0)


class _Part(InputPartition):
    def __init__(self, path: str, version: int):
        self.path, self.version = path, version


class _ChangeReader(DataSourceStreamReader):
    """Offsets are versions of the listing; a partition is one written part of a version's changes."""

    def __init__(self, base: str):
        self.base = base

    def initialOffset(self):
        return {"version": 0}

    def latestOffset(self):
        return {"version": last_version(self.base)}

    def partitions(self, start, end):
        from pyarrow import fs

        system, inner = storage(self.base)
        parts = [_Part(x.path, v) for v in range(start["version"] + 1, end["version"] + 1)
                 for x in system.get_file_info(fs.FileSelector(f"{inner}/changes/version={v}")) if x.base_name.endswith(".parquet")]
        return parts or [_Part("", 0)]

    def read(self, partition):
        import pyarrow.parquet as pq

        if not partition.path:
            return
        system, _ = storage(self.base)
        with system.open_input_file(partition.path) as f:
            for b in pq.ParquetFile(f).iter_batches(columns=["path", "change", "size", "mtime"]):
                when = b["mtime"].cast(pa.timestamp("us", "UTC"))
                yield pa.RecordBatch.from_arrays([pa.array([partition.version] * b.num_rows, pa.int64()), b["path"], b["change"], b["size"], when],
                                                 ["version", "path", "change", "size", "mtime"])

    def commit(self, end):
        """Nothing to free: versions stay for other readers."""


class FolderChanges(DataSource):
    """The changes that a FolderWatch has written, as a stream."""

    @classmethod
    def name(cls):
        return "folio_folder_changes"

    def schema(self):
        return "version long, path string, change string, size long, mtime timestamp"

    def streamReader(self, schema):
        return _ChangeReader(self.options["path"])


# --- documents as markdown files (U4) --------------------------------------

class _FilePartition(InputPartition):
    def __init__(self, paths: list):
        self.paths = paths


class MarkdownReader(DataSourceReader):
    """Markdown files below a folder; a partition holds files of about PART_BYTES."""

    PART_BYTES = 16 << 20

    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        from pyarrow import fs

        system, inner = storage(self.root)
        parts, held, size = [], [], 0
        for x in sorted(system.get_file_info(fs.FileSelector(inner, allow_not_found=True, recursive=True)), key=lambda x: x.path):
            if x.type != fs.FileType.File or not x.base_name.lower().endswith((".md", ".markdown")) or "/." in x.path[len(inner):]:
                continue
            held.append(x.path)
            size += x.size or 0
            if size >= self.PART_BYTES:
                parts, held, size = [*parts, _FilePartition(held)], [], 0
        return [*parts, _FilePartition(held)]

    def read(self, partition):
        system, _ = storage(self.root)
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                raw = f.read()
            yield (path, raw.decode("utf-8", errors="replace"), len(raw))


class _Written(WriterCommitMessage):
    def __init__(self, attempts: list, rows: int):
        self.attempts, self.rows = attempts, rows


class MarkdownWriter(DataSourceWriter):
    """Two-phase commit: every task attempt writes files of its own in a
    staging folder, a new one after about PART_BYTES, so that a reader's row does not
    follow the size of a partition; commit() moves the files of one attempt for each
    partition to their final names, and abort() leaves nothing. With `overwrite` the
    markdown files that were there go at commit."""

    PART_BYTES = 8 << 20

    def __init__(self, root: str, overwrite: bool):
        import uuid

        self.root, self.overwrite, self.job = root, overwrite, uuid.uuid4().hex

    def _staging(self):
        system, inner = storage(self.root)
        return system, inner, f"{inner}/.staging-{self.job}"

    def write(self, iterator):
        import uuid

        system, _, staging = self._staging()
        system.create_dir(staging, recursive=True)
        attempts, n, size, f = [], 0, 0, None
        try:
            for row in iterator:
                if f is None:
                    attempts.append(f"{staging}/{uuid.uuid4().hex}.md")
                    f, size = system.open_output_stream(attempts[-1]), 0
                text = f"## {row['title']}\n\n{row['content']}\n\n---\n".encode()
                f.write(text)
                n, size = n + 1, size + len(text)
                if size >= self.PART_BYTES:
                    f.close()
                    f = None
        finally:
            if f is not None:
                f.close()
        return _Written(attempts, n)

    def commit(self, messages):
        from pyarrow import fs

        system, inner, staging = self._staging()
        system.create_dir(inner, recursive=True)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(inner)):
                if x.type == fs.FileType.File and x.base_name.endswith(".md"):
                    system.delete_file(x.path)
        for i, attempt in enumerate(a for m in messages if m is not None for a in m.attempts):
            system.move(attempt, f"{inner}/part-{i:05d}-{self.job}.md")
        self.abort(messages)

    def abort(self, messages):
        from pyarrow import fs

        system, _, staging = self._staging()
        if system.get_file_info([staging])[0].type == fs.FileType.Directory:
            system.delete_dir(staging)


class MarkdownFolder(DataSource):
    """U4: custom back end through the Python Data Source API: read a folder of
    markdown files, or write documents as markdown parts of about PART_BYTES."""

    @classmethod
    def name(cls):
        return "folio_markdown"

    def schema(self):
        return "path string, content string, size long"

    def reader(self, schema):
        return MarkdownReader(self.options["path"])

    def writer(self, schema, overwrite):
        return MarkdownWriter(self.options["path"], overwrite)
