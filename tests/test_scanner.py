"""File scan contract (S*) on a real directory tree."""

import os
import time

from pyspark.sql import functions as F

from folio.operators import processors as U
from folio.sources import files as S


def make_tree(root):
    files = {"readme.md": "# Readme\n", "notes.txt": "plain", "data.json": '{"a": 1}',
             "conf.yaml": "a: 1\n", "tool.py": '"""Tool."""\n', "scratch.tmp": "x",
             "sub/inner.md": "# Inner\n", ".git/config": "x"}
    for rel, text in files.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w") as f:
            f.write(text)
    return files


def test_flat_and_recursive(spark, tmpdir_path):
    make_tree(tmpdir_path)
    flat = S.scan(spark, tmpdir_path, recursive=False)
    rec = S.scan(spark, tmpdir_path, recursive=True)
    assert flat.count() == 5
    assert rec.count() == 6


def test_empty_and_dry_run(spark, tmpdir_path):
    os.makedirs(os.path.join(tmpdir_path, "empty"))
    assert S.list_files(spark, os.path.join(tmpdir_path, "empty")).count() == 0
    make_tree(tmpdir_path)
    dry = S.list_files(spark, tmpdir_path, with_content=False)
    # hidden folders (.git) are never listed by Spark's file index
    assert "content" not in dry.columns and dry.count() == 7
    assert S.list_files(spark, os.path.join(tmpdir_path, "missing")).count() == 0


def test_incremental(spark, tmpdir_path):
    make_tree(tmpdir_path)
    time.sleep(1.2)
    since = time.strftime("%Y-%m-%d %H:%M:%S", time.localtime(time.time() - 0.1))
    time.sleep(1.2)
    with open(os.path.join(tmpdir_path, "notes.txt"), "w") as f:
        f.write("changed")
    assert S.scan(spark, tmpdir_path, since=since).count() == 1


def test_malformed_json_kept(spark, tmpdir_path):
    with open(os.path.join(tmpdir_path, "bad.json"), "w") as f:
        f.write('{"broken": ')
    r = S.scan(spark, tmpdir_path).first()
    assert r["format"] == "json" and r["content"] == '{"broken": ' and r["status"] == "indexed"


def test_scan_extracts_by_format(spark, tmpdir_path):
    files = {"a_b.md": "intro\n# Own Title\n## Part\n", "c.md": "---\ntitle: From Block\n---\ntext\n", "d-e.md": "plain",
             "tool.py": '"""Does things.\nMore."""\nclass A:\n    pass\ndef f():\n    pass\n',
             "p.html": "<title> Page </title><script>x</script><p>Body &amp; more</p>", "notes_x.txt": "# not a header"}
    for name, text in files.items():
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write(text)
    rows = {os.path.basename(r["path"]): r for r in S.scan(spark, tmpdir_path).collect()}
    assert {k: r["title"] for k, r in rows.items()} == {
        "a_b.md": "Own Title", "c.md": "From Block", "d-e.md": "D E", "tool.py": "Does things.", "p.html": "Page",
        "notes_x.txt": "Notes X"}
    assert rows["a_b.md"]["keywords"] == ["Own Title", "Part"] and rows["tool.py"]["keywords"] == ["f", "A"]
    assert rows["notes_x.txt"]["keywords"] == [] and rows["p.html"]["content"] == "Page Body & more"
    assert rows["p.html"]["snippet"] == "Page Body & more"


def test_scan_with_a_registry(spark, tmpdir_path):
    """A custom extension gets its format, and its extractor's columns, from the scan itself."""
    for name, text in {"a.note": "Subject: Own\nbody", "b.md": "# Title\n", "c.zzz": "x"}.items():
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write(text)
    reg = U.ExtractorRegistry().register("note", "note", lambda: {"title": F.regexp_extract("content", "Subject: (.*)", 1), "n_chars": F.char_length("content")})
    rows = {os.path.basename(r["path"]): r for r in S.scan(spark, tmpdir_path, registry=reg).collect()}
    assert sorted(rows) == ["a.note", "b.md"]
    assert (rows["a.note"]["format"], rows["a.note"]["title"], rows["a.note"]["n_chars"]) == ("note", "Own", 17)
    assert (rows["b.md"]["title"], rows["b.md"]["n_chars"]) == ("Title", None)


def test_listing_levels_and_roots(spark, tmpdir_path):
    """Names that start with '_' are listed, ignored folders aren't entered, nested roots and files list once, links form no ring."""
    for rel in ("_index.md", "pkg/__init__.py", "pkg/_x/deep.md", "node/skip/a.md", ".h/b.md", "x.tmp", "pkg/long/er/way/down.txt"):
        path = os.path.join(tmpdir_path, rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        open(path, "w").write(rel)
    os.symlink(tmpdir_path, os.path.join(tmpdir_path, "pkg", "ring"))
    names = lambda **k: sorted(r["path"].split(tmpdir_path + "/")[1] for r in S.list_files(spark, [tmpdir_path, f"{tmpdir_path}/pkg", f"{tmpdir_path}/x.tmp"], **k).collect())
    assert names(ignore=(".*", "node", "*.tmp")) == ["_index.md", "pkg/__init__.py", "pkg/_x/deep.md", "pkg/long/er/way/down.txt"]
    assert names(recursive=False, with_content=False) == ["_index.md", "pkg/__init__.py", "x.tmp"]
    assert names(excludes=["long", "skip"], path_glob="*.md") == ["_index.md", "pkg/_x/deep.md"]
    got = S.list_files(spark, tmpdir_path, ignore=["node", ".*"]).filter("path like '%deep.md'").first()
    assert bytes(got["content"]) == b"pkg/_x/deep.md" and got["length"] == 14


def test_failed_write_leaves_no_file(spark, tmpdir_path):
    U.register_sources(spark)
    good = spark.createDataFrame([("t", "c")], "title string, content string")
    good.write.format("folio_markdown").mode("append").save(tmpdir_path)
    kept = sorted(os.listdir(tmpdir_path))
    assert len(kept) == 1
    bad = spark.range(8).repartition(4).select(F.lit("t").alias("title"), F.when(F.col("id") == 5, F.raise_error(F.lit("stop"))).otherwise("c").alias("content"))
    try:
        bad.write.format("folio_markdown").mode("append").save(tmpdir_path)
    except Exception:  # noqa: BLE001
        pass
    else:
        raise AssertionError("the write should fail")
    assert sorted(os.listdir(tmpdir_path)) == kept
    good.write.format("folio_markdown").mode("append").save(tmpdir_path)
    assert len(os.listdir(tmpdir_path)) == 2
    good.write.format("folio_markdown").mode("overwrite").save(tmpdir_path)
    assert len(os.listdir(tmpdir_path)) == 1


def test_decode_policies(spark, tmpdir_path):
    with open(os.path.join(tmpdir_path, "t.txt"), "wb") as f:
        f.write(b"Valid text \x80\x81 more text")
    with open(os.path.join(tmpdir_path, "m.md"), "wb") as f:
        f.write(b"# T \x80\x81")
    rows = {os.path.basename(r["path"]): r for r in S.scan(spark, tmpdir_path).collect()}
    assert "Valid text" in rows["t.txt"]["content"] and "more text" in rows["t.txt"]["content"]
    assert rows["m.md"]["status"] == "failed" and rows["m.md"]["content"] == ""


def test_ignore_globs(spark):
    df = spark.createDataFrame([("/r/.git/x",), ("/r/a/__pycache__/b.pyc",), ("/r/.github/w.yml",), ("/r/ok.md",),
                                ("/r/x.swp",)], "path string")
    kept = [r["path"] for r in df.filter(~S.ignored(F.col("path"))).collect()]
    assert kept == ["/r/ok.md"]
    kept2 = [r["path"] for r in df.filter(~S.ignored(F.col("path"), [".git"])).collect()]
    assert "/r/.github/w.yml" in kept2 and "/r/.git/x" not in kept2


def test_extension_filter(spark):
    df = spark.createDataFrame([("/a/x.MD",), ("/a/y.txt",), ("/a/z.py",)], "path string")
    got = [r["path"] for r in df.filter(S.extension_allowed(F.col("path"), ["md", ".TXT"])).collect()]
    assert got == ["/a/x.MD", "/a/y.txt"]


def test_python_data_source(spark, tmpdir_path):
    U.register_sources(spark)
    make_tree(tmpdir_path)
    got = spark.read.format("folio_markdown").load(tmpdir_path)
    assert sorted(os.path.basename(r["path"]) for r in got.collect()) == ["inner.md", "readme.md"]
