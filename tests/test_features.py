"""Watcher, monitor, health and export contract (E*, W*, H*, O*)."""

import datetime as dt
import os

from pyspark.sql import functions as F

from folio.operators import export as O
from folio.operators import stats as S
from folio.streaming import stream_ops as E

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def test_debounce_keeps_last(spark):
    ev = spark.createDataFrame([(1, "modified", "/a", None, T0 + dt.timedelta(milliseconds=100), 1.0),
                                (2, "modified", "/a", None, T0 + dt.timedelta(milliseconds=300), 2.0),
                                (3, "modified", "/a", None, T0 + dt.timedelta(milliseconds=600), 3.0)],
                               "event_id long, type string, path string, old_path string, ts timestamp_ntz, value double")
    out = S.latest_per_key(ev, "path", "1 second").collect()
    assert len(out) == 1 and out[0]["event_id"] == 3


def test_apply_events_flows(spark):
    state = E.empty_state(spark)
    ev = spark.createDataFrame([
        (1, "created", "/a.md", None, T0, 1.0),
        (2, "modified", "/b.md", None, T0 + dt.timedelta(seconds=1), 2.0),   # unknown path -> create
        (3, "created", "/c.md", None, T0 + dt.timedelta(seconds=2), 3.0),
        (4, "deleted", "/c.md", None, T0 + dt.timedelta(seconds=3), 4.0),
    ], "event_id long, type string, path string, old_path string, ts timestamp_ntz, value double")
    s1 = E.apply_events(state, ev)
    assert sorted(r["path"] for r in s1.collect()) == ["/a.md", "/b.md"]
    mv = spark.createDataFrame([(5, "moved", "/z.md", "/a.md", T0 + dt.timedelta(seconds=5), 5.0)],
                               "event_id long, type string, path string, old_path string, ts timestamp_ntz, value double")
    s2 = {r["path"]: r for r in E.apply_events(s1, mv).collect()}
    old_id = {r["path"]: r["id"] for r in s1.collect()}["/a.md"]
    assert set(s2) == {"/b.md", "/z.md"} and s2["/z.md"]["id"] == old_id


def test_metric_stats_and_history(spark):
    m = spark.createDataFrame([(i, "cpu", v, "%", T0 + dt.timedelta(seconds=i)) for i, v in enumerate([100.0, 150.0, 200.0])],
                              "event_id long, name string, value double, unit string, ts timestamp_ntz")
    r = S.metric_history(m).first()
    assert (r["count"], r["min"], r["max"], r["avg"]) == (3, 100.0, 200.0, 150.0)
    h = spark.createDataFrame([(i, "m", float(i), "x", T0 + dt.timedelta(seconds=i)) for i in range(10)],
                              "event_id long, name string, value double, unit string, ts timestamp_ntz")
    kept = S.top_k_per_group(h, ["name"], [F.col("ts").desc(), F.col("event_id").desc()], 5)
    assert sorted(r["value"] for r in kept.collect()) == [5.0, 6.0, 7.0, 8.0, 9.0]


def test_threshold_checks(spark):
    m = spark.createDataFrame([(1, "cpu", 95.0, "%", T0), (2, "mem", 50.0, "%", T0)],
                              "event_id long, name string, value double, unit string, ts timestamp_ntz")
    checks = {r["name"]: r["healthy"] for r in S.threshold_checks(m).collect()}
    assert checks == {"cpu": False, "mem": True}
    assert S.overall_health(S.threshold_checks(m)).first()["healthy"] is False


def test_exports(spark, tmpdir_path):
    d = spark.createDataFrame([(1, "i1", "T", "/p.md", "markdown", 10, T0, T0, "body", "cat", ["x"])],
                              "doc_id long, id string, title string, path string, format string, size long, "
                              "created_at timestamp_ntz, modified_at timestamp_ntz, content string, category string, "
                              "tags array<string>")
    O.write_csv(d, os.path.join(tmpdir_path, "csv"))
    text = "".join(open(os.path.join(tmpdir_path, "csv", f)).read()
                   for f in os.listdir(os.path.join(tmpdir_path, "csv")) if f.endswith(".csv"))
    assert text.splitlines()[0] == ",".join(O.CSV_COLUMNS)
    md = d.select(O.markdown_render(d)).first()[0]
    assert "## T" in md and "**Path**: `/p.md`" in md
    html = d.select(O.html_render(d)).first()[0]
    assert "<h2>T</h2>" in html
    assert d.select(O.markdown_to_html(F.lit("# A\n\n**b**"))).first()[0] == "<p><h1>A</h1></p><p><strong>b</strong></p>"


def test_watch_directory_stream(spark, tmpdir_path):
    import os
    from folio.session import scratch_path
    root = os.path.join(tmpdir_path, "watched")
    os.makedirs(os.path.join(root, "sub"))
    for rel, text in {"a.md": "# A\n", "b.txt": "plain", "sub/c.py": "x = 1\n", "skip.tmp": "x"}.items():
        with open(os.path.join(root, rel), "w") as f:
            f.write(text)
    out = E.run_available_now(E.watch_directory(spark, root), "test-watch")
    got = spark.read.parquet(out)
    assert sorted(os.path.basename(r["path"]) for r in got.collect()) == ["a.md", "b.txt", "c.py"]
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/"))


def test_query_log_classification(spark):
    from folio.operators import suggest as G
    log = spark.createDataFrame([('"exact words"',), ("title:readme",), ("doc*",), ("typo~1",),
                                 ("a && b",), ("modified_at:[a TO b]",), ("plain words",)], "query string")
    rows = {r["query"]: r for r in G.classify_queries(log).collect()}
    assert rows['"exact words"']["is_phrase"] and not rows['"exact words"']["is_advanced"]
    assert rows["title:readme"]["is_field"] and rows["title:readme"]["is_advanced"]
    assert rows["doc*"]["is_wildcard"] and rows["typo~1"]["is_fuzzy"]
    assert rows["a && b"]["normalized"] == "a AND b" and rows["a && b"]["is_boolean"]
    assert rows["modified_at:[a TO b]"]["is_range"]
    assert not any(rows["plain words"][f"is_{k}"] for k in ("phrase", "field", "wildcard", "fuzzy", "range", "boolean"))
    ff = G.facet_fields(log).filter("query = 'title:readme'").first()["facet_fields"]
    assert ff == ["format", "category", "tags", "status", "year", "title"]


def test_change_log_over_several_batches(spark, tmpdir_path):
    import os
    import time as _t
    from folio.session import scratch_path
    src = os.path.join(tmpdir_path, "ev")
    schema = "event_id long, type string, path string, old_path string, ts timestamp_ntz, value double"
    batches = [
        [(1, "created", "/a.md", None, T0, 1.0), (2, "created", "/b.md", None, T0 + dt.timedelta(seconds=1), 2.0)],
        [(3, "moved", "/z.md", "/a.md", T0 + dt.timedelta(seconds=2), 3.0), (4, "modified", "/b.md", None, T0 + dt.timedelta(seconds=3), 4.0)],
        [(5, "deleted", "/b.md", None, T0 + dt.timedelta(seconds=4), 5.0), (6, "modified", "/c.md", None, T0 + dt.timedelta(seconds=5), 6.0)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(os.path.join(src, "events.parquet"))
        _t.sleep(1.1)
    log = E.ChangeLog(spark, scratch_path(spark, "test-log"), E.empty_touches(spark))
    E.run_available_now(E.table_stream(spark, src, "events"), "test-log", foreach_batch=E.change_log_sink(log))
    assert log.read().select("batch").distinct().count() == 3
    got = {r["path"]: (r["id"], r["value"]) for r in E.current_state(log).collect()}
    want = {r["path"]: r["value"] for r in
            E.apply_events(E.empty_state(spark), spark.createDataFrame([x for b in batches for x in b], schema)).collect()}
    assert {p: v for p, (_, v) in got.items()} == want == {"/z.md": 3.0, "/c.md": 6.0}
    import hashlib
    assert got["/z.md"][0] == hashlib.md5(b"/a.md").hexdigest()  # the move kept the id of /a.md


def test_change_log_compaction(spark, tmpdir_path):
    from folio.session import scratch_path
    schema = "event_id long, type string, path string, old_path string, ts timestamp_ntz, value double"
    log = E.ChangeLog(spark, scratch_path(spark, "test-compact"), E.empty_touches(spark))
    sink = E.change_log_sink(log)
    sink(spark.createDataFrame([(1, "created", "/a.md", None, T0, 1.0), (2, "created", "/b.md", None, T0, 2.0)], schema), 0)
    sink(spark.createDataFrame([(3, "deleted", "/a.md", None, T0 + dt.timedelta(seconds=1), 3.0)], schema), 1)
    before = sorted(map(tuple, E.current_state(log).collect()))
    E.compact_state(log, 1)
    assert sorted(map(tuple, E.current_state(log).collect())) == before
    sink(spark.createDataFrame([(4, "moved", "/c.md", "/b.md", T0 + dt.timedelta(seconds=2), 4.0)], schema), 2)
    after = {r["path"]: r["value"] for r in E.current_state(log).collect()}
    assert after == {"/c.md": 4.0}


def test_polling_watch_over_two_roots(spark, tmpdir_path):
    """Added, changed and deleted files of two roots arrive as documents by format, in order of the listings."""
    import os
    from folio.session import scratch_path
    from folio.sources.folders import FolderWatch
    roots = [os.path.join(tmpdir_path, r) for r in ("one", "two")]

    def put(root, rel, text):
        path = os.path.join(roots[root], rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        open(path, "w").write(text)

    put(0, "sub/a.md", "# First\nbody")
    put(1, "_b.py", '"""Does things."""\n')
    put(1, ".hidden/c.md", "# No")
    base = scratch_path(spark, "test-poll")
    watch = FolderWatch(spark, roots, f"{base}/versions")

    def seen():
        out = E.run_available_now(watch.documents().select("version", "change", "path", "title"), "test-poll", base=base)
        return sorted((r["version"], r["change"], os.path.relpath(r["path"], tmpdir_path), r["title"]) for r in spark.read.parquet(out).collect())

    assert watch.poll() == 1
    assert seen() == [(1, "added", "one/sub/a.md", "First"), (1, "added", "two/_b.py", "Does things.")]
    put(0, "sub/a.md", "# Second, longer\nbody")
    os.remove(os.path.join(roots[1], "_b.py"))
    put(1, "n.txt", "plain")
    assert (watch.poll(), watch.poll()) == (2, 3)  # nothing changed between the last two
    rows = seen()[2:]
    assert [r[:3] for r in rows] == [(2, "added", "two/n.txt"), (2, "deleted", "two/_b.py"), (2, "modified", "one/sub/a.md")]
    assert rows[2][3] == "Second, longer"
