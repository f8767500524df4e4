"""Ids of documents over moves: against an event-by-event replay, for any split into batches."""

import datetime as dt
import hashlib
import random

from folio.session import scratch_path
from folio.streaming import stream_ops as E

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, type string, path string, old_path string, ts timestamp_ntz, value double"


def replay(events):
    held = {}
    fresh = lambda p: hashlib.md5(p.encode()).hexdigest()
    for event_id, kind, path, old, _, value in sorted(events, key=lambda e: (e[4], e[0])):
        if kind == "deleted":
            held.pop(path, None)
        elif kind == "moved":
            before = held.pop(old, None)
            held[path] = (before[0] if before else fresh(path), value)
        else:
            held[path] = (held[path][0] if path in held else fresh(path), value)
    return held


def state(spark, batches, compact_after=None):
    log = E.ChangeLog(spark, scratch_path(spark, "test-ids"), E.empty_touches(spark))
    sink = E.change_log_sink(log)
    for i, rows in enumerate(batches):
        sink(spark.createDataFrame(rows, SCHEMA), i)
        if i == compact_after:
            E.compact_state(log, i)
    return {r["path"]: (r["id"], r["value"]) for r in E.current_state(log).collect()}


def some_events(seed, n):
    rng, out = random.Random(seed), []
    for i in range(n):
        kind = rng.choice(["created", "modified", "deleted", "moved", "moved"])
        a, b = rng.sample("abcdef", 2)
        out.append((i, kind, f"/{a}", f"/{b}" if kind == "moved" else None, T0 + dt.timedelta(seconds=rng.randrange(n)), float(i)))
    return out


def test_random_events_in_one_and_five_batches(spark):
    for seed in (1, 2):
        events = some_events(seed, 120)
        want = replay(events)
        assert want and state(spark, [events]) == want
        rng = random.Random(seed)
        dealt = [[] for _ in range(5)]
        for e in events:
            dealt[rng.randrange(5)].append(e)
        assert state(spark, dealt) == want


def test_ring_of_moves_and_compaction(spark):
    s = lambda i: T0 + dt.timedelta(seconds=i)
    events = [(1, "created", "/a", None, s(1), 1.0), (2, "moved", "/b", "/a", s(2), 2.0), (3, "moved", "/c", "/b", s(3), 3.0),
              (4, "moved", "/a", "/c", s(4), 4.0), (5, "modified", "/a", None, s(5), 5.0), (6, "moved", "/x", "/none", s(6), 6.0)]
    want = {"/a": (hashlib.md5(b"/a").hexdigest(), 5.0), "/x": (hashlib.md5(b"/x").hexdigest(), 6.0)}
    assert replay(events) == want
    assert state(spark, [events]) == want
    assert state(spark, [[e] for e in events], compact_after=3) == want
    chain = [(0, "created", "/p0", None, s(0), 0.0)] + [(i, "moved", f"/p{i}", f"/p{i - 1}", s(i), float(i)) for i in range(1, 40)]
    assert state(spark, [chain[:17], chain[17:]], compact_after=0) == {"/p39": (hashlib.md5(b"/p0").hexdigest(), 39.0)}


def test_apply_events(spark):
    before = spark.createDataFrame([("/a", "first", T0, 1.0), ("/b", "second", T0, 2.0)], "path string, id string, last_ts timestamp_ntz, value double")
    s = lambda i: T0 + dt.timedelta(seconds=i)
    events = spark.createDataFrame([(1, "moved", "/b", "/a", s(1), 3.0), (2, "created", "/a", None, s(2), 4.0)], SCHEMA)
    got = {r["path"]: (r["id"], r["value"]) for r in E.apply_events(before, events).collect()}
    assert got == {"/b": ("first", 3.0), "/a": (hashlib.md5(b"/a").hexdigest(), 4.0)}
