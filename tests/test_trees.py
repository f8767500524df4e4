"""Category walks against a plain walk, with deep chains, cycles and missing parents."""

import random

from folio.operators import taxonomy as T

SCHEMA = "id string, name string, parent_id string, ord int"


def walk(rows):
    """(tree, ancestors) by following parents one at a time."""
    parent, name = {r[0]: r[2] for r in rows}, {r[0]: r[1] for r in rows}
    tree, above = {}, {}
    for i in parent:
        seen, at = [], i
        while at in parent and at not in seen:
            seen.append(at)
            at = parent[at]
        above[i] = seen
        if at is None:
            tree[i] = (len(seen) - 1, "/".join(name[x] for x in reversed(seen)), seen[-1])
    return tree, above


def check(spark, rows, edges):
    cats = spark.createDataFrame(rows, SCHEMA)
    tree, above = walk(rows)
    got = {r["id"]: (r["depth"], r["path"], r["root_id"]) for r in T.category_tree(spark, cats).collect()}
    assert got == tree
    direct = {}
    for d, c in set(edges):
        direct[c] = direct.get(c, 0) + 1
    want = {i: [direct.get(i, 0), 0] for i in above}
    for i, up in above.items():
        for a in up:
            want[a][1] += direct.get(i, 0)
    counts = T.category_counts(spark, cats, spark.createDataFrame(edges, "doc_id long, category_id string"))
    assert {r["id"]: [r["direct"], r["subtree"]] for r in counts.collect()} == want


def test_random_tree(spark):
    rng = random.Random(5)
    rows = [(f"c{i}", f"n{i}", f"c{rng.randrange(max(0, i - 8), i)}" if i and rng.random() < 0.98 else None, i) for i in range(400)]
    check(spark, rows, [(d, f"c{rng.randrange(400)}") for d in range(900)])


def test_cycles_and_missing_parents(spark):
    rows = [("a", "A", "c", 0), ("b", "B", "a", 0), ("c", "C", "b", 0), ("d", "D", "b", 0), ("e", "E", "d", 0), ("s", "S", "s", 0),
            ("r", "R", None, 0), ("k", "K", "r", 0), ("o", "O", "gone", 0), ("p", "P", "o", 0), ("t", "T", "s", 0)]
    check(spark, rows, [(1, "a"), (2, "a"), (2, "c"), (3, "e"), (4, "k"), (5, "p"), (6, "s"), (7, "t"), (7, "t"), (8, "nowhere")])


def test_deep_chain(spark):
    rows = [(f"c{i}", "x", f"c{i - 1}" if i else None, i) for i in range(20_000)]
    counts = T.category_counts(spark, spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, f"c{i}") for i in range(0, 20_000, 10)], "doc_id long, category_id string"))
    got = {r["id"]: r["subtree"] for r in counts.collect()}
    assert len(got) == 20_000 and got["c0"] == 2000 and got["c19990"] == 1 and got["c19991"] == 0 and got["c10000"] == 1000
