"""Cells larger than SMALL_BAND are compared in full: their pairs equal those of all pairs."""

import random

from folio.llm.op1_near import LIKELY, _crowded


def test_large_cells_lose_no_pair(spark):
    rng = random.Random(4)
    docs = []
    for i in range(150):
        sig = [rng.randrange(1 << 20) for _ in range(30)]
        if i >= 140:  # a near copy of a document of another component
            sig[:18] = docs[i - 100][2][:18]
        docs.append((i, 0 if i < 30 else i, sig))
    docs[29][2][:20] = docs[120][2][:20]  # and one between the largest component and a stray
    cells = {"c1": range(0, 150), "c2": range(100, 150), "c3": range(30, 40)}
    rare = spark.createDataFrame([(i, hash_) for hash_, name in enumerate(cells) for i in cells[name]], "rep long, cell long")
    labels = spark.createDataFrame([(i, label) for i, label, _ in docs if i < 30], "node long, label long")
    sig = spark.createDataFrame([(i, s) for i, _, s in docs], "rep long, sig array<int>")
    want = {(a, b) for a, la, sa in docs for b, lb, sb in docs if a < b and la != lb and sum(x == y for x, y in zip(sa, sb)) >= LIKELY * 30}
    for block in (7, 2048):
        got = [tuple(r) for r in _crowded(rare, labels, sig, block=block).collect()]
        assert set(got) == want and len(got) == len(want) == 11
