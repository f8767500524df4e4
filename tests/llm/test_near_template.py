"""Near dedup of a corpus in which all documents share a template."""

import random

from folio.llm import op1_near
from tests.llm.test_operators import DOC, by_id


def test_op1_pairs_within_a_template(spark):
    rng, word = random.Random(6), iter(range(10**6))
    fresh = lambda n: [f"w{next(word)}" for _ in range(n)]
    template, texts = fresh(244), []
    for _ in range(200):  # pairs of similarity 0.83, at 0.65 to all others
        shared = fresh(8)
        texts += [" ".join(template + shared + fresh(6)) for _ in range(2)]
    order = list(range(400))
    rng.shuffle(order)
    docs = spark.createDataFrame([(order[i], t, None, None, 0, "", "", 0) for i, t in enumerate(texts)], DOC)
    got = by_id(op1_near.near_classes(docs))
    want = {order[i]: min(order[i], order[i ^ 1]) for i in range(400)}
    wrong = [k for k, c in want.items() if got[k]["class_id"] != c]
    assert not wrong, len(wrong)
