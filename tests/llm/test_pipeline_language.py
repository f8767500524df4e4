"""What the language stage rejects and keeps does not hang on the number of languages."""

import random

import corpus_pipeline as P
from folio.llm import op7_language
from tests.llm.test_operators import DOC

WORDS = {
    "en": "the thing other water with house walking under brother night and there which should because people through little".split(),
    "de": "der nicht schön straße über wasser zwischen auch lichkeit haus und dort welche sollte weil leute durch kleine".split(),
    "fr": "le chose autre eau avec maison marcher sous frère nuit et voilà lequel devrait parce gens travers petit".split(),
    "es": "el cosa otro agua con casa caminar bajo hermano noche y allí cual debería porque gente través pequeño".split(),
}


def corpus(spark, langs):
    """Rows of kind 0 in one language, 1 half in each of two, 2 of letters at random, 3 without letters."""
    rng, rows = random.Random(8), []
    pick = lambda lang, n: [rng.choice(WORDS[lang]) for _ in range(n)]
    for i in range(60 * len(langs)):
        rows.append((" ".join(pick(langs[i % len(langs)], 60)), langs[i % len(langs)], 0))
    for i in range(60):
        both = pick("en", 30) + pick("de", 30)
        rows.append((" ".join(both if i % 2 else rng.sample(both, 60)), None, 1))
        rows.append((" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(60)), None, 2))
    rows += [("123 456!", None, 3), (None, "en", 3), ("", None, 3)]
    return spark.createDataFrame([(i, t, lang, "s", 0, "", "", kind) for i, (t, lang, kind) in enumerate(rows)], DOC)


def test_mixed_stays_and_gibberish_goes(spark):
    for langs in (["en", "de"], ["en", "de", "fr", "es"]):
        docs = corpus(spark, langs)
        kept = dict(P.STAGES)["language_id"](spark, docs, None).groupBy("keys").count().collect()
        assert {r["keys"]: r["count"] for r in kept} == {0: 60 * len(langs), 1: 60}, langs
        if hasattr(op7_language, "rejected"):
            assert {r["cause"]: r["n"] for r in op7_language.rejected(docs).collect()} == {"no letter": 3, "unlike the languages": 60}
