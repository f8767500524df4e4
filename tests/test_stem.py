"""Porter stemmer on examples from the published algorithm, and the stemmed index."""

from folio.functions.stem import stem_word

EXAMPLES = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat",
    "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor",
    "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
    "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit",
    "rational": "ration", "digitizer": "digit", "operator": "oper", "feudalism": "feudal",
    "hopefulness": "hope", "formaliti": "formal", "triplicate": "triplic", "electrical": "electr",
    "goodness": "good", "revival": "reviv", "allowance": "allow", "adjustment": "adjust",
    "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas",
    "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil",
}


def test_published_examples():
    assert {w: stem_word(w) for w in EXAMPLES} == EXAMPLES
