"""License scan by a positional index of rare words.

The index holds postings of every template word: the templates and positions
that it stands at. IDFs of licence words are counted over all documents.

1. A file that holds every word of a template's mandatory key phrases looks up
   the highest-IDF words of that template that it holds: as many as make sure
   that one of them is of the longest key phrase, so no place is missed.
2. Postings turn their places into relative positions (file position minus
   template position); places where these fall into one window are looked at.
3. There every mandatory key phrase must stand, and enough distinct words of
   the template must agree with the place. The score is the share of the
   template's words, by IDF, that stand near.

Each template has its own words, so a file may hold any number of licences.
Base phrases are short templates that hold where all their words stand at
their relative positions.

Defined cases: null text is empty; texts without licence words have empty
labels and score 0; words are ranked by IDF and none is too frequent to be
looked up, so a licence that every file carries is found, also in a table of
one file; a null doc_id stays null; repeated rows are documents of
their own; other columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import LOWER, WORD, SpanHash, ragged, runs, slices, stored, text_buffers

# Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Passages of public licences, and the phrases that must stand in a file.
TEMPLATES = {
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "deal in the software without restriction")),
    "bsd-text": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met redistributions of source code must retain the above copyright notice this list of "
        "conditions and the following disclaimer",
        ("redistribution and use in source and binary forms", "redistributions of source code must retain")),
    "apache-notice": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at",
        ("licensed under the apache license", "except in compliance with the license")),
    "gpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version",
        ("you can redistribute it and or modify it", "terms of the gnu general public license")),
    "lgpl-notice": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
        "general public license as published by the free software foundation either version",
        ("you can redistribute it and or modify it", "gnu lesser general public license")),
    "mpl-notice": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at",
        ("this source code form is subject to the terms of the mozilla public license",)),
    "isc-text": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify and or distribute this software", "with or without fee is hereby granted")),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish "
        "use compile sell or distribute this software",
        ("free and unencumbered software released into the public domain",)),
    "cc-by-notice": (
        "this work is licensed under a creative commons attribution 4 0 international license",
        ("creative commons attribution",)),
    "cc0-notice": (
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        ("waived all copyright and related or neighboring rights",)),
}

MIN_VOTES = 4        # words that must agree on a relative position
SLACK = 6            # words by which a file may depart from the template


class Index:
    """Vocabulary of all templates, their words and postings."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        texts = [t for t, _ in templates.values()] + [p for _, ps in templates.values() for p in ps] + list(base)
        self.vocab = sorted({w for t in texts for w in t.split()})
        number = {w: i for i, w in enumerate(self.vocab)}
        code = lambda t: np.array([number[w] for w in t.split()])
        raw = np.frombuffer(" ".join(self.vocab).encode(), np.uint8)
        start, end = runs(raw != 32, np.array([0, len(raw)]))
        hashed = SpanHash(raw, LOWER)(start, end)
        self.order = np.argsort(hashed)
        self.hashes = hashed[self.order]
        self.base = [(code(p), label) for p, label in base.items()]
        self.templates = [(label, code(t), [(code(p), t.split().index(p.split()[0])) for p in ps]) for label, (t, ps) in templates.items()]
        # postings: of each template, its distinct words, where each one's positions begin, and the positions
        self.postings = []
        for _, template, _ in self.templates:
            order = np.argsort(template, kind="stable")
            distinct, begin = np.unique(template[order], return_index=True)
            self.postings.append((distinct, np.append(begin, len(template)), order))

    def words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(vocabulary number of every word or -1, first word of each document)."""
        data, off = text_buffers(column)
        start, end = runs(WORD[data], off)
        h = SpanHash(data, LOWER)(start, end)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.order[at], -1), np.searchsorted(start, off)


def document_frequencies(docs: DataFrame, index: Index) -> tuple[np.ndarray, int]:
    """In how many documents each licence word stands, and the number of documents: one row of counts a task."""

    def count(batches):
        total, n = np.zeros(len(index.vocab), np.int64), 0
        for b in slices(batches, "text"):
            words, first = index.words(b["text"])
            doc = np.repeat(np.arange(b.num_rows), np.diff(first))
            hit = words >= 0
            both = np.unique(doc[hit] * len(index.vocab) + words[hit])
            total += np.bincount(both % len(index.vocab), minlength=len(index.vocab))
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64())), pa.array([n], pa.int64())], ["df", "n"])

    rows = stored(docs.select("text").mapInArrow(count, "df array<long>, n long"), "op10-df")
    n = rows.agg(F.sum("n")).first()[0] or 0
    df = np.zeros(len(index.vocab), np.int64)
    for r in rows.select(F.posexplode("df").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("c")).collect():  # the templates' vocabulary
        df[r["i"]] = r["c"]
    return df, n


def _runs_at(words: np.ndarray, limit: np.ndarray, phrase: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Starts of a phrase, looked up by its highest-IDF word; limit: end of each word's document."""
    lead = int(np.argmax(idf[phrase]))
    start = np.flatnonzero(words == phrase[lead]) - lead
    start = start[start >= 0]
    start = start[(start + len(phrase) <= limit[start]) & (limit[start] == limit[np.minimum(start + lead, len(words) - 1)])]
    for j, w in enumerate(phrase.tolist()):
        start = start[words[start + j] == w]
    return start


def _share(kinds: np.ndarray, near: np.ndarray, idf: np.ndarray) -> float:
    """The part of a template's words, weighted by IDF, that stand near; unweighted where every document has all of those."""
    held = np.isin(kinds, near)
    weight = idf[kinds] if idf[kinds[held]].any() else np.ones(len(kinds))
    return float(weight[held].sum() / weight.sum())


def _rare_places(words: np.ndarray, first: np.ndarray, index: Index, idf: np.ndarray):
    """(template, document, relative positions of its rarest words there), for documents that hold all words of the
    template's key phrases."""
    licence = np.flatnonzero(words >= 0)
    doc = np.searchsorted(first, licence, "right") - 1
    holds = np.zeros((len(first) - 1, len(index.vocab)), bool)
    holds[doc, words[licence]] = True
    for k, (_, _, keys) in enumerate(index.templates):
        must = np.unique(np.concatenate([phrase for phrase, _ in keys]))
        docs = np.flatnonzero(holds[:, must].all(axis=1))
        if not len(docs):
            continue
        distinct, begin, at = index.postings[k]
        ranked = np.argsort(-idf[distinct], kind="stable")
        lookups = len(distinct) - max(len(np.unique(phrase)) for phrase, _ in keys) + 1
        held = holds[docs][:, distinct[ranked]]
        rare = np.zeros(held.shape, bool)
        rare[:, ranked] = held & (np.cumsum(held, axis=1) <= lookups)  # back in the order of `distinct`
        row = np.full(len(first) - 1, -1)
        row[docs] = np.arange(len(docs))
        slot = np.full(len(index.vocab), -1)
        slot[distinct] = np.arange(len(distinct))
        mine = np.flatnonzero((row[doc] >= 0) & (slot[words[licence]] >= 0))
        mine = mine[rare[row[doc[mine]], slot[words[licence[mine]]]]]
        entry = slot[words[licence[mine]]]
        count = np.diff(begin)[entry]
        relative = np.repeat(licence[mine] - first[doc[mine]], count) - at[ragged(begin[entry], count)]
        owner = np.repeat(doc[mine], count)
        cut = np.searchsorted(owner, docs)
        for i, d in enumerate(docs.tolist()):
            yield k, d, relative[cut[i]:cut[i + 1] if i + 1 < len(docs) else None]


def _template_score(words: np.ndarray, relative: np.ndarray, k: int, index: Index, idf: np.ndarray) -> float | None:
    """The score of a template in one document's words, by the relative positions of its rarest words; None if it is not there."""
    _, template, keys = index.templates[k]
    best, n = None, len(words)
    need = min(MIN_VOTES, *(len(np.unique(phrase)) for phrase, _ in keys))
    # windows of relative positions that hold a rare word, from `place * SLACK` on
    place = np.unique(np.floor_divide(relative[:, None], SLACK) + np.arange(-3, 2))
    lo, hi = (place - 1) * SLACK, (place + 3) * SLACK
    end = np.full(n, n)
    for phrase, q in keys:  # where every key phrase stands
        x = _runs_at(words, end, phrase, idf) - q
        some = np.searchsorted(x, lo, "left") < np.searchsorted(x, hi, "right")
        place, lo, hi = place[some], lo[some], hi[some]
    for first, a, z in zip((place * SLACK).tolist(), lo.tolist(), hi.tolist(), strict=True):
        spot = first + np.arange(len(template))[:, None] + np.arange(2 * SLACK)
        agree = (words[np.clip(spot, 0, n - 1)] == template[:, None]) & (spot >= 0) & (spot < n)
        if len(np.unique(template[agree.any(axis=1)])) >= need:
            best = max(best or 0.0, _share(np.unique(template), words[max(0, a):max(0, z + len(template))], idf))
    return best


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per document."""
    index = Index(templates, base)
    df, n = document_frequencies(docs, index)
    idf = np.log((n + 1) / (df + 1.0))

    def run(batches):
        for b in slices(batches, "text"):
            words, first = index.words(b["text"])
            limit = np.repeat(first[1:], np.diff(first))
            rows = b.num_rows
            n_base, low, high, labels = np.zeros(rows, np.int64), np.full(rows, 1 << 62), np.full(rows, -1), [set() for _ in range(rows)]
            for phrase, label in index.base:
                start = _runs_at(words, limit, phrase, idf)
                doc = np.searchsorted(first, start, "right") - 1
                np.add.at(n_base, doc, 1)
                np.minimum.at(low, doc, start - first[doc])
                np.maximum.at(high, doc, start - first[doc])
                for d in np.unique(doc).tolist():
                    labels[d].add(label)
            base_labels = [",".join(sorted(x)) for x in labels]
            score = np.where(n_base > 0, 1.0, 0.0)
            for k, d, relative in _rare_places(words, first, index, idf):
                s = _template_score(words[first[d]:first[d + 1]], relative, k, index, idf)
                if s is not None:
                    labels[d].add(index.templates[k][0])
                    score[d] = max(score[d], s)
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(np.diff(first), pa.int64()), pa.array(n_base, pa.int64()), pa.array(low, pa.int64(), mask=none),
                 pa.array(high, pa.int64(), mask=none), pa.array(base_labels, pa.string()),
                 pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array(np.minimum(score, 1.0))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
