"""Language ID by a bidirectional gated recurrent network over bytes.

The network reads a segment (a run of letters, at most SEGMENT bytes, between
two spaces) in both directions and gives every byte a distribution over the
languages; a document pools the log probabilities of all its bytes. It is
trained in numpy by backpropagation through time on a bounded sample of the
labelled rows that are not held out (TRAIN_DOCS documents of each language,
TRAIN_CHARS characters of each); languages are those that the sample holds.

A segment's distributions depend on its bytes alone, so a task runs each
distinct segment of its slice once. Whole texts are read.

Defined cases: null text, or text without a letter, is `und` with score 0;
without labelled rows every text is; a null doc_id is held out; repeated rows
are documents of their own; other columns are ignored; an empty table gives an
empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import SpanHash, ragged, runs, slices, text_buffers

UND = "und"
HIDDEN, SEGMENT = 16, 22
TRAIN_DOCS, TRAIN_CHARS, TRAIN_SEGMENTS, EPOCHS = 150, 2000, 24_000, 5
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteGRU:
    """Two GRUs over bytes and a softmax on their joined states."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 7):
        rng, h = np.random.default_rng(seed), hidden
        self.h = h
        self.p = {"out": rng.normal(0, 0.3, (2 * h, classes)), "bias": np.zeros(classes)}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * h))  # a byte's part of the three gates
            self.p[f"u{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, x: np.ndarray, d: str, trace: list | None = None) -> np.ndarray:
        """States (length, batch, hidden) of one direction; x: (batch, length)."""
        h, table, u = self.h, self.p[f"x{d}"], self.p[f"u{d}"]
        steps = range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1)
        state, out = np.zeros((len(x), h), np.float32), np.empty((x.shape[1], len(x), h), np.float32)
        for t in steps:
            a, b = table[x[:, t]], state @ u
            zr = _sigmoid(a[:, :2 * h] + b[:, :2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(a[:, 2 * h:] + r * b[:, 2 * h:])
            new = n + z * (state - n)
            if trace is not None:
                trace.append((t, state, z, r, n, b[:, 2 * h:]))
            out[t] = state = new
        return out

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(length, batch, classes) for the segments x: (batch, length) uint8."""
        s = np.concatenate((self._run(x, "f"), self._run(x, "b")), axis=2) @ self.p["out"] + self.p["bias"]
        s -= s.max(axis=2, keepdims=True)
        return s - np.log(np.exp(s).sum(axis=2, keepdims=True))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of every position, by backpropagation through time."""
        h, traces = self.h, {"f": [], "b": []}
        states = np.concatenate((self._run(x, "f", traces["f"]), self._run(x, "b", traces["b"])), axis=2)
        s = states @ self.p["out"] + self.p["bias"]
        s = np.exp(s - s.max(axis=2, keepdims=True))
        ds = s / s.sum(axis=2, keepdims=True)
        ds[:, np.arange(len(y)), y] -= 1
        ds /= ds.shape[0] * ds.shape[1]
        g = {"out": np.tensordot(states, ds, ((0, 1), (0, 1))), "bias": ds.sum((0, 1))}
        back = ds @ self.p["out"].T
        for d, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u = self.p[f"u{d}"]
            gx, gu, dh = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(u), np.zeros((len(x), h), np.float32)
            for t, before, z, r, n, bn in reversed(traces[d]):
                dh = dh + back[t][:, part]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (before - n) * z * (1 - z)
                dr = dn * bn * r * (1 - r)
                np.add.at(gx, x[:, t], np.concatenate((dz, dr, dn), axis=1))
                db = np.concatenate((dz, dr, dn * r), axis=1)
                gu += before.T @ db
                dh = dh * z + db @ u.T
            g[f"x{d}"], g[f"u{d}"] = gx, gu
        return g

    def fit(self, groups: dict[int, tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, batch: int = 256, rate: float = 0.01, seed: int = 7) -> ByteGRU:
        """Adam over batches of segments of one length; groups: length -> (bytes, class)."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        step = 0
        for epoch in range(epochs):
            plan = []
            for n, (x, _) in groups.items():
                order = rng.permutation(len(x))
                plan += [(n, order[a:a + batch]) for a in range(0, len(x), batch)]
            for i in rng.permutation(len(plan)):
                n, rows = plan[i]
                step += 1
                for k, g in self.gradients(groups[n][0][rows], groups[n][1][rows]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= rate * (1 - epoch / (epochs + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self


def _segments(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the segments; runs of letters longer than SEGMENT bytes are cut."""
    start, end = runs(LETTER[data], off)
    pieces = -(-(end - start) // SEGMENT)
    if len(start) and pieces.max() > 1:
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, stop = np.repeat(start, pieces) + nth * SEGMENT, np.repeat(end, pieces)
        end = np.minimum(start + SEGMENT, stop)
    return start, end


def _matrix(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    x = np.full((len(start), length + 2), 32, np.uint8)
    x[:, 1:-1] = data[start[:, None] + np.arange(length)]
    return x


def train(texts: list[str], labels: list[str]) -> tuple[list[str], ByteGRU | None]:
    """(languages, network) of a sample that fits in memory."""
    langs = sorted(set(labels))
    if not langs:
        return [], None
    data, off = text_buffers(pc.utf8_lower(pa.array(texts, pa.string())))
    start, end = _segments(data, off)
    y = np.array([langs.index(x) for x in labels])[np.searchsorted(off, start, "right") - 1]
    rng, rows = np.random.default_rng(3), []
    for c in range(len(langs)):  # as many segments of each language
        own = np.flatnonzero(y == c)
        rows.append(rng.choice(own, min(len(own), TRAIN_SEGMENTS // len(langs)), replace=False) if len(own) else own)
    rows = np.concatenate(rows)
    size = (end - start)[rows]
    groups = {int(n): (_matrix(data, start[rows[size == n]], int(n)), y[rows[size == n]]) for n in np.unique(size)}
    return langs, ByteGRU(len(langs)).fit(groups)


class LetterModel:
    """How much likelier a text is as written in the sample's languages than as letters at random, in nats. Each
    language has the probabilities of a byte after another, smoothed by those at random: uniform over the sample's
    letters. A segment is of any one of the languages, half by what the network takes it for and half by chance, so
    a text may mix them. For letters at random the measure is at most 0 on average, with any number of languages."""

    def __init__(self, texts: list[str], labels: list[str], smooth: float = 5.0):
        _, self.net = train(texts, labels)
        data, off = text_buffers(pc.utf8_lower(pa.array(texts, pa.string())))
        start, end = _segments(data, off)
        langs = sorted(set(labels))
        label = np.array([langs.index(x) for x in labels])[np.searchsorted(off, start, "right") - 1]
        inside = ragged(start, end - start)
        seen = np.bincount(data[inside], minlength=256) > 0
        random = np.where(seen, 1.0, 1 / 256) / (seen.sum() + 1)  # and a space, which ends a segment
        random[32] = 1 / (seen.sum() + 1)
        self.gain = np.empty((len(langs), 256, 256), np.float32)
        for c in range(len(langs)):
            a, b, _ = self._pairs(data, start[label == c], end[label == c])
            n = np.bincount(a.astype(np.int64) * 256 + b, minlength=1 << 16).reshape(256, 256)
            self.gain[c] = np.log((n + smooth * random) / (n.sum(axis=1, keepdims=True) + smooth) / random)

    @staticmethod
    def _pairs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(byte, next byte, segment) over each segment between two spaces."""
        size = end - start + 2
        x = np.full(int(size.sum()), 32, np.uint8)
        head = np.cumsum(size) - size
        x[ragged(head + 1, size - 2)] = data[ragged(start, size - 2)]
        at = ragged(head, size - 1)
        return x[at], x[at + 1], np.repeat(np.arange(len(size)), size - 1)

    def __call__(self, column: pa.Array) -> np.ndarray:
        """Of each text, summed over its segments; 0 without letters."""
        data, off = text_buffers(pc.utf8_lower(column))
        start, end = _segments(data, off)
        if not len(start):
            return np.zeros(len(column))
        _, first, inverse = np.unique(SpanHash(data)(start, end), return_index=True, return_inverse=True)
        size = (end - start)[first]
        a, b, of = self._pairs(data, start[first], end[first])
        each = np.stack([np.bincount(of, g[a, b], len(first)) for g in self.gain], axis=1)
        mean = _sums(self.net, data, start[first], size, len(self.gain)) / size[:, None]
        taken = np.exp(mean - mean.max(axis=1, keepdims=True))
        each += np.log(0.5 * taken / taken.sum(axis=1, keepdims=True) + 0.5 / len(self.gain))
        top = each.max(axis=1)
        mixed = top + np.log(np.exp(each - top[:, None]).sum(axis=1))
        return np.bincount(np.searchsorted(off, start, "right") - 1, mixed[inverse], len(off) - 1)


def label_positions(net: ByteGRU, langs: list[str], text: str) -> list[str | None]:
    """The language of every byte of a lower-cased text; None outside letters."""
    data, off = text_buffers(pc.utf8_lower(pa.array([text])))
    out: list[str | None] = [None] * len(data)
    for a, z in zip(*_segments(data, off), strict=True):
        for i, c in zip(range(a, z), net.log_probabilities(_matrix(data, np.array([a]), z - a))[1:-1, 0].argmax(1), strict=True):
            out[i] = langs[c]
    return out


def _sums(net: ByteGRU, data: np.ndarray, start: np.ndarray, size: np.ndarray, classes: int) -> np.ndarray:
    """(segments, classes): the log probabilities over the bytes of each segment, summed."""
    sums = np.zeros((len(start), classes))
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        for a in range(0, len(rows), 4096):
            some = rows[a:a + 4096]
            sums[some] = net.log_probabilities(_matrix(data, start[some], int(n)))[1:-1].sum(axis=0)
    return sums


def pooled(net: ByteGRU, column: pa.Array, classes: int) -> np.ndarray:
    """(documents, classes): the mean log probability over the letters of each text, NaN without letters."""
    data, off = text_buffers(pc.utf8_lower(column))
    start, end = _segments(data, off)
    docs = len(off) - 1
    _, first, inverse = np.unique(SpanHash(data)(start, end), return_index=True, return_inverse=True)
    sums = _sums(net, data, start[first], (end - start)[first], classes)
    doc = np.searchsorted(off, start, "right") - 1
    letters = np.bincount(doc, end - start, docs)
    total = np.stack([np.bincount(doc, sums[inverse, c], docs) for c in range(classes)], axis=1)
    return total / np.where(letters > 0, letters, np.nan)[:, None]


def _has_letter(column: pa.Array) -> np.ndarray:
    data, off = text_buffers(column)
    ascii_letter = LETTER[data] & (data < 128)
    out = np.diff(np.concatenate(([0], np.cumsum(ascii_letter)))[off]) > 0
    for i in np.flatnonzero(~out & (np.diff(off) > 0)):
        out[i] = any(c.isalpha() for c in column[int(i)].as_py())
    return out


def held_out():
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    return F.coalesce(rest == 2, F.lit(True))


def sample(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> tuple[list[str], list[str]]:
    """Texts and labels: `train_docs` documents of each language (smallest hash of doc_id), `train_chars` characters of each."""
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = (docs.select("doc_id", "text", "lang").filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
            .select("doc_id", "lang", F.substring("text", 1, train_chars).alias("text"))
            .withColumn("nth", nth).filter(F.col("nth") <= train_docs).orderBy("lang", "nth").select("text", "lang").collect())
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> tuple[list[str], ByteGRU | None]:
    """Train on the sample."""
    return train(*sample(docs, train_docs, train_chars))


def _judge(column: pa.Array, langs: list[str], net: ByteGRU | None) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of each text."""
    pred, score = np.full(len(column), UND, object), np.zeros(len(column))
    if net is not None:
        mean = pooled(net, column, len(langs))
        known = np.flatnonzero(_has_letter(column))
        p = np.exp(mean[known] - mean[known].max(axis=1, keepdims=True))
        pred[known], score[known] = np.array(langs, object)[p.argmax(1)], 1 / p.sum(axis=1)
    return pred, score


def predict(docs: DataFrame, langs: list[str], net: ByteGRU | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""

    def run(batches):
        for b in slices(batches, "text"):
            pred, score = _judge(b["text"], langs, net)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(pred, pa.string()), pa.array(score)],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, *fit(docs))


def causes(column: pa.Array, model: LetterModel | None) -> np.ndarray:
    """Why a text goes: no letter, or no likelier in the languages than as letters at random; None for a text that
    stays. Without labelled rows there are no languages to compare with, and every text with a letter stays."""
    out = np.full(len(column), None, object) if model is None else np.where(model(column) > 0, None, "unlike the languages")
    out[~_has_letter(column)] = "no letter"
    return out


def _model(docs: DataFrame) -> LetterModel | None:
    texts, labels = sample(docs)
    return LetterModel(texts, labels) if texts else None


def language_filter(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose text is in the languages of the labelled rows, one or several."""
    model = _model(docs)

    def run(batches):
        for b in slices(batches, "text"):
            yield b.filter(pa.array(np.equal(causes(b["text"], model), None), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)  # the verdict falls on the row itself


def rejected(docs: DataFrame) -> DataFrame:
    """(cause, n): how many rows language_filter() rejects, by cause."""
    model = _model(docs)

    def run(batches):
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(causes(b["text"], model), pa.string())], ["cause"])

    return (docs.select("text").mapInArrow(run, "cause string").filter("cause is not null")
            .groupBy("cause").agg(F.count("*").alias("n")))
