"""Token ids of whole texts by a public tokenizer of the `tokenizers` library.

The tokenizer of word_bpe_49k.json lower-cases, and no token spans white space
or the border between an ASCII letter and one of .,;:!? after it. So a text's
ids are the ids of its chunks, cut there, one after another. Chunks are found in
numpy and compared as bytes; each distinct chunk is encoded once by the library
and held in a cache of bounded size, as arrays: a worker keeps it for later tasks
and stages, where objects of Python would weigh three times as much. Texts holding "<|" (special tokens) are
encoded whole, and so is every text for a file of another form."""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa

from folio.llm.common import LOWER, SPACE, prints, ragged, runs, text_buffers

END_ID = 2
VOCABULARY = "word_bpe_49k.json"
CACHE_CHUNKS, CACHE_BYTES = 600_000, 16 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _cuttable(tok) -> bool:
    """Does the file lower-case, drop white space and end words, so that chunks have the ids they have inside a text?"""
    form = json.loads(tok.to_str())
    kinds = [x["type"] for x in (form["normalizer"] or {}).get("normalizers", [])]
    probe = "It's  OK,\nreally.So x1!? (a) b\u00e9"
    parts = "It's|OK|,|really|.So|x1!?|(a)|b\u00e9".split("|")
    ids = lambda t: tok.encode(t, add_special_tokens=False).ids
    return "Lowercase" in kinds and bool(form["model"].get("end_of_word_suffix")) and ids(probe) == [i for p in parts for i in ids(p)]


class Encoder:
    """encode(column) -> (ids of all texts, each text followed by END_ID; number of ids of each text)."""

    def __init__(self, path: str, cache: int = CACHE_CHUNKS, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.most, self.most_bytes = Tokenizer.from_file(path), cache, cache_bytes
        self.cuttable = _cuttable(self.tok)
        self._clear()

    def _clear(self) -> None:
        self.key, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int32)     # hashes in order, and whose they are
        self.text, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.uint32)      # of all entries, one after another
        self.begin, self.size, self.at, self.n = (np.zeros(0, np.int32) for _ in range(4))

    def _direct(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), np.uint32, int(n.sum())), n

    def _find(self, data: np.ndarray, off: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The cache entry of each chunk that has one, else -1."""
        out = np.full(len(key), -1)
        if not len(self.key):
            return out
        place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        held, size = self.entry[place], np.diff(off)
        hit = np.flatnonzero((self.key[place] == key) & (self.size[held] == size))
        held, size = held[hit], size[hit]
        other = data[ragged(off[hit], size)] != self.text[ragged(self.begin[held], size)]
        out[hit] = held
        out[np.repeat(hit, size)[other]] = -1
        return out

    def _lookup(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The cache entry of each distinct chunk."""
        (key,) = prints(data, off[:-1], off[1:], (1,))
        entry = self._find(data, off, key)
        new = np.flatnonzero(entry < 0)
        if not len(new):
            return entry
        if len(self.n) and (len(self.n) + len(new) > self.most or len(self.text) + 4 * len(self.ids) > self.most_bytes):
            self._clear()
            new = np.arange(len(key))
        raw, size = data.tobytes(), np.diff(off)
        for a in range(0, len(new), 20_000):
            some = new[a:a + 20_000]
            ids, n = self._direct([raw[x:z].decode() for x, z in zip(off[some].tolist(), off[some + 1].tolist(), strict=True)])
            entry[some] = np.arange(len(some)) + len(self.n)
            self.begin = np.concatenate((self.begin, (len(self.text) + np.cumsum(size[some]) - size[some]).astype(np.int32)))
            self.size = np.concatenate((self.size, size[some].astype(np.int32)))
            self.text = np.concatenate((self.text, data[ragged(off[some], size[some])]))
            self.at, self.n = np.concatenate((self.at, (len(self.ids) + np.cumsum(n) - n).astype(np.int32))), np.concatenate((self.n, n.astype(np.int32)))
            self.ids = np.concatenate((self.ids, ids))
        new = new[np.argsort(key[new])]
        place = np.searchsorted(self.key, key[new])
        self.key, self.entry = np.insert(self.key, place, key[new]), np.insert(self.entry, place, entry[new].astype(np.int32))
        return entry

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, off = text_buffers(column)
        docs, raw = len(off) - 1, data.tobytes()
        whole = np.zeros(docs, bool)
        if not self.cuttable:
            whole[:] = True
        hit = raw.find(b"<|")
        while hit >= 0:
            d = int(np.searchsorted(off, hit, "right")) - 1
            whole[d] = True
            hit = raw.find(b"<|", max(hit + 1, int(off[d + 1]) - 1))
        member = ~SPACE[data]
        member[ragged(off[:-1][whole], np.diff(off)[whole])] = False
        cut = np.zeros(len(data), bool)
        cut[1:] = _LETTER[data[:-1]] & _STOP[data[1:]]
        start, end = runs(member, off, cut)
        bounds = np.concatenate(([0], np.cumsum(end - start)))
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(LOWER[data[member]])]).dictionary_encode()
        entry = self._lookup(*text_buffers(chunks.dictionary))[chunks.indices.to_numpy()]
        place, n = self.at[entry].astype(np.int64), self.n[entry].astype(np.int64)
        doc = np.searchsorted(off, start, "right") - 1
        count = np.bincount(doc, n, docs).astype(np.int64) if len(n) else np.zeros(docs, np.int64)
        alone = np.flatnonzero(whole)
        ids, each = self._direct([raw[off[i]:off[i + 1]].decode() for i in alone])
        count[alone] = each
        out = np.full(int(count.sum()) + docs, END_ID, np.uint32)
        begin = np.cumsum(count + 1) - (count + 1)
        if len(n):
            inside = np.cumsum(n) - n
            firsts = np.searchsorted(doc, np.arange(docs))
            lead = np.where(firsts < len(doc), inside[np.minimum(firsts, len(doc) - 1)], 0)
            out[ragged(begin[doc] + inside - lead[doc], n)] = self.ids[ragged(place, n)]
        out[ragged(begin[alone], each)] = ids
        return out, count + 1


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, so its cache serves later tasks too."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
