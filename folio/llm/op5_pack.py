"""Hierarchical multi-length packing of token ids.

A document's ids beyond whole windows of LENGTH go to the smallest tier (4096,
2048, 1024, 512, 256) that holds them. Each tier, longest first, is packed by
best fit; a gap in a long window is filled from shorter tiers, the last gap by
the head of one more document, whose rest is routed anew. So every window is
full. Windows are dealt to step groups of STEP_IDS ids, longest first, and
since tiers divide each other every group but the last holds exactly that.
What is left when a task ends is cut at powers of two: no id is padding.

Tasks pack pools of POOL_IDS ids of their own input split, so memory is
bounded and nothing is shuffled; what a pool leaves over goes into the next.

Defined cases: null text is empty and has the end id alone; a null doc_id
stays null; repeated rows are documents of their own; other columns are
ignored; an empty table gives no rows."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folio.llm.common import slices
from folio.llm.tokens import encoder, vocabulary_path

LENGTH, SHORTEST, POOL_IDS, STEP_IDS = 4096, 256, 1 << 20, 8 * 4096
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "window long, step_id long")


class Packer:
    """Collects documents' remainders; windows() packs them."""

    def __init__(self, longest: int = LENGTH, shortest: int = SHORTEST):
        self.longest, self.shortest = longest, shortest
        self.pieces: list[tuple] = []      # (size, key, doc_id, start, doc_tokens, ids), sorted by size
        self.key = 0
        self.held = 0

    def put(self, doc_id, start, total, ids) -> None:
        if len(ids):
            insort(self.pieces, (len(ids), self.key, doc_id, start, total, ids))
            self.key += 1
            self.held += len(ids)

    def _take(self, i: int) -> tuple:
        p = self.pieces.pop(i)
        self.held -= p[0]
        return p

    def _tier(self, n: int) -> int:
        t = self.shortest
        while t < n:
            t *= 2
        return t

    def _best(self, most: int) -> int:
        """The largest piece of at most `most` ids, or -1."""
        return bisect_right(self.pieces, (most, 1 << 62)) - 1

    def _window(self, size: int) -> list[tuple]:
        """A full window; the caller knows that enough ids are held."""
        out, gap = [], size
        while gap:
            i = self._best(gap)
            if i >= 0:
                p = self._take(i)
                out.append(p)
                gap -= p[0]
            else:  # the shortest of the longer pieces closes the gap with its head
                n, _, doc, start, total, ids = self._take(0)
                out.append((gap, 0, doc, start, total, ids[:gap]))
                self.put(doc, start + gap, total, ids[gap:])
                gap = 0
        return out

    def windows(self, last: bool):
        """Full windows; with `last`, what is left at powers of two too."""
        while self.pieces and self.held >= self.longest:
            size = min(self.longest, self._tier(self.pieces[-1][0]))
            yield size, self._window(size)
        while last and self.held:
            size = 1 << (self.held.bit_length() - 1)
            yield size, self._window(size)


def pack(docs: DataFrame, vocabulary: str | None = None, longest: int = LENGTH, shortest: int = SHORTEST,
         pool_ids: int = POOL_IDS, step_ids: int = STEP_IDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window (the
    sequence's length), step_id."""
    vocabulary = vocabulary or vocabulary_path()

    def run(batches):
        from pyspark import TaskContext

        tok, part = encoder(vocabulary), TaskContext.get().partitionId()
        packer, sequence, step, waiting = Packer(longest, shortest), part << 33, part << 33, []

        def emit(windows, last=False):
            """Full step groups of the windows so far. Window lengths are powers of two that divide step_ids, so from
            the longest down they fill a group exactly; what is left waits for the next windows."""
            nonlocal sequence, step, waiting
            waiting = sorted(waiting + windows, key=lambda w: -w[0])
            left = sum(size for size, _ in waiting)
            rows, room, taken = [], step_ids, 0
            for size, pieces in waiting:
                if room == step_ids and left < step_ids and not last:
                    break
                taken, left, at = taken + 1, left - size, 0
                room -= size
                for n, _, doc, start, total, ids in pieces:
                    rows.append((doc, start, n, zlib.crc32(ids.tobytes()), total, sequence, at, size, step))
                    at += n
                sequence += 1
                if not room:
                    step, room = step + 1, step_ids
            waiting = waiting[taken:]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 9
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                              ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_id"])

        for b in slices(batches, "text", 4 << 20):
            ids, n = tok.encode(b["text"])
            ids, end, ready = ids.astype("<u4"), 0, []
            for doc, total in zip(b["doc_id"].to_pylist(), n.tolist(), strict=True):
                own, end, whole = ids[end:end + total], end + total, total - total % longest
                for a in range(0, whole, longest):
                    ready.append((longest, [(longest, 0, doc, a, total, own[a:a + longest])]))
                packer.put(doc, whole, total, own[whole:])
                if packer.held >= pool_ids:
                    ready += packer.windows(False)
                if len(ready) >= 1024:
                    yield emit(ready)
                    ready = []
            if ready:
                yield emit(ready)
        yield emit(list(packer.windows(False)) + list(packer.windows(True)), last=True)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
