"""Golomb-coded fingerprint exchange: which fingerprints occur more than once?

Rows are dealt into groups. A group sends every owner the sorted, distinct
fingerprints of the owner's range as Golomb-coded differences (divisor 256^k,
k from the mean difference; quotients in unary, remainders as k bytes), with a
bit for those that it holds more than once. The owner returns a bitmap over
the list that it received: a set bit says that the fingerprint also occurs
elsewhere or repeats at home. A group sends a fingerprint once, so a very
frequent one weighs no more than its number of groups."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 48
U = np.uint64


def golomb_encode(keys: np.ndarray) -> bytes:
    """Sorted distinct uint64 keys -> bytes."""
    n = len(keys)
    if not n:
        return struct.pack("<IB", 0, 0)
    gaps = np.diff(keys, prepend=U(0))
    k = max(1, min(8, (int(keys[-1]) // n).bit_length() // 8 + 1))
    rest = gaps if k == 8 else gaps & U((1 << 8 * k) - 1)
    over = np.zeros(n, np.int64) if k == 8 else (gaps >> U(8 * k)).astype(np.int64)
    unary = np.ones(int(over.sum()) + n, np.uint8)
    unary[np.cumsum(over + 1) - 1] = 0
    return struct.pack("<IB", n, k) + rest.astype("<u8").view(np.uint8).reshape(n, 8)[:, :k].tobytes() + np.packbits(unary).tobytes()


def golomb_decode(blob: bytes) -> np.ndarray:
    n, k = struct.unpack_from("<IB", blob)
    if not n:
        return np.zeros(0, U)
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :k] = np.frombuffer(blob, np.uint8, n * k, 5).reshape(n, k)
    gaps = raw.view("<u8").ravel().astype(U)
    if k < 8:
        ends = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, -1, 5 + n * k)) == 0)[:n]
        gaps += (np.diff(ends, prepend=-1) - 1).astype(U) << U(8 * k)
    return np.cumsum(gaps, dtype=U)


def _ranges(own: np.ndarray, owners: int) -> np.ndarray:
    """Where each owner's equal share of the key range begins in the sorted keys."""
    return np.searchsorted(own, np.array([i * (1 << BITS) // owners for i in range(owners)] + [1 << BITS], U))


def owner_cuts(keys: np.ndarray, owners: int) -> np.ndarray:
    """Where each owner's range begins in sorted 64-bit fingerprints."""
    return _ranges(keys >> U(64 - BITS), owners)


def send(gid: int, keys: np.ndarray, owners: int) -> pd.DataFrame:
    """The rows (owner, gid, keys, multi) for all fingerprints of one group;
    `keys` may repeat and need no order."""
    own, count = np.unique(keys >> U(64 - BITS), return_counts=True)
    cut = _ranges(own, owners)
    rows = [(o, gid, golomb_encode(own[a:z]), np.packbits(count[a:z] > 1).tobytes())
            for o, (a, z) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if z > a]
    return pd.DataFrame(rows, columns=["owner", "gid", "keys", "multi"])


SENT = "owner int, gid long, keys binary, multi binary"
BACK = "gid long, owner int, bits binary"


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    lists = [golomb_decode(x) for x in pdf["keys"]]
    multi = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)).astype(bool) for m, k in zip(pdf["multi"], lists, strict=True)]
    every = np.concatenate(lists)
    order = np.argsort(every, kind="stable")
    ordered, shared = every[order], np.concatenate(multi)[order]
    same = ordered[1:] == ordered[:-1]
    first = np.flatnonzero(np.concatenate(([True], ~same)))
    shared = np.logical_or.reduceat(shared, first) | (np.diff(first, append=len(ordered)) > 1)
    out = np.empty(len(every), bool)
    out[order] = np.repeat(shared, np.diff(first, append=len(ordered)))
    cut = np.cumsum([len(x) for x in lists])[:-1]
    return pd.DataFrame({"gid": pdf["gid"], "owner": pdf["owner"], "bits": [np.packbits(x).tobytes() for x in np.split(out, cut)]})


def answers(sent: DataFrame) -> DataFrame:
    """The owners' bitmaps, one row for each row sent."""
    return sent.groupBy("owner").applyInPandas(_answer, BACK)


def shared(keys: np.ndarray, back: pd.DataFrame, owners: int) -> np.ndarray:
    """A mask over `keys` of those that occur more than once, from the rows
    that came back to the group that sent exactly these."""
    if not len(keys):
        return np.zeros(0, bool)
    own, at = np.unique(keys >> U(64 - BITS), return_inverse=True)
    sizes = np.diff(_ranges(own, owners))
    bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=int(sizes[o])) for o, b in back.sort_values("owner")[["owner", "bits"]].itertuples(index=False)]
    return np.concatenate(bits).astype(bool)[at]


def group_of(column, groups: int):
    """The group that a row with this id belongs to."""
    return F.pmod(F.xxhash64(column), F.lit(groups)).alias("gid")
