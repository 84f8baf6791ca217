"""Words and word shingles of many texts at once: numpy over Arrow's own bytes, no Python object for a word.

A word is a run of bytes other than the six ASCII blanks, A-Z lower-cased. Texts are taken in slices of a few MB, so the
working memory is bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 2 << 20
BLANK = 32
_U = np.uint64
#: The primes of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_ALL = (1 << 64) - 1
_FEW = 16  # groups of fewer strings of one length are hashed one by one


def _plain() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[ord("A") : ord("Z") + 1] += 32
    t[[9, 10, 11, 12, 13]] = BLANK
    return t


_PLAIN = _plain()


class Words(NamedTuple):
    """Bytes of all words, each followed by a blank; where words start and end; first word and number of words of a text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    count: np.ndarray


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(from, to) of rows whose texts have ``most`` bytes or less, or of one row."""
    ends = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_string(column.type) else np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield at, min(to, len(column))
        at = to


def words(column: pa.Array) -> Words:
    """The words of a string array; null texts have none."""
    n = len(column)
    ends = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_string(column.type) else np.int64)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    text = np.full(len(raw) + n, BLANK, np.uint8)  # a blank after each text
    low = _PLAIN[raw]
    for i in range(n):
        text[ends[i] + i : ends[i + 1] + i] = low[ends[i] : ends[i + 1]]
    solid = text != BLANK
    before = np.concatenate(([False], solid[:-1])) if len(solid) else solid
    start, end = np.flatnonzero(solid & ~before), np.flatnonzero(~solid & before)
    data = np.concatenate((text[solid | before], np.zeros(8, np.uint8)))  # words and the blank after each; room for a last read
    size = end - start
    last = np.cumsum(size + 1) - 1
    first = np.searchsorted(start, ends[:-1] + np.arange(n))
    return Words(data, last - size, last, first, np.diff(np.append(first, len(start))))


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    """``x``, its own copy, with bits turned left."""
    low = x >> _U(64 - n)
    x <<= _U(n)
    x |= low
    return x


def _round(value: np.ndarray, lane: np.ndarray | None = None) -> np.ndarray:
    x = value * _U(P2)
    if lane is not None:
        x += lane
    x = _turned(x, 31)
    x *= _U(P1)
    return x


def xxh64(data: np.ndarray, at: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of each data[at : at + size]; ``data`` goes on for 8 bytes after the last. Strings of one length go together."""
    eight = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    four = np.ndarray((len(data) - 3,), "<u4", buffer=data, strides=(1,))
    out = np.empty(len(at), np.uint64)
    order = np.argsort(size.astype(np.uint16) if len(size) and size.max() < 1 << 16 else size, kind="stable")  # small ones by radix
    sizes = size[order]
    cuts = np.flatnonzero(np.diff(sizes)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)], strict=True):
        rows = order[a:b]
        if not len(rows):
            continue
        n, p = int(sizes[a]), at[rows]
        if len(rows) < _FEW:
            raw = data.data
            out[rows] = [xxhash.xxh64_intdigest(raw[s : s + n], seed) for s in p.tolist()]
            continue
        rest = n
        if n >= 32:
            lanes = [np.full(len(p), x & _ALL, np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            while rest >= 32:
                lanes = [_round(eight[p + 8 * i], v) for i, v in enumerate(lanes)]
                p, rest = p + 32, rest - 32
            h = sum((_turned(v.copy(), k) for v, k in zip(lanes, (1, 7, 12, 18), strict=True)), np.zeros(len(p), np.uint64))
            for v in lanes:
                h = (h ^ _round(v)) * _U(P1) + _U(P4)
        else:
            h = np.full(len(p), (seed + P5) & _ALL, np.uint64)
        h = h + _U(n)
        while rest >= 8:
            h = _turned(h ^ _round(eight[p]), 27) * _U(P1) + _U(P4)
            p, rest = p + 8, rest - 8
        if rest >= 4:
            h = _turned(h ^ (four[p].astype(np.uint64) * _U(P1)), 23) * _U(P2) + _U(P3)
            p, rest = p + 4, rest - 4
        for _ in range(rest):
            h = _turned(h ^ (data[p].astype(np.uint64) * _U(P5)), 11) * _U(P1)
            p = p + 1
        h = (h ^ (h >> _U(33))) * _U(P2)
        h = (h ^ (h >> _U(29))) * _U(P3)
        out[rows] = h ^ (h >> _U(32))
    return out


def places(w: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of shingles of each text, first word of each shingle, its words): one of all words where a text has fewer
    than ``width``, none without words."""
    n = np.where(w.count > 0, np.maximum(w.count - width + 1, 1), 0)
    first = np.repeat(w.first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return n, first, np.repeat(np.minimum(w.count, width), n)


def fingerprints(w: Words, width: int, seed: int) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text: a bit is set where it is in over half the shingles' XXH64; 0 without words."""
    n, first, own = places(w, width)
    at = w.start[first]
    h = xxh64(w.data, at, w.end[first + own - 1] - at, seed).astype("<u8").view(np.uint8).reshape(-1, 8)
    out, done = np.zeros((len(n), 8), np.uint8), 0
    for i, k in enumerate(n.tolist()):
        if k:
            votes = np.zeros(64, np.int64)
            for a in range(done, done + k, 255):  # 255 rows at most fit a byte's sum
                votes += np.add.reduce(np.unpackbits(h[a : min(a + 255, done + k)], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
            out[i] = np.packbits(votes * 2 > k, bitorder="little")
            done += k
    return out.view("<u8").reshape(-1).astype(np.uint64)


def shingle_keys(w: Words, width: int) -> list[np.ndarray]:
    """Ascending 64-bit keys (signed) of the distinct shingles of each text: XXH64 of words, folded in order and mixed."""
    n, first, own = places(w, width)
    h = np.concatenate((xxh64(w.data, w.start, w.end - w.start), np.zeros(width, np.uint64)))
    x = own.astype(np.uint64)
    short = bool((own < width).any())
    for k in range(width):
        y = (x ^ (x >> _U(29))) * _U(0x9E3779B97F4A7C15) + h[first + k]
        x = np.where(k < own, y, x) if short else y
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))).view(np.int64)
    out, done = [], 0
    for k in n.tolist():
        part = np.sort(x[done : done + k])
        out.append(part[np.concatenate(([True], part[1:] != part[:-1]))] if k > 1 else part)
        done += k
    return out
