"""Words and n-grams of whole texts as byte spans, interned by an open-addressed NumPy table.

Words are maximal runs of 0-9, A-Z, a-z and bytes from 0x80 on, A-Z lower-cased. A text is worked through in slices of about a
megabyte, so memory doesn't grow with its length; the last words of a slice begin the next one where a text goes on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import xxhash

from .common import _cut

WORD = np.zeros(256, dtype=bool)
for _a, _z in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    WORD[_a : _z + 1] = True
GAP = ~WORD
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The primes of xxHash64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Spans from this length on are hashed and checksummed one by one.
LONG = 32
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> np.uint32(1)) ^ np.uint32(0xEDB88320), CRC >> np.uint32(1))


def word_slices(data: np.ndarray, bounds: np.ndarray, keep: int = 0, size: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bytes, start, end, row, fresh) of each slice: its words in lower case with one space between them and 8 bytes after them, the
    words' spans and rows. The words before `fresh`, at most `keep`, are the last of the slice before."""
    a, stop = int(bounds[0]), int(bounds[-1])
    tail: list[bytes] = []
    tail_row = -1
    while a < stop:
        b = a + size
        b = stop if b >= stop else _cut(data, bounds, GAP, b)
        d = data[a:b]
        inside = WORD[d]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cut = bounds[np.searchsorted(bounds, a, "right") : np.searchsorted(bounds, b, "left")] - a
        cut = cut[cut < len(d)]
        first[cut] = inside[cut]
        begin = np.flatnonzero(first)
        row = np.searchsorted(bounds, begin + a, "right") - 1
        letters = LOWER[d[inside]]
        at = np.flatnonzero(first[inside])  # where words begin among the letters
        length = np.diff(np.append(at, len(letters)))
        if not len(row) or row[0] != tail_row:
            tail = []
        head = b"".join(w + b" " for w in tail)
        out = np.full(len(head) + len(letters) + len(at) + 8, 32, np.uint8)
        out[: len(head)] = np.frombuffer(head, np.uint8)
        out[len(head) + np.arange(len(letters)) + np.repeat(np.arange(len(at)), length)] = letters
        start = len(head) + at + np.arange(len(at))
        end = start + length
        if tail:
            size_of = np.array([len(w) for w in tail])
            s = np.cumsum(size_of + 1) - size_of - 1
            start, end, row = np.concatenate([s, start]), np.concatenate([s + size_of, end]), np.concatenate([np.full(len(tail), tail_row), row])
        yield out, start, end, row, len(tail)
        if keep and len(row):
            last = np.flatnonzero(row[-keep:] == row[-1]) + len(row) - len(row[-keep:])
            tail, tail_row = [out[start[i] : end[i]].tobytes() for i in last], int(row[-1])
        a = b


def runs_of(start: np.ndarray, end: np.ndarray, row: np.ndarray, fresh: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the runs of 1 to `order` words of one row that end with a word from `fresh` on."""
    parts = []
    for j in range(order):
        i = np.arange(max(fresh, j), len(start))
        i = i[row[i - j] == row[i]] if j else i
        parts.append((start[i - j], end[i], row[i]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return x << np.uint64(r) | x >> np.uint64(64 - r)


def _views(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 8 and the 4 bytes from each place on, as whole numbers; buf ends with 8 bytes more than any span."""
    n = len(buf) - 7
    return np.ndarray(n, "<u8", buf, strides=(1,)), np.ndarray(n, "<u4", buf, strides=(1,))


def xxhash64(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """xxHash64 (seed 0) of each span."""
    wide, half = _views(buf)
    length = end - start
    out = np.empty(len(start), np.uint64)
    order = np.argsort(np.minimum(length, LONG).astype(np.uint16), kind="stable")
    at = np.searchsorted(np.minimum(length, LONG)[order], np.arange(LONG + 2))
    for n in range(LONG):
        own = order[at[n] : at[n + 1]]
        if not len(own):
            continue
        p = start[own]
        h = np.full(len(own), P5 + np.uint64(n), np.uint64)
        for j in range(0, n - 7, 8):
            h ^= _rotl(wide[p + j] * P2, 31) * P1
            h = _rotl(h, 27) * P1 + P4
        j = n // 8 * 8
        if n - j >= 4:
            h ^= half[p + j].astype(np.uint64) * P1
            h = _rotl(h, 23) * P2 + P3
            j += 4
        for i in range(j, n):
            h ^= buf[p + i].astype(np.uint64) * P5
            h = _rotl(h, 11) * P1
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        out[own] = h ^ h >> np.uint64(32)
    for i in order[at[LONG] :]:
        out[i] = xxhash.xxh64_intdigest(buf[start[i] : end[i]].tobytes())
    return out


def crc32(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The unsigned crc32 of each span."""
    length = end - start
    order = np.argsort(-np.minimum(length, LONG), kind="stable")
    order = order[int((length >= LONG).sum()) :]
    s, n = start[order], length[order]
    c = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j in range(LONG - 1):
        m = len(n) - int(np.searchsorted(n[::-1], j, "right"))
        if not m:
            break
        c[:m] = CRC[(c[:m] ^ buf[s[:m] + j]) & np.uint32(255)] ^ c[:m] >> np.uint32(8)
    out = np.empty(len(start), np.int64)
    out[order] = ~c
    for i in np.flatnonzero(length >= LONG):
        out[i] = zlib.crc32(buf[start[i] : end[i]].tobytes())
    return out


def _same(wide: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the spans of that length from a and from b hold equal bytes."""
    equal = np.ones(len(a), bool)
    left = np.flatnonzero(length > 0)
    j = 0
    while len(left):
        rest = length[left] - j
        x = wide[a[left] + j] ^ wide[b[left] + j]
        short = rest < 8
        x[short] &= (np.uint64(1) << (rest[short] * 8).astype(np.uint64)) - np.uint64(1)
        equal[left[x != 0]] = False
        j += 8
        left = left[(x == 0) & (rest > 8)]
    return equal


class Slots:
    """An open-addressed table of the distinct spans of a slice: keys are xxhash64, and a span takes a slot only after its bytes were
    compared with those of the span that holds it. `of` is the slot of each occurrence; start, end and count are the slots' own."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray | None = None):
        n = len(start)
        key = xxhash64(buf, start, end) if keys is None else keys
        cells = 1 << max(4, (2 * n).bit_length())
        wide, length = _views(buf)[0], end - start
        table = np.full(cells, -1, np.int64)
        holder = np.empty(n, np.int64)
        left, cell = np.arange(n), (key & np.uint64(cells - 1)).astype(np.int64)
        while len(left):
            own = table[cell]
            free = own < 0
            table[cell[free]] = left[free]  # of those that want one cell, one gets it
            own = table[cell]
            same = (key[own] == key[left]) & (length[own] == length[left])
            check = np.flatnonzero(same & (own != left))
            same[check] = _same(wide, start[own[check]], start[left[check]], length[left[check]])
            holder[left[same]] = own[same]
            left, cell = left[~same], cell[~same] + 1 & cells - 1
        used = table[table >= 0]
        slot = np.empty(n, np.int64)
        slot[used] = np.arange(len(used))
        self.of = slot[holder]
        self.start, self.end, self.key = start[used], end[used], key[used]
        self.count = np.bincount(self.of, minlength=len(used))

    def __len__(self) -> int:
        return len(self.start)
