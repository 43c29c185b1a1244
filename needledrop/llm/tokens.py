"""Words and hashes of many texts at once, in numpy, over the bytes of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are handled in slices of about so many bytes, which bounds a worker's memory.
SLICE = 1 << 20
#: A text longer than this is split into words piece by piece.
PIECE = 4 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a multiply-and-shift finaliser)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Powers:
    """Powers of the hash base and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(BASE, n), _powers(INVERSE, n)
        return self.up[:n], self.down[:n]


POWERS = Powers()

LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def slices(column, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) over an Arrow binary column without nulls."""
    n = len(column)
    wide = str(column.type).startswith("large")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = LETTERS, fold: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, start and end of each word; by default runs of ASCII letters and digits, lower-cased, and of bytes above 127.

    A long text is gone through in pieces that end between words.
    """
    parts, at, n = [], 0, len(data)
    while at < n:
        end = n
        if n - at > PIECE:
            end = at + PIECE
            while end < n and letters[data[end]]:  # on to the end of the word, a piece at a time
                gap = np.flatnonzero(~letters[data[end : end + PIECE]])
                end = end + int(gap[0]) if len(gap) else min(n, end + PIECE)
        inside = offsets[(offsets > at) & (offsets < end)] - at
        parts.append((at, *_words(data[at:end], np.concatenate(([0], inside, [end - at])), letters, fold)))
        at = end
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    value, starts, stops = np.concatenate([p[1] for p in parts]), np.concatenate([p[0] + p[2] for p in parts]), np.concatenate([p[0] + p[3] for p in parts])
    return value, np.searchsorted(offsets, starts, "right") - 1, starts, stops


def _words(data: np.ndarray, edges: np.ndarray, letters: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word; no word crosses an edge."""
    n = len(data)
    inside = letters[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins, ends = edges[edges < n], edges[edges > 0] - 1
    first[begins] = inside[begins]
    last[ends] = inside[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = POWERS.to(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((fold[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    value = (total[stops] - total[starts]) * down[starts]
    return mix(value ^ (stops - starts).astype(np.uint64)), starts, stops


def shingles(word: np.ndarray, text: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and first word of every run of k words within one text."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(text[:n] == text[k - 1 :])
    value = word[at].copy()
    for j in range(1, k):
        value = value * BASE + word[at + j]
    return mix(value), text[at], at
