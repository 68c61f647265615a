"""Vectorised words and polynomial prefix hashes over the UTF-8 bytes of an Arrow batch of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

#: Upper-case ASCII letters to lower case, every other byte to itself.
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32

#: Bytes of words between blanks: all but space and 9 to 13.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[32, 9, 10, 11, 12, 13]] = False

#: Bytes of alphanumeric words after lower-casing: digits, a-z, and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


class Powers:
    """The powers of BASE and of its inverse modulo 2**64, as far as the longest text so far needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


POWERS = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A second value of each byte, for a second hash: 64 bits without order.
BYTE_VALUES = mix(np.arange(1000, 1256, dtype=np.uint64))


def prefix_hashes(data: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """P with P[i] the polynomial hash of data[:i]; the hash of data[s:e] is (P[e] - P[s]) / BASE**s. ``values`` has each byte's value, else it is itself + 1."""
    POWERS.reach(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    terms = data.astype(np.uint64) + np.uint64(1) if values is None else values[data]
    np.cumsum(terms * POWERS.up[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hashes of the spans; not mixed."""
    return (prefix[end] - prefix[start]) * POWERS.down[start]


def text_chunks(column: pa.Array, most: int = 1 << 18, rows: int = 500) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (from, to, their UTF-8 bytes, to - from + 1 offsets into them) of about ``most`` bytes; a longer text
    comes alone and whole. Null is an empty text."""
    for base in range(0, len(column), rows):
        part = column.slice(base, rows).fill_null("").cast(pa.large_string())
        n = len(part)
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + n + 1]
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            to = min(to, n)
            yield base + at, base + to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, and for each text the index of its first word (one more at the end)."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = kind[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]  # a word that would run on into the next text
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offsets)


#: Odd multipliers that make a shingle's hash depend on the order of its words.
PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every ``size`` consecutive words; entry i starts at word i."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = word_hashes[:n] * PLACES[0]
    for k in range(1, size):
        out = out + word_hashes[k : k + n] * PLACES[k]
    return mix(out + np.uint64(size))
