"""The longest end of one text that another begins with, by rolling hashes over code points."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def suffix_prefix(left: str, right: str, least: int = 4) -> int:
    """Characters of the longest end of ``left`` that ``right`` begins with, 0 under ``least``.

    Ends and beginnings of every size are compared by polynomial hashes at once; sizes with equal hashes are compared themselves, the longest first.
    """
    most = min(len(left), len(right))
    if most < least:
        return 0
    a, b = _points(left[-most:]), _points(right[:most])
    powers = np.full(most + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    ends = np.concatenate([[np.uint64(0)], np.cumsum(a * powers[:-1])])
    starts = np.cumsum(b * powers[:-1])
    size = np.arange(1, most + 1)
    # an end of size k begins at most - k, so its hash carries that power
    same = np.flatnonzero(ends[most] - ends[most - size] == starts * powers[most - size]) + 1
    return next((int(k) for k in same[::-1] if k >= least and left[-k:] == right[:k]), 0)
