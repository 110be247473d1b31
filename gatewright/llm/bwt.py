"""Burrows-Wheeler transform and common prefixes of many short texts, built column by column.

Round j inserts, for every text of j or more bytes, the suffix of j bytes: its place follows from the place
of the suffix before it and the ranks of symbols in the transform so far. Transform, common prefixes and
the suffixes' owners are sequential columns that each round reads and writes once, front to back.
"""

from __future__ import annotations

import numpy as np

#: Stands before a text's first byte; no UTF-8 text holds it.
END = 255


def _spread(old: np.ndarray, stay: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.empty(len(stay), old.dtype)
    out[stay] = old
    out[at] = values
    return out


def build(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per suffix, in order (the texts' ends come first): transform, common prefix with the suffix before
    (up to 255), text, start. Ends of texts differ from each other and never match."""
    sizes = np.diff(offsets)
    m = len(sizes)
    before = lambda text, start: np.where(start > 0, data[np.minimum(offsets[text] + np.maximum(start, 1) - 1, len(data) - 1)] if len(data) else END, END).astype(np.uint8)
    last, prefix = before(np.arange(m), sizes), np.zeros(m, np.uint8)
    owner = (np.arange(m, dtype=np.int64) << 32) + sizes  # text and start
    active, place = np.arange(m), np.arange(m)
    for j in range(1, int(sizes.max(initial=0)) + 1):
        still = sizes[active] >= j
        active, place = active[still], place[still]
        n = len(last)
        order = np.argsort(last, kind="stable").astype(np.int32)
        rank = np.empty(n, np.int32)
        rank[order] = np.arange(n, dtype=np.int32)
        mine = rank[place]
        symbol = last[place]
        padded = np.append(prefix, np.uint8(0))
        left = order[np.maximum(mine - 1, 0)]
        right = order[np.minimum(mine + 1, n - 1)]
        has_left = (mine > 0) & (last[left] == symbol)
        has_right = (mine + 1 < n) & (last[right] == symbol)

        def least(lo: np.ndarray, hi: np.ndarray, padded: np.ndarray = padded) -> np.ndarray:
            """1 + the minimum of prefix over lo to hi, both included."""
            down = np.argsort(lo)[::-1]  # so that the gaps between pairs cost nothing
            pairs = np.stack([lo[down], hi[down] + 1], axis=1).ravel()
            out = np.empty(len(lo), np.int64)
            out[down] = np.minimum.reduceat(padded, pairs)[::2]
            return np.minimum(out + 1, 255)

        with_left, with_right = np.zeros(len(mine), np.int64), np.zeros(len(mine), np.int64)
        if has_left.any():
            with_left[has_left] = least(left[has_left] + 1, place[has_left])
        if has_right.any():
            with_right[has_right] = least(place[has_right] + 1, right[has_right])
        at = m + mine
        stay = np.ones(n + len(at), bool)
        stay[at] = False
        begin = sizes[active] - j
        prefix = _spread(prefix, stay, at, with_left.astype(np.uint8))
        next_at = at + 1
        inside = next_at < len(prefix)
        prefix[next_at[inside]] = with_right[inside].astype(np.uint8)
        last = _spread(last, stay, at, before(active, begin))
        owner = _spread(owner, stay, at, (active << 32) + begin)
        place = at
    return last, prefix, owner >> 32, owner & 0xFFFFFFFF
