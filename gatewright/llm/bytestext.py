"""Words and rolling hashes of whole Arrow batches of texts, as numpy arrays over their UTF-8 bytes.

One document's bytes never meet another's: every function takes the documents' bounds in the buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; one longer document is a piece of its own.
PIECE = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (two multiply-and-shift steps)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))

def seeds(n: int, start: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(start)) | np.uint64(1)

_BYTE = seeds(256, 7)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)

def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(pow(base, done, 1 << 64))
        done += take
    return out[:n]

def pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces of a string column: index of the first row, bytes, offsets of each row (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
        end = min(end, len(column))
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end

def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes outside gap), and the number of words before each row's end."""
    n = len(data)
    inside = ~gap[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    bounds = offsets[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < n)]
    first[bounds] = inside[bounds]
    last[bounds - 1] = inside[bounds - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")

def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of the bytes' random values times powers, modulo 2**64; differences of it hash any substring."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=out[1:])
    return out

def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, back: np.ndarray | None = None) -> np.ndarray:
    """Hash of each span, the same wherever the span stands; lengths are part of it."""
    back = powers(_INVERSE, len(prefix)) if back is None else back
    return mix((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(data), starts, ends)

def shingle_hash(hashes: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of width values, in order; as many as there are whole runs."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i, odd in enumerate(seeds(width, 1000 + salt)):
        out += hashes[i : i + n] * odd
    return mix(out)

def rows_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each item, given the number of items before each row and at the end."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
