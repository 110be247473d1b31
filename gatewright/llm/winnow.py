"""Where texts repeat each other: anchors, the part that byte and word repeats share.

A window is `length` consecutive units (bytes or words). Its anchor is the unit run of `gram` units with
the smallest hash in it, so equal windows have equal anchors, wherever they stand. Each window belongs to
one anchor; the windows of an anchor form a segment (those of equal anchors in a row share one). Anchors are dealt by hash once: anchors alone in the
corpus end there, equal segments repeat as wholes, and only segments that differ although their anchors
agree go on to be compared window by window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatewright.llm.bytestext import mix, powers

_BASE = 0xC2B2AE3D27D4EB4F | 1
_PLACE = np.uint64((1 << 24) - 1)
#: Units of one row that are handled at once; longer rows overlap by a window.
STRETCH = 1 << 23

ANCHORS = "h long, seg long, doc_id long, at long"


def with_parts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows as doc_id, part, text, and those that are compared: each text of each id once, no null ids.
    part tells rows that share an id apart (equal rows share a part); it is 0 where ids are unique."""
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows, ids = out.where("doc_id is not null").agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows == ids:
        plain = out.select("doc_id", F.lit(0).alias("part"), "text")
        return plain, plain.where("doc_id is not null")
    ranked = out.select("doc_id", (F.dense_rank().over(Window.partitionBy("doc_id").orderBy("text")) - 1).alias("part"), "text")
    return ranked, ranked.where("doc_id is not null").dropDuplicates(["doc_id", "part"])


def pack(part, first, windows, offset):
    """part, first window's start, number of windows and the anchor's offset in one number."""
    return (((part << 32) + first) << 16) + (windows << 8) + offset


def unpack(at):
    return at >> 48, (at >> 16) & 0xFFFFFFFF, (at >> 8) & 255, at & 255


def unit_prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_BASE, len(values)), out=out[1:])
    return out


_BACK = pow(_BASE, -1, 1 << 64)


def runs_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of unit runs by their values and length."""
    back = powers(_BACK, len(prefix))
    return mix((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts + salt).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def find_anchors(grams: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows that lie within a row: row, place, first window and number of windows.

    grams holds the hash of the gram units from each place; bounds the rows' bounds in units.
    """
    spread = length - gram + 1
    n = int(bounds[-1])
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none
    keyed = (grams[: n - gram + 1] & ~_PLACE) | (np.arange(n - gram + 1, dtype=np.uint64) & _PLACE)
    least, span = keyed, 1
    while span < spread:
        step = min(span, spread - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    sizes = np.diff(bounds)
    counts = np.maximum(sizes - length + 1, 0)
    row = np.repeat(np.arange(len(sizes)), counts)
    if not len(row):
        return none, none, none, none
    start = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + bounds[:-1][row]
    low = (least[start] & _PLACE).astype(np.int64)
    place = start + ((low - start) & int(_PLACE))
    new = np.ones(len(row), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], place[at], start[at], np.diff(np.append(at, len(row)))


#: Windows of a segment, about; and the offset of a segment with several anchors.
MOST_WINDOWS, SEVERAL = 200, 255


def join_anchors(row: np.ndarray, place: np.ndarray, first: np.ndarray, count: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbouring anchors of equal hash (of a word or phrase that is said again and again) become one segment of
    at most MOST_WINDOWS windows and one anchor's more. Returns row, h, first window, number of windows, and the
    anchor's offset (SEVERAL where there are more)."""
    if not len(row):
        return row, h, first, count, place
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    before = np.cumsum(count) - count
    part = (before - before[new][np.cumsum(new) - 1]) // MOST_WINDOWS
    new[1:] |= part[1:] != part[:-1]
    at = np.flatnonzero(new)
    several = np.diff(np.append(at, len(row))) > 1
    return row[at], h[at], first[at], np.add.reduceat(count, at), np.where(several, SEVERAL, place[at] - first[at])


class _Runs:
    """Streams anchors sorted by h, seg, doc_id, at. Between batches it keeps only the last run's own rows
    (those of its first document, or its first row), whatever the size of the run and of its h."""

    def __init__(self, by_document: bool):
        self.by_document = by_document
        self.kept = [np.zeros(0, np.int64)] * 5  # h, seg, doc_id, at, weight of the last run's own rows
        self.several = False  # the last run's h has other segs before it

    def feed(self, rows: list[np.ndarray]) -> Iterator[tuple[bool, list[np.ndarray]]]:
        old = len(self.kept[0])
        h, seg, doc, at, weight = (np.concatenate(x) for x in zip(self.kept, [*rows, np.ones(len(rows[0]), np.int64)], strict=True))
        n = len(h)
        new_h, new_seg = np.ones(n, bool), np.ones(n, bool)
        new_h[1:] = h[1:] != h[:-1]
        new_seg[1:] = new_h[1:] | (seg[1:] != seg[:-1])
        run, group = np.cumsum(new_seg) - 1, np.cumsum(new_h) - 1
        several = np.bincount(group, new_seg) >= 2
        several[0] |= self.several and old > 0
        if self.by_document:
            own = doc == doc[new_seg][run]
            covered = ~own
        else:
            total = np.bincount(run, weight)[run]
            own, covered = new_seg, (total >= 2) & (weight < 2)
            weight = np.where(own, np.minimum(total, 2), weight).astype(np.int64)
        if covered.any():
            yield True, [c[covered] for c in (h, seg, doc, at, weight)]
        last = run == run[-1]
        go = own & (several[group] | self._alone(at)) & ~last
        if go.any():
            yield False, [c[go] for c in (h, seg, doc, at, weight)]
        self.kept = [c[own & last] for c in (h, seg, doc, at, weight)]
        self.several = bool(several[-1])

    def finish(self) -> Iterator[tuple[bool, list[np.ndarray]]]:
        go = self._alone(self.kept[3]) | self.several
        if go.any():
            yield False, [c[go] for c in self.kept]

    def _alone(self, at: np.ndarray) -> np.ndarray:
        """Rows to open although no other segment has their h: windows of a segment with several anchors may repeat each other."""
        return np.zeros(len(at), bool) if self.by_document else at & 255 == SEVERAL


FOUND = "covered boolean, h long, seg long, doc_id long, at long, weight long"


def shared_runs(by_document: bool):
    """Rows of FOUND from anchors sorted by h, seg, doc_id, at: covered ones (all their windows repeat: by
    document, in a smaller one; else anywhere), and those to compare by windows, as their h has several segs.
    Of a seg, those are the rows of its first document, or its first row with weight 2 if it has others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(by_document)

        def made(found: Iterator[tuple[bool, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
            for covered, columns in found:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), covered)), *map(pa.array, columns)], names=["covered", "h", "seg", "doc_id", "at", "weight"])

        for batch in batches:
            if batch.num_rows:
                yield from made(runs.feed([c.to_numpy() for c in batch.columns]))
        yield from made(runs.finish())

    return run


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    at = np.flatnonzero(new)
    return starts[at], ends[np.append(at[1:], len(starts)) - 1]
