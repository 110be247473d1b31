"""Repeated byte strings across documents, by column-wise construction of collection transforms.

Winnowing (see winnow) finds the parts of the corpus where a string of `length` bytes may repeat. Segments
that another, smaller document has as a whole are removed as wholes. Segments that differ although their
anchors agree are fetched as texts, and blocks of them get their collection Burrows-Wheeler transform and
common prefixes, built one column of symbols a round (see bwt). Suffixes whose common prefix is `length` or
more are the same string; the smallest document among them decides. The segments of one anchor go to one
block; an anchor with more than MOST segments takes several, and its strings are then compared across them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm import winnow
from gatewright.llm.bwt import build
from gatewright.llm.bytestext import pieces, powers, prefix_hash, span_hash
from gatewright.llm.bytestext import _INVERSE as INVERSE
from gatewright.llm.storage import batches_of, written

LENGTH, GRAM, LONGEST = 50, 16, 200
#: Segments of a block, and of one anchor that a block takes.
BLOCK, MOST = 4000, 16000

_STRINGS = "doc_id long, first long, n long, covered boolean, e1 long, e2 long"


def _anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:2])
            for at, data, bounds in pieces(batch.column(2)):
                if len(data) < length:
                    continue
                prefix, back = prefix_hash(data), powers(INVERSE, len(data) + 1)
                starts = np.arange(len(data) - gram + 1)
                grams = span_hash(prefix, starts, starts + gram, back)
                row, place, first, count = winnow.find_anchors(grams, bounds, length, gram)
                h = grams[place] >> np.uint64(16)
                seg = span_hash(prefix, first, first + count - 1 + length, back) + (place - first).astype(np.uint64)
                packed = winnow.pack(parts[at + row], first - bounds[row], count, place - first)
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(seg.astype(np.int64)), pa.array(ids[at + row]), pa.array(packed)], names=["h", "seg", "doc_id", "at"])

    return run


def _segments(length: int):
    """h, doc_id, first (with the part above it) and the bytes of the listed segments of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:2])
            listed = batch.column(3)
            flat, counts = listed.flatten(), np.diff(listed.offsets.to_numpy())
            owner, h = np.repeat(np.arange(len(ids)), counts), flat.field("h").to_numpy()
            part, first, n, off = winnow.unpack(flat.field("at").to_numpy())
            own = part == parts[owner]
            owner, h, first, n, off = owner[own], h[own], first[own], n[own], off[own]
            for at, data, bounds in pieces(batch.column(2)):
                here = np.flatnonzero((owner >= at) & (owner < at + len(bounds) - 1))
                begin = bounds[owner[here] - at] + first[here]
                size = n[here] + length - 1
                ends = np.cumsum(size)
                take = np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
                texts = pa.Array.from_buffers(pa.binary(), len(here), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[take]))])
                yield pa.RecordBatch.from_arrays([pa.array(h[here]), pa.array(ids[owner[here]]), pa.array((parts[owner[here]] << 32) + first[here]), pa.array(off[here]), texts], names=["h", "doc_id", "first", "off", "seg"])

    return run


def _strings(length: int, gram: int):
    """Per block, runs of windows that a smaller document of the block has; where an anchor has several blocks,
    also the hashes of each of its other windows."""

    side = (length - gram) // 2

    def _may_share(key: np.ndarray, off: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Two segments share a window only if they agree on `side` bytes before the anchor, or after it:
        a window holds length - gram bytes besides the anchor."""
        sums = prefix_hash(data)
        after = np.diff(offsets) - off - gram
        out = np.zeros(len(key), bool)
        for there, begin in ((off >= side, offsets[:-1] + off - side), (after >= side, offsets[:-1] + off)):
            own = np.flatnonzero(there)
            if len(own):
                h = span_hash(sums, begin[own], begin[own] + side + gram) ^ (key[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                _, which, times = np.unique(h, return_inverse=True, return_counts=True)
                out[own] |= times[which] > 1
        return out

    def block(doc: np.ndarray, first: np.ndarray, several: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        _, prefix, text, start = build(data, offsets)
        whole = np.diff(offsets)[text] - start >= length
        text, start, same = text[whole], start[whole], prefix[whole] >= length
        # A suffix too short for a window matches none, so neighbours among the whole ones stay neighbours.
        heads = np.flatnonzero(~same) if len(same) else np.zeros(0, np.int64)
        least = np.minimum.reduceat(doc[text], heads) if len(heads) else doc[:0]
        covered = doc[text] > least[np.cumsum(~same) - 1] if len(heads) else np.zeros(0, bool)
        order = np.lexsort((start, text))
        text, start, covered = text[order], start[order], covered[order]
        open_ = several[text] & ~covered
        rows = [(doc[text[open_]], first[text[open_]] + start[open_], np.ones(int(open_.sum()), np.int64), covered[open_])]
        prefix_sums = prefix_hash(data)
        begin = offsets[text[open_]] + start[open_]
        first_hash = span_hash(prefix_sums, begin, begin + length)
        sides = np.cumsum(data.astype(np.uint64) * powers(0x5851F42D4C957F2D, len(data)))
        sides = np.concatenate([np.zeros(1, np.uint64), sides])
        second_hash = (sides[begin + length] - sides[begin]) * powers(pow(0x5851F42D4C957F2D, -1, 1 << 64), len(data) + 1)[begin]
        text, start = text[covered], start[covered]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)
        at = np.flatnonzero(new)
        rows.append((doc[text[at]], first[text[at]] + start[at], np.diff(np.append(at, len(text))), np.ones(len(at), bool)))
        columns = [pa.array(np.concatenate([np.asarray(r[k]) for r in rows])) for k in range(4)]
        for h in (first_hash, second_hash):
            columns.append(pa.array(np.concatenate([h.astype(np.int64), np.zeros(len(at), np.int64)])))
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "first", "n", "covered", "e1", "e2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while table.num_rows > BLOCK:
                keys = table.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[BLOCK], side="left")) or int(np.searchsorted(keys, keys[0], side="right"))
                if cut == len(keys):
                    break  # the key may go on
                yield of(table.slice(0, cut))
                table = table.slice(cut)
            held = table
        if held is not None and held.num_rows:
            yield of(held)

    def of(table: pa.Table) -> pa.RecordBatch:
        doc, first = (table.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "first"))
        texts = table.column("seg").combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        several = table.column("several").to_numpy(zero_copy_only=False).astype(bool)
        key, off = (table.column(c).to_numpy().astype(np.int64) for c in ("key", "off"))
        offsets = offsets - offsets[0]
        use = several | _may_share(key, off, data, offsets)
        if not use.all():
            sizes = np.diff(offsets)
            data = data[np.repeat(use, sizes)]
            doc, first, several = doc[use], first[use], several[use]
            offsets = np.concatenate([[0], np.cumsum(sizes[use])])
        return block(doc, first, several, data, offsets)

    return run


def _kept(length: int):
    """Applies spans of windows to whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            listed = batch.column(3)
            flat, bounds = listed.flatten(), listed.offsets.to_numpy()
            firsts, ns = flat.field("first").to_numpy(), flat.field("n").to_numpy()
            base = bounds[0]
            for i, (part, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                data = text.as_py().encode()
                f, n = firsts[bounds[i] - base : bounds[i + 1] - base], ns[bounds[i] - base : bounds[i + 1] - base]
                own = f >> 32 == (part or 0)
                f, n = f[own] & 0xFFFFFFFF, n[own]
                starts, ends = winnow.merged(f, f + n - 1 + length)
                digest, at, removed = hashlib.sha256(), 0, 0
                for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                    digest.update(data[at:a])
                    at, removed = b, removed + b - a
                digest.update(data[at:])
                out.append((len(data), removed, len(starts), digest.hexdigest(), [{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            columns = [batch.column(0), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (array of struct<start, end>, in bytes).

    A byte is removed if a string of `length` bytes that covers it also starts in a document with a smaller
    id; strings never cross documents and are judged on the input. Null texts are empty. Rows that share an
    id don't remove each other's bytes. A row without an id takes no part and keeps all its bytes. Other
    columns are not read; an empty table gives an empty result. length is LONGEST at most, as common prefixes and
    windows of an anchor are counted in bytes.
    """
    if not gram <= length <= LONGEST:
        raise ValueError(f"length must be {gram} to {LONGEST}, not {length}")
    parted, one = winnow.with_parts(docs, id_col, text_col)
    dealt = one.mapInArrow(_anchors(length, gram), winnow.ANCHORS).repartition("h").sortWithinPartitions("h", "seg", "doc_id", "at")
    with batches_of(docs.sparkSession, 4000):
        found = written(dealt.mapInArrow(winnow.shared_runs(by_document=True), winnow.FOUND), "shared")
    opened = found.where("not covered").groupBy("doc_id").agg(F.collect_list(F.struct("h", "at")).alias("anchors"))
    with batches_of(docs.sparkSession, 1000):
        segments = written(one.join(opened, "doc_id").select("doc_id", "part", "text", "anchors").mapInArrow(_segments(length), "h long, doc_id long, first long, off long, seg binary"), "segments")
    hot = segments.groupBy("h").agg(F.count("*").alias("times")).where(F.col("times") > MOST)
    hot = written(hot, "hot")
    salted = segments.join(hot, "h", "left").withColumn("several", F.col("times").isNotNull())
    salt = F.when(F.col("several"), F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("times") / MOST))).otherwise(F.lit(0))
    keyed = salted.select(F.xxhash64("h", salt).alias("key"), "doc_id", "first", "off", "several", "seg")
    blocks = keyed.repartition("key").sortWithinPartitions("key", "doc_id", "first")
    strings = written(blocks.mapInArrow(_strings(length, gram), _STRINGS), "strings")
    place = (F.shiftright("at", 48) * (1 << 32)) + F.shiftright("at", 16).bitwiseAND((1 << 32) - 1)
    spans = found.where("covered").select("doc_id", place.alias("first"), F.shiftright("at", 8).bitwiseAND(255).alias("n"))
    spans = spans.union(strings.where("covered").select("doc_id", "first", "n"))
    if not hot.isEmpty():
        single = strings.where("e1 <> 0 or e2 <> 0")
        owners = single.groupBy("e1", "e2").agg(F.min("doc_id").alias("owner"))
        spans = spans.union(single.where("not covered").join(owners, ["e1", "e2"]).where("doc_id > owner").select("doc_id", "first", "n"))
    listed = written(spans.groupBy("doc_id").agg(F.collect_list(F.struct("first", "n")).alias("spans")), "spans")
    texts = parted.join(listed, "doc_id", "left").select("doc_id", "part", "text", F.coalesce("spans", F.array().cast("array<struct<first:bigint,n:bigint>>")).alias("spans"))
    return texts.mapInArrow(_kept(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>")
