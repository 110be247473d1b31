"""Repeated word spans by compaction of a token De Bruijn graph.

Edges are k-mers of `length` words, nodes their (k-1)-word overlaps. Winnowing (see winnow) keeps only the
parts of the corpus where some k-mer may repeat: segments whose anchors are alone have no repeated edge.
A segment is itself a nonbranching path of edges. Equal segments are repeated paths; segments that differ
although their anchors agree are opened into single edges, whose multiplicities decide. Repeated paths are
then compacted: a path whose every occurrence is followed by one and the same path, and the other way
round, is joined to it, by pointer doubling over Spark joins. Source coordinates of every occurrence verify
that the joined paths stand next to each other, and give the long spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm import winnow
from gatewright.llm.bytestext import pieces, shingle_hash, word_hash, words
from gatewright.llm.storage import batches_of, written

LENGTH, GRAM = 35, 8


def _anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:2])
            for at, data, offsets in pieces(batch.column(2)):
                starts, ends, bounds = words(data, offsets)
                hashes = word_hash(data, starts, ends)
                grams = shingle_hash(hashes, gram)
                row, place, first, count = winnow.find_anchors(grams, bounds, length, gram)
                row, h, first, count, off = winnow.join_anchors(row, place, first, count, grams[place] >> np.uint64(16))
                seg = winnow.runs_hash(winnow.unit_prefix(hashes), first, first + count - 1 + length) + off.astype(np.uint64)
                packed = winnow.pack(parts[at + row], first - bounds[row], count, off)
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(seg.astype(np.int64)), pa.array(ids[at + row]), pa.array(packed)], names=["h", "seg", "doc_id", "at"])

    return run


def _edges(length: int):
    """Edges of opened segments: two hashes of the k-mer, doc_id, place (with the part above it), weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:2])
            listed = batch.column(3)
            flat = listed.flatten()
            counts = np.diff(listed.offsets.to_numpy())
            owner, packed, weight = np.repeat(np.arange(len(ids)), counts), flat.field("at").to_numpy(), flat.field("weight").to_numpy()
            part, first, n, _ = winnow.unpack(packed)
            own = part == parts[owner]
            owner, first, n, weight = owner[own], first[own], n[own], weight[own]
            for at, data, offsets in pieces(batch.column(2)):
                starts, ends, bounds = words(data, offsets)
                prefix = winnow.unit_prefix(word_hash(data, starts, ends))
                here = (owner >= at) & (owner < at + len(bounds) - 1)
                o, f, c, w = owner[here], first[here], n[here], weight[here]
                seg = np.repeat(np.arange(len(o)), c)
                place = f[seg] + np.arange(len(seg)) - np.repeat(np.cumsum(c) - c, c)
                begin = place + bounds[o[seg] - at]
                two = [winnow.runs_hash(prefix, begin, begin + length, salt=s).astype(np.int64) for s in (0, 977)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, (*two, ids[o[seg]], (parts[o[seg]] << 32) + place, w[seg]))], names=["e1", "e2", "doc_id", "place", "weight"])

    return run


def _kept(length: int):
    """Applies spans of windows to whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part, text, spans in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                tokens = text.as_py().encode().split()
                own = np.array([(s["first"] & 0xFFFFFFFF, (s["first"] & 0xFFFFFFFF) + s["n"] - 1 + length) for s in spans or () if s["first"] >> 32 == (part or 0)], np.int64).reshape(-1, 2)
                starts, ends = winnow.merged(own[:, 0], own[:, 1])
                kept, at, removed = [], 0, 0
                for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                    kept += tokens[at:a]
                    at, removed = b, removed + b - a
                kept += tokens[at:]
                out.append((len(tokens), removed, hashlib.sha256(b" ".join(kept)).hexdigest(), list(zip(starts.tolist(), ends.tolist(), strict=True))))
            spans = pa.array([[{"start": a, "end": b} for a, b in o[3]] for o in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            columns = [batch.column(0), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))), spans]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

    return run


def compacted(paths: DataFrame) -> DataFrame:
    """paths: path (its hash), doc_id, first, n: occurrences of repeated paths, first with the part above it.

    Returns doc_id, unitig, first, n: the occurrences of compacted paths. Two paths are joined where each is
    the other's only neighbour in all occurrences; heads are found by pointer doubling; an occurrence of a
    compacted path is a run of its parts that stand next to each other in the source.
    """
    paths = written(paths, "paths")
    here = paths.select("doc_id", "path", "first", "n")
    after = here.select("doc_id", F.col("path").alias("succ"), F.col("first").alias("next"))
    linked = here.withColumn("next", F.col("first") + F.col("n")).join(after, ["doc_id", "next"], "left")
    forward = linked.groupBy("path").agg(F.min("succ").alias("succ"), F.max("succ").alias("other"), F.count_if(F.col("succ").isNull()).alias("open"))
    forward = forward.where("succ = other and open = 0 and succ <> path").select("path", "succ")
    back = linked.where("succ is not null").groupBy("succ").agg(F.min("path").alias("pred"), F.max("path").alias("other"), F.count("*").alias("seen"))
    occurrences = paths.groupBy("path").agg(F.count("*").alias("times")).withColumnRenamed("path", "succ")
    back = back.where("pred = other").join(occurrences, "succ").where("seen = times").select("succ", "pred")
    joined = forward.join(back.withColumnRenamed("pred", "path"), ["path", "succ"])
    step = written(joined.select(F.col("succ").alias("path"), F.col("path").alias("up")), "steps")
    for _ in range(40):
        higher = step.select(F.col("path").alias("up"), F.col("up").alias("top"))
        lifted = step.join(higher, "up", "left")
        step = written(lifted.select("path", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "steps")
        if step.where("moved").isEmpty():
            break
        step = step.drop("moved")
    heads = step.select("path", F.col("up").alias("head"))
    occurring = paths.join(heads, "path", "left").select("doc_id", F.coalesce("head", "path").alias("unitig"), F.struct("first", "n").alias("p"))
    runs = occurring.groupBy("doc_id", "unitig").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    empty = F.array().cast("array<struct<first:bigint,n:bigint>>")

    def grow(done, p):
        last = F.get(done, F.size(done) - 1)
        joins = (F.size(done) > 0) & (p["first"] == last["first"] + last["n"])
        longer = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["first"].alias("first"), (last["n"] + p["n"]).alias("n"))))
        return F.when(joins, longer).otherwise(F.array_append(done, F.struct(p["first"].alias("first"), p["n"].cast("long").alias("n"))))

    return runs.select("doc_id", "unitig", F.explode(F.aggregate("ps", empty, grow)).alias("r")).select("doc_id", "unitig", "r.first", "r.n")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and spans (array of struct<start, end>, in words).

    A word is removed if a window of `length` consecutive words that covers it starts anywhere else too, in
    the same document or another. Words are runs of bytes outside space and 0x09-0x0D. Null and empty texts
    have none. Rows equal in id and text are one document and get the same result; rows that share an id but
    not the text are documents of their own. A row without an id takes no part and keeps all its words. Other columns are not read.
    """
    parted, one = winnow.with_parts(docs, id_col, text_col)
    dealt = one.mapInArrow(_anchors(length, gram), winnow.ANCHORS).repartition("h").sortWithinPartitions("h", "seg", "doc_id", "at")
    with batches_of(docs.sparkSession, 4000):
        found = written(dealt.mapInArrow(winnow.shared_runs(by_document=False), winnow.FOUND), "shared")
    opened = found.where("not covered").groupBy("doc_id").agg(F.collect_list(F.struct("at", "weight")).alias("anchors"))
    with batches_of(docs.sparkSession, 1000):
        edges = written(one.join(opened, "doc_id").select("doc_id", "part", "text", "anchors").mapInArrow(_edges(length), "e1 long, e2 long, doc_id long, place long, weight long"), "edges")
    times = edges.groupBy("e1", "e2").agg(F.sum("weight").alias("times")).where("times >= 2").select("e1", "e2")
    single = edges.where("weight = 1").join(times, ["e1", "e2"], "left_semi").select(F.xxhash64("e1", "e2").alias("path"), "doc_id", F.col("place").alias("first"), F.lit(1).cast("long").alias("n"))
    place = (F.shiftright("at", 48) * (1 << 32)) + F.shiftright("at", 16).bitwiseAND((1 << 32) - 1)
    whole = found.where("covered").select(F.col("seg").alias("path"), "doc_id", place.alias("first"), F.shiftright("at", 8).bitwiseAND(255).alias("n"))
    spans = compacted(whole.union(single)).groupBy("doc_id").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    spans = written(spans, "spans")
    texts = parted.join(spans, "doc_id", "left").select("doc_id", "part", "text", "spans")
    return texts.mapInArrow(_kept(length), "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>")

