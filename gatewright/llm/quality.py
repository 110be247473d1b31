"""Quality classifier by co-training of two views: a text's content, and its page's metadata.

The content view has the words (hashed) and statistics of words and characters; the metadata view has what a
page's record tells: source, language, size and number and length of lines, and nothing of what the text says. Both learn from a bounded sample of labelled rows. Over rounds,
each gives its most confident labels for a bounded pool of unlabelled rows to the other. Labelled rows
that neither learned from calibrate both views, and a logistic combination of the calibrated views scores
every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm.bytestext import LOWER, SPACE, mix, pieces, rows_of, word_hash, words
from gatewright.llm.learn import Logistic, sigmoid
from gatewright.llm.storage import written
from gatewright.llm.toxicity import held_out

#: Bounds on labelled rows and on the pool of unlabelled rows, rounds, and the rows each view passes on a round.
MAX_LABELLED, MAX_POOL, ROUNDS, PASSED = 20_000, 20_000, 5, 500
#: Confidence below which a view passes nothing on.
SURE = 0.95
BUCKETS, WORD_BUCKETS = 64, 128
N_TEXT, N_META = 20 + WORD_BUCKETS, 5 + BUCKETS
THRESHOLD = 0.5


def _shares(raw: np.ndarray, row: np.ndarray, n: int, size: np.ndarray):
    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(row, mask, minlength=n)[:n] / size

    return share


def content(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Per piece of the column: first row, and N_TEXT numbers per text."""
    for at, raw, offsets in pieces(column):
        n = len(offsets) - 1
        low = LOWER[raw]
        starts, ends, bounds = words(low, offsets)
        row, count = rows_of(bounds), np.diff(bounds).astype(float)
        many = np.maximum(count, 1.0)
        h = word_hash(low, starts, ends)
        order = np.lexsort((h, row))
        first = np.ones(len(h), bool)
        first[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
        distinct = np.bincount(row[order], first, minlength=n)[:n]
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        share = _shares(raw, np.repeat(np.arange(n), np.diff(offsets)), n, np.maximum(np.diff(offsets).astype(float), 1.0))
        lower, upper = (raw >= 97) & (raw <= 122), (raw >= 65) & (raw <= 90)
        digit, wide, space = (raw >= 48) & (raw <= 57), raw >= 128, SPACE[raw]
        sign = ~(lower | upper | digit | wide | space)
        twin = np.zeros(len(raw), bool)
        twin[1:] = sign[1:] & (raw[1:] == raw[:-1])
        lengths = (ends - starts).astype(float)
        mean = np.bincount(row, lengths, minlength=n)[:n] / many
        spread = np.sqrt(np.maximum(np.bincount(row, lengths**2, minlength=n)[:n] / many - mean**2, 0))
        columns = [mean, spread, distinct / many, distinct / np.sqrt(many), np.bincount(row, again, minlength=n)[:n] / many, share(upper), share(digit), share(sign), share(twin), share(wide), share(lower), np.log1p(distinct), np.minimum(np.bincount(row, lengths > 24, minlength=n)[:n], 50) / many, np.minimum(many, 20)]
        columns += [share(np.isin(raw, list(s))) for s in (b"|", b"!", b"#$%&*", b".?", b",;:", b" ")]
        cell = row * WORD_BUCKETS + (h >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS
        said = np.bincount(cell, minlength=n * WORD_BUCKETS)[: n * WORD_BUCKETS].reshape(n, WORD_BUCKETS)
        yield at, np.hstack([np.stack(columns, axis=1), np.sqrt(said / many[:, None])])


def metadata(batch_columns: list[pa.Array]) -> Iterator[tuple[int, np.ndarray]]:
    """From the text's size and lines, source and lang: N_META numbers per row."""
    text, source, lang = batch_columns
    named = [[str(v) for v in c.to_pylist()] for c in (source, lang)]
    for at, raw, offsets in pieces(text):
        n = len(offsets) - 1
        row = np.repeat(np.arange(n), np.diff(offsets))
        size = np.diff(offsets).astype(float)
        line = raw == 10
        lines = np.bincount(row, line, minlength=n)[:n] + 1
        place = np.concatenate([[-1], np.flatnonzero(line)])
        gaps = np.diff(place).astype(float)
        owner = row[place[1:]] if len(place) > 1 else np.zeros(0, np.int64)
        short = np.bincount(owner, gaps < 20, minlength=n)[:n]
        dense = np.stack([np.log1p(size), np.log1p(lines), np.log1p(size / lines), short / lines, np.log1p(size) ** 2], axis=1)
        hashed = np.zeros((n, BUCKETS))
        for names, salt in zip(named, (b"s", b"l"), strict=True):
            for i in range(n):
                data = np.frombuffer(salt + names[at + i].encode(), np.uint8).astype(np.uint64)
                hashed[i, int(mix(np.array([np.sum(data * (np.arange(len(data), dtype=np.uint64) * np.uint64(131) + np.uint64(7)))]))[0] % np.uint64(BUCKETS))] += 1
        yield at, np.hstack([dense, hashed])


def _view_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Both views of a batch whose first columns are text, source and lang."""
    text = [x for _, x in content(batch.column(0))] or [np.zeros((0, N_TEXT))]
    meta = [x for _, x in metadata([batch.column(i) for i in range(3)])] or [np.zeros((0, N_META))]
    return np.concatenate(text), np.concatenate(meta)


class CoTrained:
    """Two views, their calibrations, and the weights that combine them."""

    def fit(self, views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS, passed: int = PASSED) -> CoTrained:
        n = len(y)
        part = np.arange(n) % 4  # rows come in the order of a hash
        learn, rest = part != 3, part == 3
        sets = [(v[learn], y[learn].astype(float), np.ones(int(learn.sum()))) for v in views]
        left = np.arange(len(pool[0]))
        for k in range(rounds + 1):
            self.views = [Logistic().fit(*s) for s in sets]
            if k == rounds or not len(left):
                break
            sure = [sigmoid(m.margin(p[left])) for m, p in zip(self.views, pool, strict=True)]
            share = float(y.mean()) if n else 0.5
            gone: set[int] = set()
            for giver, taker in ((0, 1), (1, 0)):
                p = sure[giver]
                up, down = np.argsort(-p, kind="stable")[: max(1, int(passed * share))], np.argsort(p, kind="stable")[: max(1, int(passed * (1 - share)))]
                up, down = up[p[up] >= SURE], down[p[down] <= 1 - SURE]
                rows = left[np.concatenate([up, down])]
                x, t, w = sets[taker]
                sets[taker] = (np.vstack([x, pool[taker][rows]]), np.concatenate([t, np.ones(len(up)), np.zeros(len(down))]), np.concatenate([w, np.full(len(rows), 0.5)]))
                gone |= set(rows.tolist())
            left = left[~np.isin(left, list(gone))]
        margins = [m.margin(v[rest])[:, None] for m, v in zip(self.views, views, strict=True)]
        self.scales = [Logistic(ridge=0.1).fit(m, y[rest].astype(float)) for m in margins]
        both = np.hstack([s.margin(m)[:, None] for s, m in zip(self.scales, margins, strict=True)])
        self.both = Logistic(ridge=1.0).fit(both, y[rest].astype(float))
        return self

    def score(self, views: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, and the calibrated views of content and metadata."""
        margins = [s.margin(m.margin(v)[:, None]) for s, m, v in zip(self.scales, self.views, views, strict=True)]
        return sigmoid(self.both.margin(np.stack(margins, axis=1))), sigmoid(margins[0]), sigmoid(margins[1])


def _drawn(rows: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Both views and labels of a bounded table, in the order of a hash of the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                text, meta = _view_rows(batch)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in np.hstack([text, meta])], pa.binary()), batch.column(3), batch.column(4)], names=["x", "y", "o"])

    made = rows.select("text", "source", "lang", "y", F.xxhash64("doc_id", F.lit(5)).alias("o")).mapInArrow(run, "x binary, y int, o long").toPandas()
    x = np.frombuffer(b"".join(made["x"]), np.float64).reshape(-1, N_TEXT + N_META)
    order = np.lexsort((*x.T[:4], made["o"].to_numpy(np.int64)))
    x = x[order]
    return (x[:, :N_TEXT], x[:, N_TEXT:]), made["y"].fillna(-1).to_numpy()[order]


def quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", label_col: str = "quality", max_labelled: int = MAX_LABELLED, max_pool: int = MAX_POOL, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per input row: doc_id, held_out, p_text, p_meta, score (0 to 1, higher is better), predicted.

    Learns from labelled rows that aren't held out (crc32(doc_id as text) mod 4 is 2 for those). Null texts
    are empty ones; null source and lang are values like others; null labels are none; ids may be null or
    repeat. Without labels every score is about one half. Other columns are not read.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    free = ~held_out()
    share = min(1.0, max_labelled / max(1, known.where(free).count()))
    hashed = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000))
    chosen = known.where(free & (hashed < int(share * 1_000_000)))
    source = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang")
    )
    kind = source.schema["doc_id"].dataType.simpleString()
    sample = written(source.join(F.broadcast(chosen), "doc_id"), "labelled")  # at most about max_labelled rows
    pool_share = min(1.0, max_pool / max(1, docs.count()))
    unlabelled = written(source.where(free & (F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1_000_000)) < int(pool_share * 1_000_000))).join(known, "doc_id", "left_anti").withColumn("y", F.lit(None).cast("int")), "pool")
    views, y = _drawn(sample)
    pool, _ = _drawn(unlabelled)
    model = CoTrained().fit(views, y, pool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                both = _view_rows(pa.RecordBatch.from_arrays(batch.columns[1:], names=["text", "source", "lang"]))
                score, p_text, p_meta = model.score(both)
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (p_text, p_meta, score))], names=["doc_id", "p_text", "p_meta", "score"])

    scored = source.mapInArrow(run, f"doc_id {kind}, p_text double, p_meta double, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "p_text", "p_meta", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
