"""Toxicity scores: gradient-boosted trees over dense text features, with isotonic calibration.

Labelled rows (a sample of at most MAX_LABELLED, taken by a hash of the id) are dealt by another
hash into folds. A lexicon holds the terms (whole words and their first 4 to 7 bytes, so that
inflected forms count) whose presence goes with the label far beyond chance; a row that trees or calibration
learn from gets its features from a lexicon learned without its fold, and calibration sees the margins of
trees that were grown without its fold. Only the text is an input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm.bytestext import LOWER, SPACE, pieces, powers, prefix_hash, rows_of, span_hash, words
from gatewright.llm.bytestext import _INVERSE as INVERSE
from gatewright.llm.learn import BoostedTrees, Isotonic
from gatewright.llm.storage import written

#: Bound on labelled rows that are learned from, and on the lexicon's terms.
MAX_LABELLED, MAX_TERMS = 30_000, 4_000
FOLDS = 3
_COUNTS = [f"c{i}" for i in range(2 * FOLDS)]
LEAST_EVIDENCE, LEAST_LIFT = 20.0, 5.0
PREFIXES = (4, 5, 6, 7)
#: Words between a lexicon hit and a word that addresses the reader.
NEAR = 6
THRESHOLD = 0.3

#: Words that address the reader, in four languages (fixed values).
SECOND_PERSON = tuple("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split())

_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True
_WORD_GAP = ~_LETTER.copy()
_WORD_GAP[48:58] = False
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "@$*!01345"]] = True
#: Signs that stand for letters in disguised words.
_PLAIN = LOWER.copy()
for _a, _b in zip("@$!01345", "asioieas", strict=True):
    _PLAIN[ord(_a)] = ord(_b)
_PLAIN_GAP = ~_LETTER.copy()
_PLAIN_GAP[[ord(c) for c in "@$!01345"]] = False

N_FEATURES = 22


def _terms(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, back: np.ndarray) -> list[np.ndarray]:
    """Hashes of whole words and of their first bytes (0 for words that aren't longer)."""
    out = [span_hash(prefix, starts, ends, back)]
    for k in PREFIXES:
        longer = ends - starts > k
        h = np.zeros(len(starts), np.uint64)
        h[longer] = span_hash(prefix, starts[longer], starts[longer] + k, back) ^ np.uint64(0x5555)
        out.append(h)
    return out


def _address() -> np.ndarray:
    out = []
    for word in SECOND_PERSON:
        data = np.frombuffer(word.encode(), np.uint8)
        out.append(span_hash(prefix_hash(data), np.array([0]), np.array([len(data)]))[0])
    return np.sort(np.array(out, np.uint64))


def _within(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each x in sorted_values, or -1."""
    if not len(sorted_values):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return np.where(sorted_values[at] == x, at, -1)


def features(column: pa.Array, terms: np.ndarray, weights: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Per piece of the column: first row, and a row of N_FEATURES numbers for each text."""
    address = _address()
    for at, raw, offsets in pieces(column):
        n = len(offsets) - 1
        low = LOWER[raw]
        starts, ends, bounds = words(low, offsets, _WORD_GAP)
        row = rows_of(bounds)
        back = powers(INVERSE, len(low) + 1)
        prefix = prefix_hash(low)
        value = np.zeros(len(starts))
        for h in (parts := _terms(prefix, starts, ends, back)):
            found = _within(terms, h)
            value = np.maximum(value, np.where(found >= 0, weights[np.maximum(found, 0)] if len(weights) else 0.0, 0.0))
        hit = value > 0
        you = _within(address, parts[0]) >= 0
        count = np.diff(bounds).astype(float)
        per_word = 1.0 / np.maximum(count, 1.0)

        def total(w: np.ndarray, of: np.ndarray = row, size: int = n) -> np.ndarray:
            return np.bincount(of, w, minlength=size)[:size].astype(float)

        spots = np.flatnonzero(you)
        if len(spots):
            k = np.searchsorted(spots, np.arange(len(starts)))
            after, before = spots[np.minimum(k, len(spots) - 1)], spots[np.maximum(k - 1, 0)]
            here = np.arange(len(starts))
            gap = np.minimum(np.where(row[after] == row, np.abs(after - here), 10**6), np.where(row[before] == row, np.abs(here - before), 10**6))
        else:
            gap = np.full(len(starts), 10**6)
        plain = _PLAIN[raw]
        ps, pe, pb = words(plain if len(raw) else raw, offsets, _PLAIN_GAP)
        prow = rows_of(pb)
        signs = np.concatenate([[0], np.cumsum(_SIGN[raw])])
        masked = (signs[pe] - signs[ps] > 0) & (pe - ps > 2)
        disguised = np.zeros(len(ps))
        if masked.any() and len(terms):
            idx = np.flatnonzero(masked)
            h = span_hash(prefix_hash(plain), ps[idx], pe[idx])
            disguised[idx] = _within(terms, h) >= 0
        byte_row = np.repeat(np.arange(n), np.diff(offsets))
        size = np.maximum(np.diff(offsets).astype(float), 1.0)
        upper = (raw >= 65) & (raw <= 90)
        letter = _LETTER[low]
        punct = ~letter & ~SPACE[raw] & ~((raw >= 48) & (raw <= 57))
        again = np.zeros(len(raw), bool)
        if len(raw) > 2:
            again[2:] = letter[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2])
        b = lambda mask: total(mask.astype(float), byte_row)
        digits = (raw >= 48) & (raw <= 57)
        hits, strength = total(hit.astype(float)), total(value)
        strongest = np.zeros(n)
        np.maximum.at(strongest, row, value)
        columns = [
            hits, np.log1p(hits), hits * per_word * 100, strength * per_word * 100, strength, strongest,
            total((value >= 3).astype(float)), total((value >= 3).astype(float)) * per_word * 100,
            total((hit & (gap <= NEAR)).astype(float)) * per_word * 100, total((hit & (gap <= NEAR)).astype(float)),
            total(you.astype(float)) * per_word * 100,
            b(upper) / np.maximum(b(letter), 1.0), b(punct) / size, b(raw == 33) / size, b(raw == 63) / size,
            total(masked.astype(float), prow) * per_word, total(disguised, prow), b(again) / size, b(digits) / size,
            np.log1p(count), b(letter) / np.maximum(count, 1.0), b(raw == 42) / size,
        ]
        yield at, np.stack(columns, axis=1)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each term, by fold and label."""
    for batch in batches:
        group = np.array(batch.column(1).to_pylist(), np.int64) + 2 * np.array(batch.column(2).to_pylist(), np.int64)
        for at, raw, offsets in pieces(batch.column(0)):
            low = LOWER[raw]
            starts, ends, bounds = words(low, offsets, _WORD_GAP)
            row, back, prefix = rows_of(bounds), powers(INVERSE, len(low) + 1), prefix_hash(low)
            h = np.concatenate(_terms(prefix, starts, ends, back))
            r = np.tile(row, 1 + len(PREFIXES))
            h, r = h[h != 0], r[h != 0]
            order = np.lexsort((r, h))
            h, r = h[order], r[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
            term, where = np.unique(h[first], return_inverse=True)
            counts = np.zeros((len(term), 2 * FOLDS), np.int64)
            np.add.at(counts, (where, group[at + r[first]]), 1)
            yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int64)), *(pa.array(np.ascontiguousarray(c)) for c in counts.T)], names=["term", *_COUNTS])


def _lexicon(counts: DataFrame, sizes: dict[tuple[int, int], int], without: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Terms that go with the label, sorted as unsigned numbers, and their log lifts; without one fold's texts."""
    folds = [f for f in range(FOLDS) if f != without]
    n0, n1 = (sum(sizes.get((f, y), 0) for f in folds) for y in (0, 1))
    t0, t1 = (sum((F.col(f"c{y + 2 * f}") for f in folds), F.lit(0)).cast("double") for y in (0, 1))
    lift = (t1 + 0.5) / (n1 + 1) / ((t0 + 0.5) / (n0 + 1))
    expected = (t0 + t1) * (n1 / max(n0 + n1, 1))
    evidence = 2 * (t1 * F.log(t1 / expected) + F.greatest(t0, F.lit(0.5)) * F.log(F.greatest(t0, F.lit(0.5)) / F.greatest(t0 + t1 - expected, F.lit(0.5))))
    chosen = counts.where((t1 >= 4) & (lift >= LEAST_LIFT)).select("term", F.log(lift).alias("w"), evidence.alias("e")).where(F.col("e") >= LEAST_EVIDENCE)
    top = chosen.orderBy(F.desc("e"), "term").limit(MAX_TERMS).toPandas()
    terms = top["term"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(terms)
    return terms[order], top["w"].to_numpy(float)[order]


class Scorer:
    """What a score needs: lexicon, trees and calibration."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, trees: BoostedTrees, calibration: Isotonic):
        self.terms, self.weights, self.trees, self.calibration = terms, weights, trees, calibration

    def score(self, column: pa.Array) -> np.ndarray:
        out = [self.calibration.apply(self.trees.margin(x)) for _, x in features(column, self.terms, self.weights)]
        return np.concatenate(out) if out else np.zeros(0)


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> Scorer:
    """Learns from at most about max_labelled labelled rows, none of them held out; null labels are no labels."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    share = min(1.0, max_labelled / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(FOLDS)).cast("int")
    sample = written(texts.join(F.broadcast(known), "doc_id").withColumn("part", part).withColumn("fold", F.col("part")), "labelled")
    sums = [F.sum(c).alias(c) for c in _COUNTS]
    counts = sample.select("text", "y", "fold").mapInArrow(_term_counts, "term long, " + ", ".join(f"{c} long" for c in _COUNTS))
    counts = written(counts.groupBy("term").agg(*sums).where(sum(F.col(c) for c in _COUNTS[1::2]) >= 4), "terms")
    sizes = {(r["fold"], r["y"]): r["count"] for r in sample.groupBy("fold", "y").count().collect()}
    lexicons = [_lexicon(counts, sizes, f) for f in range(FOLDS)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = np.array(batch.column(3).to_pylist())
            for f in range(FOLDS):
                own = batch.filter(pa.array(folds == f))
                for at, x in features(own.column(0), *lexicons[f]):
                    yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), own.column(1).slice(at, len(x)), own.column(2).slice(at, len(x))], names=["x", "y", "part"])

    made = sample.select("text", "y", "part", "fold").mapInArrow(rows, "x binary, y int, part int").toPandas()
    x = np.frombuffer(b"".join(made["x"]), np.float64).reshape(-1, N_FEATURES)
    y, parts = made["y"].to_numpy(float), made["part"].to_numpy()
    order = np.lexsort((*x.T, y, parts))
    x, y, parts = x[order], y[order], parts[order]
    margins = np.zeros(len(y))
    for f in range(FOLDS):
        own = parts == f
        margins[own] = BoostedTrees().fit(x[~own], y[~own]).margin(x[own])
    return Scorer(*_lexicon(counts, sizes, None), BoostedTrees().fit(x, y), Isotonic().fit(margins, y))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 from threshold on).

    Null and empty texts are scored as texts without words. Ids may be null or repeat. Without labelled
    rows every score is 0. Other columns are not read. An empty table gives an empty result.
    """
    scorer = fit(docs, labels, id_col, text_col, label_col)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.score(batch.column(1)))], names=["doc_id", "score"])

    scored = texts.mapInArrow(run, f"doc_id {id_type}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that toxicity() would predict 1 for; all columns stay and no row moves."""
    scorer = fit(docs, labels, id_col, text_col, label_col)
    text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(scorer.score(batch.column(text).cast(pa.string())) < threshold))

    return docs.mapInArrow(run, docs.schema)
