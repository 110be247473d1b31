"""Near-duplicate documents by MinHash with tensored banding, every candidate confirmed on whole shingle sets.

Two collections of `tables` short bands each are hashed from 2 * tables * band minimum hashes. A table
key pairs one band of the first collection with one of the second, so tables**2 tables of 2 * band
values cost only the square root of the hashing. A pair at similarity s is missed with probability
below 2 * (1 - s**band)**tables: 2e-5 at 0.8 with the defaults.

Equal shingle sets collapse to one representative before any link is made, and bands that one
representative alone has are dropped before pairs of bands are formed; neither loses a link.
Inside a bucket, pairs are not listed outright: members meet the bucket's smallest one; what is then
still in different components meets in blocks of bounded size, compared as matrices inside a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewright.llm.bytestext import LOWER, mix, pieces, seeds, shingle_hash, word_hash, words
from gatewright.llm.components import components
from gatewright.llm.storage import batches_of, written

WIDTH, PERCENT, BAND, TABLES = 5, 80, 4, 22
#: Documents of a block, shingles of a block (some 7 MB of text; a longer document is a block of its own), and columns of a
#: product of incidence matrices.
BLOCK, BLOCK_SHINGLES, COLUMNS = 256, 1 << 20, 8192
#: Of 2 * TABLES * BAND minimum hashes, pairs with fewer equal ones than this share aren't confirmed:
#: at similarity 0.8 that is six standard deviations below the mean (1e-9).
LEAST_EQUAL = 0.6

_SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("h1", T.LongType()),
        T.StructField("h2", T.LongType()),
        T.StructField("u", T.ArrayType(T.LongType())),
        T.StructField("v", T.ArrayType(T.LongType())),
        T.StructField("sketch", T.BinaryType()),
    ]
)


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per piece of the column: first row, sorted distinct shingle hashes of all rows, bounds of each row's."""
    for at, data, offsets in pieces(column):
        data = LOWER[data]
        starts, ends, bounds = words(data, offsets)
        hashes = word_hash(data, starts, ends)
        grams = shingle_hash(hashes, width)
        sets = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= width:
                sets.append(np.unique(grams[a : b - width + 1]))
            else:
                sets.append(shingle_hash(hashes[a:b], b - a, salt=b - a) if b > a else hashes[:0])
        sizes = np.array([len(s) for s in sets], np.int64)
        yield at, np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)])


def _sign(width: int, band: int, tables: int):
    odd = seeds(2 * band * tables, 50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, grams, bounds in shingle_sets(batch.column(1), width):
                n = len(bounds) - 1
                full = np.flatnonzero(np.diff(bounds))
                least = np.zeros((len(odd), n), np.uint64)
                sums = np.zeros((2, n), np.uint64)
                if len(full):
                    for k, o in enumerate(odd):
                        least[k, full] = np.minimum.reduceat(grams * o, bounds[full])
                    sums[0, full] = np.add.reduceat(mix(grams), bounds[full])
                    sums[1, full] = np.add.reduceat(mix(grams + np.uint64(0x1234567)), bounds[full])
                least >>= np.uint64(16)
                bands = np.zeros((2 * tables, n), np.uint64)
                for k in range(len(odd)):
                    bands[k // band] = mix(bands[k // band] * np.uint64(31) + least[k])
                sketch = np.ascontiguousarray((least & np.uint64(255)).astype(np.uint8).T)
                flat = np.ascontiguousarray(bands.T).astype(np.int64)
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * tables), pa.array(np.ascontiguousarray(flat[:, side]).ravel()))
                    for side in (slice(0, tables), slice(tables, None))
                ]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, n), pa.array(np.diff(bounds)), *(pa.array(s.astype(np.int64)) for s in sums), *lists, pa.array([r.tobytes() for r in sketch], pa.binary())],
                    names=_SIGNED.fieldNames(),
                )

    return run


def _exact(sets_a: list[np.ndarray], sets_b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of one block with every set of the other, by products of incidence columns."""
    both = np.intersect1d(np.concatenate(sets_a), np.concatenate(sets_b))
    out = np.zeros((len(sets_a), len(sets_b)), np.float32)
    for at in range(0, len(both), COLUMNS):
        some = both[at : at + COLUMNS]
        sides = []
        for sets in (sets_a, sets_b):
            side = np.zeros((len(sets), len(some)), np.float32)
            for i, s in enumerate(sets):
                own = s[np.searchsorted(s, some[0]) : np.searchsorted(s, some[-1], side="right")]
                k = np.searchsorted(some, own)
                side[i, k[some[k] == own]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _blocks_alike(least: float, percent: int):
    """Keeps pairs of blocks in which some two members of different components may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                x, y = (batch.column(k)[i].values for k in (2, 3))
                a, b = (np.frombuffer(b"".join(side.field("sketch").to_pylist()), np.uint8).reshape(len(side), -1) for side in (x, y))
                (na, ra), (nb, rb) = ((side.field("n_shingles").to_numpy(), side.field("root").to_numpy()) for side in (x, y))
                equal = np.zeros((len(a), len(b)), np.int32)
                for k in range(a.shape[1]):
                    equal += a[:, k, None] == b[None, :, k]
                sized = 100 * np.minimum(na[:, None], nb[None]) >= percent * np.maximum(na[:, None], nb[None])
                good.append(bool((sized & (ra[:, None] != rb[None]) & (equal >= least * a.shape[1])).any()))
            yield batch.select(["x", "y"]).filter(pa.array(good, pa.bool_()))

    return run


def _block_links(width: int, percent: int):
    """One confirmed link for every two components that meet in a pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for row in range(batch.num_rows):
                x, y = (batch.column(k)[row].values for k in (2, 3))
                sets = [[g[b[i] : b[i + 1]] for _, g, b in shingle_sets(side.field("text"), width) for i in range(len(b) - 1)] for side in (x, y)]
                na, nb = (np.array([len(s) for s in side]) for side in sets)
                ra, rb = (side.field("root").to_numpy() for side in (x, y))
                shared = _exact(*sets)
                good = (shared > 0) & (100 * shared >= percent * (na[:, None] + nb[None] - shared)) & (ra[:, None] != rb[None])
                found |= {(int(ra[i]), int(rb[j])) for i, j in zip(*np.nonzero(good), strict=True)}
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _between_blocks(apart: DataFrame, sketches: DataFrame, bodies: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between components that share buckets, found between blocks of at most about BLOCK documents and BLOCK_SHINGLES shingles.

    Documents whose buckets lead to the same smallest document share a block (members of one large component have blocks of
    their own, which never meet each other). Blocks that meet in a bucket are compared by sketches, then
    exactly, as matrices inside one task: no pair of documents is ever a row.
    """
    placed = apart.groupBy("rep", "root").agg(F.min("first").alias("least")).join(sketches.select("rep", "n_shingles"), "rep")
    sizes = placed.groupBy("least", "root").agg(F.count("*").alias("same"))
    placed = placed.join(sizes, ["least", "root"]).withColumn("pure", F.when(F.col("same") >= BLOCK // 2, F.col("root")))
    counts = placed.groupBy("least", F.coalesce("pure", F.lit(-1)).alias("kind")).agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("chunks"))
    placed = placed.withColumn("kind", F.coalesce("pure", F.lit(-1))).join(counts, ["least", "kind"])
    chunk = F.pmod(F.xxhash64("rep"), F.col("chunks"))
    placed = written(placed.select("rep", "root", "pure", F.xxhash64("least", "kind", chunk).alias("block")), "blocks")
    met = apart.select("key", "rep").join(placed.select("rep", "block", "pure"), "rep").select("key", "block", "pure").distinct()
    sets = met.groupBy("key").agg(F.bit_xor(F.xxhash64("block")).alias("set"), F.count("*").alias("n"))
    kept = sets.where("n > 1").groupBy("set", "n").agg(F.min("key").alias("key"))  # buckets of the same blocks say the same
    met = met.join(kept, "key", "left_semi")
    other = met.select("key", F.col("block").alias("y"), F.col("pure").alias("pure2"))
    pairs = met.join(other, "key").where("block < y and (pure is null or pure2 is null or pure <> pure2)").select(F.col("block").alias("x"), "y").distinct()
    pairs = pairs.union(placed.where("pure is null").select("block").distinct().select(F.col("block").alias("x"), F.col("block").alias("y")))

    def both(pairs: DataFrame, members: DataFrame, fields: list[str]) -> DataFrame:
        listed = members.groupBy("block").agg(F.collect_list(F.struct(*fields)).alias("members"))
        with_x = pairs.join(listed.select(F.col("block").alias("x"), F.col("members").alias("mx")), "x")
        return with_x.join(listed.select(F.col("block").alias("y"), F.col("members").alias("my")), "y").select("x", "y", "mx", "my")

    drawn = both(pairs, placed.join(sketches, "rep"), ["root", "n_shingles", "sketch"])
    with batches_of(apart.sparkSession, 64):
        near = written(drawn.mapInArrow(_blocks_alike(LEAST_EQUAL, percent), "x long, y long"), "near-blocks")
    texts = placed.join(bodies.withColumnRenamed("doc_id", "rep"), "rep")
    with batches_of(apart.sparkSession, 2):
        return written(both(near, texts, ["root", "text"]).repartition("x", "y").mapInArrow(_block_links(width, percent), "a long, b long").distinct(), "block-links")


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = []
            for column in (batch.column(1), batch.column(3)):
                sides.append([g[b[i] : b[i + 1]] for _, g, b in shingle_sets(column, width) for i in range(len(b) - 1)])
            good = []
            for x, y in zip(*sides, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _alike(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (batch.column(2), batch.column(3)))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= least))

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, band: int = BAND, tables: int = TABLES
) -> DataFrame:
    """Groups documents whose shingle sets have 100 * intersection >= percent * union, transitively.

    Words are runs of bytes outside space and 0x09-0x0D after A-Z are lowered; a set holds the distinct
    width-word shingles, or the whole sequence where there are fewer words. Returns one row per input row:
    doc_id, n_shingles, component_id (the smallest id reachable), kept (doc_id = component_id).
    Empty and null texts have empty sets and link with nothing. Rows that share an id are one node.
    A row without an id links with nothing: its component_id is null and it is kept. No other column
    of docs is read. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with batches_of(docs.sparkSession, 1000):
        signed = written(texts.mapInArrow(_sign(width, band, tables), _SIGNED), "signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    reps = full.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").withColumnRenamed("doc_id", "rep")

    def shared(side: str) -> DataFrame:
        bands = reps.select("rep", F.posexplode(side).alias("i", "x"))
        common = bands.groupBy("i", "x").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("i", "x")
        return bands.join(common, ["i", "x"], "left_semi").groupBy("rep").agg(F.collect_set(F.struct("i", "x")).alias(side))

    pairs_of_bands = shared("u").join(shared("v"), "rep").select("rep", F.explode("u").alias("p"), "v").select("rep", "p", F.explode("v").alias("q"))
    keys = pairs_of_bands.select("rep", F.xxhash64("p.i", "p.x", "q.i", "q.x").alias("key"))
    keys = written(keys, "keys")
    buckets = keys.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    keys = written(keys.join(buckets.select("key", "lo"), "key"), "buckets")
    involved = keys.select(F.col("rep").alias("doc_id")).distinct()
    bodies = written(texts.join(involved, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), "bodies")
    sketches = written(reps.join(involved.withColumnRenamed("doc_id", "rep"), "rep", "left_semi").select("rep", "n_shingles", "sketch"), "sketches")

    def confirmed(pairs: DataFrame) -> DataFrame:
        one, two = (sketches.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
        sized = pairs.distinct().join(one, "a").join(two, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        near = sized.select("a", "b", "sa", "sb").mapInArrow(_alike(LEAST_EQUAL), "a long, b long").distinct()
        with_b = near.join(bodies.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
        both = with_b.join(bodies.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
        with batches_of(docs.sparkSession, 256):
            return written(both.select("a", "ta", "b", "tb").mapInArrow(_confirm(width, percent), "a long, b long"), "confirmed")

    def apart(roots: DataFrame) -> DataFrame:
        """Buckets' members with their components, where a bucket still has several."""
        rooted = keys.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.col("lo").alias("first"), F.coalesce("root", "rep").alias("root"))
        several = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
        return written(rooted.join(several, "key", "left_semi"), "apart")

    roots = components(confirmed(keys.where("rep <> lo").select(F.col("lo").alias("a"), F.col("rep").alias("b"))))
    left = apart(roots)
    if not left.isEmpty():
        found = _between_blocks(left, sketches, bodies, width, percent)
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found))

    groups = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("root", "rep").alias("root"))
    linked = signed.select("doc_id", "n_shingles", "h1", "h2").join(groups, ["h1", "h2"], "left")
    root = F.when(F.col("n_shingles") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    return linked.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), root).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
