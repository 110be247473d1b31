"""Embedding near-duplicates by dual traversal of cover trees, exact at a cosine threshold.

Unit vectors with cosine >= c are those within sqrt(2 - 2c) of each other. The tree's nested levels have
halving radii. A label of more vectors than a block holds gets the tree's top from a bounded sample: pivots
picked farthest first (so that each prefix of them is a net, and later ones lie below earlier ones), to which
every vector descends. A cell that is too large is cut into rings by distance from its pivot. Cells and rings,
with their exact covering radii, are packed in tree order into blocks; a pair of blocks is a task unless the
bounds rule out a link between each of their parts. A task grows the lower levels over its blocks and walks
both trees together, pruning node pairs by centre distance and covering radii; what is left at the lowest
level is compared exactly, in double precision. The walk goes depth first in bounded batches.

Equal vectors collapse first. A task returns a count and a spanning link per vector, never its pairs, so a
large group of near copies costs comparisons inside tasks but no rows. A vector is sent to at most as many
tasks as its label has blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatewright.llm.components import components
from gatewright.llm.storage import written

COSINE = 0.98
#: Vectors of a block; bytes and number of sampled vectors for the tree's top; pivots of a label, and those of its upper level.
BLOCK, SAMPLE_BYTES, SAMPLE, PIVOTS, UPPER = 8192, 16 << 20, 4096, 64, 8
RADII = (1.0, 0.5, 0.25, 0.125)
#: Node pairs that the walk holds at once, and candidates for a centre that are measured together.
BATCH, CANDIDATES = 1 << 17, 64
SLACK = 1e-9


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length-one vectors as bytes; null where there is nothing to compare."""
    for batch in batches:
        out: list[bytes | None] = []
        column = batch.column(1)
        for i in range(batch.num_rows):
            values = column[i].values
            unit = None
            if values is not None and len(values) and not values.null_count:
                v = values.to_numpy(zero_copy_only=False).astype(np.float64)
                top = np.abs(v).max()
                if np.isfinite(top) and top > 0:
                    v = v / top
                    unit = (v / np.sqrt(v @ v) + 0.0).tobytes()
            out.append(unit)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["row", "unit"])


def _distance(gram: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * gram, 0.0))


def _cover(x: np.ndarray, members: np.ndarray, centre: int, radius: float) -> list[tuple[int, np.ndarray, float]]:
    """Centres among members, each at least radius from the ones before, with the members that are nearest in order: the
    given centre first. Returns (centre, its members, covering radius)."""
    out, todo = [], np.concatenate([[centre], members[members != centre]])
    while len(todo):
        own, taken = x[todo], np.zeros(len(todo), bool)
        some = np.arange(min(CANDIDATES, len(todo)))
        far = _distance(own @ own[some].T)
        for k in some.tolist():
            if not taken[k]:
                near = ~taken & (far[:, k] <= radius)
                near[k] = True
                taken |= near
                out.append((int(todo[k]), todo[near], float(far[near, k].max())))
        todo = todo[~taken]
    return out


class Tree:
    """Levels of nodes over the rows of x: centres, covering radii, first child and number of children per parent; the last level's members."""

    def __init__(self, x: np.ndarray):
        self.x = x
        groups = [(0, np.arange(len(x)))]
        self.centres, self.radii, self.first, self.count = [], [], [], []
        for radius in RADII:
            lower, sizes = [], []
            for centre, members in groups:
                found = _cover(x, members, centre, radius) if len(members) > 1 else [(centre, members, 0.0)]
                sizes.append(len(found))
                lower += found
            self.first.append(np.cumsum(sizes) - sizes)
            self.count.append(np.array(sizes))
            self.centres.append(np.array([c for c, _, _ in lower]))
            self.radii.append(np.array([r for _, _, r in lower]))
            groups = [(c, m) for c, m, _ in lower]
        self.members = [m for _, m in groups]


def _child_pairs(a: Tree, b: Tree, level: int, u: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of children of the node pairs, at most about BATCH at a time."""
    fu, nu, fv, nv = a.first[level][u], a.count[level][u], b.first[level][v], b.count[level][v]
    each = nu * nv
    for k in np.flatnonzero(each > BATCH).tolist():
        rows = max(1, BATCH // int(nv[k]))
        right = fv[k] + np.arange(nv[k])
        for s in range(0, int(nu[k]), rows):
            left = fu[k] + np.arange(s, min(s + rows, int(nu[k])))
            yield np.repeat(left, len(right)), np.tile(right, len(left))
    small = np.flatnonzero(each <= BATCH)
    for part in np.split(small, np.flatnonzero(np.diff(np.cumsum(each[small]) // BATCH)) + 1):
        if len(part):
            size = each[part]
            pair = np.repeat(part, size)
            inner = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
            yield fu[pair] + inner // nv[pair], fv[pair] + inner % nv[pair]


def _dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.concatenate([np.einsum("nd,nd->n", a[i[k : k + 8192]], b[j[k : k + 8192]]) for k in range(0, max(1, len(i)), 8192)])


def dual_links(a: Tree, b: Tree, cosine: float, level: int = 0, u: np.ndarray | None = None, v: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (rows of a, rows of b) with cosine of at least the threshold, in batches; for a is b, each pair both ways and without itself."""
    reach = float(np.sqrt(2.0 - 2.0 * cosine))
    u, v = (np.zeros(1, np.int64) if w is None else w for w in (u, v))
    for p, q in _child_pairs(a, b, level, u, v):
        between = _distance(_dots(a.x, b.x, a.centres[level][p], b.centres[level][q]))
        near = between <= a.radii[level][p] + b.radii[level][q] + reach + SLACK
        p, q = p[near], q[near]
        if level + 1 < len(RADII):
            if len(p):
                yield from dual_links(a, b, cosine, level + 1, p, q)
            continue
        single = (a.radii[level][p] == 0) & (b.radii[level][q] == 0)
        single &= np.array([len(a.members[k]) == 1 for k in p.tolist()], bool) & np.array([len(b.members[k]) == 1 for k in q.tolist()], bool)
        yield from _checked(a, b, a.centres[level][p[single]], b.centres[level][q[single]], cosine)
        for k, n in zip(p[~single].tolist(), q[~single].tolist(), strict=True):
            right = b.members[n]
            for s in range(0, len(a.members[k]), 1024):
                left = a.members[k][s : s + 1024]
                i, j = np.nonzero(a.x[left] @ b.x[right].T >= cosine)
                yield _apart(a, b, left[i], right[j])


def _apart(a: Tree, b: Tree, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (i[i != j], j[i != j]) if a is b else (i, j)


def _checked(a: Tree, b: Tree, i: np.ndarray, j: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    good = _dots(a.x, b.x, i, j) >= cosine
    yield _apart(a, b, i[good], j[good])


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of i and j in place: each row points to a smaller one, or to itself."""
    while len(i):
        x, y = root[i], root[j]
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root[:] = root[root]
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]


def _task(cosine: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        sides = [group[group["side"] == s].sort_values("rep") for s in (0, 1)]
        x = [np.frombuffer(b"".join(s["unit"]), np.float64).reshape(len(s), -1) for s in sides if len(s)]
        ids, weights = (np.concatenate([s[c].to_numpy(np.int64) for s in sides]) for c in ("rep", "copies"))
        trees = [Tree(v) for v in x]
        shift = len(x[0]) if len(trees) > 1 else 0
        links, order = np.zeros(len(ids)), np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        root = np.arange(len(ids))  # by rank of the id, so that a tree's root is its smallest id
        for i, j in dual_links(trees[0], trees[-1], cosine):
            j = j + shift
            links += np.bincount(i, weights[j], minlength=len(ids))
            if shift:
                links += np.bincount(j, weights[i], minlength=len(ids))
            _join(root, rank[i], rank[j])
        some = links > 0
        return pd.DataFrame({"rep": ids[some], "links": links[some].astype(np.int64), "root": ids[order[root[rank]]][some]})

    return run


def _pivots(sample: pd.DataFrame) -> dict[str, np.ndarray]:
    """Per label, farthest-first centres of its sampled vectors until they cover them at the lowest radius, those below
    one of the first few next to each other."""
    out = {}
    for key, own in sample.sort_values("rep").groupby("key"):
        x = np.frombuffer(b"".join(own["unit"]), np.float64).reshape(len(own), -1)
        chosen, far = [0], _distance(x @ x[0])
        while len(chosen) < min(PIVOTS, len(x)) and far.max() > RADII[-1]:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, _distance(x @ x[chosen[-1]]))
        pivots = x[chosen]
        above = (pivots @ pivots[:UPPER].T).argmax(axis=1)
        out[key] = pivots[np.argsort(above, kind="stable")]
    return out


def _blocks(placed: DataFrame, pivots: dict[str, np.ndarray], cosine: float) -> tuple[DataFrame, DataFrame]:
    """placed: rep, key, cell, far, ... Returns (placed with block, pairs of blocks that may hold a link: key, block, block2)."""
    spark = placed.sparkSession
    cells = placed.groupBy("key", "cell").agg(F.count("*").alias("n"))
    large = cells.where(F.col("n") > BLOCK)
    cuts = placed.join(large.select("key", "cell", "n"), ["key", "cell"]).groupBy("key", "cell").agg(F.percentile_approx("far", [k / 32 for k in range(1, 32)], 1000).alias("cuts"))
    ringed = placed.join(cuts, ["key", "cell"], "left").withColumn("ring", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("far"))), F.lit(0))).drop("cuts")
    rings = ringed.groupBy("key", "cell", "ring").agg(F.count("*").alias("n"), F.min("far").alias("least"), F.max("far").alias("most"))
    parts = rings.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    before = Window.partitionBy("key").orderBy("cell", "ring", "part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("n") / F.col("parts")).over(before), F.lit(0.0))
    units = written(parts.withColumn("block", F.floor(start / BLOCK)).select("key", "cell", "ring", "part", "parts", "block", "least", "most"), "units")
    sized = units.select("key", "cell", "ring", "parts").distinct()
    mine = ringed.join(sized, ["key", "cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).drop("parts")
    dealt = mine.join(units.select("key", "cell", "ring", "part", "block"), ["key", "cell", "ring", "part"])
    one = units.select("key", "cell", "block", "least", "most")
    two = one.select("key", F.col("cell").alias("cell2"), F.col("block").alias("block2"), F.col("least").alias("least2"), F.col("most").alias("most2"))
    several = one.groupBy("key").agg(F.max("block").alias("last"))
    alone = several.select("key", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("block")).select("key", "block", F.col("block").alias("block2"))
    gaps = [(k, p, q, float(d)) for k, x in pivots.items() for p, row in enumerate(_distance(x @ x.T)) for q, d in enumerate(row)]
    if not gaps:
        return dealt, alone
    apart = spark.createDataFrame(gaps, "key string, cell int, cell2 int, gap double")
    reach = float(np.sqrt(2.0 - 2.0 * cosine)) + SLACK
    met = one.join(several.where("last > 0").select("key"), "key", "left_semi").join(apart, ["key", "cell"]).join(two, ["key", "cell2"]).where("block < block2")
    may = (F.col("gap") <= F.col("most") + F.col("most2") + reach) & (F.col("least") <= F.col("gap") + F.col("most2") + reach) & (F.col("least2") <= F.col("gap") + F.col("most") + reach)
    return dealt, alone.union(met.where(may).select("key", "block", "block2").distinct())


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """Links vectors of equal, non-null label whose cosine is at least the threshold.

    Returns one row per input row: vec_id, n_links (other rows linked directly), component_id (the smallest
    vec_id reachable), kept (vec_id = component_id). Vectors that are null, empty, zero or hold nulls or
    values that aren't finite link with nothing, as do null ids (their component is null and they are
    kept); vectors of different lengths never link. Rows that share an id are one node. Other columns are
    not read; an empty table gives an empty result.
    """
    source = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    source = written(source, "vectors")
    units = source.where("label is not null and vec_id is not null").select("row", "v").mapInArrow(_unit, "row long, unit binary").where("unit is not null")
    keyed = source.select("row", "vec_id", "label").join(units, "row").withColumn("key", F.concat_ws(":", F.length("unit"), "label")).withColumn("same", F.md5("unit"))
    keyed = written(keyed.select("row", "vec_id", "key", "same", "unit"), "units")
    classes = keyed.groupBy("key", "same").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    reps = keyed.join(classes, ["key", "same"]).where("vec_id = rep").dropDuplicates(["key", "same"]).select("rep", "copies", "key", "unit")
    reps = written(reps, "reps")
    sizes = reps.groupBy("key").agg(F.count("*").alias("n"), F.max(F.length("unit")).alias("width"))
    large = sizes.where(F.col("n") > BLOCK)
    width = large.agg(F.max("width")).first()[0] or 8
    sample = reps.join(large.select("key"), "key", "left_semi").orderBy(F.xxhash64("rep"), "rep").limit(max(1, min(SAMPLE, SAMPLE_BYTES // width))).select("key", "rep", "unit").toPandas()
    pivots = _pivots(sample)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            keys = np.array(batch.column(2).to_pylist(), dtype=object)
            for key in set(keys.tolist()) & pivots.keys():
                own = np.flatnonzero(keys == key)
                x = np.frombuffer(b"".join(batch.column(3).take(pa.array(own)).to_pylist()), np.float64).reshape(len(own), -1)
                gaps = _distance(x @ pivots[key].T)
                cell[own] = gaps.argmin(axis=1)
                far[own] = gaps.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    placed = reps.select("rep", "copies", "key", "unit").mapInArrow(descend, "rep long, copies long, key string, unit binary, cell int, far double")
    placed = written(placed, "cells")
    dealt, pairs = _blocks(placed, pivots, cosine)
    tasks = pairs.withColumn("task", F.concat_ws(":", "key", "block", "block2"))
    one = tasks.select("task", "key", "block", F.lit(0).alias("side"))
    two = tasks.where("block <> block2").select("task", "key", F.col("block2").alias("block"), F.lit(1).alias("side"))
    groups = dealt.select("rep", "copies", "key", "unit", "block").join(one.union(two), ["key", "block"]).select("task", "side", "rep", "copies", "unit")
    found = written(groups.groupBy("task").applyInPandas(_task(cosine), "rep long, links long, root long"), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    joined = classes.join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = joined.select("key", "same", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    per_row = keyed.select("row", "key", "same").join(per_class, ["key", "same"]).select("row", "n_links", "component_id")
    out = source.select("row", "vec_id").join(per_row, "row", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
