"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame operations only.

Slots of equal numbers of words get golden-ratio points; a point's place in the cumulative target
weights gives the slot's source. Slots are ranked per source, each source's documents are shuffled and
laid end to end (as often as its target needs, and no further than its target), cut into blocks of the
same number of words, and the block of a rank joins the slot of that rank. A source gives its target's
words, rounded, however small it is beside a slot.

Prefix sums and ranks go in two steps (sums per bucket, then within a bucket), so that a source with a
third of all rows is never one task's group; the only single-task windows run over bucket or source sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewright.llm.storage import written

WEIGHTS, MAX_EPOCHS, BLOCK_WORDS, LEAST_SLOTS, SEED = (5, 2, 1), 3, 2048, 1 << 16, 17
#: The golden ratio's fraction.
GOLDEN = 0.6180339887498949
#: Rows that share a bucket of a prefix sum, and slots of a range that is ranked at once.
BUCKET_ROWS, RANGE_SLOTS = 2000, 1 << 14


def n_words(text: Column) -> Column:
    """Number of runs of characters outside space and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes: source, source_size (long), one row per source. Adds place (order by code point, null last),
    weight and target: weighted shares of all words, none above max_epochs times its source, the excess
    reshared by weight among the others until none is above."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights)).cast("int") + 1).cast("double")
    rated = written(sizes.select("source", "source_size", place.cast("long").alias("place"), weight.alias("weight"), (F.lit(float(max_epochs)) * F.col("source_size")).alias("most")), "sources")
    total = float(rated.agg(F.sum("source_size")).first()[0] or 0)
    level = -1.0  # words per unit of weight
    while True:
        held = F.col("most") <= F.lit(level) * F.col("weight")
        stopped, open_weight = rated.agg(F.sum(F.when(held, F.col("most")).otherwise(0.0)), F.sum(F.when(held, 0.0).otherwise(F.col("weight")))).first()
        if not open_weight:
            break
        after = (total - stopped) / open_weight
        if after <= level:
            break
        level = after
    return rated.withColumn("target", F.least(F.col("most"), F.lit(max(level, 0.0)) * F.col("weight"))).drop("most")


def slot_count(total: int, block: int) -> int:
    return -(-total // block)


def block_words(total: int, most: int = BLOCK_WORDS, least_slots: int = LEAST_SLOTS) -> int:
    """Words of a slot: most, or less where the corpus would have fewer than least_slots slots."""
    return max(1, min(most, total // least_slots))


def schedule(targets: DataFrame, slots: int, block: int) -> DataFrame:
    """slot, place, rank (of the slot among its source's slots, from 0): one row for each block of `block` words that a
    source's target asks for, whatever its size. A slot has one block.

    Points give a source its share of the slots to within their discrepancy. Slots beyond the blocks of its target go
    to the blocks that no point brought, in the order of an even spread of their sources; new slots hold the rest.
    These are few for each source, whatever the number of slots.
    """
    spark = targets.sparkSession
    total = targets.agg(F.sum("target")).first()[0] or 0.0
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    low = F.coalesce(F.sum("target").over(before), F.lit(0.0))
    quota = F.ceil(F.round("target") / block).alias("blocks")
    bands = targets.where("target > 0").select("place", quota, (low / total).alias("low"), F.lead(low / total).over(Window.orderBy("place")).alias("high"))
    bands = bands.withColumn("high", F.coalesce("high", F.lit(2.0)))
    # A point's band is looked up by the hundredth it lies in: an equal join, whatever the number of sources.
    grid = 1 << 12
    cells = bands.select("place", "blocks", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * grid), F.least(F.floor(F.col("high") * grid), F.lit(grid - 1)))).alias("cell"))
    point = F.col("slot") * F.lit(GOLDEN) - F.floor(F.col("slot") * F.lit(GOLDEN))
    points = spark.range(slots).select(F.col("id").alias("slot")).withColumn("point", point).withColumn("cell", F.floor(F.col("point") * grid))
    owned = points.join(cells, "cell").where("point >= low and point < high").select("slot", "place", "blocks", F.floor(F.col("slot") / RANGE_SLOTS).alias("part"))
    counts = written(owned.groupBy("place", "blocks", "part").agg(F.count("*").alias("n")), "counts")
    start = F.coalesce(F.sum("n").over(Window.partitionBy("place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("place", "part", "n", start.alias("start"), "blocks")
    rank = F.col("start") + F.row_number().over(Window.partitionBy("place", "part").orderBy("slot")) - 1

    def ranked(ranges: DataFrame) -> DataFrame:
        return owned.drop("blocks").join(ranges, ["place", "part"]).select("slot", "place", "blocks", rank.alias("rank"))

    surplus = ranked(starts.where("start + n > blocks")).where("rank >= blocks")  # only a source's last ranges have any
    free = surplus.select("slot", (F.row_number().over(Window.orderBy("slot")) - 1).alias("k"))
    brought = bands.select("place", "blocks").join(counts.groupBy("place").agg(F.sum("n").alias("n")), "place", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    lacking = brought.where("n < blocks").select("place", "blocks", F.explode(F.sequence("n", F.col("blocks") - 1)).alias("rank"))
    lacking = lacking.withColumn("k", F.row_number().over(Window.orderBy((F.col("rank") + 0.5) / F.col("blocks"), "place")) - 1)
    lacking = lacking.join(free, "k", "left").select(F.coalesce("slot", F.col("k") + slots).cast("long").alias("slot"), "place", "rank")
    return ranked(starts).where("rank < blocks").select("slot", "place", "rank").unionByName(lacking)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    most_block_words: int = BLOCK_WORDS,
    least_slots: int = LEAST_SLOTS,
) -> tuple[DataFrame, DataFrame]:
    """Plans the mix. Returns (documents, pieces).

    documents: doc_id, size, source_size, target, taken for every input row, repeats of an id included;
    a row without words is returned with taken 0, a null source is a source of its own, a null id is an
    id like another (rows of one id are shuffled by a key of their own).
    pieces: slot, place, rank, row, epoch, n (words of the document that the slot takes); it is the
    mix itself, in slot order. An empty table gives two empty results. Other columns are not read.
    """
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    sized = written(sized.withColumn("key", key).withColumn("row", F.monotonically_increasing_id()), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(sources, weights, max_epochs), "targets")
    total, rows = (x or 0 for x in sized.agg(F.sum("size"), F.count("*")).first())
    block = block_words(total, most_block_words, least_slots)
    bits = max(4, min(28, 4 * -(-max(1, rows // BUCKET_ROWS).bit_length() // 4)))
    same = F.col("source").eqNullSafe(F.col("s"))
    named = targets.select(F.col("source").alias("s"), "place", "source_size", "target")
    placed = sized.join(F.broadcast(named) if named.count() <= 100_000 else named, same).drop("s")
    # Rows of one id (or none) share a key; where they are many, their bucket goes on into the digits of a key of the row's own.
    placed = placed.withColumn("tie", F.md5(F.col("row").cast("string"))).withColumn("bucket", F.substring("key", 1, bits // 4))
    crowded = placed.groupBy("bucket").agg(F.count("*").alias("rows")).where(F.col("rows") > 8 * BUCKET_ROWS).select("bucket", F.ceil(F.log2(F.col("rows") / BUCKET_ROWS) / 4).cast("int").alias("more"))
    placed = placed.join(crowded, "bucket", "left").withColumn("bucket", F.when(F.col("more").isNull(), F.col("bucket")).otherwise(F.concat("key", F.substr("tie", F.lit(1), F.col("more"))))).drop("more")
    sums = placed.groupBy("place", "bucket").agg(F.sum("size").alias("n"))
    start = F.coalesce(F.sum("n").over(Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("place", "bucket", start.alias("start"))
    before = Window.partitionBy("place", "bucket").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.where("size > 0").withColumn("within", F.coalesce(F.sum("size").over(before), F.lit(0)))
    laid = inner.join(starts, ["place", "bucket"]).withColumn("at", F.col("start") + F.col("within"))
    epochs = F.sequence(F.lit(0), F.least(F.lit(max_epochs), F.ceil(F.col("target") / F.col("source_size") + 0.01).cast("int")) - 1)
    copies = laid.withColumn("epoch", F.explode(epochs)).withColumn("first", F.col("at") + F.col("epoch") * F.col("source_size")).where(F.col("first") < F.round("target"))
    last = F.least(F.col("first") + F.col("size"), F.round("target").cast("long")) - 1  # the last block ends where the target does
    blocks = copies.withColumn("rank", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(last / block))))
    n = F.least(last + 1, (F.col("rank") + 1) * block) - F.greatest("first", F.col("rank") * block)
    parts = blocks.select("place", "rank", "row", "epoch", n.alias("n"))
    pieces = schedule(targets, slot_count(total, block), block).join(parts, ["place", "rank"])
    taken = pieces.groupBy("row").agg(F.sum("n").alias("taken"))
    done = placed.join(taken, "row", "left")
    documents = done.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return documents, pieces.select("slot", "place", "rank", "row", "epoch", "n")
