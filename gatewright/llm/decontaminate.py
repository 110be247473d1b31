"""Benchmark decontamination by a prefix-filtered join of shingles, with DataFrame operations only.

An item's windows are its runs of `window` consecutive words. A window's tokens are its shingles of
`gram` words, ordered by rarity in the corpus. A window occurs only if all its tokens do, so the
necessary prefix is one token, its rarest. Documents keep the positions whose shingle is one of the
benchmark's; these give the corpus counts that order the tokens, and meet the windows on the prefix token
alone. Positional and length bounds then fix the one place where the window could stand, and its words
are compared there.

Windows of the same words are one window, whatever items (or rows of one item's id) they come from; its
items meet it again at the end. Documents are read once: a benchmark of at most SET_GRAMS distinct shingles
is a set inside the scan's expression, so documents never move for the search; a larger one is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.llm.storage import written

WINDOW, GRAM = 10, 3
#: Shingles of the benchmark that the scan's expression may hold (half a MB on the driver); more are joined.
SET_GRAMS = 50_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of digits, letters and all beyond ASCII, with A-Z lowered; no words for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def _grams(tokens: Column, width: int) -> Column:
    """A hash for each run of width words, at the position of its first; the last runs are cut short."""
    return F.transform(tokens, lambda w, i: F.xxhash64(w, *[F.coalesce(F.get(tokens, i + k), F.lit(" ")) for k in range(1, width)]))


def _windows(benchmark: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(windows, owners). windows: win (its number), words, width (of its shingles), grams (all its tokens), one
    row for each sequence of words. owners: win, item."""
    items = benchmark.withColumn("tokens", words(F.col("text"))).where("size(tokens) > 0")
    last = F.greatest(F.size("tokens") - window, F.lit(0))
    cut = items.select("item", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("tokens", i + 1, window))).alias("words"))
    cut = written(cut.distinct(), "cut")
    wins = cut.select("words").distinct().withColumn("width", F.least(F.size("words"), F.lit(gram)))
    exact = F.lit(None)
    for k in range(1, gram + 1):
        exact = F.when(F.col("width") == k, F.slice(_grams(F.col("words"), k), 1, F.size("words") - k + 1)).otherwise(exact)
    wins = written(wins.withColumn("grams", exact).withColumn("win", F.monotonically_increasing_id()), "windows")
    return wins, written(cut.join(wins.select("win", "words"), "words").select("win", "item"), "owners")


def find_windows(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM, set_grams: int = SET_GRAMS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns (documents, hits, owners). documents: row, doc_id, n_words for every input row. hits: row, win,
    start, len: every place in a document where a window stands, in words. owners: win, item."""
    wins, owners = _windows(benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")), window, gram)
    tokens = written(wins.select("width", F.explode("grams").alias("gram")).distinct(), "tokens")
    n_tokens, widths = tokens.agg(F.count("*"), F.sort_array(F.collect_set("width"))).first()
    sized = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("words"))
    kept, places = _listed(sized, tokens, widths) if n_tokens <= set_grams else _joined(sized, tokens, widths)
    rarity = places.groupBy("width", "gram").agg(F.count("*").alias("n"))
    offset = wins.select("win", "width", F.posexplode("grams").alias("offset", "gram"))
    counted = offset.join(rarity, ["width", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("win", "width").agg(F.min(F.struct("n", "gram", "offset")).alias("r")).where("r.n > 0")
    prefix = rarest.join(wins.select("win", F.col("words").alias("win_words")), "win").select("win", "width", "r.gram", "r.offset", "win_words")
    met = places.join(prefix, ["width", "gram"]).select("row", "win", "win_words", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")
    per_row = met.groupBy("row").agg(F.collect_list(F.struct("win", "win_words", "start")).alias("met"))
    bodies = kept.where("words is not null").select("row", "n_words", "words").join(per_row, "row")
    there = F.filter("met", lambda m: (m.start + F.size(m.win_words) <= F.col("n_words")) & (F.slice(F.col("words"), m.start + 1, F.size(m.win_words)) == m.win_words))
    hits = bodies.select("row", F.explode(there).alias("m")).select("row", "m.win", "m.start", F.size("m.win_words").alias("len"))
    return kept.select("row", "doc_id", "n_words"), written(hits, "hits"), owners


def _listed(sized: DataFrame, tokens: DataFrame, widths: list[int]) -> tuple[DataFrame, DataFrame]:
    """(documents with their words where a shingle is the benchmark's, places of such shingles), the shingles being literals."""
    found = F.array().cast("array<struct<width:int,pos:int,gram:bigint>>")
    for k in widths:
        members = ", ".join(str(r[0]) for r in tokens.where(F.col("width") == k).select("gram").collect())
        name = f"g{k}"
        sized = sized.withColumn(name, _grams(F.col("words"), k))
        found = F.concat(found, F.expr(f"filter(transform({name}, (g, i) -> struct({k} as width, int(i) as pos, g as gram)), x -> x.gram in ({members}))"))
    seen = sized.withColumn("found", found)
    kept = seen.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "found", F.when(F.size("found") > 0, F.col("words")).alias("words"))
    kept = written(kept, "found")
    return kept, kept.where("size(found) > 0").select("row", F.explode("found").alias("f")).select("row", "f.*")


def _joined(sized: DataFrame, tokens: DataFrame, widths: list[int]) -> tuple[DataFrame, DataFrame]:
    """The same by a join on the shingles' hashes, for a benchmark of any size; all documents' words are kept."""
    kept = written(sized.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "words"), "found")
    every = None
    for k in widths:
        one = kept.select("row", F.lit(k).alias("width"), F.posexplode(_grams(F.col("words"), k)).alias("pos", "gram"))
        every = one if every is None else every.union(one)
    return kept, written(every.join(tokens, ["width", "gram"]).select("row", "width", "pos", "gram"), "places")


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit (words inside any occurrence of a window), n_items
    (items with one), items_sha256 (of their ids sorted as strings and comma-joined), contaminated.

    An item of fewer than `window` words is one window; an item without words (or null text) has none. Rows of
    one item id are one item with the windows of all its texts. A null or empty document has no words. Repeated
    documents are rows of their own, ids may be null (an item without an id counts as the empty string), no
    other column is read, and an empty benchmark marks nothing.
    """
    documents, hits, owners = find_windows(docs, benchmark, id_col, text_col, item_col, item_text_col, window, gram)
    spans = hits.select("row", "start", "len").distinct()
    inside = spans.select("row", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("word"))
    n_hit = inside.distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    named = hits.select("row", "win").distinct().join(owners, "win").select("row", F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"))
    items = named.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    joined = documents.join(n_hit, "row", "left").join(items, "row", "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
