"""Secret scan: fixed forms of credentials, and tokens that pass a battery of randomness tests.

Fixed forms are found by pattern. Every other run of 20 or more characters of an encoding's alphabet is a
candidate. Its encoding (hex, base32, base64) is inferred from its characters, and three tests ask whether
it looks drawn at random from that alphabet: chi-squared uniformity of the symbols (by the Wilson-Hilferty
normal form), runs above and below the alphabet's middle, and serial correlation of neighbours.

The battery's p-value is a token's chance under the null that a person wrote it. Written text repeats its
symbols and seldom changes between lower case, upper case, digits and signs; so the statistic of the
chi-squared test (pairs of equal symbols) and the number of runs of one kind have Chernoff tail bounds under
text's rates. The p-value is twice the smaller bound, and 1 where one of the three tests rejects randomness.
These p-values go through Benjamini-Hochberg control within strata of token length, over all candidates;
what it finds is what is returned, so the share of false discoveries holds for the result.

Only DataFrame functions are used. Positions come from the pieces between matches, so they are exact code
points; the false-discovery cut comes from counts per stratum and bin of p, a table of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewright.functions.dialect import let
from gatewright.llm.storage import written

#: Fixed patterns; "letters in either case" is spelt out so that every regex engine agrees.
ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
LEAST_VALUE, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "random")

#: Share of false discoveries; in written text, at most the rate of changes between kinds of characters and at least
#: the rate of equal symbols among pairs; and the deviation in standard units beyond which a test rejects randomness.
FALSE_SHARE, TEXT_RATE, TEXT_PAIRS, MOST_Z = 0.01, 0.2, 0.05, 3.9
#: Elements that are worked through at once where an array grows, so that time stays near linear in a text's matches.
CHUNK = 128

_ALPHABETS = (
    ("hex", "0123456789abcdef", r"^(?:[0-9a-f]+|[0-9A-F]+)$"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r"^[A-Z2-7]+=*$"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", r"^"),
)
_BIN, _BINS = 0.02, 2000


def _matches(text: Column, pattern: str, value_group: int = 0) -> tuple[Column, Column]:
    """Matches of pattern (value_group of each), and the pieces between them; one piece where nothing matches."""
    hit = F.rlike(text, F.lit(pattern))
    return (
        F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))),
        F.when(hit, F.split(text, pattern, -1)),
    )


def _chunked(array: Column) -> Column:
    """The array in pieces of CHUNK elements; no piece for an empty one."""

    def cut(a: Column) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(0), F.floor(F.size(a) / CHUNK)), lambda c: c * CHUNK < F.size(a)), lambda c: F.slice(a, (c * CHUNK + 1).cast("int"), CHUNK))

    return let(array, cut)


_SPAN = "struct<start:int,kind:int,end:int,token:string>"


def _placed(matches: Column, pieces: Column, kind: int, wanted) -> Column:
    """Spans (start, kind, end, token) of the matches, in order, of those that wanted(match, index) holds for."""
    # What lambdas refer to is bound by let: an expression inside a lambda is computed for each element.
    def step_of(gaps: Column) -> Column:
        return F.transform(matches, lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("size"), m.alias("token"), wanted(m, i).alias("wanted")))

    def laid(chunk: Column, at: Column) -> Column:
        zero = F.struct(at.alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))

        def step(done: Column, s: Column) -> Column:
            start = done["at"] + s["gap"]
            span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + s["size"]).alias("end"), s["token"].alias("token"))
            return F.struct((start + s["size"]).alias("at"), F.when(s["wanted"], F.array_append(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

        return F.aggregate(chunk, zero, step, lambda done: done["spans"])

    def spans(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, s: n + s["gap"] + s["size"]))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda done, n: F.array_append(done, F.element_at(done, -1) + n))
        return let(starts, lambda at: F.flatten(F.transform(chunks, lambda c, i: laid(c, F.get(at, i)))))

    return F.when(matches.isNotNull(), let(_chunked(let(pieces, step_of)), spans)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _overlapping(spans: Column, start: Column, end: Column) -> Column:
    return F.filter(spans, lambda s: (s["start"] < end) & (start < s["end"]))


def _clear_of(base: Column, tokens: Column) -> Column:
    """Tokens that overlap no base span; each piece of the tokens meets the base spans of its own stretch alone."""

    def clear(spans: Column, chunk: Column) -> Column:
        near = _overlapping(spans, F.element_at(chunk, 1)["start"], F.element_at(chunk, -1)["end"])
        return let(near, lambda own: F.filter(chunk, lambda t: F.size(_overlapping(own, t["start"], t["end"])) == 0))

    return let(base, lambda spans: F.flatten(F.transform(_chunked(tokens), lambda chunk: clear(spans, chunk))))


def _battery(tokens: DataFrame) -> DataFrame:
    """Adds n, random (all tests passed) and surprise (minus the base-10 logarithm of the battery's p-value)."""
    body = F.regexp_replace("token", "=+$", "")
    base = tokens.withColumn("body", body)
    lowered = F.when(F.rlike("body", F.lit(r"^[0-9A-F]+$")), F.lower("body")).otherwise(F.translate("body", "-_", "+/"))
    which = F.lit(_ALPHABETS[-1][0])
    alphabet = F.lit(_ALPHABETS[-1][1])
    for name, symbols, form in reversed(_ALPHABETS[:-1]):
        alphabet = F.when(F.rlike("token", F.lit(form)), F.lit(symbols)).otherwise(alphabet)
        which = F.when(F.rlike("token", F.lit(form)), F.lit(name)).otherwise(which)
    coded = base.withColumn("encoding", which).withColumn("alphabet", alphabet).withColumn("chars", F.filter(F.split(lowered, ""), lambda c: c != ""))
    coded = coded.withColumn("codes", F.transform("chars", lambda c: F.instr(F.col("alphabet"), c) - 1).cast("array<double>"))
    coded = coded.withColumn("n", F.size("codes").cast("double")).where("n >= 2").withColumn("k", F.length("alphabet").cast("double"))
    squares = F.aggregate(F.array_distinct("codes"), F.lit(0.0), lambda s, c: s + F.pow(F.size(F.filter("codes", lambda x: x == c)).cast("double"), F.lit(2.0)))
    coded = coded.withColumn("squares", squares).withColumn("pairs", (F.col("squares") - F.col("n")) / 2)
    chi = F.col("k") / F.col("n") * F.col("squares") - F.col("n")
    free = F.col("k") - 1
    third = F.lit(2.0) / (free * 9)
    coded = coded.withColumn("chi_z", (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (F.lit(1.0) - third)) / F.sqrt(third))
    highs = F.transform("codes", lambda c: F.when(c * 2 >= F.col("k"), F.lit(1.0)).otherwise(F.lit(0.0)))
    coded = coded.withColumn("highs", highs).withColumn("n1", F.aggregate("highs", F.lit(0.0), lambda s, x: s + x))
    turns = F.aggregate(F.sequence(F.lit(1), F.size("highs") - 1), F.lit(1.0), lambda s, i: s + F.abs(F.get("highs", i) - F.get("highs", i - 1)))
    twice = F.col("n1") * 2 * (F.col("n") - F.col("n1"))
    spread = twice * (twice - F.col("n")) / (F.col("n") * F.col("n") * (F.col("n") - 1))
    runs_z = F.when(spread > 0, (turns - twice / F.col("n") - 1) / F.sqrt(spread)).otherwise(F.lit(99.0))
    mean = F.aggregate("codes", F.lit(0.0), lambda s, x: s + x) / F.col("n")
    coded = coded.withColumn("runs_z", runs_z).withColumn("mean", mean)
    variance = F.aggregate("codes", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean")))
    lagged = F.aggregate(F.sequence(F.lit(1), F.size("codes") - 1), F.lit(0.0), lambda s, i: s + (F.get("codes", i) - F.col("mean")) * (F.get("codes", i - 1) - F.col("mean")))
    serial_z = F.when(variance > 0, lagged / variance * F.sqrt("n")).otherwise(F.lit(99.0))
    coded = coded.withColumn("serial_z", serial_z)
    kinds = F.transform("chars", lambda c: F.when(F.rlike(c, F.lit("[a-z]")), 0).when(F.rlike(c, F.lit("[A-Z]")), 1).when(F.rlike(c, F.lit("[0-9]")), 2).otherwise(3))
    coded = coded.withColumn("kinds", kinds)
    changes = F.aggregate(F.sequence(F.lit(1), F.size("kinds") - 1), F.lit(0.0), lambda s, i: s + F.when(F.get("kinds", i) != F.get("kinds", i - 1), 1.0).otherwise(0.0))
    rate = F.least(changes / (F.col("n") - 1), F.lit(1 - 1e-9))
    coded = coded.withColumn("rate", rate)
    excess = F.col("rate") * F.log(F.col("rate") / TEXT_RATE) + (F.lit(1.0) - F.col("rate")) * F.log((F.lit(1.0) - F.col("rate")) / (1 - TEXT_RATE))
    by_runs = F.when(F.col("rate") > TEXT_RATE, (F.col("n") - 1) * excess).otherwise(F.lit(0.0))
    expected, pairs = F.col("n") * (F.col("n") - 1) / 2 * TEXT_PAIRS, F.col("pairs")
    fewer = expected - pairs + F.when(pairs > 0, pairs * F.log(pairs / expected)).otherwise(0.0)
    by_pairs = F.when(pairs < expected, fewer).otherwise(F.lit(0.0))
    passed = (F.abs("chi_z") <= MOST_Z) & (F.abs("runs_z") <= MOST_Z) & (F.abs("serial_z") <= MOST_Z)
    surprise = F.greatest(F.greatest(by_runs, by_pairs) / F.log(F.lit(10.0)) - F.log10(F.lit(2.0)), F.lit(0.0))
    return coded.withColumn("random", passed).withColumn("surprise", F.when(passed, surprise).otherwise(0.0))


def _discoveries(tested: DataFrame, false_share: float) -> DataFrame:
    """Benjamini-Hochberg within strata of length (powers of two), on p-values rounded up to a bin."""
    binned = tested.withColumn("stratum", F.floor(F.log2("n")).cast("int")).withColumn("bin", F.least(F.floor(F.col("surprise") / _BIN), F.lit(_BINS)).cast("int"))
    counts = binned.groupBy("stratum", "bin").agg(F.count("*").alias("c"))
    upward = Window.partitionBy("stratum").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("rank", F.sum("c").over(upward)).withColumn("m", F.sum("c").over(Window.partitionBy("stratum")))
    within = (F.pow(F.lit(10.0), -F.col("bin") * _BIN) * F.col("m") <= F.col("rank") * false_share) & (F.col("bin") > 0)  # bin 0 holds p = 1
    cuts = ranked.where(within).groupBy("stratum").agg(F.min("bin").alias("cut"))
    return binned.join(F.broadcast(cuts), "stratum").where("bin >= cut")  # a row for each power of two


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", false_share: float = FALSE_SHARE) -> DataFrame:
    """One row per input row: row, doc_id, base and all (arrays of struct<start, kind, end>; kind indexes KINDS).

    base holds the fixed forms, leftmost and non-overlapping per kind, failing matches dropped; all adds
    random tokens clear of base spans. Offsets are code points, ends exclusive. A null or empty text has no
    spans; ids may be null or repeat; the text itself and other columns are not returned.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = read.select("row", "doc_id", text.alias("text"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("token", TOKEN)):
        matches, pieces = _matches(F.col("text"), pattern)
        found = found.withColumn(f"{name}_m", matches).withColumn(f"{name}_p", pieces)
    spans = {
        "assign": _placed(F.col("assign_m"), F.col("assign_p"), 0, lambda m, i: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_VALUE),
        "access": _placed(F.col("access_m"), F.col("access_p"), 1, lambda m, i: F.length(m) >= LEAST_ACCESS),
        "hex": _placed(F.col("hex_m"), F.col("hex_p"), 2, lambda m, i: F.lit(True)),
        "token": _placed(F.col("token_m"), F.col("token_p"), 3, lambda m, i: F.lit(True)),
    }
    placed = found.select("row", "doc_id", *[s.alias(name) for name, s in spans.items()])
    base = F.transform(F.sort_array(F.concat("assign", "access", "hex")), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    placed = placed.select("row", "doc_id", base.alias("base"), "token")
    placed = written(placed.withColumn("token", _clear_of(F.col("base"), F.col("token"))), "spans")
    tokens = placed.where("size(token) > 0").select("row", F.explode("token").alias("t")).select("row", "t.*")
    random = _discoveries(_battery(tokens), false_share).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("random"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    joined = placed.select("row", "doc_id", "base").join(random, "row", "left")
    return joined.select("row", "doc_id", "base", F.sort_array(F.concat("base", F.coalesce("random", empty))).alias("all"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of scan(): doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scan(docs, id_col, text_col).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("all")).alias("spans")
    )


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """docs with every span of scan() replaced by mask; all columns and rows stay."""
    tagged = written(docs.withColumn("__gatewright_row", F.monotonically_increasing_id()), "tagged")
    found = scan(tagged.select(F.col("__gatewright_row").alias("doc_id"), F.col(text_col).alias("text"))).where("size(all) > 0").select(F.col("doc_id").alias("__gatewright_row"), F.col("all").alias("__gatewright_spans"))
    def within(chunk: Column, at: Column, piece: Column) -> Column:
        """struct<at, out>: piece starts at code point at of the text and reaches over the chunk's spans."""
        zero = F.struct(at.alias("at"), F.lit("").alias("out"))

        def step(done: Column, s: Column) -> Column:
            kept = F.substr(piece, done["at"] - at + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
            marked = F.when(s["end"] > done["at"], F.concat(done["out"], kept, F.when(s["start"] >= done["at"], F.lit(mask)).otherwise(F.lit("")))).otherwise(done["out"])
            return F.struct(F.greatest(done["at"], s["end"]).alias("at"), marked.alias("out"))

        return F.aggregate(chunk, zero, step)

    def clean(text: Column) -> Column:
        def over(done: Column, chunk: Column) -> Column:
            reach = F.greatest(F.array_max(F.transform(chunk, lambda s: s["end"])), done["at"])
            piece = F.substr(text, done["at"] + 1, reach - done["at"])
            inner = let(piece, lambda p: within(chunk, done["at"], p))
            return let(inner, lambda i: F.struct(i["at"].alias("at"), F.concat(done["out"], i["out"]).alias("out")))

        whole = F.aggregate(_chunked(F.col("__gatewright_spans")), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), over)
        return let(whole, lambda w: F.concat(w["out"], F.substr(text, w["at"] + 1, F.length(text))))

    joined = tagged.join(found, "__gatewright_row", "left").withColumn(text_col, F.when(F.col("__gatewright_spans").isNotNull(), let(F.col(text_col), clean)).otherwise(F.col(text_col)))
    return joined.select(*docs.columns)
