"""Mechanical normalisation of untrusted text, with a report of every kind of change."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.functions import dialect as D
from gatewright.functions import tables
from gatewright.functions.unicode_forms import nfkc

# Classes of characters that carry hidden payloads, in the order they are stripped.
INVISIBLE = (
    ("zeroWidthStripped", r"[\x{200B}-\x{200D}\x{FEFF}\x{2060}\x{00AD}\x{180E}]"),
    ("bidiStripped", r"[\x{202A}-\x{202E}\x{2066}-\x{2069}\x{200E}\x{200F}\x{061C}]"),
    ("tagCharsStripped", r"[\x{E0000}-\x{E007F}]"),
    ("variationSelectorsStripped", r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]"),
)
# Combining marks after a Latin letter or digit, in long runs, and without a base.
MARKS = ((r"([0-9A-Za-z\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}])\p{M}+", "$1"), (r"\p{M}{3,}", ""), (rf"(^|{D.SPACE})\p{{M}}+", "$1"))

REPORT_FIELDS = (
    "unicodeNormalized zeroWidthStripped bidiStripped tagCharsStripped homoglyphsFolded combiningStripped variationSelectorsStripped stylesFolded whitespaceCollapsed truncated"
).split()

_PAREN = r"\(([A-Za-z])\)(?=\([A-Za-z]\))|(?<=\([A-Za-z]\))\(([A-Za-z])\)"


def _class_of(characters: str) -> str:
    """The characters as a class; an engine meets its single members only from the first one beyond ASCII on."""
    listed = "[" + "".join(rf"\x{{{ord(c):X}}}" for c in characters) + "]"
    first = min(map(ord, characters))
    return D.above_ascii(listed, first) if first > 0x7F else listed


#: All that the steps before white space may change, except parenthesised runs: texts without any of it are left alone.
_TOUCHED = D.above_ascii("[" + "".join(c for _, c in INVISIBLE) + r"\p{M}" + "".join(_class_of("".join(c for c in t if ord(c) > 0x7F)) for t in (
    tables.SMALL_CAPS, tables.NEGATIVE_SQUARED, tables.REGIONAL_INDICATORS, tables.UPSIDE_DOWN, tables.live_homoglyphs())) + "]")


def fold_table(text: Column, table: dict[str, str], gate: Column, needed: str = "") -> tuple[Column, Column]:
    """Folded text, and how many characters the table had; only where gate holds and the text has one of needed (the table's)."""
    single = {k: v for k, v in table.items() if len(v) == 1}
    out = F.translate(text, "".join(single), "".join(single.values()))
    for k, v in table.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    has = gate & D.matches(text, _class_of(needed or "".join(table)))
    return F.when(has, out).otherwise(text), F.when(has, D.count_of(text, _class_of("".join(table)))).otherwise(0)


def fold_steps(df: DataFrame, text: str = "_t", gate: str = "_touched") -> DataFrame:
    """Folds styles in column text: small capitals, parenthesised runs, squared letters, flags, upside-down. Adds _styles."""
    t, touched = F.col(text), F.col(gate)
    folded, n = fold_table(t, tables.SMALL_CAPS, touched)
    df = df.withColumns({text: folded, "_styles": n})
    flat = F.when(F.contains(t, F.lit(")(")), F.regexp_replace(t, _PAREN, "$1$2")).otherwise(t)
    df = df.withColumns({"_p": flat}).withColumns({"_styles": F.col("_styles") + F.length(t) - F.length("_p"), text: F.col("_p")}).drop("_p")
    for table in (tables.NEGATIVE_SQUARED, tables.REGIONAL_INDICATORS):
        folded, n = fold_table(t, table, touched)
        df = df.withColumns({text: folded, "_styles": F.col("_styles") + n})
    folded, n = fold_table(t, tables.UPSIDE_DOWN, touched, tables.UPSIDE_DOWN_ONLY)
    return df.withColumns({text: folded, "_styles": F.col("_styles") + n})


def _touched(text: Column) -> Column:
    return F.when(D.is_ascii(text), F.lit(False)).otherwise(D.matches(text, _TOUCHED))


def fold_styles(df: DataFrame, text_col: str = "text", out_col: str = "text", folded_col: str = "folded") -> DataFrame:
    """Adds the text with styles folded, and the number of characters folded; a null text stays null, with a null number."""
    done = fold_steps(df.withColumn("_t", F.col(text_col)).withColumn("_touched", _touched(F.col("_t"))))
    return done.withColumns({out_col: F.col("_t"), folded_col: F.when(F.col("_t").isNotNull(), F.col("_styles"))}).drop("_t", "_styles", "_touched")


def _replaced(t: Column, may: Column, pattern: str, by: str) -> Column:
    return F.when(may, F.regexp_replace(t, pattern, by)).otherwise(t)


def canonical_whitespace(t: Column, odd: Column | None = None) -> Column:
    """Tabs to spaces, runs in a line to one space, none at line ends, at most one empty line. odd: whether the text has
    white space beyond spaces, tabs and line ends; plain searches then tell which patterns may match."""
    odd, has = D.matches(t, D.ODD_SPACE) if odd is None else odd, lambda text, *some: D.any_in(text, some)
    one = lambda t: _replaced(t, odd | has(t, "  "), rf"{D.INLINE_SPACE}{{2,}}", " ")
    cut = lambda t: _replaced(t, odd | has(t, " \n", " \r") | F.endswith(t, F.lit(" ")), rf"{D.INLINE_SPACE}+{D.LINE_END}", "")
    near = lambda t: _replaced(t, has(t, "\n\n\n"), r"\n{3,}", "\n\n")
    return D.let(F.replace(t, F.lit("\t"), F.lit(" ")), lambda t: D.let(one(t), lambda t: D.let(cut(t), near)))


def collapsed_whitespace(t: Column, odd: Column | None = None) -> Column:
    odd, has = D.matches(t, D.ODD_SPACE) if odd is None else odd, lambda text, *some: D.any_in(text, some)
    return D.let(_replaced(t, odd | has(t, "   ", "\t"), rf"{D.INLINE_SPACE}{{3,}}", "  "), lambda t: _replaced(t, has(t, "\n\n\n\n"), r"\n{4,}", "\n\n\n"))


@dataclass(frozen=True)
class Normalization:
    """fold and canonical may be Columns, so that each row follows its own sink's policy."""

    fold: Column | bool = True
    canonical: Column | bool = False
    collapse: bool = True
    max_length: int = 0


def normalize(df: DataFrame, text_col: str = "text", options: Normalization = Normalization(), out_col: str = "normalized", report_col: str = "normalization") -> DataFrame:
    """Adds the normalised text and the report; a null text gives nulls in both. Lengths are code points.

    Each step is a projection of its own over the one before, so that no text is rewritten twice.
    """
    t = F.col("_t")
    fold, canonical = (c if isinstance(c, Column) else F.lit(c) for c in (options.fold, options.canonical))
    df = df.withColumns({"_raw": F.col(text_col), "_fold": fold, "_canon": canonical}).withColumn("_t", nfkc(F.col("_raw")))
    df = df.withColumns({"_unicodeNormalized": t != F.col("_raw"), "_touched": _touched(t)})
    touched = F.col("_touched")
    for name, pattern in INVISIBLE:
        df = df.withColumn("_u", F.when(touched, F.regexp_replace(t, pattern, "")).otherwise(t))
        df = df.withColumns({f"_{name}": F.when(touched, F.length(t) - F.length("_u")).otherwise(0), "_t": F.col("_u")}).drop("_u")
    df = df.withColumn("_n", F.length(t))
    for pattern, kept in MARKS:
        df = df.withColumn("_t", F.when(touched, F.regexp_replace(t, pattern, kept)).otherwise(t))
    df = fold_steps(df.withColumn("_combiningStripped", F.col("_n") - F.length(t)))
    folded, n = fold_table(t, tables.live_homoglyphs(), touched & F.col("_fold"))
    df = df.withColumns({"_homoglyphsFolded": n, "_h": folded})
    t = F.col("_h")
    df, odd = df.withColumn("_odd", D.matches(t, D.ODD_SPACE)), F.col("_odd")
    loose = collapsed_whitespace(t, odd) if options.collapse else t
    df = df.withColumn("_w", F.when(F.col("_canon"), canonical_whitespace(t, odd)).otherwise(loose))
    df = df.withColumn("_whitespaceCollapsed", F.col("_w") != t)
    long = (F.length("_w") > options.max_length) if options.max_length > 0 else F.lit(False)
    df = df.withColumns({"_truncated": long, out_col: F.when(long, F.substring("_w", 1, options.max_length)).otherwise(F.col("_w")) if options.max_length > 0 else F.col("_w")})
    sources = {"stylesFolded": "_styles"}
    report = F.struct(*[F.col(sources.get(f, f"_{f}")).alias(f) for f in REPORT_FIELDS])
    df = df.withColumn(report_col, F.when(F.col("_raw").isNotNull(), report))
    gone = ["_raw", "_fold", "_canon", "_touched", "_t", "_n", "_h", "_odd", "_w", "_styles", *[f"_{f}" for f in REPORT_FIELDS if f not in sources]]
    return df.drop(*gone)


def was_modified(report: Column) -> Column:
    """Whether the report tells of any change."""
    changed = F.lit(False)
    for field in REPORT_FIELDS:
        value = report[field]
        changed = changed | (value if field in ("unicodeNormalized", "whitespaceCollapsed", "truncated") else value > 0)
    return changed
