"""Regular expressions with ECMAScript meaning, written for Spark's engine.

Spark's \\b knows all of Unicode and its \\s only ASCII; these forms say what the rules mean. Groups that
may repeat without bound are given an exact or small count, as each turn costs the engine a stack frame.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: No ASCII word character before, or after.
START, STOP = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

#: White space as ECMAScript counts it, inside and as a class; without line ends.
BLANKS = r"\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACE = rf"[\t\n\x0B\f\r {BLANKS}]"
NON_SPACE = rf"[^\t\n\x0B\f\r {BLANKS}]"
INLINE_SPACE = rf"[\t\x0B\f {BLANKS}]"

#: White space inside lines that is neither a space nor a tab.
ODD_SPACE = rf"[\x0B\f[\x{{A0}}-\x{{10FFFF}}&&[{BLANKS}]]]"

#: Starts and ends of lines with the m flag.
LINE_START, LINE_END = r"(?<![^\n\r\u2028\u2029])", r"(?![^\n\r\u2028\u2029])"


def gap(most: int) -> str:
    return rf"[\s\S]{{0,{most}}}?"


def utf16_length(text: Column) -> Column:
    """UTF-16 code units; Spark's length() counts code points. A text of fewer than four bytes a character has no pairs to count."""
    return F.length(text) + F.when(is_ascii(text), 0).otherwise(count_of(text, r"[\x{10000}-\x{10FFFF}]"))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def count_of(text: Column, characters: str) -> Column:
    """How many characters of a class there are: what goes when its runs go, without a list of matches."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{characters}+", ""))


def any_in(lowered: Column, needles: Sequence[str]) -> Column:
    """Whether a lowered text holds one of the plain strings: a byte search, much cheaper than a pattern."""
    out = F.contains(lowered, F.lit(needles[0]))
    for needle in needles[1:]:
        out = out | F.contains(lowered, F.lit(needle))
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def above_ascii(characters: str, first: int = 0x80) -> str:
    """The class, for an engine that looks at its many parts only from a code point on."""
    return rf"[\x{{{first:X}}}-\x{{10FFFF}}&&{characters}]"


def matches(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern))


def found(text: Column, pattern: str) -> Column:
    """All matches, as an array of strings."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def pieces_between(text: Column, pattern: str) -> Column:
    """What lies between the matches: one piece more than there are matches."""
    return F.split(text, pattern, -1)


def rewrite(text: Column, pattern: str, change) -> Column:
    """Replaces every match by change(match): a closure replacement without Python."""
    hits = found(text, pattern)
    gaps = pieces_between(text, pattern)
    parts = F.transform(gaps, lambda g, i: F.concat(g, F.when(i < F.size(hits), change(F.get(hits, i))).otherwise(F.lit(""))))
    return F.when(matches(text, pattern), F.array_join(parts, "")).otherwise(text)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def settle(df: DataFrame, column: Column, name: str) -> DataFrame:
    """Adds the column in a form that filters on it aren't rewritten through, as they would compute it again and again.

    It comes out of a generator of one row, so filters on the other columns still go below it, down to the scan.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.explode_outer(F.array(column)).alias(name))
