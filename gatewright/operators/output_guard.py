"""Neutralises images and links in model output that could carry data to another host."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.functions import dialect as D

# What is looked for, and what stands in its place.
IMAGE = rf"(?i)!\[[^\]]*\]\({D.SPACE}*(https?://(?:(?!\)){D.NON_SPACE})+)[^)]*\)"
LINK = rf"(?i)\[([^\]]+)\]\({D.SPACE}*(https?://(?:(?!\)){D.NON_SPACE})*\?[^)]*)\)"
IMAGE_NOTE, LINK_NOTE = "[image removed: external exfil sink]", " (link removed)"


def host(url: Column) -> Column:
    """Host of a URL, lowered, with a port that isn't the scheme's own; null where there is none."""
    authority = F.lower(F.regexp_extract(url, r"(?i)^https?:[/\\]+([^/?#\\]*)", 1))
    bare = F.regexp_replace(authority, r"^.*@", "")
    bare = F.when(F.lower(F.substring(url, 1, 6)) == "https:", F.regexp_replace(bare, r":0*443$|:$", "")).otherwise(F.regexp_replace(bare, r":0*80$|:$", ""))
    return F.when(bare != "", bare)


def purify_output(df: DataFrame, text_col: str = "text", allow_hosts: Sequence[str] = (), out_col: str = "purified", removed_col: str = "removed") -> DataFrame:
    """Adds the text without external images and tracking links, and how many were removed. Hosts of allow_hosts
    (a short list; ports other than the scheme's are part of a host) stay. Links are looked for after images."""
    hosts = [h.lower() for h in allow_hosts]

    def step(text: Column, pattern: str, url_group: int, note) -> tuple[Column, Column]:
        if not hosts:
            return F.regexp_replace(text, pattern, note(None)), D.count(text, pattern)
        allowed = lambda m: F.coalesce(host(F.regexp_extract(m, pattern, url_group)).isin(*hosts), F.lit(False))
        gone = F.size(F.filter(D.found(text, pattern), lambda m: ~allowed(m)))
        return D.rewrite(text, pattern, lambda m: F.when(allowed(m), m).otherwise(note(m))), gone

    df = df.withColumn("_o", F.col(text_col))
    text, images = step(F.col("_o"), IMAGE, 1, lambda m: IMAGE_NOTE if m is None else F.lit(IMAGE_NOTE))
    df = df.withColumns({"_i": images, "_o": text})
    text, links = step(F.col("_o"), LINK, 2, lambda m: f"$1{LINK_NOTE}" if m is None else F.concat(F.regexp_extract(m, LINK, 1), F.lit(LINK_NOTE)))
    return df.withColumns({removed_col: F.col("_i") + links, out_col: text}).drop("_o", "_i")
