"""Evaluation of scores against labels: tiers, recall and false positives, thresholds, tags, percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The thresholds of the block and advisory tiers, and the tag of rows without one.
BLOCK, ADVISORY, UNTAGGED = 0.95, 0.85, "(untagged)"


def coerced_label(y: Column, ground_truth: Column) -> Column:
    """y, or 1 for an attack or harmful ground truth, else 0."""
    return F.coalesce(y, F.when(ground_truth.isin("attack", "harmful"), 1).otherwise(0)).cast("int")


def bench_rows(df: DataFrame, behavior: str | None = None) -> DataFrame:
    """text, y, behavior (and score, if there is one) of rows that have a text; one behavior only if given."""
    keep = ["score"] if "score" in df.columns else []
    rows = df.where("text is not null").select("text", coerced_label(F.col("y"), F.col("ground_truth")).alias("y"), F.coalesce("behavior", F.lit(UNTAGGED)).alias("behavior"), *keep)
    return rows if behavior is None else rows.where(F.col("behavior") == behavior)


def tier(score: Column, block: float = BLOCK, advisory: float = ADVISORY) -> Column:
    return F.when(score >= block, "blocked").when(score >= advisory, "advisory").otherwise("pass")


def tier_counts(df: DataFrame, block: float = BLOCK) -> DataFrame:
    """One row per tier: attacks and benign rows in it."""
    return df.groupBy(tier(F.col("score"), block).alias("tier")).agg(F.count_if(F.col("y") == 1).alias("attacks"), F.count_if(F.col("y") != 1).alias("benign"))


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def recall_fpr(df: DataFrame, block: float = BLOCK) -> DataFrame:
    """One row: n_attacks, n_benign, recall and fpr of the block tier, advisory_rate of benign rows."""
    attack, name = F.col("y") == 1, tier(F.col("score"), block)
    sums = df.agg(
        F.count_if(attack).alias("n_attacks"), F.count_if(~attack).alias("n_benign"), F.count_if(attack & (name == "blocked")).alias("ba"), F.count_if(~attack & (name == "blocked")).alias("bb"), F.count_if(~attack & (name == "advisory")).alias("ab")
    )
    return sums.select("n_attacks", "n_benign", _rate(F.col("ba"), F.col("n_attacks")).alias("recall"), _rate(F.col("bb"), F.col("n_benign")).alias("fpr"), _rate(F.col("ab"), F.col("n_benign")).alias("advisory_rate"))


def confusion(df: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """One row per threshold: tp, fp, tn, fn, recall, fpr. All thresholds in one pass, without a join."""
    each = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    sums = df.select("y", "score", each).groupBy("threshold")
    hit, attack = F.col("score") >= F.col("threshold"), F.col("y") == 1
    out = sums.agg(F.count_if(attack & hit).alias("tp"), F.count_if(~attack & hit).alias("fp"), F.count_if(~attack & ~hit).alias("tn"), F.count_if(attack & ~hit).alias("fn"))
    return out.withColumns({"recall": _rate(F.col("tp"), F.col("tp") + F.col("fn")), "fpr": _rate(F.col("fp"), F.col("fp") + F.col("tn"))})


def by_behavior(df: DataFrame, order_col: str, block: float = BLOCK) -> DataFrame:
    """One row per behavior: n, blocked, y of its last row by order_col, rate, and first (its first order_col)."""
    blocked = F.count_if(F.col("score") >= block)
    return df.groupBy("behavior").agg(F.count("*").alias("n"), blocked.alias("blocked"), F.max_by("y", order_col).alias("y"), F.min(order_col).alias("first")).withColumn("rate", _rate(F.col("blocked"), F.col("n")))


def top_behaviors(df: DataFrame, order_col: str, k: int = 20, block: float = BLOCK) -> DataFrame:
    """The k behaviors with most rows; of equal ones, the one seen first."""
    return by_behavior(df, order_col, block).orderBy(F.desc("n"), "first").limit(k).drop("first")


def percentiles(df: DataFrame, value_col: str, shares: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """share, value: the element at floor(n * share) of the sorted values, or 0 where there is none.

    Values are counted first and ranked by running sums over value buckets, so no task sorts the whole column.
    """
    counts = df.where(F.col(value_col).isNotNull()).groupBy(F.col(value_col).alias("v")).agg(F.count("*").alias("c"))
    ranged = counts.withColumn("part", F.hash(F.floor(F.log2(F.abs(F.col("v").cast("double")) + 1) * 64) * F.signum(F.col("v").cast("double"))))
    parts = ranged.groupBy("part").agg(F.sum("c").alias("pc"), F.min("v").alias("lo"))
    before = F.coalesce(F.sum("pc").over(Window.orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("part", before.alias("start"))  # a few thousand rows at most, whatever the column
    upto = F.sum("c").over(Window.partitionBy("part").orderBy("v"))
    ranks = ranged.withColumn("upto", upto).join(F.broadcast(starts), "part").select("v", (F.col("start") + F.col("upto")).alias("upto"), "c")
    n = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    wanted = n.select("n", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")).withColumn("at", F.floor(F.col("n") * F.col("share")))
    met = ranks.join(F.broadcast(wanted), (F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("c")), "right")
    return met.select("share", F.coalesce("v", F.lit(0)).alias("value"))


def class_probability(scores: Column, wanted: Sequence[str] = (), label: str | None = None) -> Column:
    """scores: array<struct<label, score>>. The sum over wanted labels; else that of the named label; else the largest."""
    names = [w.upper() for w in wanted]
    if names:
        return F.aggregate(F.filter(scores, lambda s: F.upper(s["label"]).isin(*names)), F.lit(0.0), lambda a, s: a + s["score"])
    largest = F.array_max(F.transform(scores, lambda s: s["score"]))
    named = F.get(F.filter(scores, lambda s: F.upper(s["label"]) == (label or "").upper()), F.lit(0))["score"]
    return F.coalesce(named, largest)


def serving_stats(df: DataFrame, verdict_col: str = "verdict", score_col: str = "score") -> DataFrame:
    """One row: total, blocked, block_rate, max_score."""
    sums = df.agg(F.count("*").alias("total"), F.count_if(F.col(verdict_col) == "blocked").alias("blocked"), F.max(score_col).alias("max_score"))
    return sums.select("total", "blocked", _rate(F.col("blocked"), F.col("total")).alias("block_rate"), "max_score")
