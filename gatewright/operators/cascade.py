"""Cascade of classifiers: the transparent score decides clear cases, an encoder the ambiguous band."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gatewright.operators import encoders, scoring

# The band's ends and the weight of the second stage.
ALLOW_BELOW, BLOCK_ABOVE, GATE = 0.15, 0.95, 1.0


@dataclass(frozen=True)
class Cascade:
    """second: text -> struct<score, error> (see encoders), or None for the first stage alone. It sees the texts of
    the band only: others reach it as nulls, so nothing is split, computed twice or joined back."""

    second: Callable[[Column], Column] | None = None
    second_version: str = "encoder"
    allow_below: float = ALLOW_BELOW
    block_above: float = BLOCK_ABOVE
    gate: float = GATE
    with_reason: bool = True

    @staticmethod
    def of(folder: str, l5e: bool = False, l5d: bool = False, l5c: bool = False, **options) -> Cascade:
        """The encoder that the flags ask for: the last of b, c, d, e."""
        kind = "l5e" if l5e else "l5d" if l5d else "l5c" if l5c else "l5b"
        return Cascade(encoders.encoder_scorer(kind, folder), kind, **options)

    def classify(self, df: DataFrame, text_col: str = "text", out_col: str = "result", observe: Observation | None = None) -> DataFrame:
        """Adds struct<score, label, version, stage, route<stage, l5a, l5b, l5bInvoked>, reason, error>. Where the second
        stage fails, score and label are null and error says why. observe counts the routes taken."""
        df = scoring.features(df.withColumn("_ct", F.col(text_col)), "_ct", out_col="_vec").withColumn("_a", scoring.score(F.col("_vec")))
        a = F.col("_a")
        if self.second is None:
            band, seen = F.lit(False), F.lit(None).cast("struct<score:double,error:string>")
        else:
            band = (a >= self.allow_below) & (a <= self.block_above)
            seen = self.second(F.when(band, F.col("_ct")))
        df = df.withColumns({"_band": band, "_b": seen})
        b, band = F.col("_b")["score"], F.col("_band")
        ramp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (a - self.allow_below) / (0.5 - self.allow_below)))
        raised = F.when(b.isNotNull(), F.least(F.lit(1.0), a + (F.lit(1.0) - a) * b * self.gate * ramp))  # least() passes nulls over
        score = F.when(band, raised).otherwise(a)
        low = a < (0.5 if self.second is None else self.allow_below)
        stage = F.when(band, "l5b-escalated").when(low, "l5a-allow").otherwise("l5a-block")
        alone = f"cascade({scoring.VERSION};l5a-only)" if self.second is None else f"cascade({scoring.VERSION})"
        version = F.when(band, f"cascade({scoring.VERSION}+{self.second_version})").otherwise(alone)
        why = scoring.reason(F.col("_vec"))
        why = F.when(band, F.concat(F.format_string("l5a=%.2f l5b=%.2f | ", a, b), why)).otherwise(why)
        df = df.withColumns({"_s": score, "_stage": stage})
        route = F.struct(F.col("_stage").alias("stage"), a.alias("l5a"), b.alias("l5b"), band.alias("l5bInvoked"))
        fields = [F.col("_s").alias("score"), F.when(F.col("_s") >= 0.5, "INJECTION").when(F.col("_s").isNotNull(), "SAFE").alias("label"), version.alias("version"), F.col("_stage").alias("stage"), route.alias("route")]
        if self.with_reason:
            fields.append(why.alias("reason"))
        fields.append(F.when(band, F.col("_b")["error"]).alias("error"))
        df = df.withColumn(out_col, F.when(F.col("_vec").isNotNull(), F.struct(*fields)))
        if observe is not None:
            df = df.observe(observe, *[F.count_if(F.col("_stage") == s).alias(s) for s in ("l5a-allow", "l5a-block", "l5b-escalated")])
        return df.drop("_ct", "_vec", "_vec_fired", "_a", "_band", "_b", "_s", "_stage")
