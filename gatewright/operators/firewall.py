"""The firewall: per-sink policy, sanitising, inspection with a verdict, and fusion with a classifier's score."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.functions.dialect import settle
from gatewright.operators import structure
from gatewright.operators.normalize import Normalization, normalize, was_modified
from gatewright.operators.tripwires import BLOCKING, BUILTIN_RULES, RISK, Rule, risks

# Where text flows to, and the profiles.
SINKS = ("trusted_instruction", "untrusted_data", "tool_output", "rag_chunk")
PROFILES = ("strict", "balanced", "off")
# The advisory threshold of a classifier's score, and the score from which its risk is high.
CLASSIFIER_THRESHOLD, HIGH_SCORE = 0.445, 0.95

#: A classifier: (text, sink) -> struct<score: double, label: string, error: string>; a null score with an error is a failure.
Classifier = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Config:
    """profile 'off' disables rules and makes sanitize() the identity; 'strict' and 'balanced' are alike.
    sink is the default where a row has none. max_length 0 is no cap."""

    profile: str = "balanced"
    sink: str = "untrusted_data"
    strip_template_tokens: bool = True
    max_length: int = 0
    extra_rules: Sequence[Rule] = field(default_factory=tuple)
    classifier: Classifier | None = None
    classifier_threshold: float = CLASSIFIER_THRESHOLD
    defuse_fixpoint: bool = False


class Firewall:
    """Transforms DataFrame to DataFrame; every method is lazy and moves no row. Null texts give nulls, never 'clean'."""

    def __init__(self, config: Config | None = None, **changes):
        self.config = replace(config or Config(), **changes)
        if self.config.profile not in PROFILES:
            raise ValueError(f"unknown profile {self.config.profile!r}")
        self.rules = (*BUILTIN_RULES, *self.config.extra_rules)

    @property
    def profile(self) -> str:
        return self.config.profile

    def _sink(self, sink: Column | str | None) -> Column:
        if sink is None:
            return F.lit(self.config.sink)
        return F.coalesce(F.col(sink) if isinstance(sink, str) else sink, F.lit(self.config.sink))

    def _cleaned(self, df: DataFrame, text_col: str, sink: Column | str | None) -> DataFrame:
        """Adds _sink, _norm (normalised), _report and _text (defused as the sink demands)."""
        df = df.withColumn("_sink", self._sink(sink))
        untrusted = F.col("_sink") != "trusted_instruction"
        df = normalize(df, text_col, Normalization(untrusted, untrusted, max_length=self.config.max_length), "_norm", "_report")
        defused = structure.defuse(F.col("_norm"), self.config.strip_template_tokens, self.config.defuse_fixpoint)
        return df.withColumn("_text", F.when(untrusted, defused).otherwise(F.col("_norm")))

    def sanitize(self, df: DataFrame, text_col: str = "text", sink: Column | str | None = None, out_col: str = "sanitized") -> DataFrame:
        if self.config.profile == "off":
            return df.withColumn(out_col, F.col(text_col))
        return self._cleaned(df, text_col, sink).withColumn(out_col, F.col("_text")).drop("_sink", "_norm", "_report", "_text")

    def inspect(self, df: DataFrame, text_col: str = "text", sink: Column | str | None = None, out_col: str = "report") -> DataFrame:
        """Adds struct<text, risks, modified, normalization, verdict, sink>. Risks (and their spans) are those of the
        normalised text before template tokens go; verdict is blocked, flagged or clean-structural, never 'safe'."""
        df = self._cleaned(df, text_col, sink)
        none = F.when(F.col("_norm").isNotNull(), F.array().cast(f"array<{RISK}>"))
        df = df.withColumn("_risks", none if self.config.profile == "off" else risks(F.col("_norm"), self.rules))
        untrusted = F.col("_sink") != "trusted_instruction"
        hard = untrusted & F.exists("_risks", lambda r: (r["severity"] == "high") & r["rule"].isin(*BLOCKING))
        verdict = F.when(hard, "blocked").when(F.size("_risks") > 0, "flagged").otherwise("clean-structural")
        modified = was_modified(F.col("_report")) | (F.col("_text") != F.col("_norm"))
        report = F.struct(
            F.col("_text").alias("text"), F.col("_risks").alias("risks"), modified.alias("modified"), F.col("_report").alias("normalization"), verdict.alias("verdict"), F.col("_sink").alias("sink")
        )
        return settle(df, F.when(F.col("_norm").isNotNull(), report), out_col).drop("_sink", "_norm", "_report", "_text", "_risks")

    def inspect_with_classifier(self, df: DataFrame, text_col: str = "text", sink: Column | str | None = None, out_col: str = "report") -> DataFrame:
        """inspect(), then the classifier on the sanitised text. Its score only adds a risk: nothing is ever cleared.
        Without a classifier, or with profile off, it is inspect()."""
        df = self.inspect(df, text_col, sink, out_col)
        if self.config.classifier is None or self.config.profile == "off":
            return df
        df = df.withColumn("_r", self.config.classifier(F.col(out_col)["text"], F.col(out_col)["sink"]))
        return df.withColumn(out_col, fused(F.col(out_col), F.col("_r"), self.config.classifier_threshold)).drop("_r")

    def build_messages(self, df: DataFrame, key: str, **columns) -> DataFrame:
        return structure.build_messages(df, key, **columns)


def _added(rule: str, message: Column, severity: Column) -> Column:
    span = F.lit(None).cast("struct<start:int,end:int>")
    return F.array(F.struct(F.lit(rule).alias("rule"), message.alias("message"), severity.alias("severity"), span.alias("span")).cast(RISK))


def fused(report: Column, result: Column, threshold: float = CLASSIFIER_THRESHOLD) -> Column:
    """A report with a classifier's result: a failure adds an info risk, a score from the threshold on a semantic one."""
    score, label = result["score"], result["label"]
    failed = _added("classifier-error", F.lit("L5 classifier failed; semantic check NOT performed."), F.lit("info"))
    labelled = F.when(label.isNotNull() & (label != ""), F.concat(F.lit(", label="), label)).otherwise(F.lit(""))
    message = F.concat(F.lit("Classifier flagged likely injection/jailbreak (score="), F.format_string("%.2f", score), labelled, F.lit(")."))
    semantic = _added("semantic-jailbreak", message, F.when(score >= HIGH_SCORE, "high").otherwise("warn"))
    over, error = score >= threshold, score.isNull()
    found = F.when(error, F.concat(report["risks"], failed)).when(over, F.concat(report["risks"], semantic)).otherwise(report["risks"])
    verdict = F.when(~error & over & (report["verdict"] != "blocked"), "flagged").otherwise(report["verdict"])
    whole = F.struct(report["text"].alias("text"), found.alias("risks"), report["modified"].alias("modified"), report["normalization"].alias("normalization"), verdict.alias("verdict"), report["sink"].alias("sink"))
    return F.when(report.isNotNull(), whole)


#: The instance without a configuration of its own.
default = Firewall()
