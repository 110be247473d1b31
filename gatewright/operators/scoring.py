"""The transparent classifier: 18 features of a text, a logistic score, and the reasons for it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from gatewright.functions import dialect as D
from gatewright.operators.structure import TEMPLATE_TOKENS
from gatewright.operators.tripwires import fired

_S, _A, _Z = D.SPACE, D.START, D.STOP

# The trained model.
VERSION = "l5a-v3-real-2026-05-17"
NAMES = (
    "char_entropy role_token_density override_verb_ratio override_target_proximity script_mix_frac log_len token_count_log mean_token_len uppercase_ratio punct_ratio "
    "longest_nonspace_run negation_near_safety second_person_density fiction_frame_hits l4_families_fired has_url b64_run_norm l4_rule_count"
).split()
MEAN = (4.10988863, 0.00169946, 0.01187843, 0.94168587, 0.24028117, 1.89054594, 1.12112386, 7.10539015, 0.08535519, 0.02829903, 0.21127722, 0.00094594, 0.02875009, 0.00854839, 0.09137097, 0.00395161, 0.21569624, 0.09669355)
STD = (0.34190921, 0.12717153, 0.03781533, 0.20765676, 0.40284058, 0.51418013, 0.52132719, 29.67654901, 0.19501108, 0.0423479, 1.77394811, 0.01187163, 0.13635281, 0.09550117, 0.34024146, 0.06273753, 2.36533139, 0.37449584)
WEIGHTS = (-0.1662921, 0.00146727, 0.55298438, -0.44009255, -0.74729546, 0.39552554, 0.06997858, 0.13474369, 0.20268, 0.09302222, 0.13824503, 0.19670842, 0.04797375, -0.19365482, 0.47317698, 0.03023126, 0.14534104, 0.44173782)
INTERCEPT = -1.10797811

# Words and shapes that the features count, and the family each rule belongs to.
VERBS = "ignore disregard forget override bypass reveal print repeat pretend act leak expose dump exfiltrate".split()
TARGETS = "instruction instructions prompt prompts rule rules system context guideline guidelines directive directives".split()
ROLE_LINE = rf"(?i){D.LINE_START}{D.INLINE_SPACE}*(?:system|user|assistant|tool|developer){_S}*:"
SECOND_PERSON = f"(?i)(?=[yfapYFAP]){_A}(?:you are(?: now)?|you will|you must|from now on you|act as|pretend (?:you|to)){_Z}".replace(" ", f"{_S}+")
FICTION = (
    f"(?i)(?=[hiftlHIFTL]){_A}(?:hypothetically|in a fictional|for a (?:novel|story|movie|screenplay|play)|imagine a world|this is just a (?:game|story|simulation)|let'?s role[~-]?play|in this story){_Z}".replace(" ", f"{_S}+").replace("[~-]?", f"(?:{_S}|-)?")
)
NEGATION = (
    f"(?i)(?=[nwdsifNWDSIF]){_A}(?:no|not|without|never|disable|drop|skip|ignore|forget){_Z}{D.gap(24)}{_A}"
    "(?:restriction|restrictions|filter|filters|guideline|guidelines|policy|policies|safety|rule|rules|refus(?:e|al)|guard|limit|limits|moral|ethic)"
)
URL = rf"(?i){_A}https?://[^\t\n\x0B\f\r ){D.BLANKS}]+"
FAMILIES = {
    "instruction-override": "override", "role-reassignment": "persona", "named-jailbreak": "persona", "system-prompt-leak": "leak", "role-token-spoof": "spoof",
    "safety-suppression": "safety", "fiction-frame": "fiction", "encoded-payload": "encoded", "binary-blob": "encoded", "morse-blob": "encoded",
    "numeric-cipher": "encoded", "mixed-script-obfuscation": "script", "confusable-residue": "script", "exfil-sink": "exfil",
}
_OTHER_SCRIPT = D.above_ascii(r"[\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsArabic}\p{IsHebrew}]", 0x370)
#: Plain strings without one of which a text can't match; lower case.
_GUARDED = ("restriction", "filter", "guideline", "polic", "safety", "rule", "refus", "guard", "limit", "moral", "ethic")
_FORGED, _ROLES = ("<|", "inst]", "sys]", "sys>>", "s>", "_of_turn>", "human", "assistant", "system"), ("system", "user", "assistant", "tool", "developer")
_TOLD = ("hypothetically", "fictional", "novel", "story", "movie", "screenplay", "play", "world", "game", "simulation")


def _words(words: Sequence[str]) -> str:
    first = "".join(sorted({w[0] for w in words}))
    return rf"(?i)(?=[{first}{first.upper()}]){_A}(?:{'|'.join(words)}){_Z}"


def _longest(text: Column, pattern: str) -> Column:
    most = lambda runs, length: F.array_max(F.transform(runs, length))
    short = pattern.replace(D.BLANKS, "")  # the same class, among ASCII
    return F.coalesce(F.when(D.is_ascii(text), most(D.found(text, short), F.octet_length)).otherwise(most(D.found(text, pattern), D.utf16_length)), F.lit(0))


@pandas_udf(DoubleType())
def _entropy(text: pd.Series) -> pd.Series:
    """Bits per character; shares are of UTF-16 units. The one feature that needs a count of every character, so it crosses to Python."""

    def bits(s: str | None) -> float | None:
        if not s:
            return None if s is None else 0.0
        if s.isascii():
            n = np.bincount(np.frombuffer(s.encode("ascii"), np.uint8))
            n, size = n[n > 0], len(s)
        else:
            units = s.encode("utf-32-le", "surrogatepass")
            points, n = np.unique(np.frombuffer(units, np.uint32), return_counts=True)
            size = int(n.sum() + n[points > 0xFFFF].sum())
        share = n / size
        return float(-(share * np.log2(share)).sum())

    return text.map(bits)


def _proximity(tokens: Column) -> Column:
    """1 / (1 + the least distance in tokens between an override verb and a target); 1 if either is missing.
    One pass that remembers the last place of each."""
    far = F.lit(1 << 30)
    zero = F.struct(F.lit(0).alias("i"), F.lit(-(1 << 30)).alias("verb"), F.lit(-(1 << 30)).alias("target"), far.alias("least"))

    def step(acc: Column, token: Column) -> Column:
        word = F.lower(token)
        verb, target = F.when(word.isin(*VERBS), acc["i"]).otherwise(acc["verb"]), F.when(word.isin(*TARGETS), acc["i"]).otherwise(acc["target"])
        seen = (verb >= 0) & (target >= 0)
        return F.struct((acc["i"] + 1).alias("i"), verb.alias("verb"), target.alias("target"), F.when(seen, F.least(acc["least"], F.abs(verb - target))).otherwise(acc["least"]).alias("least"))

    least = F.aggregate(tokens, zero, step, lambda acc: acc["least"])
    return F.when(least < (1 << 30), F.lit(1.0) / (least + 1)).otherwise(F.lit(1.0))


def features(df: DataFrame, text_col: str = "text", fired_col: str | None = None, out_col: str = "features") -> DataFrame:
    """Adds the features as array<double> in the order of NAMES, and <out_col>_fired, the ids of rules that fire (taken
    from fired_col if given). Null texts give nulls."""
    t, low, plain = F.col("_ft"), F.col("_low"), F.col("_plain")
    df = df.withColumn("_ft", F.col(text_col)).withColumn(f"{out_col}_fired", F.col(fired_col) if fired_col else fired(t))
    df = df.withColumns({"_low": F.lower(t), "_plain": D.is_ascii(t), "_bits": _entropy(t)})
    df = df.withColumns({"_tok": D.found(t, r"[\p{L}\p{N}]+"), "_verb": D.any_in(low, VERBS), "_foreign": F.when(plain, F.lit(False)).otherwise(D.matches(t, _OTHER_SCRIPT))})
    n_tokens = F.greatest(F.size("_tok"), F.lit(1)).cast("double")
    foreign, near = F.col("_foreign"), F.when(F.col("_verb") & D.any_in(low, TARGETS), D.matches(t, _words(VERBS)) & D.matches(t, _words(TARGETS))).otherwise(F.lit(False))
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    other = F.size(F.filter("_tok", lambda w: D.matches(w, _OTHER_SCRIPT)))
    latin = F.size(F.filter("_tok", lambda w: ~D.matches(w, _OTHER_SCRIPT) & D.matches(w, "[A-Za-z]")))
    letters, upper = D.count_of(t, "[A-Za-z]"), D.count_of(t, "[A-Z]")
    families = F.array_distinct(F.transform(F.filter(f"{out_col}_fired", lambda r: r.isin(*FAMILIES)), lambda r: F.element_at(F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv]), r)))
    counted = lambda condition, pattern: F.when(condition, D.count(t, pattern)).otherwise(0)
    values = {
        "char_entropy": F.col("_bits"),
        "role_token_density": (counted(D.any_in(low, _FORGED), f"(?i){TEMPLATE_TOKENS}") + counted(F.contains(t, F.lit(":")) & D.any_in(low, _ROLES), ROLE_LINE)) / n_tokens * 100,
        "override_verb_ratio": counted(F.col("_verb"), _words(VERBS)) / n_tokens,
        "override_target_proximity": F.when(near, _proximity(F.col("_tok"))).otherwise(1.0),
        "script_mix_frac": F.when(foreign, other / F.greatest(latin + other, F.lit(1))).otherwise(0.0),
        "log_len": F.log10(chars + 1),
        "token_count_log": F.log10(n_tokens + 1),
        "mean_token_len": D.utf16_length(F.regexp_replace(t, r"[^\p{L}\p{N}]+", "")) / n_tokens,
        "uppercase_ratio": F.when(letters > 0, upper / letters).otherwise(0.0),
        "punct_ratio": D.count_of(t, r"[!-/:-@\[-`{-~]") / chars,
        "longest_nonspace_run": _longest(t, f"{D.NON_SPACE}+") / 80,
        "negation_near_safety": counted(D.any_in(low, _GUARDED), NEGATION) / n_tokens,
        "second_person_density": counted(D.any_in(low, ("you", "act", "pretend")), SECOND_PERSON) / n_tokens * 10,
        "fiction_frame_hits": counted(D.any_in(low, _TOLD), FICTION),
        "l4_families_fired": F.size(families),
        "has_url": F.when(F.contains(low, F.lit("http")), D.matches(t, URL).cast("double")).otherwise(0.0),
        "b64_run_norm": _longest(t, "[A-Za-z0-9+/=]+") / 60,
        "l4_rule_count": F.size(f"{out_col}_fired"),
    }
    df = D.settle(df, F.when(t.isNotNull(), F.array(*[values[n].cast("double") for n in NAMES])), out_col)
    return df.drop("_ft", "_low", "_plain", "_tok", "_bits", "_verb", "_foreign")


def standardized(vector: Column) -> Column:
    return F.array(*[(F.get(vector, F.lit(i)) - MEAN[i]) / (STD[i] or 1.0) for i in range(len(NAMES))])


def score(vector: Column) -> Column:
    """Probability of an injection."""
    total = F.lit(INTERCEPT)
    for i, w in enumerate(WEIGHTS):
        total = total + (F.get(vector, F.lit(i)) - MEAN[i]) / (STD[i] or 1.0) * w
    e = F.exp(-F.abs(total))
    return F.when(total >= 0, F.lit(1.0) / (e + 1)).otherwise(e / (e + 1))


def reason(vector: Column) -> Column:
    """The three features that raise the score most, largest first (ties in the features' order)."""
    parts = [F.struct((-(F.get(vector, F.lit(i)) - MEAN[i]) / (STD[i] or 1.0) * w).alias("c"), F.lit(i).alias("i"), F.lit(NAMES[i]).alias("name")) for i, w in enumerate(WEIGHTS)]
    top = F.slice(F.array_sort(F.filter(F.array(*parts), lambda p: p["c"] < 0)), 1, 3)
    text = F.array_join(F.transform(top, lambda p: F.concat(p["name"], F.lit(" (+"), F.format_string("%.2f", -p["c"]), F.lit(")"))), ", ")
    return F.when(vector.isNull(), None).when(F.size(top) == 0, "no positive contributing feature").otherwise(text)


def scored(df: DataFrame, text_col: str = "text", with_reason: bool = True, out_col: str = "result") -> DataFrame:
    """Adds struct<score, label, version[, reason]> of the text; only built-in rules count among the features."""
    df = features(df, text_col, out_col="_vec").withColumn("_score", score(F.col("_vec")))
    label = F.when(F.col("_score") >= 0.5, "INJECTION").otherwise("SAFE")
    fields = [F.col("_score").alias("score"), label.alias("label"), F.lit(VERSION).alias("version")]
    if with_reason:
        fields.append(reason(F.col("_vec")).alias("reason"))
    return df.withColumn(out_col, F.when(F.col("_vec").isNotNull(), F.struct(*fields))).drop("_vec", "_vec_fired", "_score")


def classify(df: DataFrame, firewall, text_col: str = "text", sink=None, out_col: str = "report") -> DataFrame:
    """The firewall's inspection fused with this classifier on the sanitised text."""
    from gatewright.operators.firewall import fused

    df = firewall.inspect(df, text_col, sink, out_col)
    if firewall.profile == "off":
        return df
    df = scored(df.withColumn("_clean", F.col(out_col)["text"]), "_clean", with_reason=False, out_col="_l5")
    return df.withColumn(out_col, fused(F.col(out_col), F.col("_l5"), firewall.config.classifier_threshold)).drop("_clean", "_l5")
