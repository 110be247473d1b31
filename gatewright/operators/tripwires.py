"""Tripwire rules: shapes of known attacks, as risks with severity and span. They flag, they don't clean."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatewright.functions import dialect as D
from gatewright.operators.structure import TEMPLATE_TOKENS

RISK = "struct<rule:string,message:string,severity:string,span:struct<start:int,end:int>>"
_S, _A, _Z = D.SPACE, D.START, D.STOP


@dataclass(frozen=True)
class Rule:
    """pattern is for Spark's engine. needs are groups of plain lower-case strings: a text without one of each group
    (ASCII letters in either case) can't match, which is cheaper to see than a pattern. gate is a pattern that must
    match too. tail gives the length of the match at the start of its argument, where the pattern's own match is short of it.
    """

    id: str
    severity: str
    pattern: str
    message: str
    needs: tuple[tuple[str, ...], ...] = ()
    gate: str | None = None
    tail: Callable[[Column], Column] | None = None


def _spaced(phrase: str) -> str:
    return phrase.replace(" ", f"{_S}+")


def _word(first: str) -> str:
    """Start of a word whose first letter is one of these; the letter is looked at first."""
    return f"(?=[{first}{first.upper()}]){_A}"


#: Not after an earlier start of a line within the same white space: a match from there would be the first one.
_NEW_RUN = rf"(?<![\n\r\u2028\u2029]{D.INLINE_SPACE}{{0,8}}[\n\r\u2028\u2029])"
_HAN = r"[\x{2E80}-\x{10FFFF}&&[\p{IsHiragana}\p{IsKatakana}\p{IsHan}]]"
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
_PAIR = rf"[0-9a-fA-F]{{2}}{_S}?+"


def _encoded_length(rest: Column) -> Column:
    """Length of the longest encoded run that starts here and ends at a word's edge. A run of hex pairs that the engine
    takes whole is given back to its last edge: its end, before its last space, or after the last space inside it."""
    packed = F.regexp_substr(rest, F.lit(rf"^[A-Za-z0-9+/]{{40,}}={{0,2}}{_EDGE}"))
    run = F.regexp_substr(rest, F.lit(f"^(?:{_PAIR})++"))
    inner = F.regexp_substr(run, F.lit(f"(?s)^.*{_S}"))
    size, after = F.length(run), F.substring(rest, F.length(run) + 1, F.lit(1))
    ends_in_word, goes_on = ~D.matches(run, rf"{_S}\z"), D.matches(after, "[A-Za-z0-9_]")
    pairs = F.when(ends_in_word != goes_on, size).when(~ends_in_word, size - 1).otherwise(F.length(inner))
    return F.coalesce(F.length(packed), pairs)


# The rules' ids, severities, messages and what they match.
BUILTIN_RULES = (
    Rule(
        "instruction-override", "high",
        f"(?i){_word('idfob')}(?:ignore|disregard|forget|override|bypass){_Z}{D.gap(40)}{_A}(?:previous|prior|above|earlier|all|the){_Z}{D.gap(20)}{_A}(?:instruction|prompt|rule|context|message)",
        "Attempts to override or discard prior/system instructions.",
        (("ignore", "disregard", "forget", "override", "bypass"), ("instruction", "prompt", "rule", "context", "message")),
    ),
    Rule(
        "role-reassignment", "high",
        _spaced(f"(?i){_word('yafp')}(?:you are now{_Z}|act as (?:an?{_S}+)?(?:unrestricted|uncensored|jailbroken|dan){_Z}|from now on you{_Z}|pretend (?:you are|to be){_Z})"),
        "Attempts to reassign the model's role/persona.",
        (("now", "act", "pretend"), ("you", "unrestricted", "uncensored", "jailbroken", "dan", "to")),
    ),
    Rule(
        "named-jailbreak", "high",
        _spaced(f"(?i){_word('dasjgl')}(?:DAN|do anything now|developer mode|AIM|STAN|DUDE|jailbreak|godmode|liberated?){_Z}"),
        "Known jailbreak persona/keyword.",
        (("dan", "anything", "developer", "aim", "stan", "dude", "jailbreak", "godmode", "liberate"),),
    ),
    Rule(
        "system-prompt-leak", "high",
        _spaced(f"(?i){_word('rpsow')}(?:repeat|print|reveal|show|output|what (?:are|is|were)){_Z}{D.gap(40)}{_A}(?:system prompt|initial instruction|your instruction|above text|hidden (?:prompt|rule))"),
        "Attempts to exfiltrate the system prompt / hidden instructions.",
        (("prompt", "instruction", "above", "hidden"), ("repeat", "print", "reveal", "show", "output", "what")),
    ),
    Rule(
        "role-token-spoof", "high",
        f"(?i)(?:{TEMPLATE_TOKENS}|{D.LINE_START}{_NEW_RUN}{_S}*+(?:system|user|assistant|tool|developer){_S}*+:)",
        "Forged chat-template / role tokens.",
        (("<|", "[inst]", "[/inst]", "[sys]", "[/sys]", "sys>>", "s>", "_of_turn>", ":"),),
    ),
    Rule(
        "safety-suppression", "warn",
        _spaced(f"(?i){_word('nwdti')}(?:no|without|disable|turn off|ignore){_Z}{D.gap(30)}{_A}(?:restriction|filter|guideline|policy|safety|censorship|moral|ethic)"),
        "Asks the model to drop safety/guidelines/refusals.",
        (("restriction", "filter", "guideline", "policy", "safety", "censorship", "moral", "ethic"),),
    ),
    Rule(
        "fiction-frame", "warn",
        _spaced(f"(?i){_word('hifit')}(?:hypothetically|in a fictional|for a (?:novel|story|movie|screenplay)|imagine a world|this is just a (?:game|story|simulation)){_Z}"),
        "Hypothetical/fiction wrapper commonly used to bypass refusals.",
        (("hypothetically", "fictional", "novel", "story", "movie", "screenplay", "world", "game", "simulation"),),
    ),
    Rule(
        "encoded-payload", "warn",
        rf"(?=[A-Za-z0-9+/]{{40}}|{_PAIR * 6}){_EDGE}(?:[A-Za-z0-9+/]{{40,}}={{0,2}}|(?:[0-9a-fA-F]{{2}}{_S}?){{32,64}}){_EDGE}",
        "Long encoded blob (base64/base32/hex) — possible hidden payload.",
        tail=_encoded_length,
    ),
    Rule("binary-blob", "warn", rf"[01]{{7,8}}(?:[{_S},]++[01]{{7,8}}){{4,}}+", "Binary-encoded run — possible obfuscated payload."),
    Rule("morse-blob", "warn", rf"[.\-]{{1,6}}(?:[{_S}/]++[.\-]{{1,6}}){{8,}}+", "Morse-code run — possible obfuscated payload."),
    Rule("numeric-cipher", "info", rf"(?=\d){_A}\d{{1,3}}(?:[{_S},.\-]++\d{{1,3}}{_Z}){{12,}}+", "Long numeric run — possible A1Z26 / code-point cipher."),
    Rule(
        "mixed-script-obfuscation", "high", f"[A-Za-z]{_HAN}[A-Za-z]|{_HAN}[A-Za-z]{_HAN}",
        "Latin interleaved with CJK/Kana inside a token — keyword-filter evasion (phonetic/homoglyph spoof). Treat as untrusted, not command.",
        gate=_HAN,
    ),
    Rule(
        "exfil-sink", "high", rf"(?i)!\[[^\]]*\]\({_S}*https?://[^)]+\)|\]\({_S}*https?://[^)]*\?[^)]*\)",
        "Markdown image/link to external URL — output exfiltration vector.",
        (("](",), ("http",)),
    ),
)
CONFUSABLE = Rule(
    "confusable-residue", "high", "",
    "Cyrillic/Greek/Armenian homoglyph residue mixed into ASCII-Latin text after normalization — keyword-filter evasion. Treat as untrusted, not command.",
)
#: High risks of these rules block text that flows into an untrusted sink.
BLOCKING = ("instruction-override", "role-token-spoof", "role-reassignment", "system-prompt-leak")

_TOKEN = r"[\p{L}\p{N}]+"
_OTHER_SCRIPT = D.above_ascii(r"[\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}]", 0x370)


def _risk(rule: Rule, start: Column, end: Column) -> Column:
    span = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
    return F.struct(F.lit(rule.id).alias("rule"), F.lit(rule.message).alias("message"), F.lit(rule.severity).alias("severity"), span.alias("span"))


def fires(text: Column, rule: Rule, lowered: Column | None = None) -> Column:
    """Whether the rule matches: its cheap conditions first, its pattern only where they hold."""
    out = D.matches(text, rule.pattern)
    if rule.gate:
        out = D.matches(text, rule.gate) & out
    for group in reversed(rule.needs):
        out = D.any_in(F.lower(text) if lowered is None else lowered, group) & out
    return out


def match_risk(text: Column, rule: Rule, lowered: Column | None = None) -> Column:
    """The rule's risk with the span of its first match (code points, end exclusive), or null."""
    start = F.length(F.get(F.split(text, rule.pattern, 2), F.lit(0)))
    size = F.length(F.regexp_substr(text, F.lit(rule.pattern))) if rule.tail is None else rule.tail(F.substring(text, start + 1, F.length(text)))
    return F.when(fires(text, rule, lowered), _risk(rule, start, start + size))


def confusable_residue(text: Column) -> Column:
    """struct<token, start, end> of a word spelt with letters of other scripts in otherwise Latin text, or null."""
    tokens = D.found(text, _TOKEN)
    suspect = F.when(D.is_ascii(text), F.lit(False)).otherwise(D.matches(text, _OTHER_SCRIPT))  # else there is nothing to look for
    placed = F.transform(tokens, lambda token, place: F.struct(token.alias("token"), place.alias("place")))
    bearing = F.filter(placed, lambda w: ~D.is_ascii(w["token"]) & D.matches(w["token"], _OTHER_SCRIPT))
    n_bearing = F.size(bearing)
    with_ascii = F.size(F.filter(tokens, lambda w: D.matches(w, "[A-Za-z]")))
    latin = with_ascii - F.size(F.filter(bearing, lambda w: D.matches(w["token"], "[A-Za-z]")))

    def spoofed(w: Column) -> Column:
        count = lambda p: D.count(w["token"], p)
        letters, ascii_, other = count(r"\p{L}"), count("[A-Za-z]"), count(_OTHER_SCRIPT)
        return (letters >= 3) & (((ascii_ >= 2) & (other >= 1)) | ((ascii_ == 0) & (other >= 3)))

    first = F.get(F.filter(bearing, spoofed), F.lit(0))
    gaps = D.pieces_between(text, _TOKEN)
    lengths = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    start = lengths(F.slice(gaps, 1, first["place"] + 1)) + lengths(F.slice(tokens, 1, first["place"]))
    found = F.struct(first["token"].alias("token"), start.alias("start"), (start + F.length(first["token"])).alias("end"))
    rare = F.when(n_bearing.between(1, 2), (latin >= 3) & (n_bearing / (latin + n_bearing) <= 0.25) & first.isNotNull())
    return F.when(suspect, F.when(rare, found))


def risks(text: Column, rules: Sequence[Rule] = BUILTIN_RULES) -> Column:
    """array<RISK> in the rules' order, confusable-residue last; null for null."""

    def found(lowered: Column) -> Column:
        last = D.let(confusable_residue(text), lambda residue: F.when(residue.isNotNull(), _risk(CONFUSABLE, residue["start"], residue["end"])))
        return F.filter(F.array(*[match_risk(text, r, lowered).cast(RISK) for r in rules], last.cast(RISK)), lambda r: r.isNotNull())

    return F.when(text.isNotNull(), D.let(F.lower(text), found))


def fired(text: Column, rules: Sequence[Rule] = BUILTIN_RULES) -> Column:
    """Ids of the rules that match, without spans: the cheap form."""

    def found(lowered: Column) -> Column:
        ids = [F.when(fires(text, r, lowered), F.lit(r.id)) for r in rules] + [F.when(confusable_residue(text).isNotNull(), F.lit(CONFUSABLE.id))]
        return F.filter(F.array(*ids), lambda r: r.isNotNull())

    return F.when(text.isNotNull(), D.let(F.lower(text), found))
