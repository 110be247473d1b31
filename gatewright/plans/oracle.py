"""SQL that states the firewall's results, for an engine whose regular expressions know no lookaround.

The SQL is derived from the same fixed values as the operators, but computed by other means.
"""

from __future__ import annotations

import re

from gatewright.functions import dialect as D
from gatewright.functions import tables
from gatewright.operators import scoring
from gatewright.operators.normalize import INVISIBLE
from gatewright.operators.structure import TEMPLATE_TOKENS
from gatewright.operators.tripwires import BLOCKING, BUILTIN_RULES
from gatewright.plans.dirty import sql_dirty

_SCRIPTS = r"\p{Cyrillic}\p{Greek}\p{Armenian}"


# What the rules match, as they are defined; the operators' own forms are other ones.
LITERAL = {
    "instruction-override": r"(?i:\b(?:ignore|disregard|forget|override|bypass)\b[\s\S]{0,40}?\b(?:previous|prior|above|earlier|all|the)\b[\s\S]{0,20}?\b(?:instruction|prompt|rule|context|message))",
    "role-reassignment": r"(?i:\byou\s+are\s+now\b|\bact\s+as\s+(?:an?\s+)?(?:unrestricted|uncensored|jailbroken|dan)\b|\bfrom\s+now\s+on\s+you\b|\bpretend\s+(?:you\s+are|to\s+be)\b)",
    "named-jailbreak": r"(?i:\b(?:DAN|do\s+anything\s+now|developer\s+mode|AIM|STAN|DUDE|jailbreak|godmode|liberate[d]?)\b)",
    "system-prompt-leak": r"(?i:\b(?:repeat|print|reveal|show|output|what\s+(?:are|is|were))\b[\s\S]{0,40}?\b(?:system\s+prompt|initial\s+instruction|your\s+instruction|above\s+text|hidden\s+(?:prompt|rule)))",
    "role-token-spoof": r"(?im:<\|(?:im_start|im_end|system|user|assistant|endoftext|eot_id|bos|eos|begin_of_text|start_header_id|end_header_id|channel)\|>|\[/?INST\]|\[/?SYS\]|<</?SYS>>|</?s>|</?(?:start|end)_of_turn>"
    r"|(?:\r?\n){1,2}(?:Human|Assistant|System)\s*:|^\s*(?:system|user|assistant|tool|developer)\s*:)",
    "safety-suppression": r"(?i:\b(?:no|without|disable|turn\s+off|ignore)\b[\s\S]{0,30}?\b(?:restriction|filter|guideline|policy|safety|censorship|moral|ethic))",
    "fiction-frame": r"(?i:\b(?:hypothetically|in\s+a\s+fictional|for\s+a\s+(?:novel|story|movie|screenplay)|imagine\s+a\s+world|this\s+is\s+just\s+a\s+(?:game|story|simulation))\b)",
    "encoded-payload": r"\b(?:[A-Za-z0-9+/]{40,}={0,2}|[A-Z2-7]{40,}={0,6}|(?:[0-9a-fA-F]{2}\s?){32,})\b",
    "binary-blob": r"(?:[01]{7,8}[\s,]+){4,}[01]{7,8}",
    "morse-blob": r"(?:[.\-]{1,6}[\s/]+){8,}[.\-]{1,6}",
    "numeric-cipher": r"(?:\b\d{1,3}[\s,.\-]+){12,}\d{1,3}\b",
    "mixed-script-obfuscation": r"[A-Za-z][\p{Hiragana}\p{Katakana}\p{Han}][A-Za-z]|[\p{Hiragana}\p{Katakana}\p{Han}][A-Za-z][\p{Hiragana}\p{Katakana}\p{Han}]",
    "exfil-sink": r"(?i:!\[[^\]]*\]\(\s*https?://[^)]+\)|\]\(\s*https?://[^)]*\?[^)]*\))",
}


def plain(pattern: str) -> str:
    """A pattern for an engine whose \\b and \\s are ASCII and that has no lookaround."""
    pattern = re.sub(r"\(\?=\[[A-Za-z]+\]\)", "", pattern)  # a look at the first letter decides nothing
    for spark, other in ((D.START, r"\b"), (D.STOP, r"\b"), (D.LINE_START, "(?m:^)"), (D.INLINE_SPACE, r"[^\S\r\n]"), (D.SPACE, r"\s"), (D.NON_SPACE, r"\S"), (D.BLANKS, ""), (r"\p{Is", r"\p{")):
        pattern = pattern.replace(spark, other)
    return pattern


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _count(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, {q(pattern)}))"


def _class(characters: str) -> str:
    return "[" + "".join(rf"\x{{{ord(c):X}}}" for c in characters) + "]"


def _fold(t: str, table: dict[str, str]) -> str:
    single = {k: v for k, v in table.items() if len(v) == 1}
    out = f"translate({t}, {q(''.join(single))}, {q(''.join(single.values()))})"
    for k, v in table.items():
        if len(v) > 1:
            out = f"replace({out}, {q(k)}, {q(v)})"
    return out


def normalized(source: str, fold: bool = True, canonical: bool = True) -> str:
    """CTEs over source(doc_id, text, ...) that end in norm(…, t, and the report's counters). The texts are known
    to be their own compatibility form, and to hold no parenthesised runs."""
    steps, last = [f"n0 AS (SELECT *, text AS t FROM ({source}))"], "n0"

    def add(columns: str, t: str) -> None:
        nonlocal last
        name = f"n{len(steps)}"
        steps.append(f"{name} AS (SELECT * EXCLUDE (t), {columns + ', ' if columns else ''}{t} AS t FROM {last})")
        last = name

    for field, pattern in INVISIBLE:
        add(f"{_count('t', pattern)} AS {field}", f"regexp_replace(t, {q(pattern)}, '', 'g')")
    marks = "regexp_replace(regexp_replace(regexp_replace(t, '([0-9A-Za-z\\x{00C0}-\\x{024F}\\x{1E00}-\\x{1EFF}])\\p{M}+', '\\1', 'g'), '\\p{M}{3,}', '', 'g'), '(^|\\s)\\p{M}+', '\\1', 'g')"
    add("length(t) AS before", marks)
    add("before - length(t) AS combiningStripped", "t")
    for i, table in enumerate((tables.SMALL_CAPS, tables.NEGATIVE_SQUARED, tables.REGIONAL_INDICATORS)):
        add(f"{_count('t', _class(''.join(table)))} AS s{i}", _fold("t", table))
    gate = f"regexp_matches(t, {q(_class(tables.UPSIDE_DOWN_ONLY))})"
    add(f"CASE WHEN {gate} THEN {_count('t', _class(''.join(tables.UPSIDE_DOWN)))} ELSE 0 END AS s3", f"CASE WHEN {gate} THEN {_fold('t', tables.UPSIDE_DOWN)} ELSE t END")
    live = tables.live_homoglyphs()
    if fold:
        add(f"s0 + s1 + s2 + s3 AS stylesFolded, {_count('t', _class(''.join(live)))} AS homoglyphsFolded", _fold("t", live))
    else:
        add("s0 + s1 + s2 + s3 AS stylesFolded, 0 AS homoglyphsFolded", "t")
    if canonical:
        white = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\t', ' ', 'g'), '[^\\S\\r\\n]{2,}', ' ', 'g'), '(?m)[^\\S\\r\\n]+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"
    else:
        white = "regexp_replace(regexp_replace(t, '[^\\S\\r\\n]{3,}', '  ', 'g'), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g')"
    add("t AS unspaced", white)
    steps.append(f"norm AS (SELECT *, t <> unspaced AS whitespaceCollapsed FROM {last})")
    return ",\n".join(steps)


_TOKEN = "'[\\p{L}\\p{N}]+'"
_SPOOF = "x.l >= 3 AND ((x.a >= 2 AND x.o >= 1) OR (x.a = 0 AND x.o >= 3))"


def _census(t: str) -> str:
    """Per token: letters, ASCII letters, letters of other scripts."""
    count = lambda p: f"len(regexp_extract_all(w, {q(p)}))"
    letters, ascii_, other = count(chr(92) + "p{L}"), count("[A-Za-z]"), count("[" + _SCRIPTS + "]")
    return f"list_transform(regexp_extract_all({t}, {_TOKEN}), lambda w: {{'l': {letters}, 'a': {ascii_}, 'o': {other}}})"


def spans(source: str) -> str:
    """SELECT of doc_id, rule, severity, span_start, span_end of every rule that is in source's rules, for its text t."""
    one = "SELECT doc_id, '{id}' AS rule, '{severity}' AS severity, length(regexp_extract(t, {before}, 1)) AS span_start, length(regexp_extract(t, {before}, 1)) + length(regexp_extract(t, {match}, 0)) AS span_end FROM {source} WHERE list_contains(rules, '{id}')"
    parts = [one.format(id=r.id, severity=r.severity, before=q(f"(?s)^(.*?)(?:{LITERAL[r.id]})"), match=q(LITERAL[r.id]), source=source) for r in BUILTIN_RULES]
    found = f"SELECT doc_id, regexp_extract_all(t, {_TOKEN}) AS toks, string_split_regex(t, {_TOKEN}) AS gaps, list_position(list_transform({_census('t')}, lambda x: {_SPOOF}), true)::BIGINT AS first FROM {source} WHERE list_contains(rules, 'confusable-residue')"
    start = "coalesce(list_sum(list_transform(gaps[1:first], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(toks[1:first-1], lambda g: length(g))), 0)"
    parts.append(f"SELECT doc_id, 'confusable-residue', 'high', ({start})::BIGINT, ({start} + length(toks[first]))::BIGINT FROM ({found})")
    return " UNION ALL ".join(parts)


def fired(t: str) -> str:
    """A list of the rules' ids that match, in order."""
    ids = ", ".join(f"CASE WHEN regexp_matches({t}, {q(LITERAL[r.id])}) THEN {q(r.id)} END" for r in BUILTIN_RULES)
    words = f"list_filter({_census(t)}, lambda x: x.l > 0)"
    latin = f"len(list_filter({words}, lambda x: x.a > 0 AND x.o = 0))"
    bearing = f"len(list_filter({words}, lambda x: x.o > 0))"
    spoof = f"len(list_filter({words}, lambda x: {_SPOOF}))"
    residue = f"CASE WHEN regexp_matches({t}, '[{_SCRIPTS}]') AND {spoof} > 0 AND {latin} >= 3 AND {bearing} <= 2 AND {bearing} / ({latin} + {bearing}) <= 0.25 THEN 'confusable-residue' END"
    return f"list_filter([{ids}, {residue}], lambda x: x IS NOT NULL)"


def verdict(rules: str) -> str:
    return f"CASE WHEN list_has_any({rules}, [{', '.join(map(q, BLOCKING))}]) THEN 'blocked' WHEN len({rules}) > 0 THEN 'flagged' ELSE 'clean-structural' END"


def inspected(source: str) -> str:
    """CTEs that end in seen(doc_id, ..., t, rules, verdict) for the untrusted sinks."""
    return f"{normalized(source)},\nruled AS (SELECT *, {fired('t')} AS rules FROM norm),\nseen AS (SELECT *, {verdict('rules')} AS verdict FROM ruled)"


def dirty_inspected() -> str:
    return inspected(sql_dirty())


def defused(t: str) -> str:
    return f"regexp_replace({t}, {q('(?i)' + plain(TEMPLATE_TOKENS))}, '', 'g')"


def features(t: str, rules: str) -> dict[str, str]:
    """Expressions of the features, by name. toks and chars are columns: tokens and single characters of t."""
    c = lambda p: _count(t, plain(p))
    n_tok, n_len = "greatest(len(toks), 1)", f"greatest(length({t}), 1)"
    units = f"(length({t}) + {_count(t, '[\\x{10000}-\\x{10FFFF}]')})"
    other = r"[\p{Cyrillic}\p{Greek}\p{Armenian}\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Arabic}\p{Hebrew}]"
    place = lambda words: f"list_filter(range(1, len(toks) + 1), lambda i: list_contains([{', '.join(map(q, words))}], lower(toks[i])))"
    near = f"list_min(list_transform({place(scoring.VERBS)}, lambda a: list_min(list_transform({place(scoring.TARGETS)}, lambda b: abs(a - b)))))"
    non_latin, latin = f"len(list_filter(toks, lambda w: regexp_matches(w, {q(other)})))", f"len(list_filter(toks, lambda w: NOT regexp_matches(w, {q(other)}) AND regexp_matches(w, '[A-Za-z]')))"
    longest = lambda p: f"coalesce(list_max(list_transform(regexp_extract_all({t}, {q(p)}), lambda w: length(w) + {_count('w', '[\\x{10000}-\\x{10FFFF}]')})), 0)"
    family = "CASE r " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in scoring.FAMILIES.items()) + " END"
    times = f"(length({t}) - length(replace({t}, c, '')))"
    words = lambda listed: rf"(?i)\b(?:{'|'.join(listed)})\b"
    return {
        "char_entropy": f"CASE WHEN length({t}) = 0 THEN 0 ELSE list_sum(list_transform(list_distinct(chars), lambda c: -{times} / {units} * log2({times} / {units}))) END",
        "role_token_density": f"({c('(?i)' + TEMPLATE_TOKENS)} + {c(scoring.ROLE_LINE)}) / {n_tok} * 100",
        "override_verb_ratio": f"{c(words(scoring.VERBS))} / {n_tok}",
        "override_target_proximity": f"coalesce(1 / (1 + {near}), 1)",
        "script_mix_frac": f"{non_latin} / greatest({latin} + {non_latin}, 1)",
        "log_len": f"log10(1 + {n_len})",
        "token_count_log": f"log10(1 + {n_tok})",
        "mean_token_len": f"coalesce(list_sum(list_transform(toks, lambda w: length(w) + {_count('w', '[\\x{10000}-\\x{10FFFF}]')})), 0) / {n_tok}",
        "uppercase_ratio": f"coalesce({c('[A-Z]')} / nullif({c('[A-Za-z]')}, 0), 0)",
        "punct_ratio": f"{c('[!-/:-@' + chr(92) + '[-`{-~]')} / {n_len}",
        "longest_nonspace_run": f"{longest(chr(92) + 'S+')} / 80",
        "negation_near_safety": f"{c(scoring.NEGATION)} / {n_tok}",
        "second_person_density": f"{c(scoring.SECOND_PERSON)} / {n_tok} * 10",
        "fiction_frame_hits": c(scoring.FICTION),
        "l4_families_fired": f"len(list_distinct(list_transform({rules}, lambda r: {family})))",
        "has_url": f"CASE WHEN regexp_matches({t}, {q('(?i)' + chr(92) + 'bhttps?://[^' + chr(92) + 's)]+')}) THEN 1 ELSE 0 END",
        "b64_run_norm": f"{longest('[A-Za-z0-9+/=]+')} / 60",
        "l4_rule_count": f"len({rules})",
    }


def featured(source: str) -> str:
    """CTEs over source(doc_id, text) that end in feat(doc_id, <features>, score); the text is taken as it stands."""
    values = ", ".join(f"({v})::DOUBLE AS {k}" for k, v in features("text", "rules").items())
    logit = " + ".join([str(scoring.INTERCEPT), *[f"({n} - {m}) / {s} * {w}" for n, m, s, w in zip(scoring.NAMES, scoring.MEAN, scoring.STD, scoring.WEIGHTS, strict=True)]])
    return (
        f"f0 AS (SELECT *, {fired('text')} AS rules, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS toks, string_split(text, '') AS chars FROM ({source})),\n"
        f"f1 AS (SELECT * EXCLUDE (toks, chars), {values} FROM f0),\nfeat AS (SELECT *, 1 / (1 + exp(-({logit}))) AS score FROM f1)"
    )
