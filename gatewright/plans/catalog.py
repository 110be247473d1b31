"""Queries of the firewall operators, by name, with the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatewright.functions import dialect as D
from gatewright.operators import encoders, evaluate, output_guard, scoring, structure
from gatewright.operators.cascade import Cascade
from gatewright.operators.firewall import Firewall, default
from gatewright.operators.normalize import INVISIBLE, REPORT_FIELDS, Normalization, fold_styles, normalize
from gatewright.operators.tripwires import fired
from gatewright.plans import oracle as O
from gatewright.plans.dirty import spark_dirty, sql_dirty
from gatewright.sources.io import parse_lines

QUERIES = {}
ORACLES = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_REPORT = ", ".join(REPORT_FIELDS[1:8] + REPORT_FIELDS[8:9])


# Tripwires and verdicts


@_query(f"WITH {O.dirty_inspected()} SELECT rule, count(*) AS hits FROM (SELECT unnest(rules) AS rule FROM seen) GROUP BY rule")
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each rule fires on; nothing but rule ids is shuffled, counted before."""
    cleaned = normalize(spark_dirty(spark, sf_dir), "text", Normalization(True, True), "clean", "report")
    return cleaned.select(F.explode(fired(F.col("clean"))).alias("rule")).groupBy("rule").agg(F.count("*").alias("hits"))


@_query(f"WITH {O.dirty_inspected()} SELECT source, verdict, count(*) AS n FROM seen GROUP BY source, verdict")
def verdict_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return default.inspect(spark_dirty(spark, sf_dir)).groupBy("source", F.col("report.verdict").alias("verdict")).agg(F.count("*").alias("n"))


@_query(f"WITH {O.dirty_inspected()} {O.spans('seen')}")
def risks_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All risks with both ends of their spans."""
    seen = default.inspect(spark_dirty(spark, sf_dir)).select("doc_id", F.explode("report.risks").alias("r"))
    span = [F.col(f"r.span.{x}").cast("long").alias(f"span_{x}") for x in ("start", "end")]
    return seen.select("doc_id", F.col("r.rule").alias("rule"), F.col("r.severity").alias("severity"), *span)


@_query(f"WITH {O.dirty_inspected()} SELECT doc_id, array_to_string(rules, ',') AS rules, verdict, md5({O.defused('t')}) AS text_md5 FROM seen")
def inspect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = default.inspect(spark_dirty(spark, sf_dir))
    return seen.select("doc_id", F.array_join(F.transform("report.risks", lambda r: r["rule"]), ",").alias("rules"), F.col("report.verdict").alias("verdict"), F.md5("report.text").alias("text_md5"))


@_query(f"WITH {O.dirty_inspected()} SELECT doc_id FROM seen WHERE list_contains(rules, 'confusable-residue')")
def confusable_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = default.inspect(spark_dirty(spark, sf_dir))
    return seen.where(F.exists("report.risks", lambda r: r["rule"] == "confusable-residue")).select("doc_id")


@_query(f"WITH {O.dirty_inspected()} SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(t, '(?i)obey') THEN 'obey' END, CASE WHEN regexp_matches(t, '[0-9a-f]{{24,}}') THEN 'long-hex' END], lambda x: x IS NOT NULL), ',') AS extra FROM seen")
def extra_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gatewright.operators.tripwires import Rule

    firewall = Firewall(extra_rules=(Rule("obey", "warn", "(?i)obey", "obey"), Rule("long-hex", "info", "[0-9a-f]{24,}", "hex")))
    seen = firewall.inspect(spark_dirty(spark, sf_dir))
    own = F.filter("report.risks", lambda r: r["rule"].isin("obey", "long-hex"))
    return seen.select("doc_id", F.array_join(F.transform(own, lambda r: r["rule"]), ",").alias("extra"))


# Normalisation


@_query(f"WITH {O.normalized(sql_dirty())} SELECT doc_id, {_REPORT}, md5(t) AS text_md5 FROM norm")
def normalize_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = normalize(spark_dirty(spark, sf_dir), "text", Normalization(True, True))
    return done.select("doc_id", *[F.col(f"normalization.{f}").alias(f) for f in _REPORT.split(", ")], F.md5("normalized").alias("text_md5"))


@_query(f"WITH {O.normalized(sql_dirty(), fold=False, canonical=False)} SELECT doc_id, {_REPORT}, md5(t) AS text_md5 FROM norm")
def normalize_trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = normalize(spark_dirty(spark, sf_dir), "text", Normalization(False, False))
    return done.select("doc_id", *[F.col(f"normalization.{f}").alias(f) for f in _REPORT.split(", ")], F.md5("normalized").alias("text_md5"))


@_query("SELECT " + ", ".join(f"sum(len(regexp_extract_all(text, {O.q(p)})))::BIGINT AS {n}" for n, p in INVISIBLE) + f" FROM ({sql_dirty()})")
def invisible_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_dirty(spark, sf_dir).agg(*[F.sum(D.count(F.col("text"), p)).alias(n) for n, p in INVISIBLE])


@_query(f"WITH {O.normalized(sql_dirty(), fold=False, canonical=False)} SELECT doc_id, stylesFolded AS folded FROM norm")
def styles_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_styles(spark_dirty(spark, sf_dir)).select("doc_id", "folded")


@_query(f"WITH {O.normalized('SELECT doc_id, text FROM documents', fold=False, canonical=False)} SELECT doc_id, regexp_matches(text, '[a-j]') AS changed, unspaced = text AS restored FROM norm")
def nfkc_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in full-width letters, and whether composition restores them."""
    docs = _table(spark, sf_dir, "documents")
    wide = F.translate("text", "abcdefghij", "".join(chr(0xFF41 + i) for i in range(10)))
    done = normalize(docs.withColumn("wide", wide), "wide", Normalization(False, False, collapse=False))
    return done.select("doc_id", F.col("normalization.unicodeNormalized").alias("changed"), (F.col("normalized") == F.col("text")).alias("restored"))


@_query(
    "WITH s AS (SELECT doc_id, regexp_extract_all(substring(text, 1, 200), '[A-Za-z]+') AS m, string_split_regex(substring(text, 1, 200), '[A-Za-z]+') AS g FROM documents) "
    "SELECT doc_id, md5(array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(CASE WHEN length(m[i]) = 1 THEN '(' || m[i] || ')' ELSE m[i] END, '')), '')) AS text_md5, "
    "coalesce(list_sum(list_transform(m, lambda w: CASE WHEN length(w) > 1 THEN 2 * length(w) ELSE 0 END)), 0)::BIGINT AS gone FROM s"
)
def parenthesised_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters in parentheses of their own: runs are folded, single ones stay."""
    spelt = F.regexp_replace(F.substring("text", 1, 200), "([A-Za-z])", "($1)")
    done = fold_styles(_table(spark, sf_dir, "documents").withColumn("text", spelt).withColumn("plain", F.col("text")))
    return done.select("doc_id", F.md5("text").alias("text_md5"), (F.length("plain") - F.length("text")).cast("long").alias("gone"))


@_query(f"WITH {O.normalized(sql_dirty())} SELECT doc_id, length(t) > 500 AS truncated, least(length(t), 500) AS n FROM norm")
def length_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = normalize(spark_dirty(spark, sf_dir), "text", Normalization(True, True, max_length=500))
    return done.select("doc_id", F.col("normalization.truncated").alias("truncated"), F.length("normalized").cast("long").alias("n"))


# Structure, sinks and messages


@_query(f"SELECT doc_id, md5({O.defused('text')}) AS text_md5, length(text) - length({O.defused('text')}) AS removed FROM ({sql_dirty()})")
def template_defuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark_dirty(spark, sf_dir).withColumn("d", structure.defuse(F.col("text")))
    return df.select("doc_id", F.md5("d").alias("text_md5"), (F.length("text") - F.length("d")).cast("long").alias("removed"))


@_query(
    "WITH d AS (SELECT doc_id, text, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS g FROM ({src})) "
    "SELECT doc_id, md5(CASE WHEN len(m) = 0 THEN text ELSE array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(regexp_replace(m[i], '[<>\\[\\]|]', chr(8228), 'g'), '')), '') END) AS text_md5 FROM d".format(
        p=O.q("(?i)" + O.plain(structure.TEMPLATE_TOKENS)), src=sql_dirty()
    )
)
def template_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_dirty(spark, sf_dir).select("doc_id", F.md5(structure.defuse(F.col("text"), strip=False)).alias("text_md5"))


_SINK_SQL = "CASE k % 4 WHEN 0 THEN 'trusted_instruction' WHEN 1 THEN 'untrusted_data' WHEN 2 THEN 'tool_output' ELSE 'rag_chunk' END"


def _sinks(df: DataFrame) -> DataFrame:
    k = F.col("k") % 4
    return df.withColumn("sink", F.when(k == 0, "trusted_instruction").when(k == 1, "untrusted_data").when(k == 2, "tool_output").otherwise("rag_chunk"))


_TRUSTED = f"SELECT doc_id, t AS clean FROM (WITH {O.normalized(sql_dirty(), fold=False, canonical=False)} SELECT * FROM norm WHERE k % 4 = 0)"
_UNTRUSTED = f"SELECT doc_id, {O.defused('t')} AS clean FROM (WITH {O.normalized(sql_dirty())} SELECT * FROM norm WHERE k % 4 <> 0)"


@_query(f"SELECT doc_id, md5(clean) AS text_md5 FROM ({_TRUSTED} UNION ALL {_UNTRUSTED})")
def sanitize_by_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return default.sanitize(_sinks(spark_dirty(spark, sf_dir)), sink="sink").select("doc_id", F.md5("sanitized").alias("text_md5"))


_TRUSTED_RULED = f"SELECT rules FROM (WITH {O.normalized(sql_dirty(), fold=False, canonical=False)} SELECT {O.fired('t')} AS rules FROM norm WHERE k % 4 = 0)"
_UNTRUSTED_SEEN = f"SELECT {_SINK_SQL} AS sink, verdict FROM (WITH {O.dirty_inspected()} SELECT k, verdict FROM seen WHERE k % 4 <> 0)"


@_query(
    f"SELECT sink, verdict, count(*) AS n FROM (SELECT 'trusted_instruction' AS sink, CASE WHEN len(rules) > 0 THEN 'flagged' ELSE 'clean-structural' END AS verdict FROM ({_TRUSTED_RULED}) "
    f"UNION ALL {_UNTRUSTED_SEEN}) GROUP BY sink, verdict"
)
def verdict_by_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the trusted sink are flagged, never blocked."""
    seen = default.inspect(_sinks(spark_dirty(spark, sf_dir)), sink="sink")
    return seen.groupBy("sink", F.col("report.verdict").alias("verdict")).agg(F.count("*").alias("n"))


@_query(f"SELECT doc_id, md5(text) AS text_md5 FROM ({sql_dirty()})")
def profile_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Firewall(profile="off").sanitize(spark_dirty(spark, sf_dir)).select("doc_id", F.md5("sanitized").alias("text_md5"))


_HARD = f"WITH {O.normalized('SELECT conv_id AS doc_id, turn, role, text FROM conversations')}, hard AS (SELECT doc_id, turn, role, {O.defused('t')} AS h FROM norm)"
_PREAMBLE = O.q(structure.PREAMBLE.replace("{0}", "00112233445566778899aabb"))
_FENCE = "'<<DATA:' || label || ':00112233445566778899aabb>>' || chr(10) || replace(h, ':00112233445566778899aabb>>', ':00112233445566778899aabb' || chr(8205) || '>>') || chr(10) || '<<END:' || label || ':00112233445566778899aabb>>'"


@_query(
    f"{_HARD}, m AS (SELECT doc_id, turn AS p, CASE WHEN role = 'user' THEN 'chat_user' ELSE 'chat_' || role END AS label, h FROM hard) "
    f"SELECT doc_id AS conv_id, -1 AS place, 'system' AS role, md5('Be brief.' || chr(10) || chr(10) || {_PREAMBLE}) AS content_md5 FROM (SELECT DISTINCT doc_id FROM m) "
    f"UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1, 'tool', md5({_FENCE}) FROM m"
)
def build_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as fenced data under a system prompt, with a nonce that is given."""
    turns = _table(spark, sf_dir, "conversations")
    item = F.struct("turn", F.concat(F.lit("chat_"), F.col("role")).alias("label"), F.col("text").alias("content"), F.lit("untrusted_data").alias("sink"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("data")).withColumns({"system": F.lit("  Be brief. "), "user": F.lit(None).cast("string")})
    made = structure.build_messages(rows, "conv_id", nonce=F.lit("00112233445566778899aabb"))
    return made.select("conv_id", F.posexplode("messages").alias("p", "m")).select("conv_id", (F.col("p") - 1).cast("long").alias("place"), F.col("m.role").alias("role"), F.md5("m.content").alias("content_md5"))


@_query("SELECT DISTINCT conv_id, 24 AS n, 2 AS messages FROM conversations")
def message_nonces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh nonces: one per conversation, all different."""
    keys = _table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumns({"system": F.lit("s"), "user": F.lit("u"), "data": F.array().cast("array<struct<label:string,content:string,sink:string>>")})
    return structure.build_messages(keys, "conv_id").select("conv_id", F.length("nonce").alias("n"), F.size("messages").alias("messages"))


# Output guard

_NO_IMAGE = r"regexp_replace(text, '(?i)!\[[^\]]*\]\(\s*(https?://[^)\s]+)[^)]*\)', '[image removed: external exfil sink]', 'g')"
_NO_LINK = rf"regexp_replace({_NO_IMAGE}, '(?i)\[([^\]]+)\]\(\s*(https?://[^)\s]*\?[^)]*)\)', '\1 (link removed)', 'g')"


@_query(
    f"SELECT doc_id, md5({_NO_LINK}) AS text_md5, len(regexp_extract_all(text, '(?i)!\\[[^\\]]*\\]\\(\\s*(https?://[^)\\s]+)[^)]*\\)')) + len(regexp_extract_all({_NO_IMAGE}, '(?i)\\[([^\\]]+)\\]\\(\\s*(https?://[^)\\s]*\\?[^)]*)\\)')) AS removed FROM ({sql_dirty()})"
)
def purify_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output_guard.purify_output(spark_dirty(spark, sf_dir)).select("doc_id", F.md5("purified").alias("text_md5"), F.col("removed").cast("long").alias("removed"))


@_query(f"SELECT doc_id, md5(text || ' [image removed: external exfil sink], z (link removed)') AS text_md5, 2 AS removed FROM ({sql_dirty()})")
def purify_output_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text gets an image and a link of a host that isn't on the list; the listed host's stay."""
    df = spark_dirty(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" ![y](https://bad.example/z), [z](http://bad.example:81/a?b=c)")))
    done = output_guard.purify_output(df, allow_hosts=["EVIL.example"])
    return done.select("doc_id", F.md5("purified").alias("text_md5"), F.col("removed").cast("long").alias("removed"))


@_query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), ':(80|443)$', '') AS host FROM pages")
def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", output_guard.host(F.col("url")).alias("host"))


# Features and scores

_ROUNDED = ", ".join(f"round({n}, 6) AS {n}" for n in scoring.NAMES)


@_query(f"WITH {O.featured(sql_dirty())} SELECT doc_id, {_ROUNDED} FROM feat")
def token_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = scoring.features(spark_dirty(spark, sf_dir))
    return done.select("doc_id", *[F.round(F.get("features", F.lit(i)), 6).alias(n) for i, n in enumerate(scoring.NAMES)])


_SCORED = f"WITH {O.featured(sql_dirty())}"


@_query(f"{_SCORED} SELECT doc_id, round(score, 6) AS score, CASE WHEN score >= 0.5 THEN 'INJECTION' ELSE 'SAFE' END AS label FROM feat")
def l5a_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(spark_dirty(spark, sf_dir), with_reason=False).select("doc_id", F.round("result.score", 6).alias("score"), F.col("result.label").alias("label"))


_PARTS = "[" + ", ".join(f"{{'c': -({n} - {m}) / {s} * {w}, 'i': {i}, 'name': {O.q(n)}}}" for i, (n, m, s, w) in enumerate(zip(scoring.NAMES, scoring.MEAN, scoring.STD, scoring.WEIGHTS, strict=True))) + "]"


@_query(f"{_SCORED} SELECT doc_id, array_to_string(list_transform(list_sort(list_filter({_PARTS}, lambda x: x.c < 0))[1:3], lambda x: x.name), ',') AS reasons FROM feat")
def l5a_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of the three features that raise the score most."""
    done = scoring.scored(spark_dirty(spark, sf_dir))
    return done.select("doc_id", F.regexp_replace(F.regexp_replace("result.reason", r" \(\+[0-9.]+\)", ""), ", ", ",").alias("reasons"))


_CLEAN = f"SELECT doc_id, k, rules AS l4, verdict, {O.defused('t')} AS text FROM (WITH {O.dirty_inspected()} SELECT * FROM seen)"
_FUSED = f"WITH {O.featured(_CLEAN)}"


@_query(
    f"{_FUSED} SELECT doc_id, CASE WHEN verdict = 'blocked' THEN 'blocked' WHEN score >= 0.445 OR verdict = 'flagged' THEN 'flagged' ELSE verdict END AS verdict, "
    "array_to_string(list_concat(l4, CASE WHEN score >= 0.445 THEN ['semantic-jailbreak'] ELSE [] END), ',') AS rules FROM feat"
)
def inspect_with_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = scoring.classify(spark_dirty(spark, sf_dir), default)
    return done.select("doc_id", F.col("report.verdict").alias("verdict"), F.array_join(F.transform("report.risks", lambda r: r["rule"]), ",").alias("rules"))


@_query(f"WITH {O.dirty_inspected()} SELECT doc_id, verdict, array_to_string(list_append(rules, 'classifier-error'), ',') AS rules FROM seen")
def classifier_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier that always fails adds an info risk and changes no verdict."""

    def failing(text: Column, sink: Column) -> Column:
        return F.struct(F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("label"))

    done = Firewall(classifier=failing).inspect_with_classifier(spark_dirty(spark, sf_dir))
    return done.select("doc_id", F.col("report.verdict").alias("verdict"), F.array_join(F.transform("report.risks", lambda r: r["rule"]), ",").alias("rules"))


@_query(
    f"{_SCORED}, c AS (SELECT doc_id, score AS a, score BETWEEN 0.15 AND 0.95 AS band FROM feat) "
    "SELECT doc_id, CASE WHEN band THEN 'l5b-escalated' WHEN a < 0.15 THEN 'l5a-allow' ELSE 'l5a-block' END AS stage, "
    "round(CASE WHEN band THEN least(1, a + (1 - a) * 0.6 * greatest(0, least(1, (a - 0.15) / 0.35))) ELSE a END, 6) AS score FROM c"
)
def cascade_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade with a second stage that always says 0.6."""
    stub = Cascade(lambda text: F.when(text.isNotNull(), F.struct(F.lit(0.6).alias("score"), F.lit(None).cast("string").alias("error"))), "stub")
    return stub.classify(spark_dirty(spark, sf_dir)).select("doc_id", F.col("result.stage").alias("stage"), F.round("result.score", 6).alias("score"))


@_query(f"{_SCORED} SELECT CASE WHEN score >= 0.5 THEN 'l5a-block' ELSE 'l5a-allow' END AS stage, count(*) AS n FROM feat GROUP BY 1")
def cascade_first_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Cascade().classify(spark_dirty(spark, sf_dir)).groupBy(F.col("result.stage").alias("stage")).agg(F.count("*").alias("n"))


# Encoders


@_query(
    "SELECT doc_id, len(w) AS n, md5(array_to_string(w, '|')) AS windows_md5 FROM (SELECT doc_id, CASE WHEN length(text) <= 500 THEN [text] "
    "ELSE list_transform(range(0, length(text) - 499, 250), lambda s: substring(text, s + 1, 500)) END AS w FROM documents)"
)
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = encoders.sliding_windows(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.md5(F.array_join(w, "|")).alias("windows_md5"))


@_query(
    "SELECT doc_id, len(w) AS n, md5(array_to_string(w, '|')) AS windows_md5 FROM (SELECT doc_id, CASE WHEN length(text) <= 500 THEN [text] "
    "ELSE list_concat([substring(text, 1, 500), right(text, 500)], CASE WHEN length(text) > 1500 THEN [substring(text, length(text) // 2 - 249, 500)] ELSE [] END) END AS w FROM documents)"
)
def anchored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = encoders.anchored_windows(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.md5(F.array_join(w, "|")).alias("windows_md5"))


@_query(r"SELECT doc_id, len(w) AS n, md5(array_to_string(w, '|')) AS tokens_md5 FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[^\s\p{P}\p{S}]+|[\p{P}\p{S}]') AS w FROM documents)")
def basic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _table(spark, sf_dir, "documents").select("doc_id", encoders.tokens(F.col("text")).alias("w"))
    return tokens.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", "|")).alias("tokens_md5"))


@_query()
def wordpiece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded with a vocabulary of letters and their continuations."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", *letters, *(f"##{c}" for c in letters), "the", "##tion", "."])}
    piece = encoders.WordPiece(vocabulary, encoders.Contract("letters", 128, "", do_lower_case=True))
    made = encoders.encoded(F.col("text"), piece.encode)
    return _table(spark, sf_dir, "documents").withColumn("e", made).select("doc_id", F.size("e.ids").alias("n"), F.aggregate("e.mask", F.lit(0), lambda a, x: a + x).alias("used"))


@_query()
def byte_pair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = {str(b): b + 3 for b in range(256)} | {"116,104": 300, "116,104,101": 301}
    pairs = encoders.BytePairs(ids, [("116", "104"), ("116,104", "101")])
    made = encoders.encoded(F.col("text"), lambda t: pairs.encode(t, 128))
    return _table(spark, sf_dir, "documents").withColumn("e", made).select("doc_id", F.size("e.ids").alias("n"), F.aggregate("e.mask", F.lit(0), lambda a, x: a + x).alias("used"))


@_query()
def encoder_unavailable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a model folder the second stage fails visibly: null score, and an error."""
    done = Cascade.of(f"{sf_dir}/no-model", l5e=True).classify(spark_dirty(spark, sf_dir))
    return done.groupBy(F.col("result.stage").alias("stage"), F.col("result.error").isNotNull().alias("failed")).agg(F.count("*").alias("n"), F.count("result.score").alias("scored"))


# Evaluation

_ROWS = "SELECT d.doc_id, l.toxic AS y, d.source AS behavior, (d.doc_id * 37 % 101) / 100.0::DOUBLE AS score FROM documents d JOIN labels l USING (doc_id)"


def _scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a made-up score."""
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "source"), _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return docs.join(labels, "doc_id").select("doc_id", F.col("toxic").alias("y"), F.col("source").alias("behavior"), (F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100.0).alias("score"))


_TIER = "CASE WHEN score >= 0.95 THEN 'blocked' WHEN score >= 0.85 THEN 'advisory' ELSE 'pass' END"


@_query(f"SELECT {_TIER} AS tier, count(*) FILTER (y = 1) AS attacks, count(*) FILTER (y <> 1) AS benign FROM ({_ROWS}) GROUP BY 1")
def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.tier_counts(_scored_rows(spark, sf_dir))


@_query(
    f"SELECT count(*) FILTER (y = 1) AS n_attacks, count(*) FILTER (y <> 1) AS n_benign, count(*) FILTER (y = 1 AND score >= 0.95) / count(*) FILTER (y = 1) AS recall, "
    f"count(*) FILTER (y <> 1 AND score >= 0.95) / count(*) FILTER (y <> 1) AS fpr, count(*) FILTER (y <> 1 AND score >= 0.85 AND score < 0.95) / count(*) FILTER (y <> 1) AS advisory_rate FROM ({_ROWS})"
)
def recall_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.recall_fpr(_scored_rows(spark, sf_dir))


_THRESHOLDS = (0.1, 0.25, 0.445, 0.5, 0.75, 0.95)


@_query(
    f"SELECT threshold, count(*) FILTER (y = 1 AND score >= threshold) AS tp, count(*) FILTER (y <> 1 AND score >= threshold) AS fp, count(*) FILTER (y <> 1 AND score < threshold) AS tn, "
    f"count(*) FILTER (y = 1 AND score < threshold) AS fn, count(*) FILTER (y = 1 AND score >= threshold) / count(*) FILTER (y = 1) AS recall, "
    f"count(*) FILTER (y <> 1 AND score >= threshold) / count(*) FILTER (y <> 1) AS fpr FROM ({_ROWS}), unnest([{', '.join(f'{t}::DOUBLE' for t in _THRESHOLDS)}]) AS u(threshold) GROUP BY threshold"
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_scored_rows(spark, sf_dir), _THRESHOLDS)


_BEHAVIORS = f"SELECT behavior, count(*) AS n, count(*) FILTER (score >= 0.95) AS blocked, arg_max(y, doc_id) AS y, count(*) FILTER (score >= 0.95) / count(*) AS rate, min(doc_id) AS first FROM ({_ROWS}) GROUP BY behavior"


@_query(f"SELECT * EXCLUDE (first) FROM ({_BEHAVIORS}) ORDER BY n DESC, first LIMIT 20")
def top_behaviors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.top_behaviors(_scored_rows(spark, sf_dir), "doc_id")


@_query(f"SELECT * EXCLUDE (first) FROM ({_BEHAVIORS})")
def by_behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.by_behavior(_scored_rows(spark, sf_dir), "doc_id").drop("first")


@_query("SELECT share, coalesce(list_sort(vs)[floor(len(vs) * share)::BIGINT + 1], 0) AS value FROM (SELECT list(n_chars) AS vs FROM documents), unnest([0.5::DOUBLE, 0.95::DOUBLE]) AS u(share)")
def percentile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.percentiles(_table(spark, sf_dir, "documents"), "n_chars")


@_query("SELECT conv_id, turn, coalesce(CASE WHEN turn % 3 = 0 THEN NULL ELSE (turn % 2)::INT END, CASE WHEN role IN ('attack', 'harmful') OR role = 'user' THEN 1 ELSE 0 END) AS y FROM conversations")
def label_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.when(F.col("turn") % 3 != 0, (F.col("turn") % 2).cast("int"))
    truth = F.when(F.col("role") == "user", "attack").otherwise(F.col("role"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", evaluate.coerced_label(y, truth).alias("y"))


@_query("SELECT text, CASE WHEN turn % 3 > 0 THEN (turn % 2)::INT WHEN role = 'user' THEN 1 ELSE 0 END AS y, CASE WHEN turn % 2 = 0 THEN role ELSE '(untagged)' END AS behavior FROM conversations WHERE text IS NOT NULL")
def jsonl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines of JSON with fields missing here and there, read back as rows of an evaluation."""
    turns = _table(spark, sf_dir, "conversations")
    y, tag = F.when(F.col("turn") % 3 != 0, (F.col("turn") % 2).cast("int")), F.when(F.col("turn") % 2 == 0, F.col("role"))
    lines = turns.select(F.to_json(F.struct("text", y.alias("y"), F.when(F.col("role") == "user", "attack").alias("ground_truth"), tag.alias("behavior"))).alias("value"))
    return evaluate.bench_rows(parse_lines(lines)).select("text", "y", "behavior")


@_query("SELECT doc_id, round((doc_id % 7 + doc_id % 5) / 20.0, 6)::DOUBLE AS summed, round(greatest(doc_id % 7, doc_id % 5, doc_id % 3) / 20.0, 6)::DOUBLE AS largest, round((doc_id % 3) / 20.0, 6)::DOUBLE AS named FROM documents")
def class_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name, m: F.struct(F.lit(name).alias("label"), (F.pmod("doc_id", F.lit(m)) / 20.0).alias("score"))
    scores = F.array(one("Jailbreak", 7), one("injection", 5), one("benign", 3))
    p = evaluate.class_probability
    return _table(spark, sf_dir, "documents").select(
        "doc_id", F.round(p(scores, ["JAILBREAK", "INJECTION"]), 6).alias("summed"), F.round(p(scores, label="other"), 6).alias("largest"), F.round(p(scores, label="BENIGN"), 6).alias("named")
    )


@_query(f"WITH {O.featured(_CLEAN)} SELECT count(*) AS total, count(*) FILTER (verdict = 'blocked') AS blocked, count(*) FILTER (verdict = 'blocked') / count(*) AS block_rate, round(max(score), 6) AS max_score FROM feat")
def serving_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = default.inspect(spark_dirty(spark, sf_dir)).select(F.col("report.verdict").alias("verdict"), F.col("report.text").alias("text"))
    done = scoring.scored(seen, with_reason=False).select("verdict", F.col("result.score").alias("score"))
    return evaluate.serving_stats(done).withColumn("max_score", F.round("max_score", 6))


# Extensions over tables: joins, windows and rollups of the results


@_query(f"WITH {O.dirty_inspected()} SELECT source, lang, count(*) AS n, count(*) FILTER (verdict = 'blocked') AS blocked FROM seen GROUP BY ROLLUP (source, lang)")
def verdict_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = default.inspect(spark_dirty(spark, sf_dir)).select("source", "lang", F.col("report.verdict").alias("verdict"))
    return seen.rollup("source", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "blocked").alias("blocked"))


@_query(f"WITH {O.inspected('SELECT conv_id AS doc_id, turn, role, text FROM conversations')} SELECT doc_id AS conv_id, count(*) AS turns, count(*) FILTER (verdict <> 'clean-structural') AS flagged, min(CASE WHEN verdict <> 'clean-structural' THEN turn END) AS first_flagged FROM seen GROUP BY doc_id")
def conversation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = default.inspect(_table(spark, sf_dir, "conversations"))
    bad = F.col("report.verdict") != "clean-structural"
    return seen.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(bad).alias("flagged"), F.min(F.when(bad, F.col("turn"))).alias("first_flagged"))


@_query(f"WITH {O.dirty_inspected()} SELECT l.toxic, verdict, count(*) AS n FROM seen JOIN labels l USING (doc_id) GROUP BY 1, 2")
def verdict_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = default.inspect(spark_dirty(spark, sf_dir)).select("doc_id", F.col("report.verdict").alias("verdict"))
    return seen.join(_table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id").groupBy("toxic", "verdict").agg(F.count("*").alias("n"))


@_query("SELECT user_id, event_type, count(*) AS n, max(gap) AS longest_gap FROM (SELECT user_id, event_type, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) GROUP BY user_id, event_type")
def user_event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    gaps = _table(spark, sf_dir, "events").withColumn("gap", seconds - F.lag(seconds).over(by_user))
    return gaps.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("gap").alias("longest_gap"))


