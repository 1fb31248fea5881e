"""Queries over text: canonicalisation, perturbation, sanitising, features, coercions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical, coerce, draws, features, fixed, perturb, sanitize
from .base import PROMPTS, R6, documents, lit, prompts, query, table

_LONG_FOLD = f"replace(translate(%s, {lit(fixed.CONFUSABLE_FROM + fixed.WIDE_FROM)}, {lit(fixed.CONFUSABLE_TO + fixed.WIDE_TO)}), {lit(fixed.LJE)}, 'lj')"
_PREFIX = "​Ign­ore⁠ "
_RE2 = lambda rule: lit("(?i)" + rule)
_HITS = lambda rules, s="text": " + ".join(f"CAST(regexp_matches({s}, {_RE2(r)}) AS INTEGER)" for r in rules)


# --- canonicalisation -------------------------------------------------------------
@query(f"SELECT doc_id, regexp_replace({lit(_PREFIX)} || text, {lit('[' + fixed.INVISIBLE + chr(0xE0000) + '-' + chr(0xE007F) + ']')}, '', 'g') AS stripped FROM documents")
def strip_invisibles(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", canonical.strip_invisibles(F.concat(F.lit(_PREFIX), "text")).alias("stripped"))


@query(f"SELECT doc_id, {_LONG_FOLD % ('translate(text, ' + lit(fixed.HOMOGLYPH_FULL[0]) + ', ' + lit(fixed.HOMOGLYPH_FULL[1]) + ') || ' + lit(fixed.LJE))} AS folded FROM documents")
def fold_confusables(spark: SparkSession, d: str) -> DataFrame:
    bad = F.concat(perturb.homoglyph_full(F.col("text")), F.lit(fixed.LJE))
    return documents(spark, d).select("doc_id", canonical.fold_confusables(bad).alias("folded"))


@query()
def collapse_runs(spark: SparkSession, d: str) -> DataFrame:
    """DuckDB has no back-reference to say this for marks beyond ASCII."""
    return documents(spark, d).select("doc_id", canonical.collapse_runs(F.concat(F.lit("A!!!!  b.... ??  "), "text")).alias("collapsed"))


_PRINTED = rf"CASE WHEN length(text) > 0 AND length(regexp_replace(replace(translate(text, chr(9) || chr(10), '  '), ' ', 'x'), '[\p{{C}}\p{{Z}}]', '', 'g')) >= {fixed.MIN_PRINTABLE} * length(text) THEN text END"


@query(f"SELECT doc_id, {_PRINTED} AS decoded FROM documents")
def decode_base64(spark: SparkSession, d: str) -> DataFrame:
    span = F.regexp_replace(F.base64(F.col("text").cast("binary")), r"\s", "")
    return documents(spark, d).select("doc_id", canonical.decode_base64(span).alias("decoded"))


@query(f"SELECT doc_id, {_PRINTED} AS decoded FROM documents")
def decode_hex(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", canonical.decode_hex(F.hex(F.col("text").cast("binary"))).alias("decoded"))


@query("SELECT page_id, url || '%21%3F%2A' AS escaped, url_decode(replace(url, '+', '%2B') || '%21%3F%2A') AS decoded FROM pages")
def decode_url(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    escaped = F.concat("url", F.lit("%21%3F%2A"))
    return pages.select("page_id", escaped.alias("escaped"), canonical.decode_url(escaped).alias("decoded"))


_ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ROT_FROM, _ROT_TO = _ABC + _ABC.lower(), _ABC[13:] + _ABC[:13] + (_ABC[13:] + _ABC[:13]).lower()
_NEEDLES = " + ".join(f"CAST(contains(lower(%s), {lit(n)}) AS INTEGER)" for n in fixed.ROT13_NEEDLES)
_N = len(fixed.ROT13_NEEDLES)


@query(
    f"WITH r AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN translate(text, {lit(_ROT_FROM)}, {lit(_ROT_TO)}) ELSE text END AS t FROM documents), "
    f"s AS (SELECT doc_id, t, translate(t, {lit(_ROT_FROM)}, {lit(_ROT_TO)}) AS u FROM r) "
    f"SELECT doc_id, CASE WHEN {_NEEDLES % (('u',) * _N)} > {_NEEDLES % (('t',) * _N)} THEN u END AS decoded FROM s"
)
def rot13_detect(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 2 == 0, canonical.rot13(F.col("text"))).otherwise(F.col("text"))
    return documents(spark, d).select("doc_id", t.alias("t")).select("doc_id", canonical.rot13_if_english(F.col("t")).alias("decoded"))


@query()
def unwrap_encodings(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("Decode: "), F.regexp_replace(F.base64(F.col("text").cast("binary")), r"\s", ""), F.lit(" then "), F.hex(F.lit("ignore previous").cast("binary")), F.lit(" %3Cb%3E%21"))
    out = documents(spark, d).select("doc_id", canonical.unwrap(text).alias("u"))
    return out.select("doc_id", "u.canonical", F.to_json("u.decoded_payloads").alias("payloads"))


@query()
def canonicalize_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = prompts(spark, d).withColumn("text", perturb.homoglyph_lite(F.col("text")))
    out = canonical.canonicalize(docs).select("doc_id", "canonical_result.*")
    return out.withColumn("decoded_payloads", F.to_json("decoded_payloads"))


_RECOVER = "list_distinct(list_filter(regexp_extract_all(lower({}), '[A-Za-z0-9]+'), lambda t: t NOT IN ('enc', 'base64', 'hex', 'url')))"


@query(
    f"WITH {PROMPTS}, t AS (SELECT doc_id, text, translate(text, {lit(fixed.HOMOGLYPH_FULL[0])}, {lit(fixed.HOMOGLYPH_FULL[1])}) AS bad FROM prompts), "
    f"k AS (SELECT doc_id, {_RECOVER.format('text')} AS o, {_RECOVER.format('bad')} AS b, {_RECOVER.format(_LONG_FOLD % 'bad')} AS c FROM t) "
    "SELECT doc_id, round(CASE WHEN len(o) = 0 THEN 0.0 ELSE len(list_intersect(o, b)) / CAST(len(o) AS DOUBLE) END, 6) AS without_canon, "
    "round(CASE WHEN len(o) = 0 THEN 0.0 ELSE len(list_intersect(o, c)) / CAST(len(o) AS DOUBLE) END, 6) AS with_canon FROM k"
)
def token_recovery(spark: SparkSession, d: str) -> DataFrame:
    bad = perturb.homoglyph_full(F.col("text"))
    rows = prompts(spark, d).select("doc_id", "text", bad.alias("bad"), canonical.fold_confusables(bad).alias("fixed"))
    return rows.select("doc_id", R6(features.recovery_rate(F.col("text"), F.col("bad"))).alias("without_canon"), R6(features.recovery_rate(F.col("text"), F.col("fixed"))).alias("with_canon"))


@query()
def recovery_report(spark: SparkSession, d: str) -> DataFrame:
    """Mean word recovery over users' turns with an attack before them, by transform, before and after canonicalisation."""
    asked = table(spark, d, "conversations").where("role = 'user'")
    number = F.col("conv_id") * 31 + F.col("turn")
    texts = asked.select(number.alias("ordinal"), perturb.planted(number, F.col("text")).alias("text"))
    rows = perturb.fan_out(texts, perturb.script_transforms(F.col("ordinal")))
    done = canonical.canonicalize(rows, "perturbed")
    plain = features.recovery_rate(F.col("text"), F.col("perturbed"))
    better = features.recovery_rate(F.col("text"), F.col("canonical_result.canonical"))
    return done.groupBy("transform").agg(F.count(F.lit(1)).alias("n"), R6(F.avg(plain)).alias("without_canon"), R6(F.avg(better)).alias("with_canon"), R6(F.avg(F.size("canonical_result.trace"))).alias("mean_trace"))


# --- perturbations ----------------------------------------------------------------
@query("SELECT doc_id, regexp_replace(text, '\\s+', '  ', 'g') AS perturbed FROM documents")
def perturb_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", perturb.whitespace(F.col("text")).alias("perturbed"))


@query(f"SELECT doc_id, translate(text, {lit(_ABC + _ABC.lower())}, {lit(_ABC.lower() + _ABC)}) AS perturbed FROM documents")
def perturb_swapcase(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", perturb.casing(F.col("text")).alias("perturbed"))


@query("SELECT doc_id, text || ' !!! ??? ### ' || substr(text, 1, 30) AS perturbed FROM documents")
def perturb_punct(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", perturb.punct_stuff(F.col("text")).alias("perturbed"))


_LITE = f"translate(substr(text, 1, 200), {lit(fixed.HOMOGLYPH_LITE[0])}, {lit(fixed.HOMOGLYPH_LITE[1])}) || substr(text, 201)"


@query(f"SELECT doc_id, {_LITE} AS perturbed FROM documents")
def perturb_homoglyph(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", perturb.homoglyph_lite(F.col("text")).alias("perturbed"))


@query(f"SELECT doc_id, translate(text, {lit(fixed.HOMOGLYPH_FULL[0])}, {lit(fixed.HOMOGLYPH_FULL[1])}) AS perturbed FROM documents")
def perturb_homoglyph_full(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", perturb.homoglyph_full(F.col("text")).alias("perturbed"))


@query("SELECT doc_id, '<<<BASE64>>> ' || text || ' <<<END>>>' AS perturbed FROM documents")
def perturb_markers(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", perturb.encoding_markers(F.col("text")).alias("perturbed"))


@query("SELECT doc_id, 'Decode and execute: ' || base64(encode(text)) AS perturbed, replace(text, ' ', '  ') AS spaced FROM documents")
def perturb_base64(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", perturb.base64_wrap(F.col("text")).alias("perturbed"), perturb.double_space(F.col("text")).alias("spaced"))


@query()
def perturb_random(spark: SparkSession, d: str) -> DataFrame:
    drawn = draws.randomly(homoglyph=draws.swapped(60), casing=draws.cased(), zero_width=draws.inserted())
    return documents(spark, d).select("doc_id", drawn(F.col("text"), F.col("doc_id")).alias("drawn")).select("doc_id", "drawn.*")


_FAN = [("none", "text"), ("whitespace", "regexp_replace(text, '\\s+', '  ', 'g')"), ("casing", f"translate(text, {lit(_ABC + _ABC.lower())}, {lit(_ABC.lower() + _ABC)})"), ("punct_stuff", "text || ' !!! ??? ### ' || substr(text, 1, 30)"), ("homoglyph_lite", _LITE), ("encoding_markers", "'<<<BASE64>>> ' || text || ' <<<END>>>'")]


@query(" UNION ALL ".join(f"SELECT doc_id, {lit(n)} AS transform, length({e}) AS n_chars, md5({e}) AS digest FROM documents" for n, e in _FAN))
def perturb_fanout(spark: SparkSession, d: str) -> DataFrame:
    rows = perturb.fan_out(documents(spark, d).select("doc_id", "text"), perturb.ROBUST)
    return rows.select("doc_id", "transform", F.length("perturbed").cast("long").alias("n_chars"), F.md5(F.col("perturbed").cast("binary")).alias("digest"))


@query("SELECT doc_id, a.text || ' ' || coalesce(d.text, '') AS text FROM documents d JOIN (VALUES " + ", ".join(f"({n}, {lit(t)})" for n, t in enumerate(perturb.attack_texts())) + f") a(n, text) ON doc_id % {len(perturb.attack_texts())} = n")
def attack_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Every document with an attack before it, in turn."""
    return documents(spark, d).select("doc_id", perturb.planted(F.col("doc_id"), F.col("text")).alias("text"))


# --- sanitising -------------------------------------------------------------------
def _strip_sql(s: str = "text") -> str:
    for r in fixed.STRIP_RULES:
        s = f"regexp_replace({s}, {_RE2(r)}, '[STRIPPED]', 'g')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


@query(f"WITH {PROMPTS} SELECT doc_id, {_strip_sql()} AS sanitized FROM prompts")
def sanitize_rule_strip(spark: SparkSession, d: str) -> DataFrame:
    return prompts(spark, d).select("doc_id", sanitize.sanitize(F.col("text"), "rule_strip").alias("sanitized"))


@query(f"WITH {PROMPTS} SELECT doc_id, 'UNTRUSTED_TEXT_BEGIN' || chr(10) || regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') || chr(10) || 'UNTRUSTED_TEXT_END' || chr(10) AS sanitized FROM prompts")
def sanitize_isolate(spark: SparkSession, d: str) -> DataFrame:
    return prompts(spark, d).select("doc_id", sanitize.sanitize(F.col("text"), "context_isolation").alias("sanitized"))


def _demo_sql() -> str:
    parts, last = ["d0 AS (SELECT doc_id, text AS t0 FROM prompts)"], 0
    for i, r in enumerate(fixed.DEMO_RULES):
        keep = ", ".join(f"t{j}" for j in range(i + 1))
        parts.append(f"d{i + 1} AS (SELECT doc_id, {keep}, regexp_replace(t{i}, {_RE2(r)}, '[REDACTED]', 'g') AS t{i + 1} FROM d{i})")
        last = i + 1
    fired = " || ".join(f"CASE WHEN t{i + 1} <> t{i} THEN '{i},' ELSE '' END" for i in range(last))
    return f"WITH {PROMPTS}, {', '.join(parts)} SELECT doc_id, t{last} AS redacted, {fired} AS fired FROM d{last}"


@query(_demo_sql())
def demo_rule_strip(spark: SparkSession, d: str) -> DataFrame:
    rows = prompts(spark, d).select("doc_id", sanitize.demo_rule_strip(F.col("text")).alias("s"))
    fired = F.array_join(F.transform("s.fired", lambda i: F.concat(i.cast("string"), F.lit(","))), "")
    return rows.select("doc_id", "s.redacted", fired.alias("fired"))


@query(
    f"WITH {PROMPTS}, s AS (SELECT doc_id, text, {_strip_sql()} AS stripped FROM prompts) SELECT doc_id, length(text) AS length_before, length(stripped) AS length_after, "
    "length(text) - length(stripped) AS delta, lower(substr(stripped, 1, 120)) AS head FROM s"
)
def sanitize_report(spark: SparkSession, d: str) -> DataFrame:
    rows = prompts(spark, d).withColumn("stripped", sanitize.rule_strip(F.col("text")))
    before, after = F.length("text").cast("long"), F.length("stripped").cast("long")
    return rows.select("doc_id", before.alias("length_before"), after.alias("length_after"), (before - after).alias("delta"), F.lower(F.substring("stripped", 1, 120)).alias("head"))


def _excerpt_sql() -> str:
    s = "trim(translate(text, chr(10) || chr(13), '  '), ' ' || chr(9) || chr(11) || chr(12))"
    for r, tag in fixed.EXCERPT_RULES:
        s = f"regexp_replace({s}, {_RE2(r)}, {lit(tag)}, 'g')"
    return s


@query(f"WITH {PROMPTS}, s AS (SELECT doc_id, {_excerpt_sql()} AS e FROM prompts) SELECT doc_id, CASE WHEN length(e) > 220 THEN substr(e, 1, 220) || '...[TRUNCATED]' ELSE e END AS excerpt FROM s")
def safe_excerpt(spark: SparkSession, d: str) -> DataFrame:
    return prompts(spark, d).select("doc_id", sanitize.safe_excerpt(F.col("text")).alias("excerpt"))


_LONG = "CASE WHEN length({}) > 800 THEN 0.5 ELSE 0.0 END"
_WORDS = lambda s: f"len(list_filter(regexp_split_to_array({s}, '\\s+'), lambda v: v <> ''))"
_BASE = lambda s: f"1.0 / (1.0 + exp(-(({_HITS(fixed.BASELINE_RULES, s)}) + CAST({_LONG.format(s)} AS DOUBLE) - 1.5)))"


@query(
    f"""WITH {PROMPTS}, b AS (SELECT doc_id, text, {_BASE('text')} AS p0 FROM prompts),
m AS (SELECT doc_id, text, p0, 'off' AS mode, text AS t FROM b UNION ALL SELECT doc_id, text, p0, 'rule_strip', {_strip_sql()} FROM b
UNION ALL SELECT doc_id, text, p0, 'context_isolation', 'UNTRUSTED_TEXT_BEGIN' || chr(10) || regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') || chr(10) || 'UNTRUSTED_TEXT_END' || chr(10) FROM b
UNION ALL SELECT doc_id, text, p0, 'llm_rewrite_optional', text FROM b),
f AS (SELECT mode, doc_id, text, p0, CASE WHEN p0 >= 0.5 THEN t ELSE text END AS s FROM m),
x AS (SELECT mode, doc_id, w, count(*) AS c FROM (SELECT mode, doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM f) GROUP BY ALL),
y AS (SELECT mode, doc_id, w, count(*) AS c FROM (SELECT mode, doc_id, unnest(regexp_extract_all(lower(s), '[a-z0-9]+')) AS w FROM f) GROUP BY ALL),
dots AS (SELECT mode, doc_id, sum(x.c * y.c) AS d FROM x JOIN y USING (mode, doc_id, w) GROUP BY ALL),
sizes AS (SELECT mode, doc_id, sqrt(CAST(p AS DOUBLE)) * sqrt(CAST(q AS DOUBLE)) AS z FROM (SELECT mode, doc_id, sum(c * c) AS p FROM x GROUP BY ALL) JOIN (SELECT mode, doc_id, sum(c * c) AS q FROM y GROUP BY ALL) USING (mode, doc_id)),
a AS (SELECT f.*, {_BASE('s')} AS p1, coalesce(d / z, 0.0) AS sim, {_WORDS('text')} AS k0, {_WORDS('s')} AS k1 FROM f LEFT JOIN dots USING (mode, doc_id) LEFT JOIN sizes USING (mode, doc_id))
SELECT mode, round(avg(sim), 6) AS similarity, round(avg(k1 / CAST(greatest(1, k0) AS DOUBLE)), 6) AS token_retention, count(*) AS n, round(avg(CASE WHEN p0 >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS frac_sanitized,
round(coalesce(avg(p0 - p1) FILTER (WHERE p0 >= 0.5), 0.0), 6) AS delta_sanitized, round(avg(p0 - p1), 6) AS delta_all,
round(avg(length(s) / CAST(greatest(1, length(text)) AS DOUBLE)), 6) AS length_retention FROM a GROUP BY mode"""
)
def sanitize_tradeoff(spark: SparkSession, d: str) -> DataFrame:
    rows = prompts(spark, d).withColumn("p0", features.regex_heuristic_score(F.col("text")))
    flagged, text = F.col("p0") >= 0.5, F.col("text")
    same = {"sim": F.when(text.isNotNull(), F.lower(text).rlike("[a-z0-9]").cast("double")), "p1": F.col("p0"), "words": features.token_count(text), "chars": F.length(text)}
    rows = rows.select("text", "p0", *(c.alias(f"same_{k}") for k, c in same.items()))
    changing = [m for m in sanitize.MODES if m in ("rule_strip", "context_isolation")]  # the others leave a text as it is
    rows = rows.select("*", *(F.when(flagged, sanitize.sanitize(text, m)).alias(m) for m in changing))
    for m in changing:  # a text that passes is compared with itself in every mode: only flagged ones are read again
        s = F.col(m)
        new = {"sim": features.bag_cosine(F.when(flagged, text), s), "p1": features.regex_heuristic_score(s), "words": features.token_count(s), "chars": F.length(s)}
        rows = rows.select("*", *(F.when(flagged, c).otherwise(F.col(f"same_{k}")).alias(f"{m}_{k}") for k, c in new.items()))
    each = F.array(*(F.struct(F.lit(m).alias("mode"), *(F.col(f"{m if m in changing else 'same'}_{k}").alias(k) for k in same)) for m in sanitize.MODES))
    rows = rows.select("p0", F.col("same_words").alias("words0"), F.col("same_chars").alias("chars0"), F.explode(each).alias("e")).select("p0", "words0", "chars0", "e.*")
    delta = F.col("p0") - F.col("p1")
    return rows.groupBy("mode").agg(
        R6(F.avg("sim")).alias("similarity"), R6(F.avg(F.col("words") / F.greatest(F.lit(1), F.col("words0")))).alias("token_retention"),
        F.count(F.lit(1)).alias("n"), R6(F.avg(flagged.cast("double"))).alias("frac_sanitized"), R6(F.coalesce(F.avg(F.when(flagged, delta)), F.lit(0.0))).alias("delta_sanitized"),
        R6(F.avg(delta)).alias("delta_all"), R6(F.avg(F.col("chars") / F.greatest(F.lit(1), F.col("chars0")))).alias("length_retention"),
    )


@query(f"WITH {PROMPTS}, b AS (SELECT doc_id, text, {_BASE('text')} AS p FROM prompts) SELECT doc_id, CASE WHEN p <= 0.5 THEN text ELSE {_strip_sql()} END AS routed FROM b")
def detect_then_route(spark: SparkSession, d: str) -> DataFrame:
    rows = prompts(spark, d).withColumn("p", features.regex_heuristic_score(F.col("text")))
    return rows.select("doc_id", sanitize.gate(F.col("text"), F.col("p"), 0.5).alias("routed"))


# --- features ---------------------------------------------------------------------
@query(f"WITH {PROMPTS} SELECT doc_id, round({_BASE('text')}, 6) AS prob FROM prompts")
def regex_heuristic_score(spark: SparkSession, d: str) -> DataFrame:
    return prompts(spark, d).select("doc_id", R6(features.regex_heuristic_score(F.col("text"))).alias("prob"))


@query(f"WITH {PROMPTS} SELECT doc_id, CAST({_HITS(fixed.SCORER_RULES)} AS DOUBLE) + CAST({_LONG.format('text')} AS DOUBLE) AS score FROM prompts")
def rule_score(spark: SparkSession, d: str) -> DataFrame:
    return prompts(spark, d).select("doc_id", features.rule_score(F.col("text")).alias("score"))


@query(f"WITH {PROMPTS} SELECT doc_id, round(({_HITS(fixed.FRACTION_RULES)}) / 7.0, 6) AS fraction, CASE WHEN regexp_matches(text, {_RE2('|'.join(fixed.ANY_RULES))}) THEN 1.0 ELSE 0.0 END AS any_rule FROM prompts")
def rule_fraction(spark: SparkSession, d: str) -> DataFrame:
    return prompts(spark, d).select("doc_id", R6(features.rule_fraction(F.col("text"))).alias("fraction"), features.any_rule(F.col("text")).alias("any_rule"))


_S = "regexp_replace(regexp_replace(coalesce(text, ''), '^\\s+', ''), '\\s+$', '')"
_PUNCT = lit("[^" + "".join("\\" + c for c in fixed.PUNCTUATION) + "]")
_COUNT = lambda pattern, s="s": f"length(regexp_replace({s}, {pattern}, '', 'g'))"


@query(
    f"WITH {PROMPTS}, t AS (SELECT doc_id, {_S} AS s FROM prompts), u AS (SELECT doc_id, s, CAST(greatest(1, length(s)) AS DOUBLE) AS n FROM t), "
    "e AS (SELECT doc_id, sum(-(c / n) * log2(c / n + 1e-12)) AS bits FROM (SELECT doc_id, n, ch, count(*) AS c FROM (SELECT doc_id, n, unnest(string_split(s, '')) AS ch FROM u) GROUP BY ALL) GROUP BY doc_id) "
    f"SELECT doc_id, CAST(length(s) AS INTEGER) AS n_chars, round({_COUNT(lit('[^ ]'))} / n, 6) AS space_ratio, round({_COUNT(_PUNCT)} / n, 6) AS punct_ratio, round({_COUNT(lit(chr(92) + 'P{Nd}'))} / n, 6) AS digit_ratio, "
    f"round({_COUNT(lit(chr(92) + 'P{Lu}'))} / n, 6) AS upper_ratio, round({_COUNT(lit('[' + chr(92) + 'x00-' + chr(92) + 'x7F]'))} / n, 6) AS non_ascii_ratio, round(bits, 6) AS entropy FROM u JOIN e USING (doc_id)"
)
def engineered_features(spark: SparkSession, d: str) -> DataFrame:
    cols = features.engineered_features(F.col("text"))
    return prompts(spark, d).select("doc_id", *((R6(c) if k != "n_chars" else c.cast("int")).alias(k) for k, c in cols.items()))


_HEUR = " + ".join(f"CAST(regexp_matches(t, {_RE2(r)}) AS INTEGER)" for r in fixed.HEURISTIC_RULES)


@query(
    f"WITH {PROMPTS}, t0 AS (SELECT doc_id, {_S} AS t FROM prompts), u AS (SELECT doc_id, t, CAST(greatest(1, length(t)) AS DOUBLE) AS n FROM t0), "
    "e AS (SELECT doc_id, sum(-(c / n) * log2(c / n)) AS bits FROM (SELECT doc_id, n, ch, count(*) AS c FROM (SELECT doc_id, n, unnest(string_split(lower(t), '')) AS ch FROM u) GROUP BY ALL) GROUP BY doc_id), "
    f"f AS (SELECT doc_id, n, {_HEUR} AS hits, {_COUNT(_PUNCT, 't')} / n AS punct, {_COUNT(lit(chr(92) + 'P{Lu}'), 't')} / n AS upper_, bits, CAST(regexp_matches(t, {_RE2(fixed.NEWLINE_COMMAND)}) AS INTEGER) AS nl FROM u JOIN e USING (doc_id)) "
    "SELECT doc_id, CAST(hits AS INTEGER) AS rule_score, round(1 / (1 + exp(-(hits * 0.55 + CASE WHEN n > 300 THEN 0.15 ELSE 0.0 END + punct * 0.8 + upper_ * 0.4 + nl * 0.3 - bits * 0.04) + 1.2)), 6) AS prob FROM f"
)
def heuristic_score(spark: SparkSession, d: str) -> DataFrame:
    h = features.heuristic_score(F.col("text"))
    return prompts(spark, d).select("doc_id", h["rule_score"].cast("int").alias("rule_score"), R6(h["prob"]).alias("prob"))


@query(f"WITH {PROMPTS} SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM prompts")
def token_count_simple(spark: SparkSession, d: str) -> DataFrame:
    return prompts(spark, d).select("doc_id", features.token_count(F.col("text")).cast("long").alias("n_tokens"))


@query("SELECT doc_id, md5(rpad(substr(hex(encode(text)), 1, 512), 512, '0')) AS digest FROM documents")
def byte_encode(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.md5(F.hex(features.first_bytes(F.col("text"))).cast("binary")).alias("digest"))


@query("SELECT CASE WHEN length(text) < 50 THEN '<50' WHEN length(text) < 150 THEN '50-149' WHEN length(text) < 400 THEN '150-399' WHEN length(text) < 800 THEN '400-799' ELSE '800+' END AS bin, count(*) AS n FROM documents GROUP BY 1")
def length_bins(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).groupBy(features.length_bin(F.col("text")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH ws AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_][\\p{L}\\p{N}_]+') AS w FROM documents), "
    "w AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM ws), "
    "n AS (SELECT count(DISTINCT doc_id) AS docs FROM documents), "
    "t AS (SELECT term, count(*) AS total, count(DISTINCT doc_id) AS df FROM w GROUP BY term) "
    "SELECT term, total, df, round(ln((1.0 + docs) / (1.0 + df)) + 1, 6) AS idf FROM t, n ORDER BY total DESC, term LIMIT 5000"
)
def tfidf_terms(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary of the word features: the 5000 commonest words and word pairs with smoothed idf."""
    from ..operators.models import vocabulary

    return vocabulary(documents(spark, d), most=5000)


# --- coercions --------------------------------------------------------------------
_RAW = "CASE CAST(doc_id % 12 AS INTEGER) WHEN 0 THEN '1' WHEN 1 THEN ' True ' WHEN 2 THEN 'Malicious' WHEN 3 THEN 'no' WHEN 4 THEN 'BENIGN' WHEN 5 THEN '7' WHEN 6 THEN '-3' WHEN 7 THEN 'maybe' WHEN 8 THEN NULL WHEN 9 THEN '1.5' WHEN 10 THEN 'prompt_injection' ELSE '' END"


def _raw_labels(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.expr(_RAW).alias("raw"))


@query(
    f"WITH r AS (SELECT doc_id, lower(trim({_RAW})) AS s FROM documents), c AS (SELECT doc_id, CASE WHEN s IN ('1','true','malicious','attack','yes') THEN 1 WHEN s IN ('0','false','benign','no') THEN 0 "
    "WHEN regexp_matches(s, '^[+-]?[0-9]+$') THEN TRY_CAST(s AS INTEGER) END AS label FROM r) SELECT doc_id, CAST(label AS INTEGER) AS label, CAST(CASE WHEN label IN (0, 1) THEN label ELSE 0 END AS INTEGER) AS label_or_default FROM c"
)
def coerce_label(spark: SparkSession, d: str) -> DataFrame:
    rows = _raw_labels(spark, d).select("doc_id", coerce.coerce_label(F.col("raw")).alias("label"))
    return rows.select("doc_id", "label", coerce.label_or_default(F.col("label")).alias("label_or_default"))


@query(f"SELECT doc_id, CAST(CASE WHEN regexp_matches(s, 'inject|jail|attack|malicious|harm|unsafe') OR s IN ('1', 'true', 'yes') THEN 1 ELSE 0 END AS INTEGER) AS label FROM (SELECT doc_id, lower(trim({_RAW})) AS s FROM documents)")
def norm_label_keyword(spark: SparkSession, d: str) -> DataFrame:
    return _raw_labels(spark, d).select("doc_id", coerce.keyword_label(F.col("raw")).alias("label"))


@query("SELECT 'documents:' || doc_id AS id, text, CAST(coalesce(l.toxic, 0) AS INTEGER) AS label, lang AS meta_lang, source AS meta_source FROM documents LEFT JOIN labels l USING (doc_id)")
def normalize_schema(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.corpus import normalize

    raw = documents(spark, d).join(table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id", "left")
    rows = normalize(raw, "documents", ordinal="doc_id")
    return rows.select("id", "text", "label", F.col("meta")["lang"].alias("meta_lang"), F.col("meta")["source"].alias("meta_source"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text_norm FROM documents")
def text_norm(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", coerce.text_norm(F.col("text")).alias("text_norm"))


@query("SELECT conv_id, turn, CASE WHEN trim(coalesce(text, '')) <> '' AND turn % 3 <> 0 THEN text ELSE role END AS text FROM conversations")
def extract_text(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    shown = F.when(F.col("turn") % 3 != 0, F.col("text"))
    return c.select("conv_id", "turn", coerce.first_text([shown, F.col("role")]).alias("text"))


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def scan_cap(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.corpus import head_cap

    return head_cap(documents(spark, d).select("doc_id", "lang"), "doc_id", 100)


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def language_counts(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0.25 WHEN doc_id % 4 = 1 THEN 0.9 WHEN doc_id % 4 = 2 THEN 0.7 ELSE 0.0 END AS prob FROM documents"
)
def pick_malicious_prob(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    s = lambda a, b: F.struct(F.lit(a).alias("label"), F.lit(b).cast("double").alias("score"))
    scores = F.when(k == 0, F.array(s("SAFE", 0.75), s("INJECTION", 0.25))).when(k == 1, F.array(s("LABEL_0", 0.1), s("LABEL_1", 0.9))).when(k == 2, F.array(s("a", 0.7), s("b", 0.3)))
    empty = F.array().cast("array<struct<label:string,score:double>>")
    return documents(spark, d).select("doc_id", coerce.pick_malicious_prob(F.coalesce(scores, empty)).alias("prob"))


@query("SELECT doc_id, CASE CAST(doc_id % 4 AS INTEGER) WHEN 0 THEN 0.8 WHEN 1 THEN 0.25 WHEN 2 THEN 0.5 ELSE 0.5 END AS prob FROM documents")
def judge_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    reply = F.when(k == 0, 'Sure: {"is_injection": 1, "confidence": 0.8} done').when(k == 1, '{"is_injection": 0, "confidence": 0.75}').when(k == 2, "no json").otherwise("{broken")
    return documents(spark, d).select("doc_id", coerce.judge_probability(reply).alias("prob"))


