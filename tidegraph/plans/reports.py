"""Queries over written reports: every score, summaries by model, end-to-end rows, excerpts.

The reports are put together from the packs of large orders: three models write some of ten sentences each, in an order that
follows the order key, and name the family and a number of bytes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegraph.functions import facts, text
from tidegraph.operators import reporting
from tidegraph.plans.flows import rounded
from tidegraph.plans.scores import _BAND, _FAMS, DET_SQL, cited_sql, packed, reports
from tidegraph.sources.tables import dealt

Q: dict = {}
BENIGN = "5-LOW"
SENTENCES = [
    "The inbound bytes raised the score by 1.5 points.",
    "The transport protocol lowered it; the destination port range increased it.",
    "A large TCP window drove the alert, whereas the client TCP flags counted against it.",
    "It is possibly borderline, and may be 3-MEDIUM or 2-high.",
    "Bytes in of 4,498 from 10.0.0.7 were raised.",
    "The model was trained on such flows.",
    "Let me think about it.",
    "Connections of a typical host reduced the score\nThe protocol 6 supported it.",
    "0.0.0.0 ... ... ... ... ... ... ... ... ... ... ... ... ... ... ... ... ... ...",
    "Distinct destination ports and the source's TCP window contributed.",
]
COLUMNS = ["IN_BYTES", "PROTOCOL", "L4_DST_PORT", "TCP_WIN_MAX_IN"]
FAMILIES = {f: (f.lower(),) for f in _FAMS}


def add(name, fn, sql=None):
    Q[name] = (fn, sql)


def notes(s, d):
    """Reports of three models on each pack, with what their scores need."""
    k = F.substring("detection_id", 5, 20).cast("long")
    p = packed(s, d).select("detection_id", k.alias("k"), F.col("flow.true_label").alias("true_label"), "detection.*", "attribution.top_features")
    p = dealt(p, "detection_id")  # scores of a text cost more than its bytes tell
    price = F.floor(F.col("score") * 500_000 + 0.001).cast("long")
    sure = F.col("k") % 3 == 0
    clear = F.transform_values("class_distribution", lambda f, x: F.when(f == F.col("predicted_class"), 0.97).otherwise(0.0075))
    window = F.struct(F.lit("TCP_WIN_MAX_IN").alias("name"), (F.col("k") % 3 - 1.2).alias("contribution"), F.when(F.col("k") % 3 > 1, "raised").otherwise("lowered").alias("direction"))
    p = p.withColumns({"class_distribution": F.when(sure, clear).otherwise(F.col("class_distribution")), "class_confidence": F.when(sure, 0.97).otherwise(F.col("class_confidence")), "top_features": F.when(F.col("k") % 2 == 0, F.concat("top_features", F.array(window))).otherwise(F.col("top_features"))})
    m = F.col("m")
    said = lambda i: F.get(F.array(*[F.lit(x) for x in SENTENCES]), (i % 10).cast("int"))
    body = F.concat_ws(" ", said(F.col("k") + m), said(F.expr("k div 3") + 2 * m), said(F.expr("k div 7")), F.concat(F.lit("The category is "), F.col("predicted_class"), F.lit(", "), (price + (F.col("k") % 5 == 0).cast("int")).cast("string"), F.lit(" bytes.")))
    evidence = F.concat(F.lit("threshold 0.8, host 10.0.0."), (F.col("k") % 9).cast("string"), F.lit(", bytes "), price.cast("string"), F.lit(", 4498 packets"))
    out = p.withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return out.select("*", F.concat(F.lit("model "), m.cast("string")).alias("model"), F.col("k").alias("pack_index"), ((F.col("k") + m) % 7 != 3).alias("ok"), body.alias("text"), evidence.alias("evidence"),
        (F.length(body) / 10 * m).alias("latency_seconds"), F.when(m < 3, F.length(body) / 20).alias("generation_seconds"), (F.length(body) * 2).alias("output_tokens"), F.when(~((m == 2) & (F.col("k") % 400 == 1)), F.length(body) / 1000).alias("cost_usd"), (F.length(body) / 500).alias("reference_cost_usd"))


def scored(s, d):
    return reporting.score_all(notes(s, d), FAMILIES, COLUMNS)


def quoted(x):
    return "'" + x.replace("'", "''") + "'"


def any_of(words, column):
    return "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


def marked_sql(column):
    """Aliases of a clause turned into marks, longest first; each alias follows its mark."""
    pairs, _ = text._marked_aliases(facts.ALIASES)
    return f"list_reduce(list_prepend({column}, [{', '.join(quoted(m + a) for a, m in pairs)}]), lambda acc, a: replace(acc, a[2:], a[1]))"


def mark(column):
    return quoted(chr(0xE000 + text._marked_aliases(facts.ALIASES)[1].index(column)))


_TEXT = " || ' ' || ".join(f"[{', '.join(quoted(x) for x in SENTENCES)}][({i}) % 10 + 1]" for i in ("k + m", "k // 3 + 2 * m", "k // 7"))
NOTES_SQL = f"""{DET_SQL}, pl AS (SELECT o_orderkey, list(f) FILTER (p >= 0.05) AS likely FROM ent GROUP BY 1),
  n0 AS (SELECT dt.o_orderkey AS k, m, o_orderpriority AS true_label, predicted, score, floor(o_totalprice)::BIGINT AS price, CASE WHEN k % 3 = 0 THEN 0.97 ELSE conf END AS conf, CASE WHEN k % 3 = 0 THEN [predicted] ELSE list_append(likely, predicted) END AS likely, CASE WHEN k % 3 = 0 THEN [] ELSE alts END AS others,
    list_concat([{{'c': 'IN_BYTES', 'd': CASE WHEN o_totalprice / 1e5 - 4.2 > 0 THEN 'raised' ELSE 'lowered' END}}, {{'c': 'PROTOCOL', 'd': CASE WHEN o_custkey % 7 > 3 THEN 'raised' ELSE 'lowered' END}}, {{'c': 'L4_DST_PORT', 'd': CASE WHEN o_orderkey % 5 > 2 THEN 'raised' ELSE 'lowered' END}}], CASE WHEN k % 2 = 0 THEN [{{'c': 'TCP_WIN_MAX_IN', 'd': CASE WHEN k % 3 > 1 THEN 'raised' ELSE 'lowered' END}}] ELSE [] END) AS reasons
    FROM dt JOIN pd USING (o_orderkey) JOIN pl USING (o_orderkey), (SELECT unnest([1, 2, 3]) AS m)),
  nt AS (SELECT *, 'model ' || m AS model, (k + m) % 7 <> 3 AS ok, {_TEXT} || ' The category is ' || predicted || ', ' || (price + (k % 5 = 0)::INT) || ' bytes.' AS text FROM n0),
  n1 AS (SELECT *, lower(text) AS t, length(text) AS len, regexp_extract_all(text, '\\S+') AS tokens FROM nt),
  cl AS (SELECT k, m, unnest(flatten([regexp_split_to_array(trim(x), ';|\\b(?:while|whereas|but|however|in contrast|on the other hand|conversely)\\b') for x in regexp_split_to_array(regexp_replace(t, '([.!?])\\s+', '\\1\n', 'g'), '\n+')])) AS c FROM n1),
  cm AS (SELECT k, m, {any_of(text.UP, 'c')} AS up, {marked_sql('c')} AS c FROM cl WHERE {any_of(text.UP, 'c')} <> {any_of(text.DOWN, 'c')}),
  rs AS (SELECT k, m, unnest(reasons) AS r FROM nt),
  dr AS (SELECT k, m, count(*) AS checked, count(*) FILTER (r.d <> CASE WHEN up THEN 'raised' ELSE 'lowered' END) AS errors FROM cm JOIN rs USING (k, m)
    WHERE {' OR '.join(f"(r.c = '{c}' AND contains(c, {mark(c)}))" for c in COLUMNS)} OR (r.c = 'TCP_WIN_MAX_IN' AND contains(c, {mark('TCP_WINDOW')})) GROUP BY 1, 2),
  en AS (SELECT *, list_distinct(regexp_extract_all(text, '\\b(?:\\d{{1,3}}\\.){{3}}\\d{{1,3}}\\b')) AS ips,
    list_filter(list_distinct([replace(x, ',', '') for x in regexp_extract_all(regexp_replace(text, '\\b(?:\\d{{1,3}}\\.){{3}}\\d{{1,3}}\\b', 'IP', 'g'), '(?:^|[^\\w.])(\\d[\\d,]*(?:\\.\\d+)?)', 1)]), lambda x: NOT list_contains(range(11)::VARCHAR[], x)) AS nums,
    [regexp_extract_all(x, '[a-z0-9]+') for x in regexp_split_to_array(t, '[.!?\n]+')] AS ws FROM n1),
  eb AS (SELECT *, list_filter(ips, lambda x: x <> '10.0.0.' || (k % 9)) AS bad_ips, list_filter(nums, lambda x: x NOT IN ('0.8', '1', '4498', price::VARCHAR)) AS bad_nums, [{', '.join(quoted(f) for f in _FAMS)}] AS fams FROM en),
  ec AS (SELECT *, list_filter(fams, lambda f: regexp_matches(t, '(^|[^a-z0-9])' || lower(f) || '([^a-z0-9]|$)')) AS named, list_filter([{', '.join(f"CASE WHEN {cited_sql(c)} THEN '{c}' END" for c in COLUMNS)}], lambda c: c IS NOT NULL AND list_contains([r.c for r in reasons], c)) AS hit,
    len(tokens) > 0 AND (len(regexp_extract_all(text, '[A-Za-z]{{2,}}')) / len(tokens) < 0.4 OR (len - length(replace(text, '.', ''))) / greatest(len, 1) > 0.2) AS bad_text, regexp_matches(t, 'let me think') AS thinks FROM eb),
  sa AS (SELECT k, m, model, true_label, predicted, ok, score, conf, others, len, ok AND bad_text AS degenerate, ok AND thinks AS leaked, ok AND NOT bad_text AS fin,
    CASE WHEN ok AND len(ips) + len(nums) > 0 THEN round((len(ips) + len(nums) - len(bad_ips) - len(bad_nums)) / (len(ips) + len(nums)), 4) END AS groundedness, CASE WHEN ok THEN len(ips) + len(nums) END AS claims, CASE WHEN ok THEN len(bad_ips) + len(bad_nums) END AS ungrounded, CASE WHEN ok THEN len(bad_ips) END AS fabricated, CASE WHEN ok THEN len(tokens) END AS words,
    CASE WHEN ok THEN NOT {any_of(text.JARGON, 't')} END AS clean, CASE WHEN ok AND conf < 0.9 THEN {any_of(text.HEDGES, 't')} END AS hedged, CASE WHEN ok THEN list_contains(named, predicted) END AS names_predicted,
    CASE WHEN ok THEN list_contains(named, predicted) AND len(list_filter(named, lambda f: NOT list_contains(likely, f))) = 0 END AS faithful, CASE WHEN ok THEN NOT list_contains(named, predicted) AND len(list_filter(named, lambda f: NOT list_contains(likely, f))) > 0 END AS substituted,
    CASE WHEN ok THEN round(len(hit) / len(reasons), 4) END AS coverage, CASE WHEN ok THEN len(hit) = 0 END AS cites_none, CASE WHEN ok THEN coalesce(checked, 0) END AS n_checked, CASE WHEN ok THEN coalesce(errors, 0) END AS n_errors,
    CASE WHEN ok AND ({_BAND} = 'narrow' OR conf < 0.6 OR len(others) > 0) THEN {any_of(text.BORDERLINE_WORDS, 't')} END AS conveyed FROM ec LEFT JOIN dr USING (k, m))"""

_FLAT = {
    "groundedness": "scores.groundedness", "claims": "scores.n_entities_claimed", "ungrounded": "scores.n_ungrounded", "words": "scores.report_words", "clean": "jargon.clean",
    "hedged": "uncertainty.uncertainty_conveyed", "names_predicted": "classification.names_predicted", "faithful": "classification.faithful", "substituted": "classification.substituted",
    "coverage": "attribution.coverage", "cites_none": "attribution.cites_none", "n_checked": "direction.n_checked", "n_errors": "direction.n_errors", "conveyed": "borderline.borderline_conveyed", "degenerate": "degenerate", "leaked": "reasoning_leaked",
}
add("r11_score_all", lambda s, d: scored(s, d).select("k", "m", *[F.col(c).alias(n) for n, c in _FLAT.items()], F.size("scores.fabricated_addresses").alias("fabricated")),
    f"WITH {NOTES_SQL} SELECT k, m, {', '.join(_FLAT)}, fabricated FROM sa")
add("r10_direction", lambda s, d: scored(s, d).where("ok").select("k", "m", "direction.n_checked", "direction.n_errors", "direction.direction_faithful"),
    f"WITH {NOTES_SQL} SELECT k, m, n_checked, n_errors, CASE WHEN n_checked > 0 THEN n_errors = 0 END AS direction_faithful FROM sa WHERE ok")

# The reference's aggregates: means over finished reports, rates over the reports that a check applies to.
_F = "FILTER (fin)"
add("r12_model_summary", lambda s, d: reporting.summarise(scored(s, d), ["model"]), f"""WITH {NOTES_SQL}, c AS (SELECT *, len / 10 * m AS lat, CASE WHEN m < 3 THEN len / 20 END AS gen, CASE WHEN NOT (m = 2 AND k % 400 = 1) THEN len / 1000 END AS cost FROM sa)
  SELECT model, count(*) AS n, count(*) {_F} AS n_ok, count(*) FILTER (NOT ok) AS n_failed, count(*) FILTER (degenerate) AS n_degenerate, count(*) FILTER (fin AND leaked) AS reports_with_reasoning_leaked,
    round(avg(groundedness) {_F}, 4) AS groundedness_mean, count(*) FILTER (fin AND fabricated > 0) AS reports_with_fabricated_addresses, count(*) FILTER (fin AND NOT clean) AS reports_with_jargon, round(avg(words) {_F}, 4) AS report_words_mean,
    round(avg(names_predicted::INT) {_F}, 4) AS classification_names_predicted_rate, round(avg(faithful::INT) {_F}, 4) AS classification_faithful_rate, round(avg(substituted::INT) {_F}, 4) AS classification_substituted_rate,
    round(avg(coverage) {_F}, 4) AS attribution_coverage_mean, round(avg(cites_none::INT) {_F}, 4) AS attribution_cites_none_rate,
    round(avg(lat) {_F}, 3) AS latency_seconds_mean, round(quantile_cont(lat, 0.5) {_F}, 3) AS latency_seconds_p50, round(quantile_cont(lat, 0.95) {_F}, 3) AS latency_seconds_p95,
    round(sum(gen) {_F}, 2) AS generation_seconds_total, round(sum(CASE WHEN gen IS NOT NULL THEN len * 2 END) {_F} / sum(gen) {_F}, 2) AS output_tokens_per_second,
    CASE WHEN count(*) FILTER (fin AND cost IS NULL) = 0 THEN round(coalesce(sum(cost) {_F}, 0), 6) END AS total_cost_usd, round(coalesce(sum(len / 500) {_F}, 0), 6) AS reference_cost_usd,
    count(hedged) {_F} AS ambiguous_detections, round(avg(hedged::INT) {_F}, 4) AS uncertainty_conveyed_rate, count(*) FILTER (fin AND n_checked > 0) AS direction_checked_reports, round(avg((n_errors = 0)::INT) FILTER (fin AND n_checked > 0), 4) AS direction_faithful_rate, coalesce(sum(n_errors) {_F}, 0)::BIGINT AS direction_errors_total,
    count(conveyed) {_F} AS borderline_detections, round(avg(conveyed::INT) {_F}, 4) AS borderline_conveyed_rate FROM c GROUP BY 1""")
add("r13_study_on_fp", lambda s, d: rounded(reporting.on_false_positives(scored(s, d), ["model"], BENIGN), "groundedness", "groundedness_on_fp"),
    f"WITH {NOTES_SQL} SELECT model, count(*) {_F} AS n_ok, round(avg(groundedness) {_F}, 6) AS groundedness, count(*) FILTER (fin AND true_label = '{BENIGN}') AS n_false_positive, round(avg(groundedness) FILTER (fin AND true_label = '{BENIGN}'), 6) AS groundedness_on_fp FROM sa GROUP BY 1")
_OUTCOMES = ("attack_right_family", "attack_wrong_family", "false_positive_borderline", "false_positive_clear")
_PASSED = "fin AND ungrounded = 0 AND fabricated = 0 AND names_predicted AND NOT substituted AND n_errors = 0 AND coalesce(conveyed, true) AND coalesce(hedged, true)"
add("r14_end_to_end", lambda s, d: reporting.end_to_end(scored(s, d), BENIGN), f"""WITH {NOTES_SQL}, o AS (SELECT *, coalesce({_PASSED}, false) AS passed, CASE WHEN true_label <> '{BENIGN}' AND predicted = true_label THEN 'attack_right_family' WHEN true_label <> '{BENIGN}' THEN 'attack_wrong_family' WHEN {_BAND} = 'narrow' OR conf < 0.6 OR len(others) > 0 THEN 'false_positive_borderline' ELSE 'false_positive_clear' END AS outcome FROM sa)
  SELECT model, count(*) AS requested, count(*) {_F} AS completed, count(*) FILTER (passed) AS passed_every_check, {', '.join(f"count(*) FILTER (passed AND outcome = '{x}') AS passed_{x}" for x in _OUTCOMES)}, count(*) FILTER (passed AND outcome = 'attack_right_family') AS correct_and_faithful,
    round(quantile_cont(len / 10 * m, 0.5) {_F}, 2) AS median_latency_seconds, floor(quantile_cont(words, 0.5) {_F})::BIGINT AS median_note_words, round(sum(len / 500) / count(*) {_F}, 5) AS list_price_per_note_usd FROM o GROUP BY 1""")
add("t7_excerpts", lambda s, d: reporting.excerpts(scored(s, d), 6, BENIGN), f"""WITH {NOTES_SQL}, g AS (SELECT k, CASE WHEN count(groundedness) > 1 THEN round(max(groundedness) - min(groundedness), 4) ELSE 0 END AS spread, any_value(true_label) = '{BENIGN}' AS fp, bool_or(hedged IS NOT NULL) AS am FROM sa GROUP BY 1),
  p1 AS (SELECT k FROM g ORDER BY spread DESC, k LIMIT 1), p2 AS (SELECT k FROM g WHERE fp AND k NOT IN (SELECT k FROM p1) ORDER BY spread DESC, k LIMIT 1),
  p3 AS (SELECT k FROM g WHERE am AND k NOT IN (SELECT k FROM p1) AND k NOT IN (SELECT k FROM p2) ORDER BY spread DESC, k LIMIT 1),
  px AS (SELECT 1 AS o, k, 'largest difference' AS rule FROM p1 UNION ALL SELECT 2, k, 'false positive' FROM p2 UNION ALL SELECT 3, k, 'ambiguous' FROM p3),
  fl AS (SELECT 10 + k AS o, k, 'next in pack order' AS rule FROM g WHERE k NOT IN (SELECT k FROM px) ORDER BY k LIMIT 6), a AS (SELECT row_number() OVER (ORDER BY o) AS place, * FROM (SELECT * FROM px UNION ALL SELECT * FROM fl))
  SELECT place, 'det-' || k AS detection_id, rule, spread FROM a JOIN g USING (k) WHERE place <= 6""")

# Documents as reports: families by words of the text.
_ALIASES = {"connective": ("and", "und the"), "article": ("the", "la", "der"), "thing": ("be the", "de la")}


def named(s, d):
    return reports(s, d).select("doc_id", text.families_named(F.col("text"), _ALIASES).alias("named"))


def word_sql(column, word):
    """Whether a word stands between characters that are no letter a to z and no digit."""
    return rf"regexp_matches({column}, '(^|[^a-z0-9]){word}($|[^a-z0-9])')"


def blank_sql(column, phrase):
    """A column without a phrase: twice, as two that follow each other share the character between them."""
    once = rf"regexp_replace({column}, '(^|[^a-z0-9]){phrase}($|[^a-z0-9])', '\1{' ' * len(phrase)}\2', 'g')"
    return once.replace(column, once, 1)


_NAMED_SQL = f"z AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), b AS (SELECT *, {blank_sql('t', 'und the')} AS t1 FROM z), c AS (SELECT *, {blank_sql('t1', 'be the')} AS t2 FROM b), e AS (SELECT *, {blank_sql('t2', 'de la')} AS t3 FROM c), nm AS (SELECT doc_id, {word_sql('t', 'und the')} OR {word_sql('t3', 'and')} AS connective, {word_sql('t3', 'the')} OR {word_sql('t3', 'der')} OR {word_sql('t3', 'la')} AS article, {word_sql('t1', 'be the')} OR {word_sql('t2', 'de la')} AS thing FROM e)"
add("r8_families_named", named, f"WITH {_NAMED_SQL} SELECT doc_id, list_filter([CASE WHEN article THEN 'article' END, CASE WHEN connective THEN 'connective' END, CASE WHEN thing THEN 'thing' END], lambda x: x IS NOT NULL) AS named FROM nm")
add("r8b_fidelity", lambda s, d: named(s, d).select(text.classification_fidelity(F.col("named"), F.lit("article"), F.create_map(F.lit("article"), F.lit(0.9), F.lit("thing"), F.lit(0.1))).alias("f")).select("f.*").groupBy("names_predicted", "substituted", "faithful").agg(F.count("*").alias("n")),
    f"WITH {_NAMED_SQL} SELECT article AS names_predicted, connective AND NOT article AS substituted, article AND NOT connective AS faithful, count(*) AS n FROM nm GROUP BY 1, 2, 3")
