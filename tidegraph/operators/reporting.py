"""Scores of written reports, one row each, and what is made of them: summaries by model, end-to-end rows, excerpts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions import facts, text

#: Confidence under which a detection is ambiguous, so that a report should hedge.
AMBIGUOUS = 0.9
SCORES = ("scores", "jargon", "uncertainty", "classification", "attribution", "direction", "borderline")


def score_all(reports: DataFrame, families: dict[str, tuple[str, ...]], columns: list[str], aliases: dict[str, tuple[str, ...]] = facts.ALIASES) -> DataFrame:
    """``reports`` with every score of the text as a struct of its own; a report that isn't ``ok`` has NULL scores.

    Reads text, ok, evidence (the text that the writer saw), score, threshold, class_confidence, predicted_class,
    class_distribution and top_features (name, direction; the first five count). ``families`` are the aliases by which each
    family may be named, ``columns`` the columns that may be cited, ``aliases`` the words for columns in clauses.
    """
    own = F.coalesce("text", F.lit(""))
    top = F.slice("top_features", 1, 5)
    bases = F.array_distinct(F.transform(top, lambda f: facts.base_column(f["name"])))
    reasons = F.transform(top, lambda f: F.struct(F.regexp_extract(f["name"], "^[^=]*", 0).alias("column"), f["direction"].alias("direction")))
    of = {
        "scores": text.let(text.groundedness(text.entities(own), text.evidence_entities(F.coalesce("evidence", F.lit("")))), lambda g: F.struct(
            F.round(g["grounded"], 4).alias("groundedness"), g["n_claims"].alias("n_entities_claimed"), g["n_ungrounded"].alias("n_ungrounded"),
            g["fabricated_ips"].alias("fabricated_addresses"), text.word_count(own).alias("report_words"))),
        "jargon": text.let(text.words_in(own, text.JARGON), lambda w: F.struct(w.alias("jargon_found"), (F.size(w) == 0).alias("clean"))),
        "uncertainty": F.when(F.col("class_confidence") < AMBIGUOUS, text.let(text.words_in(own, text.HEDGES), lambda w: F.struct("class_confidence", w.alias("hedges_found"), (F.size(w) > 0).alias("uncertainty_conveyed")))),
        "classification": text.let(F.array_intersect(text.families_named(own, families), F.map_keys("class_distribution")), lambda n: text.classification_fidelity(n, F.col("predicted_class"), F.col("class_distribution"))),
        "attribution": text.citations(own, bases, columns),
        "direction": text.direction_fidelity(own, reasons, aliases),
        "borderline": F.when(facts.borderline(F.col("score"), F.col("threshold"), F.col("class_confidence"), F.col("class_distribution")), text.let(text.words_in(own, text.BORDERLINE_WORDS), lambda w: F.struct(w.alias("words_found"), (F.size(w) > 0).alias("borderline_conveyed")))),
    }
    ok = F.coalesce("ok", F.lit(False))
    flags = {"degenerate": F.coalesce(ok & text.is_degenerate(own), F.lit(False)), "reasoning_leaked": F.coalesce(ok & text.leaked(own), F.lit(False))}
    return reports.withColumns({name: F.when(ok, of[name]) for name in SCORES} | flags)


def finished(c: str = "ok") -> Column:
    """Reports that count in means: written, and not collapsed into repetition."""
    return F.coalesce(F.col(c), F.lit(False)) & ~F.coalesce("degenerate", F.lit(False))


def summarise(scored: DataFrame, by: list[str]) -> DataFrame:
    """Per group of scored reports: how many, how many finished, failed and degenerate; over the finished ones means, rates
    over the reports that a check applies to, latency, generation and cost. A cost is NULL if any finished one lacks it."""
    done = finished()
    if_done = lambda c: F.when(done, F.col(c) if isinstance(c, str) else c)
    mean = lambda c, digits=4: F.round(F.avg(if_done(c)), digits)
    rate = lambda c: F.round(F.avg(if_done(c).cast("int")), 4)
    tail = lambda q: F.round(F.percentile(if_done("latency_seconds"), F.lit(q)), 3)
    total = lambda c: F.when(F.count_if(done & F.col(c).isNull()) == 0, F.round(F.coalesce(F.sum(if_done(c)), F.lit(0.0)), 6))
    generated = F.sum(if_done("generation_seconds"))
    tokens = F.sum(F.when(done & F.col("generation_seconds").isNotNull(), F.col("output_tokens")))
    checked = F.col("direction.n_checked") > 0
    return scored.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(done).alias("n_ok"),
        F.count_if(~F.coalesce("ok", F.lit(False))).alias("n_failed"), F.count_if(F.coalesce("ok", F.lit(False)) & F.coalesce("degenerate", F.lit(False))).alias("n_degenerate"),
        F.count_if(done & F.col("reasoning_leaked")).alias("reports_with_reasoning_leaked"),
        mean("scores.groundedness").alias("groundedness_mean"),
        F.count_if(done & (F.size("scores.fabricated_addresses") > 0)).alias("reports_with_fabricated_addresses"),
        F.count_if(done & ~F.col("jargon.clean")).alias("reports_with_jargon"),
        mean("scores.report_words").alias("report_words_mean"),
        rate("classification.names_predicted").alias("classification_names_predicted_rate"), rate("classification.faithful").alias("classification_faithful_rate"), rate("classification.substituted").alias("classification_substituted_rate"),
        mean("attribution.coverage").alias("attribution_coverage_mean"), rate("attribution.cites_none").alias("attribution_cites_none_rate"),
        mean("latency_seconds", 3).alias("latency_seconds_mean"), tail(0.5).alias("latency_seconds_p50"), tail(0.95).alias("latency_seconds_p95"),
        F.round(generated, 2).alias("generation_seconds_total"), F.when(generated > 0, F.round(F.coalesce(tokens, F.lit(0)) / generated, 2)).alias("output_tokens_per_second"),
        total("cost_usd").alias("total_cost_usd"), total("reference_cost_usd").alias("reference_cost_usd"),
        F.count_if(done & F.col("uncertainty").isNotNull()).alias("ambiguous_detections"), rate("uncertainty.uncertainty_conveyed").alias("uncertainty_conveyed_rate"),
        F.count_if(done & checked).alias("direction_checked_reports"), rate(F.when(checked, F.col("direction.direction_faithful"))).alias("direction_faithful_rate"), F.coalesce(F.sum(if_done("direction.n_errors")), F.lit(0)).alias("direction_errors_total"),
        F.count_if(done & F.col("borderline").isNotNull()).alias("borderline_detections"), rate("borderline.borderline_conveyed").alias("borderline_conveyed_rate"),
    )


def on_false_positives(scored: DataFrame, by: list[str], benign: str) -> DataFrame:
    """Per group: mean groundedness of finished reports, of all and of those on benign flows, with their number."""
    fp = finished() & (F.col("true_label") == benign)
    return scored.groupBy(*by).agg(F.count_if(finished()).alias("n_ok"), F.avg(F.when(finished(), F.col("scores.groundedness"))).alias("groundedness"), F.count_if(fp).alias("n_false_positive"), F.avg(F.when(fp, F.col("scores.groundedness"))).alias("groundedness_on_fp"))


def passed_every_check() -> Column:
    """Of a scored report: finished, nothing invented, the family named and none put in its place, and no check that applies
    failed."""
    applies = lambda struct, ok: F.col(struct).isNull() | ok
    checks = (F.col("scores.n_ungrounded") == 0) & (F.size("scores.fabricated_addresses") == 0) & F.col("classification.names_predicted") & ~F.col("classification.substituted")
    checks = checks & applies("direction", F.col("direction.n_errors") == 0) & applies("borderline", F.col("borderline.borderline_conveyed")) & applies("uncertainty", F.col("uncertainty.uncertainty_conveyed"))
    return F.coalesce(finished() & checks, F.lit(False))


def end_to_end(scored: DataFrame, benign: str) -> DataFrame:
    """Per model: reports asked for, completed, passing every check, those by outcome of the detection, medians over completed
    ones, and the list price of all reports for each completed one."""
    uncertain = facts.borderline(F.col("score"), F.col("threshold"), F.col("class_confidence"), F.col("class_distribution"))
    outcome = facts.outcome((F.col("true_label") != benign).cast("int"), F.col("predicted_class") == F.col("true_label"), uncertain)
    rows = scored.withColumns({"_outcome": outcome, "_passed": passed_every_check()})
    done = lambda c: F.when(finished(), F.col(c))
    by = {name: F.count_if(F.col("_passed") & (F.col("_outcome") == name)) for name in ("attack_right_family", "attack_wrong_family", "false_positive_borderline", "false_positive_clear")}
    return rows.groupBy("model").agg(
        F.count("*").alias("requested"), F.count_if(finished()).alias("completed"), F.count_if("_passed").alias("passed_every_check"),
        *[n.alias(f"passed_{name}") for name, n in by.items()], by["attack_right_family"].alias("correct_and_faithful"),
        F.round(F.percentile(done("latency_seconds"), F.lit(0.5)), 2).alias("median_latency_seconds"), F.floor(F.percentile(done("scores.report_words"), F.lit(0.5))).alias("median_note_words"),
        F.when(F.count_if(finished()) > 0, F.round(F.coalesce(F.sum("reference_cost_usd"), F.lit(0.0)) / F.count_if(finished()), 5)).alias("list_price_per_note_usd"),
    )


#: Rules by which excerpts are chosen, in order, and the one that fills up.
EXCERPT_RULES = ("largest difference", "false positive", "ambiguous")


def excerpts(scored: DataFrame, n: int, benign: str) -> DataFrame:
    """Up to ``n`` detections that all models reported on: the one whose groundedness differs most between models, then of
    those left the false positive and the ambiguous one that do, then the next in pack order (``pack_index``).

    Spread counts from two scores on, else it is 0; of equal spreads the first in pack order. One job makes the table of
    detections and takes from it, for each rule, as many of its best as the rules before it may have picked and one more.
    """
    models = scored.agg(F.count_distinct("model").alias("n")).first()["n"]
    g = F.col("scores.groundedness")
    spread = F.when(F.count(g) > 1, F.max(g) - F.min(g)).otherwise(0.0)
    pool = scored.groupBy("detection_id").agg(F.count_distinct("model").alias("m"), F.min("pack_index").alias("at"), F.round(spread, 4).alias("spread"), F.bool_or(F.col("true_label") == benign).alias("fp"), F.bool_or(F.col("uncertainty").isNotNull()).alias("ambiguous")).where(F.col("m") == models)
    best = [F.desc("spread"), F.asc_nulls_last("at"), F.desc("detection_id")]
    takes = [(rule, holds, best, len(EXCERPT_RULES)) for rule, holds in zip(EXCERPT_RULES, (F.lit(True), F.col("fp"), F.col("ambiguous")), strict=True)]
    takes.append(("next in pack order", F.lit(True), [F.asc_nulls_last("at"), F.asc("detection_id")], max(0, n) + len(EXCERPT_RULES)))
    # The branches share the shuffle of the pool.
    rows = reduce(DataFrame.union, [pool.where(holds).orderBy(*order).limit(most).select(F.lit(i).alias("i"), "detection_id", "at", "spread") for i, (_, holds, order, most) in enumerate(takes)]).collect()
    picked: list[tuple] = []
    for i, (rule, _, order, _) in enumerate(takes):
        own = [r for r in rows if r["i"] == i]
        own.sort(key=lambda r: r["detection_id"], reverse=order is best)
        own.sort(key=lambda r: (-r["spread"] if order is best else 0, r["at"] is None, r["at"] or 0))
        for r in own:
            if r["detection_id"] not in [p[1] for p in picked] and (i == len(EXCERPT_RULES) or rule not in [p[2] for p in picked]) and len(picked) < max(n, len(EXCERPT_RULES)):
                picked.append((len(picked) + 1, r["detection_id"], rule, r["at"], r["spread"]))
    rows = scored.sparkSession.createDataFrame(picked[:n], "place int, detection_id string, rule string, at long, spread double")
    return rows.select("place", "detection_id", "rule", "spread")
