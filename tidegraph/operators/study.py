"""Pooling of runs and reports: seeds, pairs, comparators, reconciliation."""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegraph.operators import rank


def seed_aggregate(runs: DataFrame) -> DataFrame:
    """(metric, value) over seeds: mean, population deviation and count of the values that are there."""
    return runs.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))


def transfer_pool(runs: DataFrame, floor: float) -> DataFrame:
    """Per model, source and target: mean, sample deviation (0 for one run), and whether it is a control or under the floor."""
    g = runs.groupBy("model", "source", "target").agg(F.avg("pr_auc").alias("mean"), F.coalesce(F.stddev_samp("pr_auc"), F.lit(0.0)).alias("std"), F.count("*").alias("n"))
    return g.withColumn("is_control", F.col("source") == F.col("target")).withColumn("at_floor", F.col("mean") <= floor)


def comparators(results: DataFrame, schema: str, prevalence: float, version: str, own: tuple[float, float] | None = None) -> DataFrame:
    """The strongest admissible result by PR-AUC and, on its own, by F1, and those left out; with what ``own`` (PR-AUC, F1) has
    more than each, NULL where nothing is admitted."""
    ok = (F.col("schema") == schema) & (F.col("prevalence") == prevalence) & (F.col("version") == version)
    best = lambda m: F.max(F.when(ok, F.struct(F.col(m).alias("v"), F.col("model"))))
    deltas = [(F.lit(float(x)) - best(m)["v"]).alias(f"delta_{m}") for m, x in zip(("pr_auc", "f1"), own or (), strict=bool(own))]
    return results.agg(best("pr_auc")["model"].alias("best_pr_auc"), best("f1")["model"].alias("best_f1"), *deltas, F.array_sort(F.collect_list(F.when(~ok, F.col("model")))).alias("excluded"))


def rank_sum(runs: DataFrame, n1: int, n2: int) -> DataFrame:
    """Two-sample rank sum per comparison: U of side 'a', separation of ranges, mean difference, least attainable p."""
    w = Window.partitionBy("comparison")
    mid = F.rank().over(w.orderBy("value")) + (F.count("*").over(Window.partitionBy("comparison", "value")) - 1) / 2
    r = runs.withColumn("r", mid)
    a, b = F.col("side") == "a", F.col("side") == "b"
    na = F.count_if(a)
    g = r.groupBy("comparison").agg((F.sum(F.when(a, F.col("r"))) - na * (na + 1) / 2).alias("u"), ((F.min(F.when(a, F.col("value"))) > F.max(F.when(b, F.col("value")))) | (F.max(F.when(a, F.col("value"))) < F.min(F.when(b, F.col("value"))))).alias("separated"), (F.avg(F.when(a, F.col("value"))) - F.avg(F.when(b, F.col("value")))).alias("difference"))
    return g.withColumn("least_p", F.lit(min(1.0, 2 / comb(n1 + n2, n1))))


def reconcile(counts: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """Counts made again against counts that another result recorded: rows of either side that disagree."""
    a, b = counts.withColumnRenamed("n", "n_now"), recorded.withColumnRenamed("n", "n_recorded")
    return a.join(b, keys, "full").where(~F.col("n_now").eqNullSafe(F.col("n_recorded")))


def paired_gain(a: DataFrame, b: DataFrame, key: str = "seed", position: str | None = None) -> DataFrame:
    """Differences of the same seed in two variants, and their mean; where a run of either records no seed, all are paired by
    their place in the order of the integer ``position``."""
    if position and any(x.where(F.col(key).isNull()).limit(1).count() for x in (a, b)):
        a, b = (rank.order_rank(x.select(position, "value"), position, [], key) for x in (a, b))
    j = a.select(key, F.col("value").alias("x")).join(b.select(key, F.col("value").alias("y")), key)
    return j.agg(F.count("*").alias("n_pairs"), F.avg(F.col("x") - F.col("y")).alias("mean_gain"), F.min(F.col("x") - F.col("y")).alias("min_gain"), F.max(F.col("x") - F.col("y")).alias("max_gain"))


def matched_difference(with_: DataFrame, without: DataFrame, key: str = "seed") -> DataFrame:
    """Means of two variants over the runs that both have, and their difference; a run that one lacks counts in neither."""
    j = with_.select(key, F.col("value").alias("x")).join(without.select(key, F.col("value").alias("y")), key)
    return j.agg(F.count("*").alias("n_pairs"), F.avg("x").alias("mean_with"), F.avg("y").alias("mean_without"), F.avg(F.col("x") - F.col("y")).alias("difference"))


def paired_reports(reports: DataFrame, one: str, two: str) -> DataFrame:
    """(model, detection_id, x, y): scores of one model's two reports on a detection that both prompts covered."""
    a = reports.where(F.col("prompt") == one).select("model", "detection_id", F.col("score").alias("x"))
    b = reports.where(F.col("prompt") == two).select("model", "detection_id", F.col("score").alias("y"))
    return a.join(b, ["model", "detection_id"])


def paired_prompts(reports: DataFrame, one: str, two: str) -> DataFrame:
    """Per model, over detections that both prompts covered: mean scores and difference."""
    return paired_reports(reports, one, two).groupBy("model").agg(F.count("*").alias("n"), F.avg("x").alias("mean_one"), F.avg("y").alias("mean_two"), F.avg(F.col("y") - F.col("x")).alias("gain"))


def common_detections(reports: DataFrame) -> DataFrame:
    n = reports.select("model").distinct().agg(F.count("*").alias("n_models"))
    return reports.groupBy("detection_id").agg(F.count_distinct("model").alias("m")).join(F.broadcast(n), F.col("m") == F.col("n_models")).select("detection_id")


def rank_in_label(packs: DataFrame, label: str, key: str) -> DataFrame:
    """``packs`` with the rank of a row among those of its label, how many these are (n_label), and the position that follows
    from both: the k-th of n of a label stands at (k - 0.5) / n.

    ``key`` is an integer; ranks are found in blocks of it, so that a label of most rows is spread.
    """
    sizes = packs.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("n_label"))
    ranked = rank.order_rank(packs, key, [label]).join(sizes, F.col(label).eqNullSafe(F.col("_label")))
    return ranked.select(*packs.columns, "rank", "n_label", ((F.col("rank") - 0.5) / F.col("n_label")).alias("position"))


def balanced_order(packs: DataFrame, label: str, key: str) -> DataFrame:
    """An order whose every prefix is fair to labels: rows by their position within their label."""
    return rank_in_label(packs, label, key).select(*packs.columns, "position").orderBy("position", label, key)


def rescored(reports: DataFrame, packs: DataFrame, key: str = "detection_id") -> DataFrame:
    """Reports with their packs; one missing pack refuses the whole rescoring."""
    if reports.join(packs.select(key), key, "left_anti").limit(1).count():
        raise ValueError("a report has no pack")
    return reports.join(packs, key)


def token_medians(reports: DataFrame) -> DataFrame:
    return reports.groupBy("model").agg(F.percentile("tokens", F.lit(0.5)).alias("tokens"), F.percentile("words", F.lit(0.5)).alias("words"), F.percentile(F.when(F.col("words") > 0, F.col("tokens") / F.col("words")), F.lit(0.5)).alias("tokens_per_word"))


def list_price(reports: DataFrame, prices: DataFrame) -> DataFrame:
    """List price of all and of finished reports; models without a price stay NULL."""
    cost = F.col("tokens") * F.col("price")
    return reports.join(F.broadcast(prices), "model", "left").groupBy("model").agg(F.when(F.max("price").isNotNull(), F.sum(cost)).alias("all_reports"), F.when(F.max("price").isNotNull(), F.sum(F.when(F.col("ok"), cost).otherwise(0.0))).alias("finished"))  # one row a model


def estimate(packs: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """Cost before a run: words * 1.35 + 400 tokens in and 350 out for each pack."""
    words = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    return packs.agg(F.count("*").alias("n"), (F.sum(words * 1.35 + 400) * price_in + F.count("*") * 350 * price_out).alias("cost"))


