"""Exact ranking metrics over a score table (row_id, y, score, family, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegraph.operators import rank


def curve(scores: DataFrame) -> DataFrame:
    """One row per distinct score, highest first: running true and false positives when alerting at it.

    Ties are one step, so every row is a threshold that can be had. No global window: see ``rank.running_sums``.
    """
    groups = scores.groupBy("score").agg(F.sum("y").cast("long").alias("p"), F.sum(1 - F.col("y")).cast("long").alias("n"))
    out = rank.running_sums(groups, "score", {"tp": "p", "fp": "n"})
    totals = groups.agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    out = out.crossJoin(F.broadcast(totals))  # one row
    return out.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp"))).withColumn("recall", F.when(F.col("pos") > 0, F.col("tp") / F.col("pos")))


def average_precision(points: DataFrame) -> DataFrame:
    return points.agg(F.when(F.max("pos") > 0, F.sum(F.try_divide("p", "pos") * F.col("precision"))).alias("pr_auc"))


def roc_auc(points: DataFrame) -> DataFrame:
    """Mid-rank AUC: positives above a step's negatives, ties half. NULL unless both classes are there."""
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2))
    return points.agg(F.when((F.max("pos") > 0) & (F.max("neg") > 0), area / (F.max("pos") * F.max("neg"))).alias("roc_auc"))


def fpr_at_recall(points: DataFrame, targets: tuple[float, ...] = (0.95, 0.99)) -> DataFrame:
    """False-positive rate at the first threshold that reaches a recall; NULL if a class is absent."""
    ok = (F.max("pos") > 0) & (F.max("neg") > 0)
    return points.agg(*[F.when(ok, F.coalesce(F.min(F.when(F.col("recall") >= t, F.try_divide("fp", "neg"))), F.lit(1.0))).alias(f"fpr_at_{round(t * 100)}") for t in targets])


def choose_threshold(scores: DataFrame, mode: str = "f1", target_recall: float = 0.95) -> float:
    """Threshold of the largest F1 (the higher score if tied), or the highest that reaches a recall; 0.5 without positives."""
    points = curve(scores).withColumn("f1", 2 * F.col("tp") / (F.col("pos") + F.col("tp") + F.col("fp")))
    if mode == "f1":
        r = points.agg(F.max("pos").alias("pos"), F.max(F.struct("f1", "score"))["score"].alias("t")).first()
    else:
        r = points.agg(F.max("pos").alias("pos"), F.coalesce(F.max(F.when(F.col("recall") >= target_recall, F.col("score"))), F.min("score")).alias("t")).first()
    return float(r["t"]) if r["pos"] else 0.5


def metric_set(scores: DataFrame, threshold: float) -> DataFrame:
    """Counts and rates at a threshold in one aggregate."""
    hit = F.col("score") >= threshold
    g = scores.agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("positives"), F.count_if(hit & (F.col("y") == 1)).alias("tp"), F.count_if(hit & (F.col("y") == 0)).alias("fp"))
    alerts, tp, pos = F.col("tp") + F.col("fp"), F.col("tp"), F.col("positives")
    zero = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return g.select("n", "positives", (pos / F.col("n")).alias("prevalence"), F.lit(float(threshold)).alias("threshold"), zero(tp, alerts).alias("precision"), zero(tp, pos).alias("recall"), zero(2 * tp, alerts + pos).alias("f1"), "tp", "fp", F.when(tp > 0, alerts / tp).alias("alerts_per_tp"))


def family_recall(scores: DataFrame, threshold: float, benign: str) -> DataFrame:
    p = F.avg((F.col("score") >= threshold).cast("int"))
    g = scores.where(F.col("family") != benign).groupBy("family").agg(F.count("*").alias("n"), p.alias("recall"))
    return g.withColumn("ci95", 1.96 * F.sqrt(F.greatest(F.col("recall") * (1 - F.col("recall")), F.lit(1e-12)) / F.col("n")))


def confusion(scores: DataFrame, true: str = "family", pred: str = "pred_family") -> DataFrame:
    """Sparse confusion counts with the share of the true class."""
    g = scores.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("true")))


def class_report(matrix: DataFrame) -> DataFrame:
    """Per true class precision, recall, F1 and rows, from confusion counts."""
    t = matrix.groupBy(F.col("true").alias("family")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    p = matrix.groupBy(F.col("pred").alias("family")).agg(F.sum("n").alias("m"))
    out = t.join(p, "family", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    return out.select("family", "n", F.when(F.col("m") > 0, F.col("hit") / F.col("m")).otherwise(0.0).alias("precision"), (F.col("hit") / F.col("n")).alias("recall"), (2 * F.col("hit") / (F.col("n") + F.col("m"))).alias("f1"))


def multiclass(matrix: DataFrame) -> DataFrame:
    report = class_report(matrix).agg(F.avg("f1").alias("macro_f1"), F.sum("n").alias("n"), F.count("*").alias("n_classes"))
    hits = matrix.agg((F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return report.crossJoin(hits)  # two single rows


def detection_families(scores: DataFrame, threshold: float, benign: str) -> DataFrame:
    """Family accuracy over attacks and over true-positive detections, and how often the two heads disagree."""
    hit, attack = F.col("score") >= threshold, F.col("y") == 1
    right = (F.col("family") == F.col("pred_family")).cast("int")
    return scores.agg(
        F.avg(F.when(attack, right)).alias("attack_accuracy"), F.count_if(hit & attack).alias("n_tp"), F.avg(F.when(hit & attack, right)).alias("tp_family_accuracy"),
        F.avg(F.when(hit & attack, (F.col("pred_family") == benign).cast("int"))).alias("tp_called_benign"), F.avg(F.when(hit, (F.col("pred_family") == benign).cast("int"))).alias("heads_disagree"),
    )


def prevalence_cut(scores: DataFrame, target: float, seed: int = 0, keep_positives: bool = False) -> Column:
    """Whether a row stays when ``scores`` (row_id, y) are brought to a prevalence, in md5 order within each class; one class
    alone is kept as it is.

    Negatives are cut if attacks are too rare for them, else (unless all positives must stay) positives are cut.
    """
    r = scores.agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n")).first()
    p, n = r["p"], r["n"]
    if not p or not n:
        return F.lit(True)
    want_p, want_n = p, round(p * (1 - target) / target)
    if want_n > n:
        want_p, want_n = (p if keep_positives else max(1, round(n * target / (1 - target)))), n
    return rank.first_in_hash(scores, {1: want_p, 0: want_n}, seed, ["row_id"], "y")


def at_prevalence(scores: DataFrame, target: float, seed: int = 0, keep_positives: bool = False) -> DataFrame:
    """Rows subsampled after scoring to a prevalence; see ``prevalence_cut``."""
    return scores.where(prevalence_cut(scores, target, seed, keep_positives))


def curves(scores: DataFrame, by: str) -> DataFrame:
    """``curve`` of each of few groups."""
    groups = scores.groupBy(by, "score").agg(F.sum("y").cast("long").alias("p"), F.sum(1 - F.col("y")).cast("long").alias("n"))
    out = rank.running_sums(groups, "score", {"tp": "p", "fp": "n"}, by=(by,), ranges=by)
    totals = groups.groupBy(by).agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    return out.join(F.broadcast(totals), by)  # a row a group


def judged_groups(scores: DataFrame, by: str) -> DataFrame:
    """Metrics of each of few groups of ``scores`` (y, score, threshold): counts and rates at its threshold, PR-AUC, ROC-AUC and
    false-positive rate at 95 % recall; NULL where a class is absent."""
    hit, attack = F.col("score") >= F.col("threshold"), F.col("y") == 1
    at = scores.groupBy(by).agg(F.count("*").alias("n"), F.first("threshold").alias("threshold"), F.avg("y").alias("prevalence"), F.sum("y").alias("_p"), F.count_if(hit & attack).alias("tp"), F.count_if(hit & ~attack).alias("fp"))
    points = curves(scores, by).withColumns({"_precision": F.col("tp") / (F.col("tp") + F.col("fp")), "_recall": F.try_divide("tp", "pos")})
    both = (F.max("pos") > 0) & (F.max("neg") > 0)
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2))
    fpr = F.min(F.when(F.col("_recall") >= 0.95, F.try_divide("fp", "neg")))
    whole = points.groupBy(by).agg(F.when(F.max("pos") > 0, F.sum(F.try_divide("p", "pos") * F.col("_precision"))).alias("pr_auc"), F.when(both, area / (F.max("pos") * F.max("neg"))).alias("roc_auc"), F.when(both, fpr).alias("fpr_at_95"))
    zero = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = zero(F.col("tp"), F.col("tp") + F.col("fp")), zero(F.col("tp"), F.col("_p"))
    return at.join(whole, by).select(by, "n", "threshold", "prevalence", "pr_auc", "roc_auc", zero(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("_p")).alias("f1"), precision.alias("precision"), recall.alias("recall"), "fpr_at_95")


def report_both(scores: DataFrame, threshold: float, target: float, seed: int = 0) -> DataFrame:
    """Metrics as the rows are and at a prevalence, with what was kept."""
    native = scores.count()
    two = None
    for name, df in (("native", scores), ("target", at_prevalence(scores, target, seed))):
        points = curve(df)
        one = metric_set(df, threshold).crossJoin(average_precision(points)).crossJoin(roc_auc(points)).crossJoin(fpr_at_recall(points))  # single rows
        one = one.select(F.lit(name).alias("at"), F.lit(native).cast("long").alias("n_before"), "*")
        two = one if two is None else two.union(one)
    return two


def mistaken_for(runs: DataFrame, family: str) -> DataFrame:
    """What a held-out family is taken for, pooled over runs: shares of predicted families, commonest first."""
    g = runs.where(F.col("family") == family).groupBy("pred_family").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), "pred_family")


def channel_summary(scores: DataFrame, threshold: float, weight: str) -> DataFrame:
    tp = (F.col("score") >= threshold) & (F.col("y") == 1)
    return scores.agg(F.avg(weight).alias("mean"), F.avg((F.col(weight) > 0.5).cast("int")).alias("share_above_half"), F.avg(F.when(tp, F.col(weight))).alias("mean_on_tp"))


def replay_windows(scores: DataFrame, threshold: float) -> DataFrame:
    """Per window: flows, alerts, true and false positives, attacks."""
    hit = F.col("score") >= threshold
    return scores.groupBy("window_id").agg(F.count("*").alias("flows"), F.count_if(hit).alias("alerts"), F.count_if(hit & (F.col("y") == 1)).alias("tp"), F.count_if(hit & (F.col("y") == 0)).alias("fp"), F.sum("y").cast("long").alias("attacks"))


def replay_totals(windows: DataFrame) -> DataFrame:
    """Pooled totals: sums of counts, never means of ratios."""
    g = windows.agg(F.count("*").alias("windows"), *[F.sum(c).alias(c) for c in ("flows", "alerts", "tp", "fp", "attacks")], F.count_if(F.col("alerts") > 0).alias("windows_with_alerts"))
    return g.withColumns({"precision": F.when(F.col("alerts") > 0, F.col("tp") / F.col("alerts")), "recall": F.when(F.col("attacks") > 0, F.col("tp") / F.col("attacks")), "alerts_per_1000": 1000 * F.col("alerts") / F.col("flows"), "trigger_rate": F.col("windows_with_alerts") / F.col("windows")})


def running_replay(windows: DataFrame) -> DataFrame:
    """Totals after each window, from one row a window."""
    sums = {f"{c}_so_far": c for c in ("flows", "alerts", "tp", "attacks")}
    out = rank.running_sums(windows, "window_id", sums, descending=False)
    return out.select("window_id", *sums, F.when(F.col("alerts_so_far") > 0, F.col("tp_so_far") / F.col("alerts_so_far")).alias("precision"), F.when(F.col("attacks_so_far") > 0, F.col("tp_so_far") / F.col("attacks_so_far")).alias("recall"))


def replay_latency(windows: DataFrame, seconds: str) -> DataFrame:
    """One row: exact median and 95th percentile of the seconds that windows took."""
    return rank.percentiles(windows, seconds, {"latency_median": 0.5, "latency_p95": 0.95})
