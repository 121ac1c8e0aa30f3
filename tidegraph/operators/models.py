"""Topology-blind baselines on spark.ml, scored into the score table that every metric reads."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.operators import evaluate, rank
from tidegraph.sources.tables import dealt

FLOW = ["in_bytes_l", "dst_port_d", "proto_d"]
HOST = ["src_fanout", "src_distinct_ports", "src_flow_count", "dst_fanin", "dst_flow_count"]


def features(df: DataFrame, columns: list[str]) -> DataFrame:
    ready = df.withColumns({"in_bytes_l": F.log1p("in_bytes"), "dst_port_d": F.col("dst_port").cast("double"), "proto_d": F.col("proto").cast("double")})
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(ready)


def fit(train: DataFrame, kind: str, columns: list[str], seed: int = 0):
    """A fitted classifier; logistic regression weighs classes evenly."""
    df = features(train, columns)
    if kind == "logreg":
        p = df.agg(F.avg("label")).first()[0] or 0.5
        df = df.withColumn("w", F.when(F.col("label") == 1, 0.5 / max(p, 1e-9)).otherwise(0.5 / max(1 - p, 1e-9)))
        return LogisticRegression(labelCol="label", weightCol="w", maxIter=30, regParam=1e-3).fit(df)
    if kind == "forest":
        return RandomForestClassifier(labelCol="label", numTrees=20, maxDepth=6, seed=seed).fit(df)
    return GBTClassifier(labelCol="label", maxIter=10, maxDepth=4, seed=seed).fit(df)


def scored(model, df: DataFrame, columns: list[str]) -> DataFrame:
    """row_id, y, score, family of ``df`` under a fitted model."""
    out = model.transform(features(df, columns))
    return out.select("row_id", F.col("label").alias("y"), vector_to_array("probability")[1].alias("score"), "family")


#: Rounds of boosting that may pass without a better validation loss than before by this share.
TOLERANCE = 0.001
KINDS = ("logreg", "forest", "gbt")
SETS = {"flow": FLOW, "flow+host": FLOW + HOST}


def fit_early(df: DataFrame, kind: str, features_column: str, seed: int, share: float, rounds: int = 10):
    """A classifier fitted on ``df`` (train rows and, where ``held``, validation rows), classes weighed evenly by ``w``.

    Boosting stops after ``rounds`` trees or when the validation rows don't get better; the others are fitted on the train rows
    alone. ``share`` is the share of attacks among train rows.
    """
    train = df.where("NOT held")
    common = {"labelCol": "label", "featuresCol": features_column, "weightCol": "w"}
    if kind == "logreg":
        return LogisticRegression(maxIter=3 * rounds, regParam=1e-3, **common).fit(train)
    if kind == "forest":
        return RandomForestClassifier(numTrees=2 * rounds, maxDepth=6, seed=seed, **common).fit(train)
    return GBTClassifier(maxIter=rounds, maxDepth=4, stepSize=0.3, subsamplingRate=0.8, validationIndicatorCol="held", validationTol=TOLERANCE, seed=seed, **common).fit(df)


def compare(df: DataFrame, folder: str, seeds: tuple[int, ...] = (0, 1, 2), target: float = 0.04, prevalence_seed: int = 0, kinds: tuple[str, ...] = KINDS, at_once: int = 6, rounds: int = 10) -> DataFrame:
    """Every kind of model on every feature set with every seed, by one protocol; a row for each (model, features, seed, rows_at,
    novel_only) with metrics.

    ``df`` has row_id, split (train, val, test), label, family, duplicate_of_train and the feature columns. Both feature
    vectors are made once, in one written and cached table, and fits share it, ``at_once`` of them at a time. Thresholds are those of the
    best F1 on validation rows brought to the target prevalence; test rows are judged as they are and at that prevalence, all
    of them and those without a twin in train. Which rows those are depends on no score, so they are chosen once; the scores
    of all fits are written to ``folder``, one table, and each figure is one aggregate over its groups.
    """
    table = df.where("split IS NOT NULL")
    for name, columns in SETS.items():
        table = features(table, columns).withColumnRenamed("features", f"x_{name}")
    share = df.where("split = 'train'").agg(F.avg("label")).first()[0] or 0.5
    weight = F.when(F.col("label") == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9))
    table = table.select("row_id", "split", "label", "duplicate_of_train", *[f"x_{n}" for n in SETS], weight.alias("w"), (F.col("split") == "val").alias("held")).withColumn("y", F.col("label"))
    # Written, so that no job of a fit carries, or makes again, what the rows come from.
    dealt(table, "row_id").write.parquet(f"{folder}/rows")
    table = table.sparkSession.read.schema(table.schema).parquet(f"{folder}/rows").persist()
    chosen = {name: evaluate.prevalence_cut(table.where(rows), target, prevalence_seed) for name, rows in (("val", "split = 'val'"), ("test", "split = 'test'"), ("novel", "split = 'test' AND NOT duplicate_of_train"))}

    def fitted(job: tuple[str, str, int]) -> None:
        kind, name, seed = job
        model = fit_early(table.where("split <> 'test'"), kind, f"x_{name}", seed, share, rounds)
        judged = table.where("split <> 'train'").select("row_id", "split", "y", "duplicate_of_train", F.col(f"x_{name}").alias("features"))
        # Logistic regression has no randomness: one fit stands for all seeds.
        fits = F.explode(F.array(*[F.lit(f"{kind}|{name}|{x}") for x in (seeds if kind == "logreg" else (seed,))]))
        scored_rows = model.setFeaturesCol("features").transform(judged).select(fits.alias("fit"), "row_id", "split", "y", "duplicate_of_train", vector_to_array("probability")[1].alias("score"))
        scored_rows.write.mode("append").parquet(f"{folder}/{kind}-{name}-{seed}")

    jobs = [(kind, name, seed) for kind in kinds for name in SETS for seed in (seeds[:1] if kind == "logreg" else seeds)]
    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(inheritable_thread_target(table.sparkSession)(fitted), jobs))
    scores = table.sparkSession.read.parquet(*[f"{folder}/{kind}-{name}-{seed}" for kind, name, seed in jobs])
    val = scores.where(F.col("split") == "val").where(chosen["val"])
    f1 = 2 * F.col("tp") / (F.col("pos") + F.col("tp") + F.col("fp"))
    limits = evaluate.curves(val, "fit").groupBy("fit").agg(F.max(F.struct(f1.alias("f"), "score"))["score"].alias("threshold"))
    test, novel = scores.where("split = 'test'"), ~F.col("duplicate_of_train")
    groups = [(test, "native", False), (test.where(chosen["test"]), "target", False), (test.where(novel), "native", True), (test.where(novel).where(chosen["novel"]), "target", True)]
    judged = reduce(DataFrame.union, [rows.select(F.concat_ws("|", "fit", F.lit(at), F.lit(str(only).lower())).alias("key"), "y", "score", "fit") for rows, at, only in groups])
    found = evaluate.judged_groups(judged.join(F.broadcast(limits), "fit"), "key")  # a threshold a fit
    part = lambda i: F.element_at(F.split("key", r"\|"), i)
    out = found.select(part(1).alias("model"), part(2).alias("features"), part(3).cast("int").alias("seed"), part(4).alias("rows_at"), part(5).cast("boolean").alias("novel_only"), *[c for c in found.columns if c != "key"])
    rows = out.collect()  # a row for each fit and kind of rows
    table.unpersist()
    return df.sparkSession.createDataFrame(rows, out.schema)


def seed_means(runs: DataFrame) -> DataFrame:
    """Mean and population deviation over seeds of each metric of ``compare``."""
    by = ["model", "features", "rows_at", "novel_only"]
    metrics = [c for c in ("pr_auc", "roc_auc", "f1", "precision", "recall", "fpr_at_95")]
    return runs.groupBy(*by).agg(F.count("*").alias("n_seeds"), *[x for m in metrics for x in (F.avg(m).alias(m), F.stddev_pop(m).alias(f"{m}_std"))])


def saturation(df: DataFrame, columns: list[str], n: int = 600_000, target: float = 0.04, seed: int = 0, cut: float = 0.7, limit: float = 0.98) -> DataFrame:
    """Whether two simple models solve a task: one row a model with PR-AUC, ROC-AUC, the prevalence of the rows they are
    judged on, and whether the better one shows a saturated task.

    Rows are first resampled to ``target`` attacks, ``n`` at most, and keep their order; the first ``cut`` of them are
    learned from. Where that falls is selected by counts of row ids, not by a rank.
    """
    counts = df.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
    size = min(n, counts["p"] + counts["n"])
    n_pos = min(counts["p"], max(1, int(size * target)))
    n_neg = min(counts["n"], int(n_pos * (1 - target) / target))
    sample = df.where(rank.first_in_hash(df, {1: n_pos, 0: n_neg}, seed, ["row_id"], "label"))
    last = rank.kth_keys(sample, F.col("row_id"), {None: [max(1, int(cut * (n_pos + n_neg)))]})[None, max(1, int(cut * (n_pos + n_neg)))]
    train, test = sample.where(F.col("row_id") <= last), sample.where(F.col("row_id") > last)
    rows = []
    for kind in ("logreg", "gbt"):
        points = evaluate.curve(scored(fit(train, kind, columns, seed), test, columns))
        r = evaluate.average_precision(points).crossJoin(evaluate.roc_auc(points)).crossJoin(test.agg(F.avg("label").alias("prevalence"))).first()  # single rows
        rows.append((kind, n_pos + n_neg, r["prevalence"], r["pr_auc"], r["roc_auc"]))
    best = max(r[3] or 0.0 for r in rows)
    return df.sparkSession.createDataFrame([(*r, best > limit) for r in rows], "model string, n long, prevalence double, pr_auc double, roc_auc double, saturated boolean")
