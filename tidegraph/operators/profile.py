"""Table profiles: columns, graph shape, time order, class balance, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegraph.operators import rank


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: type, distinct values, nulls, whether constant. Each distinct count is its own small aggregate."""
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    entries = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(c).alias("n_null")) for c, t in df.dtypes]
    base = nulls.select(F.explode(F.array(*entries)).alias("x")).select("x.*")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in df.columns])).alias("x")).select("x.*")
    uniques = long.where("v IS NOT NULL").groupBy("column", "v").agg(F.lit(1).alias("one")).groupBy("column").agg(F.count("*").alias("n_unique"))
    out = base.join(uniques, "column", "left").withColumn("n_unique", F.coalesce("n_unique", F.lit(0)))
    return out.withColumn("is_constant", F.col("n_unique") <= 1)


#: Bits of the sketches: 2^14 cells, an error of some 0.8%.
SKETCH_BITS = 14


def sketched_profile(df: DataFrame, part: Column | None = None) -> DataFrame:
    """Profiles that can be merged: for each column (and ``part``, such as a file) rows, NULLs, a sketch of the distinct values
    and the least and largest as text. One pass over ``df``, one aggregate; no cell becomes a row."""
    text = {c: F.col(f"`{c}`").cast("string") for c in df.columns}
    one = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.count("*").alias("n"), F.count_if(text[c].isNull()).alias("n_null"), F.hll_sketch_agg(text[c], SKETCH_BITS).alias("sketch"), F.min(text[c]).alias("least"), F.max(text[c]).alias("largest")) for c, t in df.dtypes]
    key = [] if part is None else [part.alias("part")]
    return df.groupBy(*key).agg(F.array(*one).alias("x")).select(*(["part"] if key else []), F.explode("x").alias("x")).select(*(["part"] if key else []), "x.*")


def merged_profile(sketches: DataFrame) -> DataFrame:
    """Per column of stored sketches: type, rows, NULLs, distinct values (estimated) and whether constant (exact)."""
    g = sketches.groupBy("column", "dtype").agg(F.sum("n").alias("n"), F.sum("n_null").alias("n_null"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_unique"), F.min("least").alias("least"), F.max("largest").alias("largest"))
    return g.withColumn("is_constant", F.col("least").isNull() | (F.col("least") == F.col("largest"))).drop("least", "largest")


def graph_shape(flows: DataFrame) -> DataFrame:
    """Hosts, ordered pairs, density and per-source and per-pair statistics of the whole directed multigraph.

    Medians are of counts that sum to at most the rows: n rows give at most sqrt(2 n) different ones.
    """
    pairs = flows.groupBy("src", "dst").agg(F.count("*").alias("n"))
    senders = pairs.groupBy("src").agg(F.count("*").alias("peers"), F.sum("n").alias("flows"))
    hosts = flows.select(F.col("src").alias("h")).union(flows.select("dst")).distinct().agg(F.count("*").alias("n_hosts"))
    stats = lambda c, p: [F.avg(c).alias(f"{p}_mean"), F.percentile(c, F.lit(0.5)).alias(f"{p}_median"), F.max(c).alias(f"{p}_max")]
    by_pair = pairs.agg(F.count("*").alias("n_pairs"), *stats("n", "flows_per_pair"))
    by_src = senders.agg(F.count("*").alias("n_src"), *stats("peers", "peers_per_src"), *stats("flows", "flows_per_src"))
    n_dst = pairs.select("dst").distinct().agg(F.count("*").alias("n_dst"))
    out = by_pair.crossJoin(by_src).crossJoin(hosts).crossJoin(n_dst)  # four single rows
    density = F.col("n_pairs") / (F.col("n_hosts") * (F.col("n_hosts") - 1))
    return out.withColumn("density", density).withColumn("verdict", F.when(density > 0.5, "dense").when(density > 0.1, "moderate").otherwise("sparse"))


def top_talkers(flows: DataFrame, k: int = 10) -> DataFrame:
    return flows.groupBy("src").agg(F.count("*").alias("flows")).orderBy(F.desc("flows"), "src").limit(k)


def monotone_columns(df: DataFrame, columns: list[str], order: str = "row_id", block: int = 1 << 16) -> DataFrame:
    """Per column whether it never falls in row order. Blocks are checked inside, then at their edges.

    A column is compared within its block of rows by a window, and each block's least value with the largest before.
    """
    blocked = df.select(F.expr(f"{order} div {block}").alias("b"), order, *columns)
    w = Window.partitionBy("b").orderBy(order)
    steps = blocked.select("b", *columns, *[(F.col(c) < F.lag(c).over(w)).alias(f"_{c}") for c in columns])
    per = steps.groupBy("b").agg(*[x for c in columns for x in (F.count_if(f"_{c}").alias(f"_{c}"), F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))])
    edge = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    falls = per.select(*[(F.col(f"_{c}") + F.coalesce((F.max(f"hi_{c}").over(edge) > F.col(f"lo_{c}")).cast("long"), F.lit(0))).alias(f"_{c}") for c in columns], *[f"{x}_{c}" for c in columns for x in ("lo", "hi")])
    total = falls.agg(*[x for c in columns for x in (F.sum(f"_{c}").alias(f"_{c}"), F.min(f"lo_{c}").alias(f"lo_{c}"), F.max(f"hi_{c}").alias(f"hi_{c}"))])
    rows = [F.struct(F.lit(c).alias("column"), ((F.col(f"_{c}") == 0) & (F.col(f"lo_{c}") < F.col(f"hi_{c}"))).alias("monotone")) for c in columns]
    return total.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def time_verdict(df: DataFrame, candidates: list[str], others: list[str], order: str = "row_id") -> DataFrame:
    """timestamp if a named candidate exists, else ordinal if any other column is monotone, else none."""
    named = [c for c in candidates if c in df.columns]
    found = monotone_columns(df, named or others, order)
    verdict = F.lit("timestamp") if named else F.when(F.max("monotone"), "ordinal").otherwise("none")
    return found.agg(verdict.alias("verdict"), F.array_sort(F.collect_list(F.when(F.col("monotone"), F.col("column")))).alias("monotone_columns"))


def label_balance(df: DataFrame) -> DataFrame:
    n1, n0 = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    return df.agg(F.count("*").alias("n"), n1.alias("n_attack"), n0.alias("n_benign"), (n1 / F.count("*")).alias("prevalence"), F.when(n1 > 0, n0 / n1).alias("imbalance_ratio"))


def family_balance(df: DataFrame, rare: int = 1000) -> DataFrame:
    """Counts, shares and inverse-frequency weights of mean 1; one row a family, so the windows are tiny."""
    counts = df.groupBy("family").agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    weight = F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))
    out = counts.select("family", "n", (F.col("n") / F.sum("n").over(every)).alias("share"), weight.alias("w"), (F.col("n") < rare).alias("is_rare"))
    return out.select("family", "n", "share", (F.col("w") / F.avg("w").over(every)).alias("class_weight"), "is_rare")


def split_balance(df: DataFrame, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Counts of each family by split; rows outside every split are left out."""
    return df.where(F.col("split").isNotNull()).groupBy("family").agg(*[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in splits], F.count("*").alias("n"))


def balance_summary(counts: DataFrame, benign: str) -> DataFrame:
    """Largest and smallest attack family and their ratio, from a family table with ``n``."""
    attacks = counts.where(F.col("family") != benign)
    big, small = F.max(F.struct("n", "family")), F.min(F.struct("n", "family"))
    return attacks.agg(big["family"].alias("largest"), big["n"].alias("n_largest"), small["family"].alias("smallest"), small["n"].alias("n_smallest"), (big["n"] / small["n"]).alias("ratio"))


def split_rates(df: DataFrame) -> DataFrame:
    """Rows, share of all rows and attack rate of each split; rows outside every split are ``purged``."""
    every = Window.partitionBy()
    g = df.groupBy(F.coalesce("split", F.lit("purged")).alias("split")).agg(F.count("*").alias("n"), F.avg("label").alias("attack_rate"))
    return g.select("split", "n", (F.col("n") / F.sum("n").over(every)).alias("share"), "attack_rate")


def five_numbers(df: DataFrame, value: str, by: str) -> DataFrame:
    """Per group, of few: n, mean, population std, min, quartiles, max; all NULL but n for an empty group."""
    g = df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return g.join(rank.percentiles(df, value, {"p25": 0.25, "median": 0.5, "p75": 0.75}, by), by, "left")


def spread(value: str) -> list[Column]:
    """mean, population std, min, max and coefficient of variation (NULL at mean 0)."""
    return [F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.when(F.avg(value) != 0, F.stddev_pop(value) / F.avg(value)).alias("cv")]
