"""Row selection by position: splits, windows, samples."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.operators import rank


def contiguous_bounds(n: int, train: float, val: float, test: float, gap: int) -> dict[str, tuple[int, int]]:
    """Half-open row ranges with ``gap`` rows purged on both sides of each cut; errors on bad input or empty splits."""
    a, b, c = (Fraction(str(x)) for x in (train, val, test))
    if min(a, b, c) <= 0 or a + b + c != 1:
        raise ValueError("fractions must be positive and sum to one")
    if gap < 0:
        raise ValueError("the gap must not be negative")
    one, two = int(n * a), int(n * (a + b))
    out = {"train": (0, one - gap), "val": (one + gap, two - gap), "test": (two + gap, n)}
    for name, (lo, hi) in out.items():
        if lo >= hi:
            raise ValueError(f"{name} is empty: rows {lo} to {hi}")
    return out


def in_bounds(bounds: dict[str, tuple[int, int]], row: str = "row_id") -> Column:
    """Split of a row, NULL if purged."""
    out = None
    for name, (lo, hi) in bounds.items():
        hit = (F.col(row) >= lo) & (F.col(row) < hi)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def contiguous_split(df: DataFrame, train: float = 0.7, val: float = 0.1, test: float = 0.2, gap: int = 0) -> DataFrame:
    """``df`` with ``split``; only the row count is needed before, which Parquet keeps in its footers."""
    return df.withColumn("split", in_bounds(contiguous_bounds(df.count(), train, val, test, gap)))


def window_split(df: DataFrame, size: int, train: float = 0.7, val: float = 0.1, seed: int = 0) -> DataFrame:
    """Whole windows dealt to splits in md5 order; rows renumbered so that each split is contiguous.

    The tail past the last whole window is dropped. The window table has a row for each window, not for each row.
    """
    spark, n = df.sparkSession, df.count() // size
    a, b = int(n * Fraction(str(train))), int(n * (Fraction(str(train)) + Fraction(str(val))))
    dealt = rank.hash_rank(spark.range(n).withColumnRenamed("id", "w"), seed, ["w"], [], "r").withColumn("r", F.col("r") - 1)
    dealt = dealt.withColumn("split", F.when(F.col("r") < a, "train").when(F.col("r") < b, "val").otherwise("test"))
    dealt = rank.order_rank(dealt, "w", ["split"], "k")  # windows keep their order within a split
    base = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", a).otherwise(b)
    dealt = dealt.select("w", "split", ((base + F.col("k") - 1) * size).cast("long").alias("start"))
    rows = df.withColumn("w", F.expr(f"row_id div {size}"))
    return rows.join(dealt, "w").withColumn("new_row_id", F.col("start") + F.col("row_id") % size).drop("w", "start")


def window_id(df: DataFrame, size: int, start: Column | None = None) -> DataFrame:
    """Fixed-count windows from ``start``; rows before it have none."""
    at = F.col("row_id") - (start if start is not None else F.lit(0))
    return df.withColumn("window_id", F.when(at >= 0, F.floor(at / size).cast("long")))


def whole_windows(df: DataFrame, size: int, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows in whole windows of each split; windows never cross splits and partial ones are dropped."""
    start, whole = None, None
    for name, (lo, hi) in bounds.items():
        hit = F.col("split") == name
        start = F.when(hit, lo) if start is None else start.when(hit, lo)
        whole = F.when(hit, (hi - lo) // size) if whole is None else whole.when(hit, (hi - lo) // size)
    out = window_id(df.where(F.col("split").isNotNull()).withColumn("split", in_bounds(bounds)), size, start)
    return out.where(F.col("window_id") < whole)


def rewindowed(df: DataFrame, size: int) -> DataFrame:
    """Windows counted again over the rows that a filter left, inside each split."""
    ranked = rank.order_rank(df, "row_id", ["split"], "_r")
    totals = df.groupBy("split").agg(F.count("*").alias("_n"))
    out = ranked.join(F.broadcast(totals), "split").withColumn("window_id", F.expr(f"(_r - 1) div {size}"))
    return out.where(F.expr(f"window_id < _n div {size}")).drop("_r", "_n")


def holdout(df: DataFrame, family: str, benign: str) -> DataFrame:
    """Leave one family out: train and val without it, test with it and benign rows only."""
    test = (F.col("split") == "test") & F.col("family").isin(family, benign)
    return df.where((F.col("split").isin("train", "val") & (F.col("family") != family)) | test)


def holdout_counts(df: DataFrame, family: str, benign: str) -> DataFrame:
    """Per split: rows before, kept, of the family, benign and removed."""
    kept = F.when(F.col("split") == "test", F.col("family").isin(family, benign)).otherwise(F.col("family") != family)
    g = df.where(F.col("split").isNotNull()).groupBy("split").agg(F.count("*").alias("before"), F.count_if(kept).alias("n_rows"), F.count_if(kept & (F.col("family") == family)).alias("held_out"), F.count_if(kept & (F.col("family") == benign)).alias("benign"))
    return g.withColumn("removed", F.col("before") - F.col("n_rows"))


def holdout_gates(df: DataFrame, benign: str, skip_below: int = 500, thin_below: int = 20_000) -> DataFrame:
    """Per attack family: rows in test and whether a hold-out can be measured (ok, thin or skipped)."""
    n = F.count_if(F.col("split") == "test")
    g = df.where(F.col("split").isNotNull() & (F.col("family") != benign)).groupBy("family").agg(n.alias("n_test"), F.count_if(F.col("split") != "test").alias("n_seen"))
    return g.withColumn("status", F.when(F.col("n_test") < skip_below, "skipped").when(F.col("n_test") < thin_below, "thin").otherwise("ok"))


def assert_clean(df: DataFrame, family: str) -> None:
    if df.where(F.col("split").isin("train", "val") & (F.col("family") == family)).limit(1).count():
        raise ValueError(f"{family} is in the training or validation rows")


def middle_blocks(df: DataFrame, n: int, floor: int = 200) -> DataFrame:
    """Per family one contiguous middle block, in proportion but at least ``floor`` rows (or all it has).

    The row ids at which a block begins and ends are selected by counts of ranges, so rows are filtered and never ranked;
    ``row_id`` is unique. Families are few: a row each comes to the driver.
    """
    counts = {r["family"]: r["cnt"] for r in df.groupBy("family").agg(F.count("*").alias("cnt")).collect()}
    total = sum(counts.values())
    take = {f: max(min(round(Fraction(n * c, total)), c), min(floor, c)) for f, c in counts.items()}
    ends = {f: ((c - take[f]) // 2 + 1, (c - take[f]) // 2 + take[f]) for f, c in counts.items() if take[f]}
    at = rank.kth_keys(df, F.col("row_id"), {f: sorted(set(e)) for f, e in ends.items()}, "family")
    keep = F.lit(False)
    for f, (first, last) in ends.items():
        keep = F.when(F.col("family").eqNullSafe(F.lit(f)), F.col("row_id").between(at[f, first], at[f, last])).otherwise(keep)
    return df.where(keep)


def even_sample(df: DataFrame, n: int) -> DataFrame:
    """``n`` rows spread evenly over row_id."""
    ids = df.sparkSession.range(1).select(F.explode(rank.even_rows(df.count(), n)).alias("row_id")).distinct()
    return df.join(ids, "row_id", "left_semi")


def block_stride(df: DataFrame, block: int, keep: int) -> DataFrame:
    """Every so many blocks of rows, at most ``keep`` of them."""
    blocks = -(-df.count() // block)
    step = max(1, blocks // keep)
    b = F.expr(f"row_id div {block}")
    return df.where((b % step == 0) & (b < step * keep))


def family_blocks(df: DataFrame, block: int, budget: int) -> tuple[DataFrame, DataFrame]:
    """Family-aware capped scan: whole blocks, one at least for every family, rarest first, then evenly up to ``budget`` rows.

    Returns the rows and the blocks, as ``block_id``. Only the fullest block of each family, and what is in these, comes
    to the driver; the even choice ranks blocks in Spark.
    """
    b = F.expr(f"row_id div {block}").alias("block_id")
    counts = df.groupBy(b, "family").agg(F.count("*").alias("n"))
    fullest = counts.groupBy("family").agg(F.sum("n").alias("total"), F.max_by("block_id", F.struct("n", -F.col("block_id"))).alias("own"))
    families = [(r["family"], r["own"]) for r in fullest.orderBy("total", "family").collect()]
    held: dict[int, dict[str, int]] = {}
    for r in counts.where(F.col("block_id").isin(sorted({own for _, own in families}))).collect():
        held.setdefault(r["block_id"], {})[r["family"]] = r["n"]
    first: list[int] = []
    for family, own in families:
        if not any(family in held[x] for x in first):
            first.append(own)
    room = max(0, (budget - sum(sum(held[x].values()) for x in first)) // block)
    blocks = counts.select("block_id").distinct()
    chosen = blocks.where(F.col("block_id").isin(first))
    n_rest = blocks.count() - len(first) if room else 0
    if n_rest:
        n = min(room, n_rest)
        place = F.bround(F.col("id") * F.lit(n_rest - 1) / F.lit(max(1, n - 1)), 0).cast("long") + 1
        places = df.sparkSession.range(n).select(place.alias("_r")).distinct()
        rest = rank.order_rank(blocks.where(~F.col("block_id").isin(first)), "block_id", [], "_r")
        chosen = chosen.union(rest.join(places, "_r", "left_semi").select("block_id"))
    return df.select("*", b).join(chosen, "block_id", "left_semi").select(*df.columns), chosen


def prevalence_resample(df: DataFrame, n: int, prevalence: float, seed: int = 0) -> DataFrame:
    """A sample of ``n`` rows with a forced share of attacks, in md5 order within each class."""
    pos = round(n * prevalence)
    return df.where(rank.first_in_hash(df, {1: pos, 0: n - pos}, seed, ["row_id"], "label"))


def pending(packs: DataFrame, done: DataFrame, key: str = "detection_id", retry_failed: bool = False) -> DataFrame:
    """Packs without a report yet; failed reports count as missing if they are to be tried again."""
    done = done.where("ok") if retry_failed else done
    return packs.join(done.select(key), key, "left_anti")


def refuse_unknown(packs: DataFrame, done: DataFrame, key: str = "detection_id") -> None:
    if done.join(packs.select(key), key, "left_anti").limit(1).count():
        raise ValueError("reports of detections that no pack has")
