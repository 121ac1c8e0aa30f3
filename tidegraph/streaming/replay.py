"""Replay of scored flows as a stream, and time windows where there is a time column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


COUNTS = ("flows", "alerts", "tp", "fp", "attacks")


class RunningTotals(StatefulProcessor):
    """Windows of a replay in order, each once and when it is whole, with the totals after it.

    State is what is still open: the windows that lack rows, and the totals of those that went out. A window is whole when it
    has ``size`` rows; the last one of ``total`` rows may have fewer.
    """

    def __init__(self, size: int, total: int):
        self.size, self.total = size, total

    def init(self, handle: StatefulProcessorHandle) -> None:
        counts = ", ".join(f"{c} bigint" for c in COUNTS)
        self.done = handle.getValueState("done", f"next bigint, {counts}")
        self.open = handle.getMapState("open", "window_id bigint", counts)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        own: dict[int, list[int]] = {}
        for r in rows:
            have = own.setdefault(r["window_id"], [0] * len(COUNTS))
            for i, c in enumerate(COUNTS):
                have[i] += r[c]
        for w, more in own.items():
            if self.open.containsKey((w,)):
                more = [a + b for a, b in zip(more, self.open.getValue((w,)), strict=True)]
            self.open.updateValue((w,), tuple(more))
        at, *sums = self.done.get() if self.done.exists() else (0, *[0] * len(COUNTS))
        while self.open.containsKey((at,)):
            window = self.open.getValue((at,))
            if window[0] < min(self.size, self.total - at * self.size):
                break
            self.open.removeKey((at,))
            sums = [a + b for a, b in zip(sums, window, strict=True)]
            yield Row(window_id=at, **dict(zip(COUNTS, map(int, window), strict=True)), **{f"{c}_so_far": n for c, n in zip(COUNTS, map(int, sums), strict=True)})
            at += 1
        self.done.update((at, *sums))

    def close(self) -> None:
        pass


TOTALS = T.StructType([T.StructField(c, T.LongType()) for c in ("window_id", *COUNTS, *[f"{c}_so_far" for c in COUNTS])])
_PARTIAL = T.StructType([T.StructField(c, T.LongType()) for c in ("window_id", *COUNTS)])


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of each window in a task, so that the one group of the totals gets a few rows a task and not all events."""
    held = None
    for batch in batches:
        more = batch.groupby("window_id", sort=True)[list(COUNTS)].sum()
        held = more if held is None else held.add(more, fill_value=0)
    if held is not None and len(held):
        yield held.astype("int64").reset_index()


def replayed(spark: SparkSession, path: str, size: int, hit: Column, attack: Column, folder: str, files_per_batch: int | None = None, total: int | None = None) -> DataFrame:
    """Windows of a stream of stored events with alerts, hits and attacks, and running totals, all made by the stream.

    ``hit`` and ``attack`` say of an event whether it scores as an alert and is one. The stream takes the files that are
    there, ``files_per_batch`` at once, and stops; run again on the same ``folder`` it goes on from its checkpoint. Windows
    are appended to ``folder`` once each, in order; ratios come from counts (``with_ratios``) and are never averaged.
    ``total`` is the number of events when all files are there, by default of those that are there now.
    """
    batch = spark.read.parquet(path)
    total = batch.count() if total is None else total
    source, _, name = path.rstrip("/").rpartition("/")
    one = _is_file(spark, path)
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", name if one else "*.parquet")
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    events = stream.parquet(source if one else path)
    one_each = {"flows": F.lit(1), "alerts": hit.cast("int"), "tp": (hit & attack).cast("int"), "fp": (hit & ~attack).cast("int"), "attacks": attack.cast("int")}
    marked = events.select(F.floor(F.col("event_id") / size).cast("long").alias("window_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in one_each.items()])
    counted = marked.mapInPandas(_counted, _PARTIAL).withColumn("replay", F.lit(0))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        totals = counted.groupBy("replay").transformWithState(RunningTotals(size, total), TOTALS, "append", "None")
        query = totals.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/windows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)
    return spark.read.schema(TOTALS).parquet(f"{folder}/windows")


def with_ratios(totals: DataFrame) -> DataFrame:
    """Pooled precision and recall after each window."""
    return totals.withColumns({"precision": F.when(F.col("alerts_so_far") > 0, F.col("tp_so_far") / F.col("alerts_so_far")), "recall": F.when(F.col("attacks_so_far") > 0, F.col("tp_so_far") / F.col("attacks_so_far"))})


def with_scores(flows: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``flows`` scored by a user's function, which must keep all columns and add ``score``."""
    out = scorer(flows)
    missing = [c for c in [*flows.columns, "score"] if c not in out.columns]
    if missing:
        raise ValueError(f"the scorer left out: {', '.join(missing)}")
    return out


def batch_scorer(score: Callable[[pd.DataFrame], np.ndarray]) -> Callable[[DataFrame], DataFrame]:
    """A scorer of a model in Python: ``score`` gets Arrow batches as pandas frames and returns one number a row."""

    def apply(flows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(score=score(batch))

        return flows.mapInPandas(run, T.StructType([*flows.schema.fields, T.StructField("score", T.DoubleType())]))

    return apply


def _is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def time_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Fixed-duration windows on event time, for batch and stream alike; late rows are dropped by the watermark."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
