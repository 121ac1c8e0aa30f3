"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of ``[^\\x20\\x09-\\x0D]+``.
BLANKS = " \t\n\x0b\f\r"
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def low_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8, with A-Z in lower case; ``bytes.split`` cuts at exactly these six blanks."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, else one of our own (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths of the tables that ``written`` wrote, in order.
_PATHS: list[str] = []


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, cut from its lineage, and kept if an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # shuffles of this write go with it
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    _PATHS.append(path)
    return spark.read.schema(df.schema).parquet(path)


def distilled(spark: SparkSession, make: Callable[[], DataFrame], what: str) -> DataFrame:
    """``make()`` as a written table; the tables written on the way to it are deleted."""
    before = len(_PATHS)
    out = written(make(), what)
    jvm = spark.sparkContext._jvm
    for name in _PATHS[before:-1]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del _PATHS[before:-1]
    return out


def discard(df: DataFrame) -> None:
    """Deletes what ``written`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(name).getParent()
        if str(path.toString()).split(":", 1)[-1].lstrip("/").startswith(shared_dir(spark).split(":", 1)[-1].lstrip("/")):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Ids up to this many (16 MB of them) are sent to all executors; more are shuffled with the table.
SENT_IDS = 1_000_000


def with_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the written table ``ids``."""
    return df.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, key, "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in the written table ``ids``."""
    return df.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, key, "left_anti").select(*df.columns)


def held_out(doc_id: Column | str, modulus: int, remainder: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id is never held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of uint64: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end has one edge and is no smaller end: then the smaller ends are the least of their components."""
    ends = edges.select(F.col("hi").alias("n"), F.lit(1).alias("h"), F.lit(0).alias("l")).union(edges.select("lo", F.lit(0), F.lit(1)))
    return not ends.groupBy("n").agg(F.sum("h").alias("h"), F.sum("l").alias("l")).where("h > 1 OR (h > 0 AND l > 0)").limit(1).count()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge table, as (node, component): the smallest node reachable.

    Every round links each node's larger neighbours, then its smaller ones, to the smallest node nearby, and
    writes the edges to the shared folder. The edge count never grows; rounds grow with the logarithm of the
    longest path. Null ends and loops are ignored.
    """
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = written(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    while not _stars(now):
        both = now.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(now.select("lo", "hi"))
        low = both.groupBy("n").agg(F.min("m").alias("least"))
        low = low.select("n", F.least("n", "least").alias("least"))
        large = both.where("m > n").join(low, "n").select(F.col("m").alias("hi"), F.col("least").alias("lo")).distinct()
        small_low = large.groupBy("hi").agg(F.min("lo").alias("least"))
        joined = large.join(small_low, "hi")
        small = joined.select("hi", F.col("least").alias("lo")).union(joined.where("lo > least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))).distinct()
        after = written(small, "edges")
        discard(now)
        now = after
    nodes = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return nodes.union(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
