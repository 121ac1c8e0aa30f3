"""Training-corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``docs``.

* quality rules: documents that the policy rejects go;
* n-gram Jaccard join: of each class of near copies the document with the smallest doc_id stays, once;
* substring dedup: repeated passages are cut out of the later documents, and a document left without words goes;
* benchmark decontamination: documents with an occurrence of a benchmark window go;
* best-fit packing: what is left becomes pieces in sequences.

Rows without doc_id pass the two stages that compare documents by id. Of rows that repeat an id, the second stage keeps the
one whose text hash is least, and of equal texts the least row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import decontamination, jaccard_join, packing, quality_rules, substring_dedup
from tidegraph.llm.common import distilled, documents, without_ids, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_policy(quality_rules.ledger(docs, carry=True))
    # A filter would be pushed below the ledger and repeat its expressions; a generator is not.
    return judged.select(F.inline(F.when(F.col("kept"), F.array("row")).otherwise(F.array().cast(f"array<{docs.schema.simpleString()}>"))))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = distilled(spark, lambda: jaccard_join.linked_classes(docs).where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    kept = without_ids(docs, gone)
    again = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if not again.limit(1).count():
        return kept
    # A row's columns stay together in one struct, whatever their names and types.
    rows = kept.join(again, "doc_id", "left_semi").select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.md5("text").alias("h"))
    first = rows.groupBy("doc_id").agg(F.min_by("row", F.struct("h", F.to_json("row"))).alias("row"))
    return without_ids(kept, again).unionByName(first.select("row.*"))


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spans = distilled(spark, lambda: substring_dedup.merged_spans(substring_dedup.passages(docs)), "spans")
    return substring_dedup.remove(docs, spans)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.decontaminate(docs, benchmark)
    hit = written(found.where("size(spans) > 0 AND doc_id IS NOT NULL").select("doc_id").distinct(), "hit")
    kept = without_ids(docs, hit)
    if not docs.where("doc_id IS NULL").limit(1).count():
        return kept
    unnamed = docs.where("doc_id IS NULL").withColumn("doc_id", F.xxhash64("text"))
    found = decontamination.decontaminate(unnamed, benchmark)
    key = substring_dedup.free(docs, "_text")
    hit = written(found.where("size(spans) > 0").select(F.col("doc_id").alias(key)).distinct(), "hit")
    return kept.withColumn(key, F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).join(hit, key, "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("jaccard_join", near_copy_stage),
    ("substring_dedup", passage_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Tokens cannot be made in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
