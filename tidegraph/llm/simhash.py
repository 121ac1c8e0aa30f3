"""SimHash near-duplicates by pigeonring filtering, and the classes that their links make.

A fingerprint has a bit for each position that is set in over half the XXH64 hashes of a text's word shingles. The 64 bits
are cut into ``BUDGET + 1`` segments that stand in a ring. If two fingerprints differ at ``BUDGET`` bits or fewer, then from
some segment on each chain of ``l`` consecutive segments differs at ``l * BUDGET / (BUDGET + 1)`` bits or fewer (else the
chains that break their share would cover the ring and break the whole). So for one start the first segment is equal and
the second differs at one bit at most: that pair of segments is the key of a list. A fingerprint stands in the lists of its
own keys and looks up the lists of all keys that its second segment may have; longer chains are checked before the whole
distance.

Lists are not expanded into pairs. Whoever looks a list up meets its centre first, the member with most documents; links to
centres give classes. Only lists that then still hold several classes are joined whole, members of different classes with
each other, and of a fingerprint's links into one class one is kept. A list that is one group of near copies so costs
one comparison a member.

Null text and text without words: fingerprint zero, linked like any other. Texts of fewer words than a shingle are one
shingle. Rows without doc_id link nothing and have a null component. Rows that repeat an id are judged each by its own text.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import components, discard, documents, low_words, written

SHINGLE = 4
SEED = 42
BITS = 64
#: Bits at which linked fingerprints differ, at most.
BUDGET = 4
_CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned; long texts are hashed chunk by chunk."""
    words = low_words(text)
    if not words:
        return 0
    size = min(size, len(words))
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    count = np.zeros(BITS, np.int64)
    for i in range(0, len(starts), _CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + _CHUNK], ends[i : i + _CHUNK], strict=True)], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number, of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": fp})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(run, "doc_id bigint, fp bigint")


def segments(budget: int = BUDGET) -> list[tuple[int, int]]:
    """(first bit, width) of each segment; widths differ by one at most, so that none is the only narrow one."""
    parts = budget + 1
    ends = [BITS * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _turned(fp: Column, first: int) -> Column:
    """The ring's bits with the segment that begins at bit ``first`` lowest."""
    return fp if not first else F.shiftrightunsigned(fp, first).bitwiseOR(F.shiftleft(fp, BITS - first))


def _keys(fp: Column, budget: int, looked_up: bool) -> Column:
    """Keys of a fingerprint: the first two segments of each start, and for ``looked_up`` those that its second may meet."""
    parts, out = segments(budget), []
    for k, (first, width) in enumerate(parts):
        wide = width + parts[(k + 1) % len(parts)][1]
        own = _turned(fp, first).bitwiseAND(F.lit((1 << wide) - 1)).bitwiseOR(F.lit(k << 48))
        out.append(own)
        if looked_up:
            out += [own.bitwiseXOR(F.lit(1 << j)) for j in range(width, wide)]
    return F.explode(F.array(*out))


def near(x: Column, y: Column, start: Column, budget: int = BUDGET) -> Column:
    """Whether the chains from segment ``start`` on stay within their shares, and then the whole within ``budget``."""
    parts, apart = segments(budget), x.bitwiseXOR(y)
    chains = F.lit(False)
    for k, (first, _) in enumerate(parts):
        turned, wide, kept = _turned(apart, first), 0, F.lit(True)
        for n in range(1, len(parts)):
            wide += parts[(k + n - 1) % len(parts)][1]
            if n > 2:  # the key holds the first two
                kept = kept & (F.bit_count(turned.bitwiseAND(F.lit((1 << wide) - 1))) <= n * budget // (budget + 1))
        chains = F.when(start == k, kept).otherwise(chains)
    return chains & (F.bit_count(apart) <= budget)


def linked(nodes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(node, component) of the fingerprints in ``nodes`` (fp, n) that are linked with another; fp is unique."""
    start = F.shiftright("key", 48)
    members = nodes.select(_keys(F.col("fp"), budget, looked_up=False).alias("key"), "fp", "n")
    lists = members.groupBy("key").agg(F.max(F.struct("n", "fp")).alias("centre"), F.count("*").alias("size"))
    lists = written(lists.select("key", F.col("centre.fp").alias("centre"), "size"), "lists")
    probes = nodes.select(_keys(F.col("fp"), budget, looked_up=True).alias("key"), "fp")
    # Sizes of exploded rows are underestimated: without the hint the planner would send all probes to every executor.
    met = probes.hint("merge").join(lists, "key").where("fp <> centre OR size > 1").select("key", "fp", "centre", "size", ((F.col("fp") != F.col("centre")) & near(F.col("fp"), F.col("centre"), start, budget)).alias("linked"))
    met = written(met.where("linked OR size > 1"), "met")
    links = met.where("linked").select(F.greatest("fp", "centre").alias("a"), F.least("fp", "centre").alias("b")).distinct()
    links = written(links, "links")
    found = written(components(links), "classes")
    known = found.select(F.col("node").alias("fp"), "component")
    # What looks up a list of several members, with its class; a list whose members and visitors are one class is done.
    long = lists.where("size > 1").select("key")
    inside = nodes.select(_keys(F.col("fp"), budget, looked_up=False).alias("key"), "fp").join(long, "key", "left_semi").join(known, "fp", "left")
    inside = written(inside.select("key", F.col("fp").alias("other"), F.coalesce("component", "fp").alias("kind")), "inside")
    visits = met.where("size > 1").select("key", "fp").join(known, "fp", "left").select("key", "fp", F.coalesce("component", "fp").alias("component"))
    visits = written(visits, "visits")
    span = inside.select("key", F.col("kind").alias("c")).union(visits.select("key", "component"))
    mixed = written(span.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key"), "mixed")
    visits = written(visits.join(mixed, "key", "left_semi"), "visits")
    inside = written(inside.join(mixed, "key", "left_semi"), "inside")
    pairs = visits.join(inside, "key").where((F.col("component") != F.col("kind")) & near(F.col("fp"), F.col("other"), start, budget))
    more = written(pairs.groupBy("fp", "kind").agg(F.min("other").alias("other")).select(F.greatest("fp", "other").alias("a"), F.least("fp", "other").alias("b")), "links")
    for table in (lists, met, visits, inside, mixed):
        discard(table)
    return written(components(links.union(more)), "classes") if more.limit(1).count() else found


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of ``docs`` (doc_id, text)."""
    every = written(fingerprints(docs), "fingerprints")
    nodes = written(every.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    classes = nodes.join(linked(nodes.select("fp", "n"), budget).withColumnRenamed("node", "fp"), "fp")
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    moved = written(classes.join(least, "component").select("fp", "component_id"), "moved")
    of = nodes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    rows = every.join(of, "fp", "left")
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
