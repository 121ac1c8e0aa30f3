"""Versions of a table: a hash tree over blocks of row ids, under a root that names parameters and split ranges too.

Two tables that differ are compared from the root down, so only children of nodes that differ are looked at, and only rows of
blocks that differ are joined.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, FANOUT = 1 << 16, 64


def block_hashes(df: DataFrame, columns: list[str], block: int = BLOCK, row: str = "row_id") -> DataFrame:
    """(level 0, node, n, hash) of each block of row ids; the order of rows and of columns within a block doesn't count.

    A row is the md5 of its columns as text in name order, NULL marked; a block has the count and the xor of 60 bits of each.
    """
    text = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("!")) for c in sorted({*columns, row})])
    bits = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    leaves = df.groupBy(F.expr(f"{row} div {block}").cast("long").alias("node")).agg(F.count("*").alias("n"), F.bit_xor(bits).alias("x"))
    return leaves.select(F.lit(0).alias("level"), "node", "n", F.md5(F.concat_ws(":", F.col("n").cast("string"), F.col("x").cast("string"))).alias("hash"))


def tree(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(level, node, n, hash) of all nodes: a parent is the md5 of its children's places and hashes, up to one root."""
    top = leaves.agg(F.max("node").alias("last")).first()["last"]
    out, level = leaves, leaves
    at = 0
    while top is not None and (top > 0 or at == 0):
        at, top = at + 1, top // fanout
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda c: F.concat_ws(":", c["node"].cast("string"), c["hash"])), ",")  # at most ``fanout``
        level = level.groupBy(F.expr(f"node div {fanout}").alias("node")).agg(F.sum("n").alias("n"), F.md5(children).alias("hash")).select(F.lit(at).alias("level"), "node", "n", "hash")
        out = out.union(level)
    return out


def version(nodes: DataFrame, params: dict, splits: dict) -> str:
    """16 hexadecimal digits that change with the rows, the fitted parameters or the split ranges, and with nothing else."""
    root = nodes.agg(F.max(F.struct("level", "hash"))["hash"].alias("h")).first()["h"]
    return hashlib.sha256(json.dumps({"params": params, "splits": splits, "table": root}, sort_keys=True).encode()).hexdigest()[:16]


def check(recorded: str | None, current: str, what: str) -> None:
    """Refuses a result of another version; one that names none is refused too."""
    if recorded != current:
        raise ValueError(f"{what} was made from data version {recorded}, but the data here is version {current}; make it again")


def differing_blocks(a: DataFrame, b: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Blocks (node) whose leaves differ, or that one tree lacks, found by descent from the roots of two trees."""
    levels = [x.agg(F.max("level").alias("l")).first()["l"] for x in (a, b)]
    if None in levels or levels[0] != levels[1]:  # trees of unlike height share no root
        start, below = min([x for x in levels if x is not None], default=0), None
    else:
        start, below = levels[0], None
    for level in range(start, -1, -1):
        own = [x.where(F.col("level") == level).select("node", F.col("hash").alias(f"hash_{k}")) for k, x in enumerate((a, b))]
        if below is not None:
            own = [x.join(F.broadcast(below) if n <= 1 << 20 else below, F.expr(f"node div {fanout}") == F.col("up"), "left_semi") for x in own]
        apart = own[0].join(own[1], "node", "full").where(~F.col("hash_0").eqNullSafe(F.col("hash_1"))).select("node")
        rows = apart.collect() if level else []  # nodes above the leaves whose children differ: one in ``fanout`` blocks at most
        if level:
            n = len(rows)
            below = a.sparkSession.createDataFrame([(r["node"],) for r in rows], "up long")
    return apart
