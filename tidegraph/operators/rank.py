"""Ranks and running sums over whole tables without one global window.

Rows are put in buckets that follow the order (ranges of the key, prefixes of a hash); bucket totals, few, give each
bucket's start; the window runs inside buckets. Buckets are expressions of the key alone, so a recomputed task gives the
same answer.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BUCKETS = 32


def _starts(totals: DataFrame, by: list[str], bucket: str, cols: list[str], descending: bool) -> DataFrame:
    order = F.col(bucket).desc() if descending else F.col(bucket)
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*by, bucket, *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_start_{c}") for c in cols])


def range_bucket(df: DataFrame, key: str, by: str | None = None, buckets: int | None = None) -> Column:
    """Bucket of a row: how many of some approximate quantiles of the key, of all rows or of its group, are not above it.

    At least as many buckets as shuffle partitions. The quantiles are looked up now and stand in the plan as one sorted array
    a group, searched by halves, so that all its branches and recomputed tasks agree and the plan stays small; ``by`` is for
    few groups (columns, families). NULL keys: bucket 0.
    """
    n = buckets or max(BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    quantiles = F.percentile_approx(key, [i / n for i in range(1, n)], 10 * n)
    rows = df.groupBy(*([by] if by else [])).agg(quantiles.alias("cuts")).collect()
    kind = f"array<{df.schema[key].dataType.simpleString()}>"
    cuts_of = {r[by] if by else None: sorted(set(r["cuts"] or [])) for r in rows}
    longest = max([1, *map(len, cuts_of.values())])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(longest.bit_length()))])
    array = lambda cuts: F.lit(cuts).cast(kind) if cuts else F.array().cast(kind)
    if by:  # one map, so that the plan doesn't nest however many groups there are
        name = lambda c: "-" if c is None else f"={c}"
        names = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("-"))
        pairs = [x for c, own in cuts_of.items() for x in (F.lit(name(c)), array(own))]
        cuts = F.coalesce(F.try_element_at(F.create_map(*pairs), names), array([])) if pairs else array([])
    else:
        cuts = array(cuts_of.get(None))
    held = F.array(F.struct(cuts.alias("cuts"), F.col(key).alias("key")))
    search = lambda x: F.aggregate(steps, F.lit(0), lambda b, s: F.when(F.get(x["cuts"], b + s - 1) <= x["key"], b + s).otherwise(b))
    return F.get(F.transform(held, search), F.lit(0))


def running_sums(df: DataFrame, key: str, sums: dict[str, str], descending: bool = True, buckets: int | None = None, by: tuple[str, ...] = (), ranges: str | None = None) -> DataFrame:
    """``df``, with one row per distinct ``key``, plus running sums {new column: summed column} in key order.

    ``by`` gives few groups, without NULLs, each summed on its own; ``ranges`` is the one of them whose keys differ.
    """
    placed = df.withColumn("_b", range_bucket(df, key, ranges, buckets))
    summed = sorted(set(sums.values()))
    totals = placed.groupBy(*by, "_b").agg(*[F.sum(c).alias(c) for c in summed])
    starts = _starts(totals, [*by], "_b", summed, descending)
    order = F.col(key).desc() if descending else F.col(key)
    w = Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(starts), [*by, "_b"])  # a row for each group and bucket
    for name, c in sums.items():
        out = out.withColumn(name, F.sum(c).over(w) + F.col(f"_start_{c}"))
    return out.drop("_b", *[f"_start_{c}" for c in summed])


def percentiles(df: DataFrame, key: str, qs: dict[str, float], by: str | None = None) -> DataFrame:
    """Exact percentiles {column: share}, interpolated, of all keys or of few groups of them, by selection (``kth_keys``): no
    key is sorted or shuffled. Looked up when the query is built; the result has a row a group.

    NULL keys don't count; a group without keys has no row.
    """
    column = F.col(key).cast("double")
    counts = df.where(F.col(key).isNotNull()).groupBy(*([by] if by else [])).agg(F.count("*").alias("n")).collect()
    sizes = {r[by] if by else None: r["n"] for r in counts if r["n"]}
    place = {(c, q): (n - 1) * float(q) for c, n in sizes.items() for q in qs.values()}
    wanted: dict[object, list[int]] = {}
    for (c, _), p in place.items():
        wanted.setdefault(c, []).extend((math.floor(p) + 1, math.ceil(p) + 1))
    found = kth_keys(df, column, wanted, by)
    rows = []
    for c in sizes:
        low = [(found[c, math.floor(place[c, q]) + 1], found[c, math.ceil(place[c, q]) + 1], place[c, q] % 1) for q in qs.values()]
        rows.append((*([c] if by else []), *[a + (z - a) * part if part else a for a, z, part in low]))
    fields = [T.StructField(by, df.schema[by].dataType)] if by else []
    return df.sparkSession.createDataFrame(rows, T.StructType(fields + [T.StructField(name, T.DoubleType()) for name in qs]))


def bucket_rank(df: DataFrame, bucket: Column, order: list[Column], by: list[str], name: str) -> DataFrame:
    """1-based rank within ``by``, where ``bucket`` rises with ``order``."""
    placed = df.withColumn("_b", bucket)
    totals = placed.groupBy(*by, "_b").agg(F.count("*").alias("n"))
    starts = _starts(totals, by, "_b", ["n"], False)
    w = Window.partitionBy(*by, "_b").orderBy(*order)
    keys = [*by, "_b"]
    starts = starts.select("_start_n", *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)])
    same = [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]  # a NULL is a group too
    return placed.join(starts, reduce(and_, same)).drop(*[f"_key_{i}" for i in range(len(keys))]).withColumn(name, (F.row_number().over(w) + F.col("_start_n")).cast("long")).drop("_b", "_start_n")


def md5_key(seed: int, *ids: str) -> Column:
    """The order of all seeded samples: md5 of 'seed:id'."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def hash_rank(df: DataFrame, seed: int, ids: list[str], by: list[str], name: str = "rank") -> DataFrame:
    """Rank in md5 order within ``by``; buckets are prefixes of the hash, so even a class of all rows is spread."""
    keyed = df.withColumn("_h", md5_key(seed, *ids))
    return bucket_rank(keyed, F.substring("_h", 1, 2), [F.col("_h"), *[F.col(i) for i in ids]], by, name).drop("_h")


def order_rank(df: DataFrame, order: str, by: list[str], name: str = "rank", block: int = 1 << 16) -> DataFrame:
    """Rank by an integer column within ``by``; buckets are blocks of its values."""
    return bucket_rank(df, F.expr(f"{order} div {block}"), [F.col(order)], by, name)


#: Ranges that one pass of a selection tells apart, and keys of a range that come to the driver.
BINS, GATHERED = 4096, 4096


def _same(a: float, b: float) -> bool:
    return a == b or (a != a and b != b)


def kth_keys(df: DataFrame, key: Column, wanted: dict[object, list[int]], by: str | None = None) -> dict[tuple[object, int], float]:
    """{(class, k): the k-th smallest number of the class}, 1-based; left out where a class has fewer.

    Nothing is sorted or shuffled but counts: a pass counts the keys in ``BINS`` bins of each range that holds a place asked
    for, first of all keys of a class, and goes on inside the bin that holds the place, until that is one value or few enough
    to be looked at. Each pass reads ``df`` again. Classes and places are few; NULL keys don't count, NaN is the largest.
    """
    spark = df.sparkSession
    kind = df.select(key.alias("_k")).schema["_k"].dataType
    real = kind.typeName() in ("double", "float")
    of = df.schema[by].dataType if by else T.IntegerType()
    rows = df.select(key.alias("_k"), (F.col(by) if by else F.lit(0)).alias("_c")).where("_k IS NOT NULL")
    fields = [("c", of), ("i", T.IntegerType()), ("lo", kind), ("hi", kind), ("all", T.BooleanType())]
    schema = T.StructType([T.StructField(f"_{n}", t) for n, t in fields])

    def inside(ranges: list[tuple]) -> DataFrame:
        """Rows with each range of their class that holds them; ranges are few."""
        met = rows.withColumnRenamed("_c", "_class").join(F.broadcast(spark.createDataFrame(ranges, schema)), F.col("_class").eqNullSafe(F.col("_c")))
        return met.where("_all OR _k BETWEEN _lo AND _hi")

    # Bins of doubles follow their magnitude, so that one outlier doesn't put all others into one bin.
    scale = (lambda c: F.signum(c) * F.log1p(F.abs(c))) if real else (lambda c: F.col(c).cast("double"))
    finite = ~F.isnan("_k") & (F.abs("_k") != float("inf")) if real else F.lit(True)
    ends = rows.where(finite).groupBy("_c").agg(F.min("_k").alias("lo"), F.max("_k").alias("hi")).collect()
    of_class = {r["_c"]: (r["lo"], r["hi"]) for r in ends}
    zero = 0.0 if real else 0
    class_of = lambda c: c if by else 0
    open_ = {(c, k): (*of_class.get(class_of(c), (zero, zero)), True, k) for c, ks in wanted.items() for k in sorted(set(ks)) if k > 0}
    found: dict[tuple[object, int], float] = {}
    while open_:
        ranges = list(dict.fromkeys((c, *open_[c, k][:3]) for c, k in open_))
        at = {r: i for i, r in enumerate(ranges)}
        share = F.try_divide(scale("_k") - scale("_lo"), scale("_hi") - scale("_lo"))
        place = F.coalesce(F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int"), F.when(F.col("_k") == F.col("_lo"), 0).otherwise(BINS - 1))
        if real:
            place = F.when(F.isnan("_k"), BINS + 1).when(F.col("_k") == float("inf"), BINS).when(F.col("_k") == float("-inf"), -1).otherwise(place)
        met = inside([(class_of(c), i, lo, hi, every) for (c, lo, hi, every), i in at.items()])
        bins: dict[int, list] = {}
        for r in met.groupBy("_i", place.alias("bin")).agg(F.count("*").alias("n"), F.min("_k").alias("a"), F.max("_k").alias("z")).collect():
            bins.setdefault(r["_i"], []).append((r["bin"], r["n"], r["a"], r["z"]))
        few = []
        for c, k in list(open_):
            lo, hi, every, left = open_.pop((c, k))
            for _, n, a, z in sorted(bins.get(at[c, lo, hi, every], []), key=lambda b: b[0]):
                if left <= n:
                    if _same(a, z):
                        found[c, k] = a
                    elif n <= GATHERED:
                        few.append((c, k, a, z, left))
                    else:
                        open_[c, k] = (a, z, False, left)
                    break
                left -= n
        if few:
            ranges = list(dict.fromkeys((c, a, z) for c, _, a, z, _ in few))
            keys: dict[int, list] = {}
            for r in inside([(class_of(c), i, a, z, False) for i, (c, a, z) in enumerate(ranges)]).select("_i", "_k").collect():
                keys.setdefault(r["_i"], []).append(r["_k"])
            for c, k, a, z, left in few:
                found[c, k] = sorted(keys[ranges.index((c, a, z))])[left - 1]
    return found


def first_in_hash(df: DataFrame, wanted: dict[object, int], seed: int, ids: list[str], by: str | None = None) -> Column:
    """Whether a row is among the first ``wanted[class]`` of its class in md5 order; classes that aren't named have none.

    The same rows as ``hash_rank`` up to that rank, without a rank: the cut of each class is selected by ``kth_keys``, so
    the rows are filtered where they are. Rows of equal ids stand or fall together. ``df`` must be the same when it is read
    again.
    """
    h = md5_key(seed, *ids)
    number = F.conv(F.substring(h, 1, 15), 16, 10).cast("long")  # 60 bits
    cuts = kth_keys(df, number, {c: [n] for c, n in wanted.items()}, by)
    of = (lambda c: F.col(by).eqNullSafe(F.lit(c))) if by else (lambda c: F.lit(True))
    out = F.lit(False)
    tied = []
    for c, n in wanted.items():
        cut = cuts.get((c, n))
        if n > 0:
            out = F.when(of(c), F.lit(True) if cut is None else number <= cut).otherwise(out)
            tied += [] if cut is None else [of(c) & (number == cut)]
    if not tied:
        return out
    # Where hashes of different ids share 60 bits, what lies beyond the rank is taken out again.
    same = df.where(reduce(lambda a, b: a | b, tied)).select(*([by] if by else []), number.alias("_n"), h.alias("_h"), *ids).distinct().limit(GATHERED).collect()
    for c, n in wanted.items():
        rows = sorted((r["_h"], *[r[i] for i in ids]) for r in same if (not by or r[by] == c) and r["_n"] == cuts.get((c, n)))
        if len(rows) > 1:
            before = df.where(of(c) & (number < cuts[c, n])).count()
            late = [r[1:] for r in rows[max(0, n - before) :]]
            for r in late:
                out = out & ~(of(c) & reduce(and_, [F.col(i) == F.lit(v) for i, v in zip(ids, r, strict=True)]))
    return out


def even_rows(n_rows: int, n: int) -> Column:
    """Array of ``n`` row ids spread evenly over ``n_rows``, ends included; never a prefix."""
    if n >= n_rows:
        return F.sequence(F.lit(0), F.lit(n_rows - 1))
    if n == 1:
        return F.array(F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i.cast("long") * (n_rows - 1) / (n - 1)).cast("long"))
