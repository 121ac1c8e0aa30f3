"""Data-quality, leak and shortcut audits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegraph.operators import rank

# Where a 32-bit counter wraps, of milliseconds, and of microseconds in milliseconds and in seconds.
WRAP_32 = 2**32
WRAP_MS = WRAP_32 / 1000
WRAP_SECONDS = WRAP_32 / 1000
MAX_PACKET = 65535


def unpivot(df: DataFrame, columns: list[str], keep: list[str], kind: str = "double") -> DataFrame:
    """Long form (keep..., feature, value)."""
    entries = [F.struct(F.lit(c).alias("feature"), F.col(c).cast(kind).alias("value")) for c in columns]
    return df.select(*keep, F.explode(F.array(*entries)).alias("x")).select(*keep, "x.*")


def finite(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def bias_corrected_skew(value: Column) -> Column:
    n = F.count(value).cast("double")
    return F.when((n > 2) & (F.stddev_pop(value) > 0), F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))


def skew_report(df: DataFrame, features: list[str], q: float = 0.99999) -> DataFrame:
    """Skew raw and after clip, shift and log1p; log is advised if it halves a skew over 2. Constant columns are left out."""
    long = unpivot(df, features, [])
    ends = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("top")).where("lo < top")
    params = rank.percentiles(long, "value", {"hi": q}, "feature").join(ends, "feature")  # one row a feature
    logged = F.log1p(F.least("value", "hi") - F.least(F.lit(0.0), F.col("lo")))
    rows = long.join(F.broadcast(params), "feature").withColumn("logged", logged)
    out = rows.groupBy("feature").agg(bias_corrected_skew(F.col("value")).alias("skew_raw"), bias_corrected_skew(F.col("logged")).alias("skew_log"))
    advise = (F.abs("skew_raw") > 2) & (F.abs("skew_log") < F.abs("skew_raw") / 2)
    return out.withColumn("recommend_log", advise)


def cohens_d(df: DataFrame, features: list[str]) -> DataFrame:
    """Standardised mean difference of attacks and benign rows; undefined pooled deviations are left out."""
    long = unpivot(df, features, ["label"])
    side = lambda f, y, name: f(F.when(F.col("label") == y, F.col("value"))).alias(name)
    g = long.groupBy("feature").agg(side(F.avg, 1, "mean_attack"), side(F.avg, 0, "mean_benign"), side(F.var_samp, 1, "v1"), side(F.var_samp, 0, "v0"), side(F.count, 1, "n1"), side(F.count, 0, "n0"))
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0"), F.col("n1") + F.col("n0") - 2))
    return g.withColumn("p", pooled).where(finite("p") & (F.col("p") > 0)).select("feature", "mean_attack", "mean_benign", ((F.col("mean_attack") - F.col("mean_benign")) / F.col("p")).alias("d"))


def contingency_mi(counts: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Mutual information in nats from counts ``n`` of (by..., x, y)."""
    total, px, py = (F.sum("n").over(Window.partitionBy(*by, *c)) for c in ([], [x], [y]))
    terms = counts.withColumn("t", F.col("n") / total * F.log(F.col("n") * total / (px * py)))
    return terms.groupBy(*by).agg(F.greatest(F.sum("t"), F.lit(0.0)).alias("mi"))


def binned_mi(df: DataFrame, features: list[str], bins: int = 16, n: int | None = None, seed: int = 0) -> DataFrame:
    """Mutual information of each feature, in quantile bins, with the label; of all rows, or of ``n`` rows (row_id) in which
    each class has its share of all."""
    if n is not None:
        c = df.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q")).first()
        attacks = min(c["p"], n * c["p"] // max(1, c["p"] + c["q"]))
        df = df.where(rank.first_in_hash(df, {1: attacks, 0: min(c["q"], n - attacks)}, seed, ["row_id"], "label"))
    long = unpivot(df, features, ["label"])
    at = {f"c{i}": i / bins for i in range(1, bins)}
    cuts = rank.percentiles(long, "value", at, "feature").select("feature", F.array_distinct(F.array(*at)).alias("cuts"))
    binned = long.join(F.broadcast(cuts), "feature").withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col("value"))))
    return contingency_mi(binned.groupBy("feature", "bin", "label").agg(F.count("*").alias("n")), "bin", "label", ["feature"])


def flag_bits_mi(df: DataFrame, flags: str, bits: int = 8) -> DataFrame:
    """Mutual information of a bit mask taken whole, of its bits summed, and the gain of the whole."""
    counts = df.groupBy(F.col(flags).alias("v"), "label").agg(F.count("*").alias("n"))
    whole = contingency_mi(counts.withColumn("k", F.lit(0)), "v", "label", ["k"]).select(F.col("mi").alias("mi_whole"))
    each = counts.select("label", "n", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"), "v").withColumn("on", F.expr("(v >> bit) & 1"))
    parts = contingency_mi(each.groupBy("bit", "on", "label").agg(F.sum("n").alias("n")), "on", "label", ["bit"]).agg(F.sum("mi").alias("mi_bits"))
    return whole.crossJoin(parts).withColumn("gain", F.col("mi_whole") - F.col("mi_bits"))  # two single rows


def redundant_pairs(df: DataFrame, features: list[str], least: float = 0.95) -> DataFrame:
    """Pairs of columns with |r| at least ``least``: all correlations in one pass."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    rows = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("x")).select("x.*")
    return long.where(finite("r") & (F.abs("r") >= least)).orderBy(F.desc(F.abs("r")), "a", "b")


def derived_check(df: DataFrame, total: str, duration: str, rate: str) -> DataFrame:
    """Whether a rate column repeats total / duration."""
    ok = df.where(F.col(duration) > 0)
    return ok.agg(F.corr(F.col(total) / F.col(duration), rate).alias("r"), F.count("*").alias("n_compared"))


def rank_auc(df: DataFrame, features: list[str]) -> DataFrame:
    """Mann-Whitney AUC of each feature alone, ties averaged; non-finite values count as the median of the finite."""
    long = unpivot(df, features, ["label"])
    if long.where(~finite("value")).limit(1).count():
        medians = rank.percentiles(long.where(finite("value")), "value", {"m": 0.5}, "feature")
        long = long.join(F.broadcast(medians), "feature").withColumn("value", F.when(finite("value"), F.col("value")).otherwise(F.col("m")))
    return _auc_of_counts(long.groupBy("feature", "value").agg(F.count("*").alias("n"), F.sum("label").alias("pos")), ["feature"])


def _auc_of_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """AUC by group from (by..., value, n, pos): the mean rank of a value is the rows before it and half its own."""
    upto = rank.running_sums(counts, "value", {"_upto": "n"}, descending=False, by=tuple(by), ranges="feature")
    ranked = upto.withColumn("mid", F.col("_upto") - (F.col("n") - 1) / 2)
    g = ranked.groupBy(*by).agg(F.sum(F.col("mid") * F.col("pos")).alias("s"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    neg = F.col("n") - F.col("p")
    auc = F.when((F.col("p") > 0) & (neg > 0), (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * neg))
    return g.select(*by, auc.alias("auc"), F.greatest(auc, 1 - auc).alias("abs_auc"))


def family_auc(df: DataFrame, features: list[str], families: list[str], top: int = 8, leak: float = 0.95) -> DataFrame:
    """One-against-all AUC of every feature for every family from one shuffle of counts; the ``top`` features each."""
    long = unpivot(df, features, ["family"]).withColumn("value", F.when(F.isnan("value") | F.col("value").isNull(), -1.0).otherwise(F.col("value")))
    counts = long.groupBy("feature", "value").agg(F.count("*").alias("n"), *[F.count_if(F.col("family") == f).alias(f"f{i}") for i, f in enumerate(families)])
    each = counts.select("feature", "value", "n", F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.col(f"f{i}").alias("pos")) for i, f in enumerate(families)])).alias("x")).select("feature", "value", "n", "x.*")
    aucs = _auc_of_counts(each, ["family", "feature"])
    w = Window.partitionBy("family").orderBy(F.desc("abs_auc"), "feature")
    return aucs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).withColumn("is_leak", F.col("abs_auc") >= leak)


def shortcut_coverage(df: DataFrame, features: list[str], benign: str, k: int = 2) -> DataFrame:
    """The ``k`` values commonest among attacks, and the share of each family that carries one of them."""
    long = unpivot(df, features, ["family", "label"])
    w = Window.partitionBy("feature").orderBy(F.desc("n"), "value")
    top = long.where("label = 1").groupBy("feature", "value").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("feature", "value", F.lit(1).alias("hit"))
    marked = long.join(F.broadcast(top), ["feature", "value"], "left")
    return marked.groupBy("feature", "family").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"), F.count("*").alias("n"))


def zero_sparsity(df: DataFrame, columns: list[str]) -> DataFrame:
    long = unpivot(df, columns, ["label"])
    nz = F.col("value") != 0
    return long.groupBy("feature").agg(
        F.avg((~nz).cast("int")).alias("zero_fraction"), F.count_distinct("value").alias("n_distinct"), F.count_distinct(F.when(nz, F.col("value"))).alias("n_distinct_nonzero"), F.avg(F.when(nz, F.col("label"))).alias("attack_rate_nonzero")
    )


def wrap_signatures(df: DataFrame, columns: list[str]) -> DataFrame:
    """Signs of 32-bit overflow in each column; columns without any are left out."""
    v = F.col("value")
    tests = {
        "ge_2_31": v >= 2**31,
        "near_2_32": F.abs(v - WRAP_32) <= 1e6,
        "near_wrap_seconds": F.abs(v - WRAP_SECONDS) <= 30,
        "negative": v < 0,
        "non_finite": ~finite("value"),
    }
    g = unpivot(df, columns, []).groupBy("feature").agg(*[F.count_if(F.coalesce(c, F.lit(False)) if k != "non_finite" else c).alias(k) for k, c in tests.items()])
    return g.where(" + ".join(tests) + " > 0")


def wrapped_duration(total: Column | str, *directions: Column | str) -> Column:
    """A 32-bit microsecond counter has wrapped: a duration in ms that a direction's completes to the wrap, or in the last
    30 s before it. A direction that is NULL says nothing; a NULL duration gives NULL."""
    of = lambda c: F.col(c) if isinstance(c, str) else c
    total, wrap = of(total), F.lit(WRAP_MS)
    out = (total > wrap - 30_000) & (total <= wrap + 1)
    for c in directions:
        out = out | F.coalesce(F.abs(total + of(c) - wrap) <= 2, F.lit(False))
    return out


def _wrapped(c: Callable[[str], Column]) -> Column:
    return F.coalesce(wrapped_duration(c("duration"), c("duration_out"), c("duration_in")), F.lit(False))


def _no_rate(role: str) -> Callable[[Callable[[str], Column]], Column]:
    return lambda c: c(role).isNull() | F.isnan(c(role)) | (F.abs(c(role)) == float("inf")) | (c(role) < 0)


# Physical-consistency rules over role names; each runs only if all the columns it names exist. A role beyond these is
# NULL where its column doesn't exist.
RULES: dict[str, tuple[tuple[str, ...], Callable[[Callable[[str], Column]], Column]]] = {
    "in_bytes_without_packets": (("in_bytes", "in_pkts"), lambda c: (c("in_pkts") == 0) & (c("in_bytes") > 0)),
    "in_bytes_below_20_per_packet": (("in_bytes", "in_pkts"), lambda c: (c("in_pkts") > 0) & (c("in_bytes") < 20 * c("in_pkts"))),
    "out_bytes_without_packets": (("out_bytes", "out_pkts"), lambda c: (c("out_pkts") == 0) & (c("out_bytes") > 0)),
    "out_bytes_below_20_per_packet": (("out_bytes", "out_pkts"), lambda c: (c("out_pkts") > 0) & (c("out_bytes") < 20 * c("out_pkts"))),
    "in_retransmitted_exceeds_total": (("retrans_in_pkts", "in_pkts"), lambda c: c("retrans_in_pkts") > c("in_pkts")),
    "in_retransmitted_bytes_exceed_total": (("retrans_in_bytes", "in_bytes"), lambda c: c("retrans_in_bytes") > c("in_bytes")),
    "out_retransmitted_exceeds_total": (("retrans_out_pkts", "out_pkts"), lambda c: c("retrans_out_pkts") > c("out_pkts")),
    "out_retransmitted_bytes_exceed_total": (("retrans_out_bytes", "out_bytes"), lambda c: c("retrans_out_bytes") > c("out_bytes")),
    "longest_below_shortest": (("longest_pkt", "shortest_pkt"), lambda c: c("longest_pkt") < c("shortest_pkt")),
    "ip_packet_over_65535": (("max_pkt",), lambda c: c("max_pkt") > MAX_PACKET),
    "l4_src_port_out_of_range": (("src_port",), lambda c: (c("src_port") < 0) | (c("src_port") > 65535)),
    "l4_dst_port_out_of_range": (("dst_port",), lambda c: (c("dst_port") < 0) | (c("dst_port") > 65535)),
    "tcp_win_max_in_over_65535": (("tcp_win_max_in",), lambda c: c("tcp_win_max_in") > 65535),
    "tcp_win_max_out_over_65535": (("tcp_win_max_out",), lambda c: c("tcp_win_max_out") > 65535),
    "src_to_dst_second_bytes_non_finite_or_negative": (("rate",), _no_rate("rate")),
    "dst_to_src_second_bytes_non_finite_or_negative": (("back_rate",), _no_rate("back_rate")),
    "src_to_dst_avg_throughput_non_finite_or_negative": (("throughput",), _no_rate("throughput")),
    "dst_to_src_avg_throughput_non_finite_or_negative": (("back_throughput",), _no_rate("back_throughput")),
    "duration_wrapped": (("duration",), _wrapped),
    "duration_in_exceeds_flow": (("duration_in", "duration"), lambda c: (c("duration_in") > c("duration") + 1) & ~_wrapped(c)),
    "duration_out_exceeds_flow": (("duration_out", "duration"), lambda c: (c("duration_out") > c("duration") + 1) & ~_wrapped(c)),
    "size_buckets_not_packet_total": (("bucket_pkts", "in_pkts", "out_pkts"), lambda c: F.abs(c("bucket_pkts") - c("in_pkts") - c("out_pkts")) > F.greatest(F.lit(1.0), 0.01 * (c("in_pkts") + c("out_pkts")))),
}


def failed_rules(columns: list[str], names: dict[str, str] | None = None) -> Column:
    """Names of the rules that a row fails, in the order of ``RULES``; NULL inputs fail none (but a rate must be there)."""
    names = names or {}
    of = lambda role: F.col(names.get(role, role)) if names.get(role, role) in columns else F.lit(None).cast("double")
    found = [F.when(F.coalesce(rule(of), F.lit(False)), F.lit(k)) for k, (need, rule) in RULES.items() if all(names.get(r, r) in columns for r in need)]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def flag_incidence(df: DataFrame, by: str, failed: str = "failed") -> DataFrame:
    """Per rule and group: rows that fail, and their share of the group."""
    sizes = df.groupBy(by).agg(F.count("*").alias("n_group"))
    hits = df.select(by, F.explode(failed).alias("flag")).groupBy("flag", by).agg(F.count("*").alias("n"))
    return hits.join(F.broadcast(sizes), by).select("flag", by, "n", (F.col("n") / F.col("n_group")).alias("share"))


def label_disagreement(df: DataFrame, benign: str) -> DataFrame:
    return df.agg(F.count_if((F.col("label") == 1) != (F.col("family") != benign)).alias("n_disagree"), F.count("*").alias("n"))


def predicate_profile(df: DataFrame, predicate: Column) -> DataFrame:
    """Per family: share of rows for which a predicate holds, and the attack rates on both sides over all rows."""
    marked = df.withColumn("p", predicate.cast("int"))
    rates = marked.agg(F.avg("p").alias("share_all"), F.avg(F.when(F.col("p") == 1, F.col("label"))).alias("attack_rate_true"), F.avg(F.when(F.col("p") == 0, F.col("label"))).alias("attack_rate_false"))
    return marked.groupBy("family").agg(F.avg("p").alias("share")).crossJoin(F.broadcast(rates))  # one row


def bounds_violations(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    row = df.agg(*[F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(c) for c, (lo, hi) in bounds.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in bounds])).alias("x")).select("x.*")


def duplicate_audit(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that repeat an earlier row on ``keys``, and test rows that some train row equals (exactly, NULLs equal)."""
    key = F.struct(*keys)
    repeats = df.groupBy(key.alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("split") == "train").alias("tr"), F.count_if(F.col("split") == "test").alias("te"))
    return repeats.agg(F.sum(F.col("n") - 1).alias("n_duplicates"), F.sum("te").alias("n_test"), F.sum(F.when(F.col("tr") > 0, F.col("te")).otherwise(0)).alias("n_test_in_train"))


def duplicate_of_train(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with whether a val or test row equals a train row on ``keys``."""
    seen = df.where(F.col("split") == "train").select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn("_hit", F.lit(True))
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = c if on is None else on & c
    out = df.join(seen, on, "left").withColumn("duplicate_of_train", F.coalesce(F.col("_hit") & (F.col("split") != "train"), F.lit(False)))
    return out.drop("_hit", *[f"_{k}" for k in keys])


#: Bits of a Bloom filter for each key, hash functions, and the most bits that are sent (16 MB).
KEY_BITS, HASHES, MOST_BITS = 12, 6, 1 << 27


def key_filter(keys: DataFrame) -> tuple[DataFrame, int] | None:
    """A Bloom filter of the rows of ``keys``: one row with an array of 64-bit words, and its size in bits; None if the count
    of rows asks for more than ``MOST_BITS``. Words are merged by a bitwise or, so parts of the keys can come in any order."""
    n = keys.count()
    size = 1 << max(10, (n * KEY_BITS - 1).bit_length() if n else 10)
    if size > MOST_BITS:
        return None
    at = keys.select(F.explode(_places([F.col(c) for c in keys.columns], size)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("word"))
    found = {r["slot"]: r["word"] for r in words.collect()}
    return keys.sparkSession.createDataFrame([([found.get(i, 0) for i in range(size // 64)],)], "words array<bigint>"), size


def _places(columns: list[Column], size: int) -> Column:
    one, two = F.shiftrightunsigned(F.xxhash64(*columns), 2), F.shiftrightunsigned(F.xxhash64(F.lit(1), *columns), 34)
    return F.array(*[F.pmod(one + F.lit(k) * two, F.lit(size)) for k in range(HASHES)])


def filtered_twins(df: DataFrame, keys: list[str]) -> DataFrame:
    """As ``duplicate_of_train``, but only val and test rows that a Bloom filter of the train keys lets pass are shuffled and
    compared; what it rules out is no twin, and what passes is judged exactly, NULL equal to NULL."""
    train = df.where(F.col("split") == "train").select(*keys)
    made = key_filter(train)
    if made is None:
        return duplicate_of_train(df, keys)
    words, size = made
    pass_ = F.col("split") != F.lit("train")
    word = lambda p: F.get(F.col("words"), F.shiftright(p, 6).cast("int"))
    for k in range(HASHES):
        p = _places([F.col(c) for c in keys], size)[k]
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))
        pass_ = pass_ & (word(p).bitwiseAND(bit) != 0)
    words = F.broadcast(words)  # one row of at most 16 MB
    passed, ruled_out = df.join(words, pass_, "left_semi"), df.join(words, pass_, "left_anti")
    seen = train.distinct().select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    judged = passed.join(seen.withColumn("_hit", F.lit(True)), same, "left").withColumn("duplicate_of_train", F.col("_hit").isNotNull()).drop("_hit", *[f"_{k}" for k in keys])
    return judged.unionByName(ruled_out.withColumn("duplicate_of_train", F.lit(False)))


def contradictory_twins(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per family: rows whose keys also occur with another family."""
    mixed = df.groupBy(*keys).agg((F.min("family") != F.max("family")).alias("mixed")).where("mixed").drop("mixed")
    return df.join(mixed, keys, "left_semi").groupBy("family").agg(F.count("*").alias("n_rows"))


def aligned(a: DataFrame, b: DataFrame, columns: list[str], key: str = "row_id") -> DataFrame:
    """Rows in which two tables differ, by column, and rows that only one has."""
    left, right = a.select(key, F.struct(*columns).alias("a")), b.select(key, F.struct(*columns).alias("b"))
    both = left.join(right, key, "full")
    diff = [F.count_if(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) & F.col("a").isNotNull() & F.col("b").isNotNull()).alias(f"diff_{c}") for c in columns]
    return both.agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), *diff)


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table: row count, and xor and sum of row hashes (a pair of equal rows leaves the sum)."""
    h = F.xxhash64(*sorted(df.columns))
    return df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(20,0)")).cast("string").alias("total"))
