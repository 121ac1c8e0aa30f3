"""Windowed directed multigraphs: hosts are nodes, flows are edges, and the flow table is the edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegraph.operators import rank

WIN = "window_id"


def host_features(flows: DataFrame, keys: tuple[str, ...] = (WIN,)) -> DataFrame:
    """Flows with eight features of their source and destination in the same window.

    Distinct counts come from one row per (window, source, peer), (…, port) and (…, protocol), so a scanning source is
    reduced before it is gathered.
    """
    k = list(keys)
    src = flows.groupBy(*k, "src").agg(F.count("*").alias("src_flow_count"), F.sum("in_bytes").alias("src_bytes_total"))
    for col, name in (("dst", "src_fanout"), ("dst_port", "src_distinct_ports"), ("proto", "src_distinct_proto")):
        one = flows.select(*k, "src", col).distinct().groupBy(*k, "src").agg(F.count(col).alias(name))
        src = src.join(one, [*k, "src"])
    src = src.withColumn("src_ports_per_peer", F.col("src_distinct_ports") / F.greatest(F.col("src_fanout"), F.lit(1)))
    dst = flows.groupBy(*k, "dst", "src").agg(F.count("*").alias("n")).groupBy(*k, "dst").agg(F.count("src").alias("dst_fanin"), F.sum("n").alias("dst_flow_count"))
    return flows.join(src, [*k, "src"], "left").join(dst, [*k, "dst"], "left")


def _pairs(flows: DataFrame, keys: list[str]) -> DataFrame:
    return flows.groupBy(*keys, "src", "dst").agg(F.count("*").alias("n"), F.sum("label").alias("attacks"))


def snapshot_stats(flows: DataFrame, keys: tuple[str, ...] = (WIN,)) -> DataFrame:
    """Per window: nodes, edges, pairs, density, fan-out of active senders, flows per node over all nodes, attacks."""
    k = list(keys)
    pairs = _pairs(flows, k)
    ends = F.explode(F.array(F.struct(F.col("src").alias("host"), F.col("n").alias("out"), F.lit(1).alias("peer")), F.struct(F.col("dst").alias("host"), F.lit(0).cast("long").alias("out"), F.lit(0).alias("peer"))))
    hosts = pairs.select(*k, ends.alias("e")).select(*k, "e.*").groupBy(*k, "host").agg(F.sum("out").alias("out"), F.sum("peer").alias("fanout"))
    sender = F.when(F.col("fanout") > 0, F.col("fanout"))
    by_host = hosts.groupBy(*k).agg(
        F.count("*").alias("nodes"), F.count(sender).alias("active_senders"), F.max(sender).alias("max_fanout"), F.avg(sender).alias("mean_fanout"), F.stddev_samp(sender).alias("std_fanout"), F.percentile(sender, F.lit(0.9)).alias("p90_fanout"), F.stddev_samp("out").alias("std_flows_per_node")
    )
    by_pair = pairs.groupBy(*k).agg(F.sum("n").alias("edges"), F.count("*").alias("pairs"), F.sum("attacks").alias("attack_edges"))
    n = F.col("nodes")
    return by_pair.join(by_host, k).withColumn("density", F.round(F.when(n > 1, F.col("pairs") / (n * (n - 1))).otherwise(0.0), 6)).withColumn("attack_rate", F.col("attack_edges") / F.col("edges"))


def integrity(flows: DataFrame, stats: DataFrame) -> DataFrame:
    """Per window whether the graph keeps its flows, hosts and attacks, and ids are dense."""
    plain = flows.groupBy(WIN).agg(F.count("*").alias("n"), F.sum("label").alias("a"), F.count_if(F.col("src").isNull() | F.col("dst").isNull()).alias("missing"))
    hosts = flows.select(WIN, F.explode(F.array("src", "dst")).alias("h")).distinct().groupBy(WIN).agg(F.count("*").alias("h"))
    out = stats.join(plain, WIN).join(hosts, WIN)
    return out.select(WIN, (F.col("edges") == F.col("n")).alias("edges_kept"), (F.col("nodes") == F.col("h")).alias("hosts_kept"), (F.col("attack_edges") == F.col("a")).alias("attacks_kept"), (F.col("missing") == 0).alias("ends_present"))


def node_dictionary(flows: DataFrame) -> DataFrame:
    """Global dense node ids in host order: ranks of distinct hosts, without one global window."""
    hosts = flows.select(F.col("src").alias("host")).union(flows.select("dst")).distinct()
    ids = rank.running_sums(hosts.withColumn("one", F.lit(1)), "host", {"node_id": "one"}, descending=False)
    return ids.select("host", (F.col("node_id") - 1).cast("long").alias("node_id"))


def local_ids(flows: DataFrame) -> DataFrame:
    """Node ids from 0 within each window, in host order."""
    hosts = flows.select(WIN, F.explode(F.array("src", "dst")).alias("host")).distinct()
    return hosts.withColumn("local_id", (F.row_number().over(Window.partitionBy(WIN).orderBy("host")) - 1).cast("long"))


def consecutive_jaccard(edges: DataFrame) -> DataFrame:
    """Jaccard of each window's set of (src, dst) with that of the window before; NULL if it is not there."""
    e = edges.select(WIN, "src", "dst").distinct()
    size = e.groupBy(WIN).agg(F.count("*").alias("n"))
    both = e.join(e.select((F.col(WIN) + 1).alias(WIN), "src", "dst"), [WIN, "src", "dst"]).groupBy(WIN).agg(F.count("*").alias("n_both"))
    prev = size.select((F.col(WIN) + 1).alias(WIN), F.col("n").alias("m"))
    nb = F.coalesce("n_both", F.lit(0))
    return size.join(prev, WIN, "left").join(both, WIN, "left").select(WIN, F.when(F.col("m").isNotNull(), nb / (F.col("n") + F.col("m") - nb)).alias("jaccard"))


def topology(flows: DataFrame, scheme: str = "ip") -> DataFrame:
    """Diagnostics per window with hosts as nodes, or (``service``) destinations as host:port."""
    if scheme == "service":
        flows = flows.withColumn("dst", F.concat_ws(":", "dst", "dst_port")).withColumn("src", F.col("src").cast("string"))
    pairs = _pairs(flows, [WIN])
    nodes = pairs.select(WIN, F.explode(F.array("src", "dst")).alias("h")).distinct().groupBy(WIN).agg(F.count("*").alias("nodes"))
    degree = pairs.groupBy(WIN, "src").agg(F.count("*").alias("d")).groupBy(WIN).agg(F.max("d").alias("max_out_degree"), F.when(F.avg("d") != 0, F.stddev_pop("d") / F.avg("d")).alias("out_degree_cv"))
    base = pairs.groupBy(WIN).agg(F.sum("n").alias("edges"), F.count("*").alias("pairs"), (F.sum("attacks") > 0).alias("has_attack"))
    out = base.join(nodes, WIN).join(degree, WIN).join(consecutive_jaccard(pairs), WIN)
    return out.withColumn("density", F.when(F.col("nodes") > 1, F.col("pairs") / (F.col("nodes") * (F.col("nodes") - 1))))


def separation(windows: DataFrame) -> DataFrame:
    """Mean of the largest out-degree and of edges in windows with and without attacks."""
    return windows.groupBy("has_attack").agg(F.count("*").alias("n_windows"), F.avg("max_out_degree").alias("mean_max_out_degree"), F.avg("edges").alias("mean_edges"))


def scheme_sizes(flows: DataFrame) -> DataFrame:
    ip = flows.select(F.explode(F.array("src", "dst")).alias("h")).distinct().agg(F.count("*").alias("nodes_ip"))
    service = flows.select(F.explode(F.array(F.col("src").cast("string"), F.concat_ws(":", "dst", "dst_port"))).alias("h")).distinct().agg(F.count("*").alias("nodes_service"))
    return ip.crossJoin(service).withColumn("factor", F.col("nodes_service") / F.col("nodes_ip"))  # two single rows


def host_context(flows: DataFrame, host: str = "src", peer: str = "dst") -> DataFrame:
    """Per window and host: flows, peers, ports, bytes, and fan-out against the median of the window's hosts."""
    k = [WIN, host]
    base = flows.groupBy(*k).agg(F.count("*").alias("flow_count"), F.sum("in_bytes").alias("total_bytes"))
    peers = flows.select(*k, peer).distinct().groupBy(*k).agg(F.count("*").alias("distinct_peers"))
    ports = flows.select(*k, "dst_port").distinct().groupBy(*k).agg(F.count("*").alias("distinct_ports"))
    median = peers.groupBy(WIN).agg(F.percentile("distinct_peers", F.lit(0.5)).alias("median_fanout"))
    out = base.join(peers, k).join(ports, k).join(median, WIN)
    return out.withColumn("times_typical", F.when(F.col("median_fanout") > 0, F.col("distinct_peers") / F.col("median_fanout"))).withColumnRenamed(host, "host")


def touching(flows: DataFrame, targets: DataFrame) -> DataFrame:
    """(detection, flow) of one window that share a host: an equi-join on unpivoted ends, then distinct; never an OR.

    ``targets`` has row_id, window_id, src and dst of the detections. The detection itself is left out.
    """
    end = lambda df: df.select(WIN, "row_id", F.explode(F.array_distinct(F.array("src", "dst"))).alias("h"))
    hits = end(targets).withColumnRenamed("row_id", "detection").join(end(flows), [WIN, "h"])
    return hits.where("detection <> row_id").select("detection", WIN, "row_id").distinct()


def _volumes(flows: DataFrame, targets: DataFrame) -> DataFrame:
    """(window, host, peer, n) of the hosts that ``targets`` have: flows between a host and each peer, in either direction.

    Pairs are counted before they are laid to both ends, so a hub's flows are reduced first.
    """
    pairs = flows.groupBy(WIN, "src", "dst").agg(F.count("*").alias("n"))
    ends = F.array(F.struct(F.col("src").alias("host"), F.col("dst").alias("peer")), F.struct(F.col("dst").alias("host"), F.col("src").alias("peer")))
    sides = pairs.select(WIN, "n", F.explode(F.array_distinct(ends)).alias("e")).groupBy(WIN, "e.host", "e.peer").agg(F.sum("n").alias("n"))
    return sides.join(_hosts_of(targets), [WIN, "host"], "left_semi")


def _hosts_of(targets: DataFrame) -> DataFrame:
    return targets.select(WIN, F.explode(F.array("src", "dst")).alias("host")).distinct()


def ego_graph(flows: DataFrame, targets: DataFrame, max_hosts: int = 28) -> DataFrame:
    """Busiest neighbours of each detection: flows with its two hosts, which side they are on, and how many were left out.

    No table holds all pairs of a detection and a neighbour. A neighbour of one host only that is among the busiest of the
    detection is among the busiest of that host; neighbours of both hosts are found by a join on the peer, from the host with
    fewer peers (AQE splits what is left of a hub).
    """
    volumes = _volumes(flows, targets)
    w = Window.partitionBy(WIN, "host")
    # Two more than are shown: the other host of the detection and the host itself don't count.
    top = volumes.withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "peer"))).where(F.col("r") <= max_hosts + 2).drop("r")
    peers = volumes.groupBy(WIN, "host").agg(F.count("*").alias("peers"), F.count_if(F.col("host") == F.col("peer")).alias("loop"))
    ends = targets.select(F.col("row_id").alias("detection"), WIN, F.col("src").alias("s"), F.col("dst").alias("d"))
    sides = ends.select("detection", WIN, "s", "d", F.explode(F.array_distinct(F.array("s", "d"))).alias("host"))
    listed = sides.join(top, [WIN, "host"]).where("peer <> s AND peer <> d").select("detection", WIN, "s", "d", "peer")
    pairs = ends.where("s <> d").select(WIN, "s", "d").distinct()
    of = lambda end: volumes.select(WIN, F.col("host").alias(end), "peer", F.col("n").alias(f"n_{end}"))
    both = pairs.join(of("s"), [WIN, "s"]).join(of("d"), [WIN, "d", "peer"]).where("peer <> s AND peer <> d").select(WIN, "s", "d", "peer")
    shared = both.groupBy(WIN, "s", "d").agg(F.count("*").alias("n_shared"))
    known = listed.union(ends.join(both, [WIN, "s", "d"]).select("detection", WIN, "s", "d", "peer")).distinct()
    own = known.join(of("s"), [WIN, "s", "peer"], "left").join(of("d"), [WIN, "d", "peer"], "left")
    on_s, on_d = F.col("n_s").isNotNull(), F.col("n_d").isNotNull()
    total = F.coalesce("n_s", F.lit(0)) + F.when(F.col("s") != F.col("d"), F.coalesce("n_d", F.lit(0))).otherwise(0)
    side = F.when(on_s & on_d, "both").when(on_s, "source").otherwise("destination")
    ranked = own.select("detection", F.col("peer").alias("host"), total.alias("flows"), side.alias("side")).withColumn("rank", F.row_number().over(Window.partitionBy("detection").orderBy(F.desc("flows"), "host"))).where(F.col("rank") <= max_hosts)
    # Peers of both hosts together, without these two: both are each other's peers, and a host may be its own.
    n = lambda end: peers.select(WIN, F.col("host").alias(end), F.col("peers").alias(f"p_{end}"), F.col("loop").alias(f"l_{end}"))
    sizes = ends.join(n("s"), [WIN, "s"]).join(n("d"), [WIN, "d"]).join(shared, [WIN, "s", "d"], "left")
    apart = F.col("p_s") - F.col("l_s") - 1 + F.col("p_d") - F.col("l_d") - 1 - F.coalesce("n_shared", F.lit(0))
    sizes = sizes.select("detection", F.when(F.col("s") == F.col("d"), F.col("p_s") - F.col("l_s")).otherwise(apart).alias("n_hosts"))
    return ranked.join(sizes, "detection").select("detection", "host", "flows", "side", "rank", F.greatest(F.col("n_hosts") - max_hosts, F.lit(0)).alias("n_omitted"))


def pair_counts(flows: DataFrame, targets: DataFrame) -> DataFrame:
    """Touching flows of each detection pooled by directed host pair; pairs are counted before they meet the detections."""
    pairs = flows.groupBy(WIN, "src", "dst").agg(F.count("*").alias("n"))
    hosts = pairs.select(WIN, F.col("src").alias("a"), F.col("dst").alias("b"), "n", F.explode(F.array_distinct(F.array("src", "dst"))).alias("host"))
    ends = targets.select(F.col("row_id").alias("detection"), WIN, "src", "dst", F.explode(F.array_distinct(F.array("src", "dst"))).alias("host"))
    met = ends.join(hosts, [WIN, "host"])
    # A pair of both hosts is met from either; the source's side counts, without the detection itself.
    met = met.where((F.col("host") == F.col("src")) | ((F.col("a") != F.col("src")) & (F.col("b") != F.col("src"))))
    own = ((F.col("a") == F.col("src")) & (F.col("b") == F.col("dst"))).cast("int")
    return met.select("detection", F.col("a").alias("src"), F.col("b").alias("dst"), (F.col("n") - own).alias("flows")).where("flows > 0")


#: Steps of the draws: primes beyond any number of neighbours, so that the places of one detection are all different.
STEPS = (8589934609, 8589934621, 8589934627, 8589934631)


def neighbour_candidates(flows: DataFrame, targets: DataFrame, most: int = 50, seed: int = 0) -> DataFrame:
    """Up to ``most`` touching flows of each detection, drawn at random with a seed of its own, with how many there are.

    A host's flows are numbered by (peer, row_id), so the flows that both hosts share are one block of either. Touching flows
    then are places: those of the source without the detection, then those of the destination without that block. Places are
    drawn (start and step from a hash of seed and detection, modulo their number: every place is as likely) and joined with
    the numbers, so only drawn flows meet a detection, however many a hub has.
    """
    ends = F.array(F.struct(F.col("src").alias("host"), F.col("dst").alias("peer")), F.struct(F.col("dst").alias("host"), F.col("src").alias("peer")))
    near = flows.join(_hosts_of(targets).select(WIN).distinct(), WIN, "left_semi")
    sides = near.select(WIN, "row_id", F.explode(F.array_distinct(ends)).alias("e")).select(WIN, "row_id", "e.host", "e.peer").join(_hosts_of(targets), [WIN, "host"], "left_semi")
    volumes = sides.groupBy(WIN, "host", "peer").agg(F.count("*").alias("n"))
    before = Window.partitionBy(WIN, "host").orderBy("peer").rowsBetween(Window.unboundedPreceding, -1)
    blocks = volumes.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0)))
    numbered = rank.order_rank(sides, "row_id", [WIN, "host", "peer"], "k").join(blocks.select(WIN, "host", "peer", "begin"), [WIN, "host", "peer"]).select(WIN, "host", "row_id", (F.col("begin") + F.col("k") - 1).alias("number"))
    degree = volumes.groupBy(WIN, "host").agg(F.sum("n").alias("degree"))
    own = targets.select(F.col("row_id").alias("detection"), WIN, F.col("src").alias("s"), F.col("dst").alias("d"))
    own = own.join(numbered.select(WIN, F.col("host").alias("s"), F.col("row_id").alias("detection"), F.col("number").alias("self")), [WIN, "s", "detection"])
    for end in ("s", "d"):
        own = own.join(degree.select(WIN, F.col("host").alias(end), F.col("degree").alias(f"n_{end}")), [WIN, end])
    own = own.join(blocks.select(WIN, F.col("host").alias("d"), F.col("peer").alias("s"), F.col("begin"), F.col("n").alias("block")), [WIN, "d", "s"])
    total = F.col("n_s") - 1 + F.when(F.col("s") == F.col("d"), 0).otherwise(F.col("n_d") - F.col("block"))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("detection").cast("string")))
    digits = lambda a, n: F.conv(F.substring(h, a, n), 16, 10).cast("long")
    step = F.get(F.array(*[F.lit(x) for x in STEPS]), (digits(16, 4) % len(STEPS)).cast("int"))
    drawn = own.withColumns({"n_neighbours": total, "start": digits(1, 12), "step": step}).where("n_neighbours > 0")
    drawn = drawn.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("n_neighbours"), F.lit(most)) - 1)))
    place = F.expr("(start + j * step) % n_neighbours")
    drawn = drawn.withColumn("place", place).withColumn("at_s", F.col("place") < F.col("n_s") - 1).withColumn("past", F.col("place") - F.col("n_s") + 1)
    number = F.when(F.col("at_s"), F.col("place") + (F.col("place") >= F.col("self")).cast("int")).otherwise(F.col("past") + F.when(F.col("past") >= F.col("begin"), F.col("block")).otherwise(0))
    drawn = drawn.select("detection", WIN, F.when(F.col("at_s"), F.col("s")).otherwise(F.col("d")).alias("host"), number.alias("number"), (F.col("j") + 1).cast("int").alias("rank"), "n_neighbours")
    return drawn.join(numbered, [WIN, "host", "number"]).select("detection", WIN, "row_id", "rank", "n_neighbours")


def ranked_neighbours(flows: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """Every touching flow of each detection with its rank in md5 order of 'seed:detection:flow' and how many there are.

    A prefix of the ranks is a sample without bias; ``neighbour_candidates`` draws one without making all pairs.
    """
    rows = touching(flows, targets).withColumn("_h", rank.md5_key(seed, "detection", "row_id"))
    w = Window.partitionBy("detection")
    return rows.withColumn("rank", F.row_number().over(w.orderBy("_h", "row_id"))).withColumn("n_neighbours", F.count("*").over(w)).drop("_h")


def neighbour_influence(flows: DataFrame, targets: DataFrame, feature: str, weight: float = 1.0, most: int = 50, seed: int = 0) -> DataFrame:
    """Candidate neighbours of each detection with what removing one of them does to the detection's score, exactly.

    The score is ``weight`` times the mean of ``feature`` at the detection's two hosts, where a host's mean is over the ends
    of its flows in the window. A removed flow changes sums and counts only, so one aggregate over (window, host) is enough.
    """
    ends = flows.select(WIN, F.explode(F.array("src", "dst")).alias("host"), F.col(feature).cast("double").alias("x"))
    hosts = ends.groupBy(WIN, "host").agg(F.sum("x").alias("total"), F.count("x").alias("n"))
    own = targets.select(WIN, F.col("row_id").alias("detection"), F.col("src").alias("s"), F.col("dst").alias("d"))
    for end in ("s", "d"):
        own = own.join(hosts.select(WIN, F.col("host").alias(end), F.col("total").alias(f"{end}_total"), F.col("n").alias(f"{end}_n")), [WIN, end])
    rows = neighbour_candidates(flows, targets, most, seed).join(flows.select("row_id", "src", "dst", F.col(feature).cast("double").alias("x")), "row_id")
    rows = rows.join(own.drop(WIN), "detection")

    def mean(end: str, without: bool) -> Column:
        if not without:
            return F.col(f"{end}_total") / F.col(f"{end}_n")
        times = ((F.col("src") == F.col(end)).cast("int") + (F.col("dst") == F.col(end)).cast("int")) * F.when(F.col("x").isNotNull(), 1).otherwise(0)
        left = F.col(f"{end}_n") - times
        return F.when(left > 0, (F.col(f"{end}_total") - times * F.coalesce("x", F.lit(0.0))) / left)

    score = lambda without: F.lit(weight / 2) * (mean("s", without) + mean("d", without))
    rows = rows.withColumn("score", score(False)).withColumn("score_without", score(True))
    return rows.select("detection", "row_id", "src", "dst", "rank", "n_neighbours", "score", "score_without", (F.col("score") - F.col("score_without")).alias("importance"))


def neighbourhood_means(flows: DataFrame, features: list[str], rounds: int = 1) -> DataFrame:
    """Unlearned propagation: hosts take the mean of their edges' features in both directions; edges then get both ends.

    Each round is one aggregate over (window, host) and two joins; a later round averages what the one before gave edges.
    """
    out = flows
    cols = features
    for r in range(1, rounds + 1):
        ends = out.select(WIN, F.explode(F.array("src", "dst")).alias("host"), *cols)
        means = ends.groupBy(WIN, "host").agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)])
        for end in ("src", "dst"):
            own = means.select(WIN, F.col("host").alias(end), *[F.col(f"m{i}").alias(f"{end}_{f}_{r}") for i, f in enumerate(features)])
            out = out.join(own, [WIN, end])
        mixed = [f"_mix_{f}_{r}" for f in features]
        for f, m in zip(features, mixed, strict=True):
            out = out.withColumn(m, (F.col(f"src_{f}_{r}") + F.col(f"dst_{f}_{r}")) / 2)
        cols = mixed
    return out.drop(*[c for c in out.columns if c.startswith("_mix_")])


def window_sweep(flows: DataFrame, sizes: list[int], most: int = 200) -> DataFrame:
    """Structure by window size over evenly spread whole windows of a split whose rows count from 0."""
    n = flows.count()
    parts = []
    for size in sizes:
        whole = n // size
        keep = rank.even_rows(whole, min(most, whole)) if whole else F.array().cast("array<bigint>")
        parts.append(F.struct(F.lit(size).alias("size"), keep.alias("keep")))
    # One row for each size and chosen window.
    chosen = flows.sparkSession.range(1).select(F.explode(F.array(*parts)).alias("p")).select("p.size", F.explode("p.keep").alias(WIN))
    each = flows.select(F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size"), "*").withColumn(WIN, F.expr("row_id div size"))
    rows = each.join(F.broadcast(chosen), ["size", WIN], "left_semi")
    stats = snapshot_stats(rows, ("size", WIN))
    return stats.groupBy("size").agg(F.count("*").alias("n_windows"), F.avg("nodes").alias("mean_nodes"), F.avg("pairs").alias("mean_pairs"), F.avg("max_fanout").alias("mean_max_fanout"), F.avg((F.col("attack_edges") > 0).cast("int")).alias("share_with_attack"))

