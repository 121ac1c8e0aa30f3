"""Evidence for flagged rows: who is sampled, what a pack holds, whether it may be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions import facts
from tidegraph.operators import graph, rank

# What a reader is told of a check that a flow fails, and of times that are withheld.
NOTES = {
    "size_buckets_not_packet_total": "The counts of packets by size do not add up to the flow's packet total, so the size breakdown for this flow is unreliable.",
    "in_bytes_below_20_per_packet": "The bytes recorded from source to destination are fewer than an IP header needs for that many packets, so that byte count is unreliable.",
    "out_bytes_below_20_per_packet": "The bytes recorded from destination to source are fewer than an IP header needs for that many packets, so that byte count is unreliable.",
    "in_bytes_without_packets": "Bytes were recorded from source to destination with no packets, so that direction's counts are unreliable.",
    "out_bytes_without_packets": "Bytes were recorded from destination to source with no packets, so that direction's counts are unreliable.",
    "longest_below_shortest": "The recorded longest packet is shorter than the shortest, so the packet-size figures are unreliable.",
}
TIMING_NOTE = "How long the flow lasted, and its transfer rates, are not known: in this dataset the recorded duration is either zero or a counter overflow, so it is not a measurement, and the detector does not use it."
BANNED = ("neural network", "gnn", "graph neural", "embedding", "logit", "softmax", "training data")
VERSION = "2.0"


def _plan(candidates: DataFrame, n: int, fp_share: float, benign: str) -> list[tuple]:
    rows = candidates.groupBy("family").agg(F.count("*").alias("available")).orderBy("family").collect()
    n_fp = round(n * fp_share)
    attacks = [r["family"] for r in rows if r["family"] != benign]
    each, extra = divmod(n - n_fp, max(1, len(attacks)))
    plan = []
    for r in rows:
        quota = n_fp if r["family"] == benign else each + (1 if attacks.index(r["family"]) < extra else 0)
        plan.append((r["family"], r["available"], quota, min(quota, r["available"]), max(0, quota - r["available"])))
    return plan


def sample_plan(candidates: DataFrame, n: int, fp_share: float, benign: str) -> DataFrame:
    """Quota of each family: false positives get their share, the rest is even; with what is available and missing.

    One row a family.
    """
    return candidates.sparkSession.createDataFrame(_plan(candidates, n, fp_share, benign), "family string, available long, quota long, taken long, shortfall long")


def stratified_sample(candidates: DataFrame, n: int, fp_share: float, benign: str, seed: int = 0) -> DataFrame:
    """``n`` detections: quotas per family in md5 order, then what quotas leave open from all others in md5 order.

    Both are cuts of the hash order, so candidates are filtered where they are and never ranked.
    """
    plan = _plan(candidates, n, fp_share, benign)
    first = rank.first_in_hash(candidates, {family: quota for family, _, quota, _, _ in plan}, seed, ["row_id"], "family")
    out = candidates.where(first).withColumn("taken_by", F.lit("quota"))
    left = n - sum(taken for *_, taken, _ in plan)
    if left > 0:
        rest = candidates.where(~first)
        out = out.union(rest.where(rank.first_in_hash(rest, {None: left}, seed, ["row_id"])).withColumn("taken_by", F.lit("spare")))
    return out


def quality_notes(failed: Column, withheld: tuple[str, ...] = ()) -> Column:
    """What is not known of a flow: columns withheld, checks failed in name order, and a sentence for times (if columns of
    durations are withheld) and for each check that has one."""
    said = F.create_map(*[F.lit(x) for pair in NOTES.items() for x in pair])
    timing = [F.lit(TIMING_NOTE)] if any(c.startswith(("FLOW_DURATION", "DURATION_")) for c in withheld) else []
    own = F.array_sort(failed)
    notes = F.concat(F.array(*timing).cast("array<string>"), F.array_compact(F.transform(own, lambda x: F.try_element_at(said, x))))
    return F.struct(F.array(*[F.lit(c) for c in withheld]).cast("array<string>").alias("withheld_columns"), own.alias("failed_checks"), notes.alias("notes"))


def packs(detections: DataFrame, guidance: DataFrame, benign: str, withheld: tuple[str, ...] = ()) -> DataFrame:
    """One nested pack per detection: flow, detection, attribution, data quality and guidance of the predicted family.

    ``detections`` has row_id, src, dst, family, score, threshold, distribution, contributions and failed, and may have
    ``weight`` (the share of the topological channel), ``measures`` (a map of measured columns), ``context`` (of ``with_context``) and ``neighbours`` (of
    ``neighbour_notes``); ``guidance`` (attack_family, description) is a dimension table and falls back to the benign row.
    """
    more = lambda name: [F.col(name)] if name in detections.columns else []
    own = detections.withColumn("predicted", facts.predicted(F.col("distribution")))
    fallback = guidance.where(F.col("attack_family") == benign).select(F.first("description").alias("_default"))
    joined = own.join(guidance.select(F.col("attack_family").alias("predicted"), "description"), "predicted", "left").crossJoin(F.broadcast(fallback))  # one row
    top = facts.top_features(F.col("contributions"))
    return joined.select(
        F.concat(F.lit("det-"), F.col("row_id").cast("string")).alias("detection_id"),
        F.lit(VERSION).alias("schema_version"),
        F.struct("src", "dst", F.col("family").alias("true_label"), *more("measures")).alias("flow"),
        F.struct("score", "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"), F.col("predicted").alias("predicted_class"), F.try_element_at("distribution", "predicted").alias("class_confidence"), F.col("distribution").alias("class_distribution")).alias("detection"),
        F.struct(top.alias("top_features"), *more("neighbours"), *more("weight")).alias("attribution"),
        *more("context"),
        quality_notes(F.col("failed"), withheld).alias("data_quality"),
        F.struct(F.coalesce("predicted", F.lit(benign)).alias("attack_family"), F.coalesce("description", "_default").alias("description")).alias("guidance"),
        F.lit(None).cast("string").alias("causal_path"),
    )


def validity(pack_table: DataFrame) -> DataFrame:
    """Per pack: version right, distribution there and summing to one, no banned vocabulary; and all of it."""
    d = F.col("detection.class_distribution")
    total = F.aggregate(F.map_values(d), F.lit(0.0), lambda a, x: a + x)
    blob = F.lower(F.to_json(F.struct(*pack_table.columns)))
    banned = F.exists(F.array(*[F.lit(w) for w in BANNED]), lambda w: F.contains(blob, w))
    out = pack_table.select("detection_id", (F.col("schema_version") == VERSION).alias("version_ok"), (F.coalesce(F.size(d), F.lit(0)) > 0).alias("has_distribution"), F.coalesce((total >= 0.98) & (total <= 1.02), F.lit(False)).alias("sums_to_one"), (~banned).alias("vocabulary_ok"))
    return out.withColumn("valid", F.col("version_ok") & F.col("has_distribution") & F.col("sums_to_one") & F.col("vocabulary_ok"))


def with_context(detections: DataFrame, flows: DataFrame) -> DataFrame:
    """``detections`` (window_id, src, dst, ...) with ``context``: what both hosts did in the window, and its size.

    The source's side counts flows that it started, the destination's those that it received.
    """
    out = detections
    for end, peer in (("src", "dst"), ("dst", "src")):
        own = graph.host_context(flows, end, peer)
        host = F.struct(*[F.col(c) for c in ("flow_count", "distinct_peers", "distinct_ports", "times_typical")]).alias(f"_{end}")
        out = out.join(own.select(graph.WIN, F.col("host").alias(end), host), [graph.WIN, end], "left")
    sizes = graph.snapshot_stats(flows).select(graph.WIN, F.col("edges").alias("_flows"), F.col("nodes").alias("_hosts"))
    context = F.struct(F.col("_src").alias("src_host"), F.col("_dst").alias("dst_host"), F.col("_flows").alias("window_flow_count"), F.col("_hosts").alias("window_host_count"))
    return out.join(sizes, graph.WIN, "left").withColumn("context", context).drop("_src", "_dst", "_flows", "_hosts")


def neighbour_notes(detections: DataFrame, influence: DataFrame, least: float, shown: int = 3) -> DataFrame:
    """Per detection: flows that share a host, how many were tested, the largest influence, those of at least ``least``
    (up to ``shown``, strongest first), and a note with its denominators where there are none."""
    strong = F.array_sort(F.collect_list(F.when(F.abs("importance") >= least, F.struct((-F.abs("importance")).alias("_m"), "row_id", "src", "dst", "importance", "score_without"))))
    g = influence.groupBy("detection").agg(F.max("n_neighbours").alias("n_touching"), F.count("*").alias("n_tested"), F.max(F.abs("importance")).alias("max_influence"), F.count_if(F.abs("importance") >= least).alias("n_influential"), strong.alias("_s"))
    out = detections.select(F.col("row_id").alias("detection")).join(g, "detection", "left").fillna(0, ["n_touching", "n_tested", "n_influential"])
    listed = F.transform(F.slice(F.coalesce("_s", F.array().cast(g.schema["_s"].dataType)), 1, shown), lambda x: x.dropFields("_m"))
    among = F.when(F.col("n_tested") < F.col("n_touching"), F.concat(F.lit("Of "), facts.num(F.col("n_touching")), F.lit(" flows with a host of this one, "), facts.num(F.col("n_tested")), F.lit(" were tested"))).otherwise(F.concat(F.lit("All "), facts.num(F.col("n_tested")), F.lit(" flows with a host of this one were tested")))
    note = F.when(F.col("n_tested") == 0, "No other flow of this period has a host of this one.").when(F.col("n_influential") == 0, F.concat(among, F.lit(f": without any one of them the score moves by less than {least:g}.")))
    return out.select("detection", "n_touching", "n_tested", "n_influential", "max_influence", listed.alias("influential"), note.alias("note"))


def _has(p: DataFrame, parent: str, name: str) -> bool:
    return parent in p.columns and name in p.schema[parent].dataType.names


def _traffic(m: Column, what: str, size: str, packets: str) -> Column:
    b, n = F.try_element_at(m, F.lit(size)), F.try_element_at(m, F.lit(packets))
    mean = F.when(n > 0, F.concat(F.lit(", "), facts.num(F.round(b / n)), F.lit(" bytes a packet on average"))).otherwise("")
    line = F.concat(F.lit(f"{what}: "), facts.num(b), F.lit(" bytes"), F.when(n.isNotNull(), F.concat(F.lit(" in "), facts.num(n), F.lit(" "), facts.plural(n, "packet"), F.coalesce(mean, F.lit("")))).otherwise(""), F.lit("."))
    return F.when(b.isNotNull(), line)


def measure_lines(m: Column) -> list[Column]:
    """Sentences on the measured columns of a flow, each NULL where its columns are missing."""
    at = lambda name: F.try_element_at(m, F.lit(name))
    said = lambda label, name, decode: F.when(at(name).isNotNull(), F.concat(F.lit(f"{label}: "), decode(at(name)), F.lit(".")))
    flags = [F.when(at("PROTOCOL") == 6, said(f"TCP flags of the {who}", name, facts.tcp_flags)) for who, name in (("source", "CLIENT_TCP_FLAGS"), ("destination", "SERVER_TCP_FLAGS"))]
    ends = at("SHORTEST_FLOW_PKT"), at("LONGEST_FLOW_PKT")
    sizes = F.when(ends[0] == ends[1], F.concat(F.lit("All packets had "), facts.num(ends[0]), F.lit(" bytes."))).when(ends[0].isNotNull() & ends[1].isNotNull(), F.concat(F.lit("Packets had "), facts.num(ends[0]), F.lit(" to "), facts.num(ends[1]), F.lit(" bytes.")))
    codes = [F.when(at(name) != 0, said(label, name, decode)) for label, name, decode in (("ICMP", "ICMP_TYPE", facts.icmp), ("DNS query", "DNS_QUERY_TYPE", facts.dns_type), ("FTP reply", "FTP_COMMAND_RET_CODE", facts.ftp_code))]
    return [
        said("Protocol", "PROTOCOL", facts.protocol), said("Application", "L7_PROTO", facts.app_protocol), said("Source port", "L4_SRC_PORT", facts.port), said("Destination port", "L4_DST_PORT", facts.port),
        _traffic(m, "To the destination", "IN_BYTES", "IN_PKTS"), _traffic(m, "Back to the source", "OUT_BYTES", "OUT_PKTS"), *flags, sizes, *codes,
    ]


def context_lines(c: Column) -> list[Column]:
    """Sentences on both hosts and the window, each NULL where it is not known."""

    def host(h: Column, did: str, peers: str, times: str) -> Column:
        line = F.concat(F.lit(did), facts.num(h["flow_count"]), F.lit(" "), facts.plural(h["flow_count"], "flow"), F.lit(peers), facts.num(h["distinct_peers"]), F.lit(" "), facts.plural(h["distinct_peers"], "host"), F.lit(" on "), facts.num(h["distinct_ports"]), F.lit(" "), facts.plural(h["distinct_ports"], "port"))
        return F.when(h.isNotNull(), F.concat(line, F.coalesce(F.concat(F.lit(": "), facts.times_phrase(F.round(h["times_typical"], 2), times)), F.lit("")), F.lit(".")))

    size = F.concat(F.lit("The period has "), facts.num(c["window_flow_count"]), F.lit(" flows among "), facts.num(c["window_host_count"]), F.lit(" hosts."))
    return [host(c["src_host"], "The source started ", " to ", "hosts"), host(c["dst_host"], "The destination received ", " from ", "sources"), F.when(c["window_flow_count"] > 0, size)]


def neighbour_lines(n: Column, most: int = 3) -> list[Column]:
    """Sentences on influential neighbours, or the note where there are none."""

    def one(i: int) -> Column:
        x = F.get(n["influential"], F.lit(i))
        return F.when(x.isNotNull(), F.concat(F.lit("A related flow, "), x["src"].cast("string"), F.lit(" to "), x["dst"].cast("string"), F.lit(", matters: without it the score is "), facts.num(F.round(x["score_without"], 3)), F.lit(".")))

    return [*[one(i) for i in range(most)], n["note"]]


def _parts(p: DataFrame) -> list[tuple[str, list[Column]]]:
    """Titles and sentences of a pack table's six sections; parts that the table doesn't have are left out."""
    d, flow, g = F.col("detection"), F.col("flow"), F.col("guidance")
    m = facts.margin(d["score"], d["threshold"])
    c = facts.confidence(d["class_confidence"], d["class_distribution"])
    others = F.array_join(F.transform(c["alternatives"], lambda a: a["family"]), ", ")
    uncertain = facts.borderline(d["score"], d["threshold"], d["class_confidence"], d["class_distribution"])
    reason_lines = facts.reasons(F.col("attribution.top_features"))
    return [
        ("Detection", [
            F.concat(F.lit("Flow from "), flow["src"].cast("string"), F.lit(" to "), flow["dst"].cast("string"), F.lit(".")),
            F.concat(F.lit("Predicted category: "), d["predicted_class"], F.lit(", with "), c["band"], F.lit(" confidence.")),
            F.concat(F.lit("The score cleared the threshold by a "), m["band"], F.lit(" margin.")),
            F.when(F.size(c["alternatives"]) > 0, F.concat(F.lit("Other plausible categories: "), others, F.lit("."))).otherwise("No other category is plausible."),
            F.when(uncertain, "The detection is borderline.").otherwise("The detection is clear."),
        ]),
        ("Flow", measure_lines(flow["measures"]) if _has(p, "flow", "measures") else []),
        ("Reasons", [*[F.get(reason_lines, F.lit(i)) for i in range(5)], *(neighbour_lines(F.col("attribution.neighbours")) if _has(p, "attribution", "neighbours") else [])]),
        ("Context", context_lines(F.col("context")) if "context" in p.columns else []),
        ("Data quality", [F.when(F.size("data_quality.notes") > 0, F.array_join("data_quality.notes", " ")).otherwise("Nothing more is known about this flow.")]),
        ("Guidance", [F.concat(g["attack_family"], F.lit(": "), g["description"])]),
    ]


def pack_sections(p: DataFrame) -> Column:
    """Rendered facts of a pack table: titled sections."""
    return facts.rendered([(title, lines) for title, lines in _parts(p) if lines])


def pack_lines(p: DataFrame) -> Column:
    """The same facts as one flat list of '- ' lines."""
    return F.array_join(F.transform(F.array_compact(F.array(*[x for _, lines in _parts(p) for x in lines])), lambda x: F.concat(F.lit("- "), x)), "\n")


#: Renderer of each version of the evidence text.
RENDERERS = {"v1": pack_lines, "v2": pack_lines, "v3": pack_sections, "v4": pack_sections}


def render(p: DataFrame, version: str = "v3") -> Column:
    """Text of a pack table in one of the versions."""
    if version not in RENDERERS:
        raise KeyError(f"unknown version {version!r}; there are {', '.join(RENDERERS)}")
    return RENDERERS[version](p)


def summary(pack_table: DataFrame, k: int = 5) -> DataFrame:
    """Per feature: packs that show it among their first ``k``, share, mean absolute contribution, raises and lowers."""
    n = pack_table.count()
    rows = pack_table.select("detection_id", F.explode(F.slice("attribution.top_features", 1, k)).alias("f")).select("detection_id", facts.base_column(F.col("f.name")).alias("feature"), "f.contribution")
    g = rows.groupBy("feature").agg(F.count_distinct("detection_id").alias("packs"), F.avg(F.abs("contribution")).alias("mean_abs"), F.count_if(F.col("contribution") > 0).alias("raises"), F.count_if(F.col("contribution") <= 0).alias("lowers"))
    return g.withColumn("share", F.col("packs") / n).orderBy(F.desc("packs"), "feature")


#: Confidence under which a pack's family is ambiguous.
AMBIGUOUS = 0.9


def weight_summary(pack_table: DataFrame, benign: str) -> DataFrame:
    """Per group of packs (all, attacks, false positives, and each true family): packs, and mean, population deviation, least,
    quartiles and largest of the topological weight, with the share above half; NULL where a group records none."""
    truth, w = F.col("flow.true_label"), F.col("attribution.weight")
    groups = F.array(F.lit("all"), F.when(truth == benign, "false positives").otherwise("true attacks"), F.concat(F.lit("family "), truth))
    rows = pack_table.select(F.explode(groups).alias("group"), w.alias("w"))
    g = rows.groupBy("group").agg(F.count("*").alias("packs"), F.count("w").alias("n"), F.avg("w").alias("mean"), F.stddev_pop("w").alias("std"), F.min("w").alias("min"), F.max("w").alias("max"), F.avg((F.col("w") > 0.5).cast("int")).alias("share_above_half"))
    return g.join(rank.percentiles(rows, "w", {"p25": 0.25, "median": 0.5, "p75": 0.75}, "group"), "group", "left")


def named_summary(pack_table: DataFrame, benign: str) -> DataFrame:
    """Per true family, and over all attacks: packs, those whose family was named correctly and their share, packs whose
    confidence is ambiguous, and what was named, commonest first."""
    truth, said = F.col("flow.true_label"), F.col("detection.predicted_class")
    rows = pack_table.select(F.explode(F.array_compact(F.array(truth, F.when(truth != benign, "all attacks")))).alias("family"), said.alias("said"), (truth == said).alias("right"), (F.col("detection.class_confidence") < AMBIGUOUS).alias("unsure"))
    counts = rows.groupBy("family", "said").agg(F.count("*").alias("n"), F.count_if("right").alias("right"), F.count_if("unsure").alias("unsure"))
    order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "said"))), lambda x: F.concat_ws(":", x["said"], (-x["m"]).cast("string")))  # a row a family named
    return counts.groupBy("family").agg(F.sum("n").alias("n"), F.sum("right").alias("correct"), (F.sum("right") / F.sum("n")).alias("share_correct"), F.sum("unsure").alias("ambiguous"), order.alias("named_as"))


def features_by_family(pack_table: DataFrame, most: int = 3, k: int = 5) -> DataFrame:
    """Per true family the ``most`` columns that most packs show among their first ``k``; a pack counts once a column."""
    shown = F.array_distinct(F.transform(F.slice("attribution.top_features", 1, k), lambda f: facts.base_column(f["name"])))
    counts = pack_table.select(F.col("flow.true_label").alias("family"), F.explode(shown).alias("feature")).groupBy("family", "feature").agg(F.count("*").alias("packs"))
    listed = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("packs")).alias("m"), "feature"))), 1, most)  # a row a column
    return counts.groupBy("family").agg(F.transform(listed, lambda x: x["feature"]).alias("features"))


def linear_attribution(features: Column, weights: list[float], baseline: list[float] | None = None) -> Column:
    """Exact attribution of a linear score: (x - x0) * w by position."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    x0 = F.array(*[F.lit(float(x)) for x in (baseline or [0.0] * len(weights))])
    return F.zip_with(F.zip_with(features, x0, lambda a, b: a - b), w, lambda a, b: a * b)


def deletion(df: DataFrame, attribution: str, key: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Logit drop when the ``k`` named features are zeroed against ``k`` others picked in md5 order.

    The score is linear, so a drop is a sum of contributions.
    """
    pos = F.transform(F.col(attribution), lambda c, i: F.struct((-c).alias("m"), i.alias("i"), c.alias("c")))
    named = F.slice(F.array_sort(pos), 1, k)
    rest = F.slice(F.array_sort(F.transform(F.slice(F.array_sort(pos), k + 1, 100_000), lambda x: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), x["i"].cast("string"))).alias("h"), x["c"].alias("c")))), 1, k)
    add = lambda xs: F.aggregate(xs, F.lit(0.0).cast("double"), lambda a, x: a + x["c"])
    return df.select(key, F.aggregate(attribution, F.lit(0.0).cast("double"), lambda a, x: a + x).alias("logit"), add(named).alias("drop_named"), add(rest).alias("drop_random"))


def deletion_report(drops: DataFrame, threshold: float = 0.0) -> DataFrame:
    """One row: median drops, share of packs whose named drop is the larger, and of the flagged, the share that stays flagged."""
    flagged = F.col("logit") >= threshold
    still = lambda c: F.avg(F.when(flagged, (F.col("logit") - F.col(c) >= threshold).cast("int"))).alias(f"still_flagged_{c[5:]}")
    shares = drops.agg(F.count("*").alias("n"), F.avg((F.col("drop_named") > F.col("drop_random")).cast("int")).alias("share_named_larger"), F.count_if(flagged).alias("n_flagged"), still("drop_named"), still("drop_random"))
    medians = [rank.percentiles(drops, c, {f"median_{c}": 0.5}) for c in ("drop_named", "drop_random")]
    return shares.crossJoin(medians[0]).crossJoin(medians[1])  # three single rows
