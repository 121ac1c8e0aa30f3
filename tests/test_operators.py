"""Hand-computed cases of the flow, score and text operators."""

import pytest
from pyspark.sql import functions as F

from tidegraph.functions import facts, text
from tidegraph.operators import encode, evaluate, evidence, graph, models, profile, quality, rank, split, study
from tidegraph.sources import tables
from tidegraph.streaming import replay


def scores(spark, y, s):
    return spark.createDataFrame([(i, a, b, "dos" if a else "Benign") for i, (a, b) in enumerate(zip(y, s))], "row_id long, y int, score double, family string")


@pytest.fixture(scope="module")
def example(spark):
    return scores(spark, [1, 1, 0, 1, 0, 0], [0.9, 0.8, 0.7, 0.6, 0.2, 0.1])


def test_thresholds(spark, example):
    assert evaluate.choose_threshold(example) == 0.6
    assert evaluate.choose_threshold(example, "recall", 0.6) == 0.8
    assert evaluate.choose_threshold(example.where("y = 0")) == 0.5


def test_metrics_absent_are_null(spark, example):
    none = evaluate.curve(example.where("y = 0"))
    assert evaluate.average_precision(none).first()[0] is None and evaluate.roc_auc(none).first()[0] is None and evaluate.fpr_at_recall(none).first()[0] is None
    m = evaluate.metric_set(example, 2.0).first()
    assert m.precision == 0 and m.recall == 0 and m.f1 == 0 and m.alerts_per_tp is None


def test_ranking(spark, example):
    points = evaluate.curve(example)
    assert abs(evaluate.average_precision(points).first()[0] - (1 / 3 + 1 / 3 + 0.75 / 3)) < 1e-12
    assert abs(evaluate.roc_auc(points).first()[0] - 8 / 9) < 1e-12
    tied = evaluate.curve(scores(spark, [1, 0, 1, 0], [0.5] * 4))
    assert tied.count() == 1 and evaluate.roc_auc(tied).first()[0] == 0.5


def test_partition_count_does_not_matter(spark):
    s = scores(spark, [int(i % 3 == 0) for i in range(500)], [(i * 37 % 101) / 100 for i in range(500)])
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(evaluate.average_precision(evaluate.curve(s.repartition(int(n)))).first()[0])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert abs(found[0] - found[1]) < 1e-12


def test_contiguous_bounds():
    assert split.contiguous_bounds(100, 0.7, 0.1, 0.2, 2) == {"train": (0, 68), "val": (72, 78), "test": (82, 100)}
    for bad in ((100, 0.7, 0.1, 0.1, 0), (100, 0.7, 0.1, 0.2, -1), (100, 0.7, 0.1, 0.2, 5)):
        with pytest.raises(ValueError):
            split.contiguous_bounds(*bad)


def flows(spark, pairs, label=None):
    rows = [(i, a, b, 80, 6, 10.0, (label or {}).get(i, 0), "x") for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, tables.FLOW).withColumn("window_id", F.lit(0).cast("long"))


def test_ego_graph(spark):
    f = flows(spark, [(10, 20), (10, 30), (10, 30), (20, 50), (30, 20), (40, 50), (10, 20)])
    got = {r.host: (r.flows, r.side) for r in graph.ego_graph(f, f.where("row_id = 0")).collect()}
    assert got == {30: (3, "both"), 50: (1, "destination")}
    assert {r.row_id for r in graph.touching(f, f.where("row_id = 0")).collect()} == {1, 2, 3, 4, 6}


def test_snapshot_keeps_edges_and_counts_silent_hosts(spark):
    r = graph.snapshot_stats(flows(spark, [(1, 2), (1, 2), (1, 3)], {0: 1})).first()
    assert (r.nodes, r.edges, r.pairs, r.active_senders, r.max_fanout, r.attack_edges) == (3, 3, 2, 1, 2, 1)
    assert abs(r.std_flows_per_node - 3**0.5) < 1e-9 and r.std_fanout is None


def test_windows_do_not_cross_splits(spark):
    f = split.contiguous_split(flows(spark, [(1, 2)] * 100), gap=1)
    w = split.whole_windows(f, 10, split.contiguous_bounds(100, 0.7, 0.1, 0.2, 1))
    assert w.groupBy("split", "window_id").count().where("count <> 10").count() == 0
    d = split.window_split(flows(spark, [(1, 2)] * 105), 10, seed=1)
    assert d.count() == 100 and sorted(r.new_row_id for r in d.collect()) == list(range(100))


def test_holdout_is_clean(spark):
    df = spark.createDataFrame([("train", "dos"), ("train", "mitm"), ("test", "dos"), ("test", "mitm"), ("test", "Benign")], "split string, family string")
    kept = split.holdout(df, "dos", "Benign")
    split.assert_clean(kept, "dos")
    assert sorted((r.split, r.family) for r in kept.collect()) == [("test", "Benign"), ("test", "dos"), ("train", "mitm")]
    with pytest.raises(ValueError):
        split.assert_clean(df, "dos")


def test_pipeline_fits_on_train_only(spark):
    df = spark.createDataFrame([("train", 0.0, "a"), ("train", float("nan"), "a"), ("train", 3.0, "b"), ("test", float("inf"), "z")], "split string, x double, c string")
    with pytest.raises(ValueError):
        encode.Pipeline(["x"], ["x"], ["c"]).fit(df)
    with pytest.raises(ValueError):
        encode.Pipeline(["x"]).transform(df)
    p = encode.Pipeline(["x"], ["x"], ["c"]).fit(df.where("split = 'train'"))
    rows = p.transform(df).collect()
    assert [r.c_code for r in rows] == [1, 1, 2, 0] and all(abs(r.x_z) < 10 for r in rows)
    assert p.cardinalities() == {"c": 3} and p.feature_names() == ["x", "c=OTHER", "c=a", "c=b"]


def test_pipeline_saves_and_loads(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "a"), (5.0, "b")], "x double, c string")
    p = encode.Pipeline(["x"], ["x"], ["c"]).fit(df)
    p.save(spark, str(tmp_path / "p"))
    q = encode.Pipeline.load(spark, str(tmp_path / "p"))
    assert q.params == p.params and q.vocab == p.vocab
    back = p.restore(p.transform(df)).collect()
    assert [r.x_restored for r in back] == [1.0, 5.0] and [r.x_exact for r in back] == [True, False]


def test_quality_counts(spark):
    df = spark.createDataFrame([("train", 1, "a"), ("train", 1, "b"), ("test", 1, "a"), ("test", None, "a"), ("train", None, "a")], "split string, k int, family string")
    r = quality.duplicate_audit(df, ["k"]).first()
    assert (r.n_duplicates, r.n_test, r.n_test_in_train) == (3, 2, 2)
    assert {x.family: x.n_rows for x in quality.contradictory_twins(df, ["k"]).collect()} == {"a": 2, "b": 1}
    rows = quality.duplicate_of_train(df, ["k"]).collect()
    assert sum(x.duplicate_of_train for x in rows) == 2 and len(rows) == 5


def test_rules_need_their_columns(spark):
    df = spark.createDataFrame([(10.0, 0.0), (10.0, 1.0), (None, 1.0), (50.0, 1.0)], "in_bytes double, in_pkts double")
    got = [r[0] for r in df.select(quality.failed_rules(df.columns)).collect()]
    assert got == [["in_bytes_without_packets"], ["in_bytes_below_20_per_packet"], [], []]


def test_time_verdict_over_blocks(spark):
    df = spark.range(300).select(F.col("id").alias("row_id"), F.col("id").alias("up"), (F.col("id") % 150).alias("saw"), F.lit(1).alias("flat"))
    got = {r.column: r.monotone for r in profile.monotone_columns(df, ["up", "saw", "flat"], block=50).collect()}
    assert got == {"up": True, "saw": False, "flat": False}
    assert profile.time_verdict(df, ["up"], ["saw"]).first().verdict == "timestamp"


def test_ranks(spark):
    df = spark.range(1000).select(F.col("id").alias("i"), (F.col("id") % 3).alias("g"))
    h = rank.hash_rank(df, 4, ["i"], ["g"], "r")
    assert h.groupBy("g").agg(F.min("r").alias("a"), F.max("r").alias("b"), F.count_distinct("r").alias("c")).where("a <> 1 OR b <> c").count() == 0
    o = rank.order_rank(df, "i", [], "r", block=64)
    assert o.where("r <> i + 1").count() == 0
    assert [x for x in spark.range(1).select(rank.even_rows(10, 4)).first()[0]] == [0, 3, 6, 9]


def test_row_ids_over_files(spark, tmp_path):
    spark.range(100).repartition(4).write.parquet(str(tmp_path / "t"))
    got = tables.with_row_id(spark.read.parquet(str(tmp_path / "t")))
    assert sorted(r.row_id for r in got.collect()) == list(range(100))


def test_csv_and_results_sources(spark, tmp_path):
    (tmp_path / "f.csv").write_text("row_id,src,dst,dst_port,proto,in_bytes,label,family\n0,1,2,80,6,1.5,0,Benign\n")
    df = tables.csv_to_parquet(spark, str(tmp_path / "f.csv"), str(tmp_path / "p"))
    assert df.schema == tables.FLOW and df.first().family == "Benign"
    for i in range(2):
        (tmp_path / f"r{i}.json").write_text('{"model": "m%d", "runs": [{"seed": 0, "value": 1.0}, {"seed": 1, "value": 2.0}]}' % i)
    assert tables.read_results(spark, [str(tmp_path / "r0.json"), str(tmp_path / "r1.json")]).count() == 4


def test_roles():
    assert tables.resolve_roles(["a", "b", "c"], identity=["a"])["continuous"] == ["b", "c"]
    with pytest.raises(ValueError):
        tables.resolve_roles(["a"], identity=["z"])


def test_family_blocks_cover_rare_families(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.when(F.col("id") == 777, "rare").otherwise("common").alias("family"))
    kept, chosen = split.family_blocks(df, 100, 300)
    assert 7 in {r.block_id for r in chosen.collect()} and kept.where("family = 'rare'").count() == 1 and kept.count() <= 300


def test_number_text(spark):
    df = spark.createDataFrame([(4371.0,), (0.96004,), (None,), (1234.5,)], "v double")
    assert [r[0] for r in df.select(facts.num(F.col("v"))).collect()] == ["4,371", "0.96004", "not recorded", "1,234.5"]


def col(spark, c, value="x"):
    return spark.createDataFrame([(value,)], "t string").select(c).first()[0]


def test_entities(spark):
    e = col(spark, text.entities(F.col("t")), "From 10.0.0.1 (T1046), 4 371 packets, 4,371.0 bytes, 96% and 3 hosts; 0.960 by more than 0.01.")
    assert e.ips == ["10.0.0.1"] and e.mitre == ["T1046"] and sorted(e.numbers) == ["0.01", "0.96", "4371"]


def test_groundedness_nothing_claimed_is_null(spark):
    g = col(spark, text.groundedness(text.entities(F.col("t")), text.evidence_entities(F.lit("seen 10.0.0.1 score 0.96004"))), "plain words")
    assert g.grounded is None and g.n_claims == 0
    g = col(spark, text.groundedness(text.entities(F.col("t")), text.evidence_entities(F.lit("seen 10.0.0.1 score 0.96004"))), "10.0.0.1 at 0.96, and 10.9.9.9")
    assert g.fabricated_ips == ["10.9.9.9"] and abs(g.grounded - 2 / 3) < 1e-9


def test_families_nested_aliases(spark):
    aliases = {"ddos": ("ddos", "distributed denial of service"), "dos": ("dos", "denial of service")}
    assert col(spark, text.families_named(F.col("t"), aliases), "A distributed denial of service.") == ["ddos"]
    assert col(spark, text.families_named(F.col("t"), aliases), "DoS and DDoS") == ["ddos", "dos"]


def test_reports(spark):
    assert col(spark, text.is_degenerate(F.col("t")), "0.0.0.0 . . . .") and not col(spark, text.is_degenerate(F.col("t")), "A fine report.") and not col(spark, text.is_degenerate(F.col("t")), "")
    assert col(spark, text.leaked(F.col("t")), "We need to produce an incident note.") and not col(spark, text.leaked(F.col("t")), "we need to isolate the host")
    assert col(spark, text.cites_feature(F.col("t"), "IN_BYTES", {"in": ("inbound", "in")}), "Many inbound packets. Few bytes inbound.")


def test_facts(spark):
    assert col(spark, facts.tcp_flags(F.lit(18))) == "SYN+ACK" and col(spark, facts.port(F.lit(445))) == "445 (SMB)" and col(spark, facts.icmp(F.lit(771))) == "type 3, code 3"
    m = col(spark, facts.margin(F.lit(0.96004), F.lit(0.86577)))
    assert m.band == "wide" and m.gap == 0.0943 and m.share_of_room == 0.7
    assert col(spark, facts.base_column(F.lit("L4_SRC_PORT_bucket=1"))) == "L4_SRC_PORT"


def test_stratified_sample_quotas(spark):
    rows = [(i, f) for f, n in (("scanning", 500), ("xss", 30), ("ddos", 3), ("Benign", 50)) for i in range(n)]
    df = spark.createDataFrame([(k, f) for k, (_, f) in enumerate(rows)], "row_id long, family string")
    got = {r.family: r["count"] for r in evidence.stratified_sample(df, 60, 0.25, "Benign").groupBy("family").count().collect()}
    assert sum(got.values()) == 60 and got["ddos"] == 3 and got["Benign"] >= 15
    plan = {r.family: r for r in evidence.sample_plan(df, 60, 0.25, "Benign").collect()}
    assert plan["ddos"].shortfall == 12 and plan["Benign"].quota == 15


def test_study(spark):
    runs = spark.createDataFrame([("c", "a", 1.0), ("c", "a", 2.0), ("c", "b", 3.0), ("c", "b", 4.0)], "comparison string, side string, value double")
    r = study.rank_sum(runs, 2, 2).first()
    assert r.u == 0 and r.separated and r.difference == -2 and abs(r.least_p - 1 / 3) < 1e-12
    with pytest.raises(ValueError):
        study.rescored(spark.createDataFrame([(1,)], "detection_id int"), spark.createDataFrame([(2,)], "detection_id int"))


def test_replay_pools_counts(spark):
    w = spark.createDataFrame([(0, 2, 1, 0, 1, 1), (1, 200, 201, 201, 0, 201)], "window_id long, flows long, alerts long, tp long, fp long, attacks long")
    r = evaluate.replay_totals(w).first()
    assert abs(r.precision - 201 / 202) < 1e-12 and r.windows_with_alerts == 2


def test_baselines_learn(spark):
    df = spark.range(600).select(F.col("id").alias("row_id"), F.lit(1).alias("dst_port"), (F.col("id") % 2).cast("int").alias("proto"), (F.col("id") % 2 * 100 + F.col("id") % 7).cast("double").alias("in_bytes"), (F.col("id") % 2).cast("int").alias("label"), F.lit("f").alias("family"))
    found = models.saturation(df, models.FLOW, target=0.5).collect()
    assert [r.model for r in found] == ["logreg", "gbt"] and all(r.saturated and r.n == 600 and 0.4 < r.prevalence < 0.6 for r in found)
    assert models.saturation(df, models.FLOW, target=0.1).first().n == 600 * 0.1 + 300


def test_baselines_rank_what_can_be_learned(spark):
    """A label that follows a feature is ranked near perfectly and shows as saturated; a label by chance is neither."""
    from tidegraph.operators import evaluate, models

    easy = F.when(F.col("in_bytes") > 5000, 1).otherwise(0)
    hard = (F.xxhash64("row_id", F.lit("coin")) % 2 != 0).cast("int")
    flows = spark.range(3000).select(F.col("id").alias("row_id"), (F.pmod(F.xxhash64("id"), F.lit(10_000))).alias("in_bytes"), (F.col("id") % 700).alias("dst_port"), F.lit(6).alias("proto"), F.lit("x").alias("family"))
    for label, low, high in ((easy, 0.99, 1.0), (hard, 0.35, 0.75)):
        df = flows.withColumn("label", label).cache()
        for kind in ("logreg", "forest", "gbt"):
            out = models.scored(models.fit(df.where("row_id < 2000"), kind, models.FLOW), df.where("row_id >= 2000"), models.FLOW)
            assert low <= evaluate.average_precision(evaluate.curve(out)).first()["pr_auc"] <= high + 1e-9, kind
        found = models.saturation(df, models.FLOW, target=0.5).collect()
        assert all(r.saturated == (low > 0.9) for r in found) and low - 0.05 <= max(r.pr_auc for r in found) <= high + 1e-9


def test_percentiles_are_exact(spark):
    rows = [("a", float(v * 37 % 101)) for v in range(300)] + [("b", 5.0), ("b", None), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = {"low": 0.0, "some": 0.37, "mid": 0.5, "top": 1.0}
    want = {r.g: r[1:] for r in df.where("v IS NOT NULL").groupBy("g").agg(*[F.percentile("v", F.lit(q)) for q in qs.values()]).collect()}
    got = {r.g: tuple(r[k] for k in qs) for r in rank.percentiles(df, "v", qs, "g").collect()}
    assert got == {k: tuple(v) for k, v in want.items()} and set(got) == {"a", "b"}
    assert rank.percentiles(df.where("g = 'c'"), "v", qs, "g").count() == 0
    assert rank.percentiles(df, "v", {"top": 1.0}).first().top == 100.0


def test_rank_auc_of_ties_in_buckets(spark):
    df = spark.range(2000).select((F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 7).cast("double").alias("x"), F.col("label").cast("double").alias("y"))
    got = {r.feature: r.auc for r in quality.rank_auc(df, ["x", "y"]).collect()}
    rows = [(r.label, r.x) for r in df.collect()]
    wins = [(a > b) + (a == b) / 2 for y, a in rows[:400] if y for z, b in rows[:400] if not z]
    assert got["y"] == 1.0 and abs(got["x"] - sum(wins) / len(wins)) < 0.02


def test_durations_and_directions(spark):
    wrap = 2**32 / 1000
    df = spark.createDataFrame([(100.0, 102.0, 50.0), (wrap - 50.0, 50.0, wrap), (wrap - 100.0, 0.0, 0.0), (100.0, None, 101.0)], "duration double, duration_in double, duration_out double")
    got = [r[0] for r in df.select(quality.failed_rules(df.columns)).collect()]
    assert got == [["duration_in_exceeds_flow"], ["duration_wrapped"], ["duration_wrapped"], []]
    packets = spark.createDataFrame([(5.0, 5.0, 10.0, 7.0, 70000.0), (5.0, 5.0, 5.0, 5.0, 1.0)], "in_pkts double, out_pkts double, bucket_pkts double, retrans_out_pkts double, tcp_win_max_out double")
    assert [r[0] for r in packets.select(quality.failed_rules(packets.columns)).collect()] == [["out_retransmitted_exceeds_total", "tcp_win_max_out_over_65535"], ["size_buckets_not_packet_total"]]


def test_balanced_order_keeps_null_labels(spark):
    df = spark.createDataFrame([(1, 1), (2, None), (3, 1), (4, 0)], "k long, label int")
    assert {r.k: r.position for r in study.balanced_order(df, "label", "k").collect()} == {1: 0.25, 2: 0.5, 3: 0.75, 4: 0.5}


def test_rank_in_label_has_sizes(spark):
    df = spark.createDataFrame([(1, 1), (2, None), (3, 1), (4, 0)], "k long, label int")
    assert {r.k: (r["rank"], r.n_label, r.position) for r in study.rank_in_label(df, "label", "k").collect()} == {1: (1, 2, 0.25), 2: (1, 1, 0.5), 3: (2, 2, 0.75), 4: (1, 1, 0.5)}


def test_even_rows_of_many(spark):
    """Places times rows pass 32 bits."""
    n = 6_000_000
    assert list(spark.range(1).select(rank.even_rows(n, 777)).first()[0]) == [i * (n - 1) // 776 for i in range(777)]


def test_families_named_longest_first(spark):
    aliases = {"dos": ("dos", "denial of service"), "ddos": ("distributed denial of service",)}
    named = lambda t: col(spark, text.families_named(F.col("t"), aliases), t)
    assert named("A distributed denial of service.") == ["ddos"] and named("DoS, then distributed denial of service") == ["ddos", "dos"]
    assert named("dossier") == [] and named(None) == []


def test_citations(spark):
    of = lambda t, shown: col(spark, text.citations(F.col("t"), F.array(*[F.lit(x) for x in shown]).cast("array<string>"), ["IN_BYTES", "L4_DST_PORT"]), t)
    r = of("Many incoming bytes. The port of the source.", ["IN_BYTES", "L4_DST_PORT"])
    assert (r.cited, r.missed, r.coverage, r.cites_none) == (["IN_BYTES"], ["L4_DST_PORT"], 0.5, False)
    assert of("Nothing.", ["IN_BYTES"]).cites_none and of("Nothing.", []) is None


def test_metrics_file_is_one_row(spark, tmp_path):
    from tidegraph.sources import sinks

    sinks.write_metrics(spark.createDataFrame([(1, None)], "a int, b int"), f"{tmp_path}/m")
    assert "".join(p.read_text() for p in (tmp_path / "m").glob("part-*")) == '{"a":1,"b":null}\n'
    with pytest.raises(ValueError):
        sinks.write_metrics(spark.range(2), f"{tmp_path}/n")


def test_rank_auc_puts_the_median_for_what_is_not_finite(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (1, 3.0), (0, None), (1, float("inf"))], "label int, x double")
    assert abs(quality.rank_auc(df, ["x"]).first().auc - (3 + 0.5 + 1 + 0.5) / 6) < 1e-12


@pytest.fixture(scope="module")
def near(spark):
    rows = [(0, 0, 1, 2, 10.0), (1, 0, 1, 3, 4.0), (2, 0, 4, 2, 6.0), (3, 0, 5, 6, 8.0), (4, 0, 2, 2, 1.0), (5, 1, 7, 8, 3.0)]
    return spark.createDataFrame(rows, "row_id long, window_id long, src long, dst long, x double")


def test_pair_counts_pool_touching_flows(spark, near):
    got = {(r.src, r.dst): r.flows for r in graph.pair_counts(near.union(near.where("row_id = 1").withColumn("row_id", F.lit(9).cast("long"))), near.where("row_id = 0")).collect()}
    assert got == {(1, 3): 2, (4, 2): 1, (2, 2): 1}


def test_influence_equals_rescoring(spark, near):
    rows = [tuple(r) for r in near.where("window_id = 0").collect()]

    def score(without):
        mean = lambda h: (lambda v: sum(v) / len(v))([r[4] for r in rows if r[0] != without for e in (r[2], r[3]) if e == h])
        return (mean(1) + mean(2)) / 2

    got = {r.row_id: r for r in graph.neighbour_influence(near, near.where("row_id = 0"), "x").collect()}
    assert set(got) == {1, 2, 4}
    for i, r in got.items():
        assert abs(r.score - score(None)) < 1e-12 and abs(r.score_without - score(i)) < 1e-12 and abs(r.importance - (score(None) - score(i))) < 1e-12 and r.n_neighbours == 3


def test_neighbour_notes_state_their_denominator(spark, near):
    found = graph.neighbour_influence(near, near, "x")
    notes = {r.detection: r for r in evidence.neighbour_notes(near, found, 1e9).collect()}
    assert notes[5].note == "No other flow of this period has a host of this one." and notes[5].n_tested == 0 and notes[5].max_influence is None
    assert notes[0].note.startswith("All 3 flows") and notes[0].influential == []
    few = {r.detection: r for r in evidence.neighbour_notes(near, graph.neighbour_influence(near, near, "x", most=2), 1e9).collect()}
    assert few[0].note.startswith("Of 3 flows with a host of this one, 2 were tested")
    strong = {r.detection: r for r in evidence.neighbour_notes(near, found, 0.0).collect()}[0]
    assert strong.note is None and len(strong.influential) == 3 and abs(strong.influential[0].importance) >= abs(strong.influential[1].importance)


def pack_rows(spark):
    det = spark.createDataFrame(
        [(1, 7, 8, "dos", 0.95, 0.5, {"dos": 0.97, "Benign": 0.03}, {"IN_BYTES": 1.5}, ["src_to_dst_second_bytes_non_finite_or_negative"], {"PROTOCOL": 6.0, "L4_DST_PORT": 443.0, "IN_BYTES": 300.0, "IN_PKTS": 2.0, "CLIENT_TCP_FLAGS": 2.0}), (2, 7, 9, "dos", 0.52, 0.5, {"dos": 0.5, "Benign": 0.5}, {}, [], None)],
        "row_id long, src long, dst long, family string, score double, threshold double, distribution map<string,double>, contributions map<string,double>, failed array<string>, measures map<string,double>",
    )
    guide = spark.createDataFrame([("dos", "too many"), ("Benign", "none")], "attack_family string, description string")
    return evidence.packs(det.withColumn("window_id", F.lit(0)), guide, "Benign"), evidence.packs(evidence.with_context(det.withColumn("window_id", F.lit(0)), spark.createDataFrame([(0, 7, 8, 443, 300.0, 1), (0, 7, 9, 80, 1.0, 0)], "window_id int, src long, dst long, dst_port int, in_bytes double, label int")), guide, "Benign")


def test_rendered_sections(spark):
    plain, full = pack_rows(spark)
    texts = {r[0]: r[1] for r in plain.select("detection_id", evidence.render(plain)).collect()}
    assert [x for x in texts["det-1"].split("\n") if not x.startswith("- ") and x] == ["Detection", "Flow", "Reasons", "Data quality", "Guidance"]
    assert "- To the destination: 300 bytes in 2 packets, 150 bytes a packet on average." in texts["det-1"] and "- TCP flags of the source: SYN." in texts["det-1"] and "443 (HTTPS)" in texts["det-1"]
    assert "Flow\n" not in texts["det-2"] and "- The detection is borderline." in texts["det-2"] and "- The detection is clear." in texts["det-1"] and "Nothing more is known" in texts["det-2"]
    texts = {r[0]: r[1] for r in full.select("detection_id", evidence.render(full)).collect()}
    assert "- The source started 2 flows to 2 hosts on 2 ports: about as many hosts as a typical host here." in texts["det-1"] and "- The period has 2 flows among 3 hosts." in texts["det-1"] and "- The destination received 1 flow from 1 host on 1 port" in texts["det-1"]


def test_versions_differ_in_titles_only(spark):
    _, full = pack_rows(spark)
    row = full.select(*[evidence.render(full, v).alias(v) for v in evidence.RENDERERS]).collect()[0]
    assert row.v1 == row.v2 and row.v3 == row.v4 and [x for x in row.v3.split("\n") if x.startswith("- ")] == row.v1.split("\n")
    with pytest.raises(KeyError):
        evidence.render(full, "v9")


def test_scorers(spark, near):
    out = replay.with_scores(near, replay.batch_scorer(lambda b: b["x"].to_numpy() * 2))
    assert {r.row_id: r.score for r in out.collect()} == {r.row_id: r.x * 2 for r in near.collect()}
    with pytest.raises(ValueError, match="x"):
        replay.with_scores(near, lambda df: df.drop("x").withColumn("score", F.lit(1.0)))


def test_latency_and_matched_difference(spark):
    w = spark.createDataFrame([(float(i),) for i in range(1, 6)], "seconds double")
    r = evaluate.replay_latency(w, "seconds").first()
    assert (r.latency_median, round(r.latency_p95, 6)) == (3.0, 4.8)
    a, b = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.1)], "seed int, value double"), spark.createDataFrame([(1, 0.7), (2, 0.5)], "seed int, value double")
    r = study.matched_difference(a, b).first()
    assert r.n_pairs == 2 and abs(r.mean_with - 0.85) < 1e-12 and abs(r.mean_without - 0.6) < 1e-12 and abs(r.difference - 0.25) < 1e-12


def test_encoder_keeps_the_order_of_columns(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, "0", "a", "1")] * 3, "b double, a double, z_bucket string, c string, y_present string")
    p = encode.Pipeline(["b", "a"], [], ["z_bucket", "c", "y_present"]).fit(df)
    want = ["b", "a", "z_bucket=OTHER", "z_bucket=well_known", "c=OTHER", "c=a", "y_present=OTHER", "y_present=present"]
    assert p.feature_names() == want
    p.save(spark, f"file://{tmp_path}/p")
    assert encode.Pipeline.load(spark, f"file://{tmp_path}/p").feature_names() == want
