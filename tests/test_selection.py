"""Selections without a sort, draws of neighbours, and the replay's running totals."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidegraph.operators import evaluate, evidence, graph, rank, split
from tidegraph.streaming import replay


def test_kth_keys(spark, monkeypatch):
    monkeypatch.setattr(rank, "BINS", 5)
    monkeypatch.setattr(rank, "GATHERED", 3)
    r = random.Random(1)
    rows = [(r.choice("ab"), r.randint(-1000, 10**12) if r.random() < 0.7 else 7) for _ in range(500)] + [("a", None), (None, 4), (None, 9)]
    df = spark.createDataFrame(rows, "c string, k long").repartition(4)
    want = {"a": [1, 2, 100, 249, 5000], "b": [3, 77], None: [2], "z": [1]}
    got = rank.kth_keys(df, F.col("k"), want, "c")
    for c, ks in want.items():
        keys = sorted(k for x, k in rows if x == c and k is not None)
        for k in ks:
            assert got.get((c, k)) == (keys[k - 1] if k <= len(keys) else None)
    assert rank.kth_keys(df, F.col("k"), {None: [1]}) == {(None, 1): min(k for _, k in rows if k is not None)}
    assert rank.kth_keys(df.where("k IS NULL"), F.col("k"), {None: [1]}) == {}


def test_kth_doubles(spark, monkeypatch):
    monkeypatch.setattr(rank, "BINS", 64)
    monkeypatch.setattr(rank, "GATHERED", 2)
    r = random.Random(2)
    keys = [r.choice([1e308, -1e308, 0.0, 3.5, float("inf"), float("-inf"), r.gauss(0, 1), 2.0**60 + r.randrange(3)]) for _ in range(300)]
    df = spark.createDataFrame([(k,) for k in keys] + [(float("nan"),), (None,)], "k double").repartition(3)
    got = rank.kth_keys(df, F.col("k"), {None: list(range(1, 303, 30))})
    assert all(got[None, k] == sorted(keys)[k - 1] for k in range(1, 301, 30))
    assert rank.kth_keys(df, F.col("k"), {None: [301]})[None, 301] != 0 and (None, 302) not in got


@pytest.mark.parametrize("gathered", [2, 4096])
def test_hash_selection_takes_the_rows_of_the_rank(spark, monkeypatch, gathered):
    monkeypatch.setattr(rank, "GATHERED", gathered)
    df = spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    want = {r.row_id for r in rank.hash_rank(df, 3, ["row_id"], ["y"], "r").where("(y = 1 AND r <= 50) OR (y = 0 AND r <= 900)").collect()}
    picked = df.where(rank.first_in_hash(df, {1: 50, 0: 900}, 3, ["row_id"], "y"))
    assert {r.row_id for r in picked.collect()} == want
    assert "Exchange" not in picked._jdf.queryExecution().executedPlan().toString()
    assert df.where(rank.first_in_hash(df, {1: 10**6, 0: 0}, 3, ["row_id"], "y")).count() == df.where("y = 1").count()


def test_samples_have_no_shuffle_of_rows(spark):
    df = spark.range(4000).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") / 4000).alias("score"), F.when(F.col("id") % 5 == 0, "a").when(F.col("id") % 50 == 1, "b").otherwise("view").alias("family")).withColumn("label", F.col("y"))
    for out in (evaluate.at_prevalence(df, 0.04, 1), split.prevalence_resample(df, 600, 0.2, 3), split.middle_blocks(df, 400), evidence.stratified_sample(df, 120, 0.25, "view", 3)):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert split.middle_blocks(df, 400).where("family = 'b'").count() == 80 and split.middle_blocks(df, 400).where("family = 'a'").count() == 200


def drawn(spark, flows, targets, most, seed=0):
    f = spark.createDataFrame(flows, "window_id long, row_id long, src long, dst long").repartition(5)
    t = f.where(F.col("row_id").isin(targets))
    return graph.neighbour_candidates(f, t, most, seed)


def test_draws_are_of_touching_flows(spark):
    r = random.Random(4)
    flows = [(w, w * 1000 + i, r.randrange(6), r.randrange(6)) for w in range(3) for i in range(80)]
    targets = [f[1] for f in flows if r.random() < 0.3]
    of = {f[1]: f for f in flows}
    for most in (5, 500):
        got = {}
        for x in drawn(spark, flows, targets, most).collect():
            got.setdefault(x.detection, []).append(x)
        for t in targets:
            w, _, s, d = of[t]
            near = {f[1] for f in flows if f[0] == w and f[1] != t and {s, d} & {f[2], f[3]}}
            rows = got.get(t, [])
            assert len({x.row_id for x in rows}) == len(rows) == min(most, len(near)) and {x.row_id for x in rows} <= near
            assert all(x.n_neighbours == len(near) for x in rows) and sorted(x.rank for x in rows) == list(range(1, len(rows) + 1))


def test_every_touching_flow_has_a_rank(spark):
    flows = spark.createDataFrame([(0, i, 1, 10 + i) for i in range(120)], "window_id long, row_id long, src long, dst long")
    rows = graph.ranked_neighbours(flows, flows.where("row_id < 2"), 1).collect()
    for t in (0, 1):
        own = [x for x in rows if x.detection == t]
        order = sorted((i for i in range(120) if i != t), key=lambda i: hashlib.md5(f"1:{t}:{i}".encode()).hexdigest())
        assert [x.row_id for x in sorted(own, key=lambda x: x["rank"])] == order and {x.n_neighbours for x in own} == {119}


def test_draws_are_even(spark):
    """Over many seeds every neighbour is drawn about as often."""
    flows = [(0, 0, 1, 2)] + [(0, i, 1, 100 + i) for i in range(1, 40)] + [(0, 100 + i, 2, 1) for i in range(10)] + [(0, 200 + i, 2, 300 + i) for i in range(30)]
    times = {}
    for seed in range(60):
        for x in drawn(spark, flows, [0], 20, seed).collect():
            times[x.row_id] = times.get(x.row_id, 0) + 1
    assert len(times) == 79 and sum(times.values()) == 1200 and max(times.values()) <= 30


def test_hub_of_many_detections(spark):
    """A window of one hub: what meets in the plan are draws, not all pairs."""
    flows = spark.range(60_000).select(F.lit(0).cast("long").alias("window_id"), F.col("id").alias("row_id"), F.lit(1).cast("long").alias("src"), (F.col("id") % 20_000 + 10).alias("dst"))
    targets = flows.where("row_id % 100 = 0")
    out = graph.neighbour_candidates(flows, targets, 50)
    assert out.count() == 600 * 50 and out.agg(F.min("n_neighbours")).first()[0] == 59_999
    ego = graph.ego_graph(flows, targets)
    assert ego.count() == 600 * 28 and ego.agg(F.max("n_omitted")).first()[0] == 19_999 - 28


def test_ego_graph_equals_counting(spark):
    r = random.Random(8)
    flows = [(w, w * 1000 + i, min(int(r.expovariate(0.3)), 9), min(int(r.expovariate(0.2)), 12)) for w in range(3) for i in range(120)]
    of = {f[1]: f for f in flows}
    f = spark.createDataFrame(flows, "window_id long, row_id long, src long, dst long").withColumn("label", F.lit(0))
    t = f.where("row_id % 3 = 0")
    want = []
    for x in (f[1] for f in flows if f[1] % 3 == 0):
        w, _, s, d = of[x]
        count, sides = {}, {}
        for g in flows:
            if g[0] == w and g[1] != x and {s, d} & {g[2], g[3]}:
                for h in {g[2], g[3]} - {s, d}:
                    count[h] = count.get(h, 0) + 1
                    sides.setdefault(h, set()).update({s, d} & {g[2], g[3]})
        top = sorted(count, key=lambda h: (-count[h], h))[:4]
        want += [(x, h, count[h], "both" if sides[h] == {s, d} else "source" if s in sides[h] else "destination", k + 1, max(0, len(count) - 4)) for k, h in enumerate(top)]
    assert sorted(tuple(r) for r in graph.ego_graph(f, t, 4).collect()) == sorted(want)


def test_running_totals_survive_a_restart(spark, tmp_path):
    """Files arrive out of order and in two runs of one checkpoint; windows come out once, in order, with totals so far."""
    r = random.Random(3)
    rows = [(i, r.random(), r.choice(["view", "click"])) for i in range(1050)]
    scores = spark.createDataFrame(rows, "event_id long, value double, event_type string")
    for k, (a, b) in enumerate([(300, 700), (0, 320), (700, 1050)]):
        scores.where(f"event_id >= {a} AND event_id < {b} AND NOT ({k} = 1 AND event_id >= 300)").coalesce(1).write.parquet(f"{tmp_path}/part{k}")
    source, folder = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def arrive(*parts):
        for k in parts:
            for f in (tmp_path / f"part{k}").glob("*.parquet"):
                f.rename(source / f"{k}.parquet")
        return replay.replayed(spark, str(source), 100, F.col("value") >= 0.5, F.col("event_type") != "view", folder, 1, 1050)

    assert arrive(0).count() == 0  # window 0 isn't there yet
    assert [x.window_id for x in arrive(1).orderBy("window_id").collect()] == list(range(7))
    got = replay.with_ratios(arrive(2)).orderBy("window_id").collect()
    windows = evaluate.replay_windows(scores.select((F.col("event_id") / 100).cast("int").alias("window_id"), F.col("value").alias("score"), (F.col("event_type") != "view").cast("int").alias("y")), 0.5)
    want = evaluate.running_replay(windows).orderBy("window_id").collect()
    names = ["window_id", "flows_so_far", "alerts_so_far", "tp_so_far", "attacks_so_far", "precision", "recall"]
    assert [[x[n] for n in names] for x in got] == [[x[n] for n in names] for x in want] and got[-1].flows == 50
    assert arrive().count() == 11
