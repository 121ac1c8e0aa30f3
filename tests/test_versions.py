"""Versions of tables, results of unlike shapes, inferred types, sketched profiles, filtered twins, the model comparison."""

import random

import pytest
from pyspark.sql import functions as F

from tidegraph.operators import models, profile, quality, version
from tidegraph.sources import tables


def numbered(spark, n, changed=()):
    return spark.range(n).select(F.col("id").alias("row_id"), F.when(F.col("id").isin(list(changed)), -1).otherwise(F.col("id") % 7).alias("x"), F.when(F.col("id") % 3 == 0, None).otherwise("t").alias("y"))


def made(df):
    return version.tree(version.block_hashes(df, ["x", "y"], 10), 3)


def test_version_names_rows_params_and_splits(spark):
    one = made(numbered(spark, 250))
    assert one.where("level = 0").count() == 25 and one.agg(F.max("level")).first()[0] == 3 and one.where("level = 3").first().n == 250
    v = version.version(one, {"clip": 1.0}, {"train": [0, 9]})
    assert v == version.version(made(numbered(spark, 250).orderBy(F.rand()).repartition(5).select("y", "row_id", "x")), {"clip": 1.0}, {"train": [0, 9]})
    others = [version.version(one, {"clip": 2.0}, {"train": [0, 9]}), version.version(one, {"clip": 1.0}, {"train": [0, 8]}), version.version(made(numbered(spark, 250, [17])), {"clip": 1.0}, {"train": [0, 9]})]
    assert len({v, *others}) == 4
    version.check(v, v, "the model")
    for stale in (None, others[0]):
        with pytest.raises(ValueError):
            version.check(stale, v, "the model")


def test_descent_finds_the_blocks_that_differ(spark):
    one = made(numbered(spark, 250))
    find = lambda other: sorted(r.node for r in version.differing_blocks(one, other, 3).collect())
    assert find(made(numbered(spark, 250))) == []
    assert find(made(numbered(spark, 250, [17, 18, 240]))) == [1, 24]
    assert find(made(numbered(spark, 250).where("row_id <> 99"))) == [9]
    assert find(made(numbered(spark, 20))) == list(range(2, 25))


def test_documents_of_unlike_shapes(spark, tmp_path):
    texts = {"a": '{"model": "m",\n "cost": 1.5,\n "runs": [{"v": 1}, {"v": "two", "more": {"k": [1]}}]}', "b": '{"model": null, "cost": "free", "runs": []}', "c": '{"runs": [{"v": null, "odd": true}]}', "d": '{"model": "x"}', "e": "not json", "f": '{"runs": 7}'}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    docs = tables.read_shapes(spark, str(tmp_path))
    assert docs.count() == 6
    rows = tables.entries(docs, "runs", {"v": "int", "odd": "boolean"}, {"model": "string", "cost": "double"}).collect()
    assert sorted((r.file, r.model, r.cost, r.v, r.odd) for r in rows if r.v) == [("a.json", "m", 1.5, 1, None)]
    assert sorted((r.file, r.odd) for r in rows if r.v is None) == [("a.json", None), ("c.json", True)]
    assert "cost" in tables.shape(docs.where("file < 'e'"))


def test_types_come_from_all_rows(spark, tmp_path):
    lines = ["a,b,c,d,e,f,g,h"] + ["1,1,true,2024-01-01,x,,1e3,9"] * 500 + ["2,2.5,FALSE,2024-01-01 10:00:00,7,NA,3,99999999999999999999"] + ["3,,1,,y,,nan,1"]
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    got = {r.column: r for r in tables.csv_types(spark, str(tmp_path)).collect()}
    assert {c: r.type for c, r in got.items()} == {"a": "bigint", "b": "double", "c": "string", "d": "timestamp", "e": "string", "f": "void", "g": "double", "h": "double"}
    assert got["b"].widened_by == "2.5" and got["c"].widened_by == "1" and got["a"].widened_by is None and got["f"].n_null == 502 and got["g"].n_null == 1
    out = tables.inferred_csv_to_parquet(spark, str(tmp_path / "t.csv"), str(tmp_path / "out"))
    assert dict(out.dtypes)["b"] == "double" and out.where("b IS NULL").count() == 1 and out.where("g IS NULL").count() == 1 and out.count() == 502


def test_sketched_profile(spark):
    df = spark.range(60_000).select((F.col("id") % 20_000).alias("k"), F.when(F.col("id") % 4 == 0, F.col("id").cast("string")).alias("t"), F.lit(5).alias("five"), F.lit(None).cast("int").alias("none"))
    exact = {r.column: r for r in profile.column_profile(df).collect()}
    sketches = profile.sketched_profile(df, F.spark_partition_id())
    got = {r.column: r for r in profile.merged_profile(sketches).collect()}
    for c, r in exact.items():
        assert (got[c].n, got[c].n_null, got[c].is_constant, got[c].dtype) == (60_000, r.n_null, r.is_constant, r.dtype)
        assert abs(got[c].n_unique - r.n_unique) <= 0.02 * r.n_unique


def test_filtered_twins(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, r.choice(["train", "val", "test"]), r.choice([None, *range(40)]), r.choice([None, "a", "b"]), float(r.randrange(5))) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, split string, a long, b string, c double")
    want = {x.row_id: x.duplicate_of_train for x in quality.duplicate_of_train(df, ["a", "b", "c"]).collect()}
    got = quality.filtered_twins(df, ["a", "b", "c"])
    assert {x.row_id: x.duplicate_of_train for x in got.collect()} == want and got.count() == 600 and 0 < sum(want.values()) < 400
    monkeypatch.setattr(quality, "MOST_BITS", 1)
    assert {x.row_id: x.duplicate_of_train for x in quality.filtered_twins(df, ["a", "b", "c"]).collect()} == want
    assert quality.filtered_twins(df.where("split <> 'train'"), ["a"]).where("duplicate_of_train").count() == 0


def test_comparison_by_the_protocol(spark, tmp_path):
    """One kind of model; PR-AUC, threshold and F1 equal plain Python on the same scores."""
    r = random.Random(5)
    rows = []
    for i in range(3000):
        y = int(r.random() < 0.2)
        rows.append((i, "train" if i < 1800 else "val" if i < 2300 else "test", y, "a" if y else "view", i % 10 == 0 and i >= 1800, r.gauss(2.0 * y, 1), r.random(), r.random(), *[r.gauss(0.5 * y, 1) for _ in models.HOST]))
    names = ["in_bytes", "dst_port", "proto", *models.HOST]
    df = spark.createDataFrame(rows, "row_id long, split string, label int, family string, duplicate_of_train boolean, " + ", ".join(f"{c} double" for c in names)).withColumn("in_bytes", F.exp("in_bytes"))
    runs = models.compare(df, f"file://{tmp_path}/fits", (0,), 0.04, 0, ("logreg",), 2, 8).collect()
    assert len(runs) == 2 * 2 * 2
    of = {(x.features, x.rows_at, x.novel_only): x for x in runs}
    assert of["flow", "native", False].n == 700 and of["flow", "native", True].n == 630 and abs(of["flow", "target", False].prevalence - 0.04) < 0.003
    assert of["flow+host", "native", False].pr_auc > of["flow", "native", False].pr_auc > 0.5
    share = df.where("split = 'train'").agg(F.avg("label")).first()[0]
    table = models.features(df, models.FLOW).withColumns({"w": F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)), "held": F.col("split") == "val"})
    model = models.fit_early(table.where("split <> 'test'"), "logreg", "features", 0, share, 8)
    scores = sorted(((x.probability[1], x.label) for x in model.transform(table.where("split = 'test'")).select("probability", "label").collect()), reverse=True)
    hits, total, area = 0, sum(y for _, y in scores), 0.0
    for k, (_, y) in enumerate(scores, 1):
        hits += y
        area += y * hits / k / total
    assert abs(area - of["flow", "native", False].pr_auc) < 1e-6
    means = models.seed_means(spark.createDataFrame(runs)).collect()
    assert len(means) == 8 and all(m.n_seeds == 1 and m.pr_auc_std == 0 for m in means)
