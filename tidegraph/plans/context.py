"""Queries over what surrounds a detection: neighbours, hosts, sentences, latency, scorers. Each has DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegraph.functions import facts
from tidegraph.operators import encode, evaluate, evidence, graph, study
from tidegraph.plans.flows import _CTX, _DRAWN_SQL, _TARGETS_SQL, SIZE, SPLIT_SQL, WINDOWED_SQL, rounded, scratch, splitted, targets, windowed
from tidegraph.plans.scores import DET_SQL, RUNS_SQL, SCORES_SQL, THRESHOLD, detections, runs
from tidegraph.sources.tables import BENIGN, FLOWS_SQL, csv_to_parquet, csv_types, dealt, flows_from_events, table
from tidegraph.streaming import replay

Q: dict = {}
LEAST = 2.0


def add(name, fn, sql=None):
    Q[name] = (fn, sql)


def num_sql(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN 'not recorded' WHEN ({x}) = floor({x}) THEN format('{{:,}}', ({x})::BIGINT) ELSE rtrim(rtrim(format('{{:,.5f}}', ({x})::DOUBLE), '0'), '.') END)"


def influence(s, d):
    return graph.neighbour_influence(windowed(s, d), targets(s, d), "in_bytes", 1.0, 50, 1)


_INFLUENCE_SQL = f"""WITH {WINDOWED_SQL}, {_TARGETS_SQL}, en AS (SELECT window_id, src AS host, in_bytes AS x FROM wf UNION ALL SELECT window_id, dst, in_bytes FROM wf), ho AS (SELECT window_id, host, sum(x) AS t, count(*) AS n FROM en GROUP BY ALL),
  {_DRAWN_SQL},
  jo AS (SELECT rk.*, a.t AS st, a.n AS sn, b.t AS dt, b.n AS dn, (rk.src = s)::INT + (rk.dst = s)::INT AS ks, (rk.src = d)::INT + (rk.dst = d)::INT AS kd FROM rk JOIN ho a ON a.window_id = rk.window_id AND a.host = s JOIN ho b ON b.window_id = rk.window_id AND b.host = d WHERE rank <= 50),
  im AS (SELECT *, (st / sn + dt / dn) / 2 AS score, ((st - ks * in_bytes) / (sn - ks) + (dt - kd * in_bytes) / (dn - kd)) / 2 AS score_without FROM jo)"""
add("g9b_ego_pairs", lambda s, d: graph.pair_counts(windowed(s, d), targets(s, d)), f"WITH {WINDOWED_SQL}, {_TARGETS_SQL} SELECT detection, src, dst, count(*) AS flows FROM tc GROUP BY ALL")
add("v9_neighbour_influence", lambda s, d: rounded(influence(s, d), "score", "score_without", "importance"), f"{_INFLUENCE_SQL} SELECT detection, row_id, src, dst, rank, n_neighbours, round(score, 6) AS score, round(score_without, 6) AS score_without, round(score - score_without, 6) AS importance FROM im")
add("v9b_neighbour_notes", lambda s, d: rounded(evidence.neighbour_notes(targets(s, d), influence(s, d), LEAST), "max_influence").withColumn("influential", F.transform("influential", lambda x: x["row_id"])),
    f"""{_INFLUENCE_SQL}, g AS (SELECT detection, max(n_neighbours) AS m, count(*) AS k, max(abs(score - score_without)) AS most, count(*) FILTER (abs(score - score_without) >= {LEAST}) AS c, list(row_id ORDER BY abs(score - score_without) DESC, row_id) FILTER (abs(score - score_without) >= {LEAST}) AS l FROM im GROUP BY 1)
    SELECT tg.row_id AS detection, coalesce(m, 0) AS n_touching, coalesce(k, 0) AS n_tested, coalesce(c, 0) AS n_influential, round(most, 6) AS max_influence, coalesce(l, [])[1:3] AS influential,
    CASE WHEN k IS NULL THEN 'No other flow of this period has a host of this one.' WHEN c = 0 THEN CASE WHEN k < m THEN 'Of ' || format('{{:,}}', m) || ' flows with a host of this one, ' || k || ' were tested' ELSE 'All ' || k || ' flows with a host of this one were tested' END || ': without any one of them the score moves by less than {LEAST:g}.' END AS note
    FROM tg LEFT JOIN g ON detection = tg.row_id""")


def event_packs(s, d):
    """Large events as detections, with measures, context and neighbours."""
    p = (F.col("dst") % 9 + 1) / 10
    own = targets(s, d).select(
        "row_id", "window_id", "src", "dst", "family", (F.col("in_bytes") / 500).alias("score"), F.lit(0.2).alias("threshold"),
        F.create_map(F.lit("click"), p, F.lit(BENIGN), 1 - p).alias("distribution"), F.create_map(F.lit("IN_BYTES"), F.col("in_bytes") / 50, F.lit("PROTOCOL=6"), (F.col("dst") % 7 - 3).cast("double")).alias("contributions"),
        F.array().cast("array<string>").alias("failed"), F.create_map(F.lit("PROTOCOL"), F.col("proto").cast("double"), F.lit("L4_DST_PORT"), F.col("dst_port").cast("double"), F.lit("IN_BYTES"), F.col("in_bytes")).alias("measures"),
    )
    notes = evidence.neighbour_notes(targets(s, d), influence(s, d), LEAST)
    own = evidence.with_context(own, windowed(s, d)).join(notes.select(F.col("detection").alias("row_id"), F.struct("influential", "note").alias("neighbours")), "row_id", "left")
    guidance = table(s, d, "events").select(F.col("event_type").alias("attack_family")).distinct().withColumn("description", F.concat(F.lit("guidance for "), F.col("attack_family")))
    return evidence.packs(own, guidance, BENIGN)


def _host_sql(h: str, did: str, peers: str, times: str) -> str:
    n, t = num_sql(f"{h}.times"), f"{h}.times"
    plural = lambda c, word: f"CASE WHEN {h}.{c} = 1 THEN '{word}' ELSE '{word}s' END"
    phrase = f"CASE WHEN {t} BETWEEN 0.9 AND 1.1 THEN 'about as many {times} as a typical host here' ELSE {n} || ' times as many {times} as a typical host here' || CASE WHEN {t} < 1 THEN ' (fewer than typical)' ELSE '' END END"
    return f"'{did}' || format('{{:,}}', {h}.flow_count) || ' ' || {plural('flow_count', 'flow')} || '{peers}' || {h}.distinct_peers || ' ' || {plural('distinct_peers', 'host')} || ' on ' || {h}.distinct_ports || ' ' || {plural('distinct_ports', 'port')} || ': ' || {phrase} || '.'"


_SIDE = "{b}{ctx}, {c} AS (SELECT *, round(distinct_peers / median_fanout, 2) AS times FROM {c}0)"
_SIDES_SQL = ", ".join(_SIDE.format(b="", c=c, ctx=_CTX.format(h=h, p=p).replace("b AS (", f"{c}b AS (", 1).replace("FROM b)", f"FROM {c}b)").replace("ctx AS (", f"{c}0 AS (")) for c, h, p in (("sh", "src", "dst"), ("dh", "dst", "src")))
add("x9b_context_lines", lambda s, d: event_packs(s, d).select("detection_id", *[x.alias(f"line{i}") for i, x in enumerate(evidence.context_lines(F.col("context")))]),
    f"""WITH {WINDOWED_SQL}, {_TARGETS_SQL}, {_SIDES_SQL}, ws AS (SELECT window_id, count(DISTINCT row_id) AS e, count(DISTINCT h) AS n FROM (SELECT window_id, row_id, src AS h FROM wf UNION ALL SELECT window_id, row_id, dst FROM wf) GROUP BY 1)
    SELECT 'det-' || row_id AS detection_id, {_host_sql('sh', 'The source started ', ' to ', 'hosts')} AS line0, {_host_sql('dh', 'The destination received ', ' from ', 'sources')} AS line1, 'The period has ' || format('{{:,}}', e) || ' flows among ' || format('{{:,}}', n) || ' hosts.' AS line2
    FROM tg JOIN sh ON sh.window_id = tg.window_id AND sh.host = src JOIN dh ON dh.window_id = tg.window_id AND dh.host = dst JOIN ws ON ws.window_id = tg.window_id""")
_NAMED_SQL = lambda codes, x, other: f"CASE {x} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in codes.items()) + f" ELSE {other} END"
add("x9c_flow_lines", lambda s, d: event_packs(s, d).select("detection_id", F.array_join(F.array_compact(F.array(*evidence.measure_lines(F.col("flow.measures")))), " ").alias("lines")),
    f"""WITH {WINDOWED_SQL}, {_TARGETS_SQL} SELECT 'det-' || row_id AS detection_id, 'Protocol: ' || {_NAMED_SQL(facts.PROTOCOLS, 'proto', "'protocol ' || proto")} || '. Destination port: ' || {_NAMED_SQL({k: f"{k} ({v})" for k, v in facts.SERVICES.items()}, 'dst_port', 'dst_port::VARCHAR')} || '. To the destination: ' || {num_sql('in_bytes')} || ' bytes.' AS lines FROM tg""")


def versions(s, d):
    """Each version's text of every pack: its lines and titles, and a digest of the lines."""
    p = dealt(event_packs(s, d), "detection_id")  # rendering costs more than a pack's bytes tell
    once = p.select("detection_id", *[render(p).alias(render.__name__) for render in dict.fromkeys(evidence.RENDERERS.values())])
    texts = once.select("detection_id", F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.col(render.__name__).alias("text")) for v, render in evidence.RENDERERS.items()])).alias("x")).select("detection_id", "x.*")
    own = texts.withColumn("rows", F.filter(F.split("text", "\n"), lambda x: x != "")).withColumn("lines", F.filter("rows", lambda x: x.startswith("- ")))
    return own.select("detection_id", "version", F.size("lines").alias("n_lines"), (F.size("rows") - F.size("lines")).alias("n_titles"), F.md5(F.array_join("lines", "\n")).alias("lines_md5"))


add("ud3_versions", versions)
add("x8_reasons", lambda s, d: detections(s, d).select("row_id", facts.reasons(facts.top_features(F.col("contributions"))).alias("reasons")),
    f"""WITH {DET_SQL}, c AS (SELECT o_orderkey AS row_id, unnest(['IN_BYTES', 'PROTOCOL=6', 'L4_DST_PORT_bucket=1']) AS name, unnest(['IN BYTES', 'PROTOCOL', 'L4 DST PORT']) AS said, unnest([o_totalprice / 1e5 - 4.2, o_custkey % 7 - 3, (o_orderkey % 5 - 2) / 2]) AS v FROM dt)
    SELECT row_id, list(said || CASE WHEN v > 0 THEN ' raised' ELSE ' lowered' END || ' the score by ' || {num_sql('abs(v)')} ORDER BY abs(v) DESC, name) AS reasons FROM c GROUP BY 1""")


def by_seed(df):
    return df.groupBy("seed").agg(F.avg("score").alias("value"))


add("e16_artefact_difference", lambda s, d: rounded(study.matched_difference(by_seed(runs(s, d).where("NOT ok")), by_seed(runs(s, d).where("ok"))), "mean_with", "mean_without", "difference"),
    f"WITH {RUNS_SQL}, a AS (SELECT seed, avg(score) AS x FROM rn WHERE NOT ok GROUP BY 1), b AS (SELECT seed, avg(score) AS y FROM rn WHERE ok GROUP BY 1) SELECT count(*) AS n_pairs, round(avg(x), 6) AS mean_with, round(avg(y), 6) AS mean_without, round(avg(x - y), 6) AS difference FROM a JOIN b USING (seed)")


def latency(s, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = table(s, d, "events").groupBy(F.expr(f"event_id div {SIZE}").alias("window_id")).agg(((F.max(us) - F.min(us)) / 1e6).alias("seconds"))
    return evaluate.replay_latency(spans, "seconds")


add("e17c_replay_latency", lambda s, d: rounded(latency(s, d), "latency_median", "latency_p95", digits=4), f"WITH w AS (SELECT event_id // {SIZE} AS window_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM events GROUP BY 1) SELECT round(quantile_cont(seconds, 0.5), 4) AS latency_median, round(quantile_cont(seconds, 0.95), 4) AS latency_p95 FROM w")


def scored(s, d):
    flows = windowed(s, d).select("row_id", "window_id", "in_bytes", F.col("label").alias("y"))
    return evaluate.replay_windows(replay.with_scores(flows, replay.batch_scorer(lambda batch: batch["in_bytes"].to_numpy() / 500.0)), THRESHOLD)


add("ud1_scorer", scored, f"WITH {SCORES_SQL} SELECT window_id, count(*) AS flows, count(*) FILTER (score >= 0.5) AS alerts, count(*) FILTER (score >= 0.5 AND y = 1) AS tp, count(*) FILTER (score >= 0.5 AND y = 0) AS fp, sum(y)::BIGINT AS attacks FROM sc GROUP BY 1")


def converted(s, d):
    folder = scratch(s, "csv")
    flows_from_events(s, d).write.option("header", True).csv(f"{folder}/csv")
    return csv_to_parquet(s, f"{folder}/csv", f"{folder}/parquet")


add("s4_csv_to_parquet", converted, f"WITH {FLOWS_SQL} SELECT * FROM flows")


def odd_csv(s, d):
    """Events as CSV whose columns only show late what they are: a fraction, a word, a missing cell in few rows."""
    f = flows_from_events(s, d)
    late = F.col("row_id") % 997 == 996
    folder = scratch(s, "odd-csv")
    f.select("row_id", F.when(late, (F.col("in_bytes") + 0.25).cast("string")).otherwise(F.floor("in_bytes").cast("string")).alias("size"), F.when(late, "n/a").otherwise(F.col("dst").cast("string")).alias("host"), F.when(F.col("row_id") % 991 == 990, "many").otherwise(F.col("proto").cast("string")).alias("code"), (F.col("label") == 1).alias("attack"), F.lit("").alias("nothing"), F.lit("2024-01-02 03:04:05").alias("at")).coalesce(1).write.option("header", True).csv(folder)
    return csv_types(s, folder)


add("s4b_inferred_types", odd_csv, f"""WITH {FLOWS_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (row_id % 997 = 996) AS late, count(*) FILTER (row_id % 991 = 990) AS words, min(CASE WHEN row_id % 997 = 996 THEN row_id END) AS first_late FROM flows)
  SELECT * FROM (VALUES ('row_id', 0, 'bigint'), ('attack', 4, 'boolean'), ('at', 6, 'timestamp')) AS v("column", position, type), (SELECT 0::BIGINT AS n_null, NULL::VARCHAR AS widened_by)
  UNION ALL SELECT 'size', 1, CASE WHEN late > 0 THEN 'double' ELSE 'bigint' END, 0, (SELECT (in_bytes + 0.25)::VARCHAR FROM flows WHERE row_id = first_late) FROM c UNION ALL SELECT 'host', 2, 'bigint', late, NULL FROM c
  UNION ALL SELECT 'code', 3, CASE WHEN words > 0 THEN 'string' ELSE 'bigint' END, 0, CASE WHEN words > 0 THEN 'many' END FROM c UNION ALL SELECT 'nothing', 5, 'void', n, NULL FROM c""")


def named(s, d):
    df = splitted(s, d).where("split = 'train'").withColumn("port", F.col("dst_port") * 150)
    df = df.withColumn("port_bucket", encode.bucket_port("port").cast("string"))
    names = encode.Pipeline(["in_bytes"], ["in_bytes"], ["port_bucket", "family"]).fit(df).feature_names()
    return s.createDataFrame(list(enumerate(names)), "place long, name string")


_NAME_SQL = "SELECT {i} AS o, row_number() OVER (ORDER BY count(*) DESC, {c}) AS k, '{n}=' || {said} AS name FROM sf WHERE split = 'train' GROUP BY {c} HAVING count(*) >= 0.001 * (SELECT count(*) FROM sf WHERE split = 'train')"
add("f7_feature_names", named, f"""WITH {SPLIT_SQL.replace('SELECT flows.*,', "SELECT flows.*, CASE WHEN dst_port * 150 < 1024 THEN '0' WHEN dst_port * 150 < 49152 THEN '1' ELSE '2' END AS pb,")}, a AS (SELECT 0 AS o, 0 AS k, 'in_bytes' AS name UNION ALL SELECT 1, 0, 'port_bucket=OTHER' UNION ALL SELECT 2, 0, 'family=OTHER'
    UNION ALL {_NAME_SQL.format(i=1, c='pb', n='port_bucket', said="['well_known', 'registered', 'ephemeral'][pb::INT + 1]")} UNION ALL {_NAME_SQL.format(i=2, c='family', n='family', said='family')}) SELECT row_number() OVER (ORDER BY o, k) - 1 AS place, name FROM a""")
