"""Queries over scores, packs, reports and runs. Each has DuckDB SQL of its own where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegraph.functions import facts, text
from tidegraph.operators import evaluate, evidence, graph, models, profile, quality, rank, split, study
from tidegraph.plans.flows import _FAILED_SQL, LINES_SQL, SIZE, SPLIT_SQL, failing, five_sql, rounded, scratch, splitted, windowed
from tidegraph.sources.tables import BENIGN, FLOWS_SQL, dealt, entries, flows_from_events, read_shapes, table
from tidegraph.streaming import replay

Q: dict = {}
THRESHOLD = 0.5


def add(name, fn, sql=None):
    Q[name] = (fn, sql)


def scores(s, d):
    """Event values as scores; every third key is called benign."""
    f = flows_from_events(s, d)
    return f.select("row_id", F.col("label").alias("y"), (F.col("in_bytes") / 500.0).alias("score"), "family", F.when(F.col("dst") % 3 == 0, BENIGN).otherwise(F.col("family")).alias("pred_family"), (F.col("dst") / 100.0).alias("weight"), F.floor(F.col("row_id") / SIZE).alias("window_id"))


SCORES_SQL = f"""{FLOWS_SQL}, sc AS (SELECT row_id, label AS y, in_bytes / 500.0 AS score, family, CASE WHEN dst % 3 = 0 THEN 'view' ELSE family END AS pred_family, dst / 100.0 AS weight, row_id // {SIZE} AS window_id FROM flows)"""
CURVE_SQL = f"""{SCORES_SQL}, gr AS (SELECT score, sum(y)::BIGINT AS p, sum(1 - y)::BIGINT AS n FROM sc GROUP BY 1),
  cv AS (SELECT score, p, n, (sum(p) OVER w)::BIGINT AS tp, (sum(n) OVER w)::BIGINT AS fp, (sum(p) OVER ())::BIGINT AS pos, (sum(n) OVER ())::BIGINT AS neg FROM gr WINDOW w AS (ORDER BY score DESC)),
  pt AS (SELECT *, tp / (tp + fp) AS precision, tp / pos AS recall FROM cv)"""
add("w4_cumulative_curve", lambda s, d: rounded(evaluate.curve(scores(s, d)), "precision", "recall"), f"WITH {CURVE_SQL} SELECT score, p, n, tp, fp, pos, neg, round(precision, 6) AS precision, round(recall, 6) AS recall FROM pt")
add("e1_threshold_f1", lambda s, d: table(s, d, "events").groupBy().agg(F.lit(evaluate.choose_threshold(scores(s, d))).alias("threshold")), f"WITH {CURVE_SQL} SELECT arg_max(score, (2 * tp / (pos + tp + fp), score)) AS threshold FROM pt")
add("e1b_threshold_recall", lambda s, d: table(s, d, "events").groupBy().agg(F.lit(evaluate.choose_threshold(scores(s, d), "recall", 0.9)).alias("threshold")), f"WITH {CURVE_SQL} SELECT max(score) AS threshold FROM pt WHERE recall >= 0.9")
add("e2_average_precision", lambda s, d: rounded(evaluate.average_precision(evaluate.curve(scores(s, d))), "pr_auc"), f"WITH {CURVE_SQL} SELECT round(sum(p / pos * precision), 6) AS pr_auc FROM pt")
add("e3_roc_auc", lambda s, d: rounded(evaluate.roc_auc(evaluate.curve(scores(s, d))), "roc_auc"), f"WITH {SCORES_SQL}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM sc) SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS roc_auc FROM r")
add("e4_fpr_at_recall", lambda s, d: rounded(evaluate.fpr_at_recall(evaluate.curve(scores(s, d))), "fpr_at_95", "fpr_at_99"), f"WITH {CURVE_SQL} SELECT round(min(fp / neg) FILTER (recall >= 0.95), 6) AS fpr_at_95, round(min(fp / neg) FILTER (recall >= 0.99), 6) AS fpr_at_99 FROM pt")
_METRICS = ["prevalence", "precision", "recall", "f1", "alerts_per_tp"]
_METRIC_SQL = "m AS (SELECT count(*) AS n, sum(y)::BIGINT AS positives, count(*) FILTER (score >= 0.5 AND y = 1) AS tp, count(*) FILTER (score >= 0.5 AND y = 0) AS fp FROM {src})"
_METRIC_OUT = "n, positives, round(positives / n, 6) AS prevalence, 0.5::DOUBLE AS threshold, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(positives, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(tp + fp + positives, 0), 0), 6) AS f1, tp, fp, round((tp + fp) / nullif(tp, 0), 6) AS alerts_per_tp"
add("e5_metric_set", lambda s, d: rounded(evaluate.metric_set(scores(s, d), THRESHOLD), *_METRICS), f"WITH {SCORES_SQL}, {_METRIC_SQL.format(src='sc')} SELECT {_METRIC_OUT} FROM m")
add("e6_family_recall", lambda s, d: rounded(evaluate.family_recall(scores(s, d), THRESHOLD, BENIGN), "recall", "ci95"), f"WITH {SCORES_SQL}, f AS (SELECT family, count(*) AS n, avg((score >= 0.5)::INT) AS p FROM sc WHERE family <> 'view' GROUP BY 1) SELECT family, n, round(p, 6) AS recall, round(1.96 * sqrt(greatest(p * (1 - p), 1e-12) / n), 6) AS ci95 FROM f")
_CONF_SQL = "cm AS (SELECT family AS \"true\", pred_family AS pred, count(*) AS n FROM sc GROUP BY 1, 2)"
add("e7_confusion", lambda s, d: rounded(evaluate.confusion(scores(s, d)), "share"), f"WITH {SCORES_SQL}, {_CONF_SQL} SELECT \"true\", pred, n, round(n / sum(n) OVER (PARTITION BY \"true\"), 6) AS share FROM cm")
_CLASS_SQL = "t AS (SELECT \"true\" AS family, sum(n)::BIGINT AS n, sum(CASE WHEN \"true\" = pred THEN n ELSE 0 END) AS hit FROM cm GROUP BY 1), p AS (SELECT pred AS family, sum(n) AS m FROM cm GROUP BY 1), cr AS (SELECT family, n, coalesce(hit / m, 0) AS precision, hit / n AS recall, 2 * hit / (n + coalesce(m, 0)) AS f1, hit FROM t LEFT JOIN p USING (family))"
add("e7b_class_report", lambda s, d: rounded(evaluate.class_report(evaluate.confusion(scores(s, d))), "precision", "recall", "f1"), f"WITH {SCORES_SQL}, {_CONF_SQL}, {_CLASS_SQL} SELECT family, n, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM cr")
add("e7c_multiclass", lambda s, d: rounded(evaluate.multiclass(evaluate.confusion(scores(s, d))), "macro_f1", "accuracy"), f"WITH {SCORES_SQL}, {_CONF_SQL}, {_CLASS_SQL} SELECT round(avg(f1), 6) AS macro_f1, sum(n)::BIGINT AS n, count(*) AS n_classes, round(sum(hit) / sum(n), 6) AS accuracy FROM cr")
add("e8_detection_families", lambda s, d: rounded(evaluate.detection_families(scores(s, d), THRESHOLD, BENIGN), "attack_accuracy", "tp_family_accuracy", "tp_called_benign", "heads_disagree"),
    f"WITH {SCORES_SQL} SELECT round(avg((family = pred_family)::INT) FILTER (y = 1), 6) AS attack_accuracy, count(*) FILTER (y = 1 AND score >= 0.5) AS n_tp, round(avg((family = pred_family)::INT) FILTER (y = 1 AND score >= 0.5), 6) AS tp_family_accuracy, round(avg((pred_family = 'view')::INT) FILTER (y = 1 AND score >= 0.5), 6) AS tp_called_benign, round(avg((pred_family = 'view')::INT) FILTER (score >= 0.5), 6) AS heads_disagree FROM sc")
_PREV_SQL = f"""{SCORES_SQL}, pn AS (SELECT sum(y) AS p, count(*) - sum(y) AS n FROM sc), wn AS (SELECT CASE WHEN round_even(p * 0.96 / 0.04, 0) > n THEN greatest(1, round_even(n * 0.04 / 0.96, 0)) ELSE p END AS wp, least(round_even(p * 0.96 / 0.04, 0), n) AS wneg FROM pn),
  rk AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('1:' || row_id), row_id) AS r FROM sc), sub AS (SELECT rk.* FROM rk, wn WHERE (y = 1 AND r <= wp) OR (y = 0 AND r <= wneg))"""
add("e9_at_prevalence", lambda s, d: evaluate.at_prevalence(scores(s, d), 0.04, 1).select("row_id", "y"), f"WITH {_PREV_SQL} SELECT row_id, y FROM sub")
add("e10_report_both", lambda s, d: rounded(evaluate.report_both(scores(s, d), THRESHOLD, 0.04, 1), *_METRICS, "pr_auc", "roc_auc", "fpr_at_95", "fpr_at_99").select(F.col("at").alias("rows_at"), "n_before", "n", "positives", "tp", "fp", "precision", "recall", "f1"),
    f"WITH {_PREV_SQL}, both_ AS (SELECT 'native' AS rows_at, y, score FROM sc UNION ALL SELECT 'target', y, score FROM sub), m AS (SELECT rows_at, count(*) AS n, sum(y)::BIGINT AS positives, count(*) FILTER (score >= 0.5 AND y = 1) AS tp, count(*) FILTER (score >= 0.5 AND y = 0) AS fp FROM both_ GROUP BY 1) SELECT rows_at, (SELECT count(*) FROM sc) AS n_before, n, positives, tp, fp, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(tp / positives, 6) AS recall, round(2 * tp / (tp + fp + positives), 6) AS f1 FROM m")


def novel(s, d):
    keep = quality.duplicate_of_train(splitted(s, d).where("split IS NOT NULL"), ["src", "dst"]).where("split = 'test' AND NOT duplicate_of_train").select("row_id")
    return evaluate.metric_set(scores(s, d).join(keep, "row_id", "left_semi"), THRESHOLD)


add("e11_novel_only", lambda s, d: rounded(novel(s, d), *_METRICS), f"WITH {SPLIT_SQL}, nv AS (SELECT row_id, label AS y, in_bytes / 500.0 AS score FROM sf WHERE split = 'test' AND (src, dst) NOT IN (SELECT (src, dst) FROM sf WHERE split = 'train')), {_METRIC_SQL.format(src='nv')} SELECT {_METRIC_OUT} FROM m")


def two_thresholds(s, d):
    target = table(s, d, "orders").select(F.col("o_orderkey").alias("row_id"), (F.col("o_orderpriority") != "5-LOW").cast("int").alias("y"), (F.col("o_totalprice") / 500_000).alias("score"))
    own, other = evaluate.choose_threshold(scores(s, d)), evaluate.choose_threshold(target)
    return evaluate.metric_set(target, own).select(F.lit("source").alias("from"), "tp", "fp").union(evaluate.metric_set(target, other).select(F.lit("target").alias("from"), "tp", "fp"))


add("e12_two_thresholds", two_thresholds, f"""WITH {CURVE_SQL}, tg AS (SELECT (o_orderpriority <> '5-LOW')::INT AS y, o_totalprice / 500000 AS score FROM orders), g2 AS (SELECT score, sum(y) AS p, count(*) AS c FROM tg GROUP BY 1),
  c2 AS (SELECT score, sum(p) OVER w AS tp, sum(c) OVER w AS al, sum(p) OVER () AS pos FROM g2 WINDOW w AS (ORDER BY score DESC)), th AS (SELECT 'source' AS "from", (SELECT arg_max(score, (2 * tp / (pos + tp + fp), score)) FROM pt) AS t UNION ALL SELECT 'target', (SELECT arg_max(score, (2 * tp / (pos + al), score)) FROM c2))
  SELECT "from", count(*) FILTER (score >= t AND y = 1) AS tp, count(*) FILTER (score >= t AND y = 0) AS fp FROM tg, th GROUP BY 1""")
add("e13_mistaken_for", lambda s, d: rounded(evaluate.mistaken_for(scores(s, d), "click"), "share"), f"WITH {SCORES_SQL} SELECT pred_family, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM sc WHERE family = 'click' GROUP BY 1")
add("e14_channel_summary", lambda s, d: rounded(evaluate.channel_summary(scores(s, d), THRESHOLD, "weight"), "mean", "share_above_half", "mean_on_tp"), f"WITH {SCORES_SQL} SELECT round(avg(weight), 6) AS mean, round(avg((weight > 0.5)::INT), 6) AS share_above_half, round(avg(weight) FILTER (y = 1 AND score >= 0.5), 6) AS mean_on_tp FROM sc")
_RW_SQL = "rw AS (SELECT window_id, count(*) AS flows, count(*) FILTER (score >= 0.5) AS alerts, count(*) FILTER (score >= 0.5 AND y = 1) AS tp, count(*) FILTER (score >= 0.5 AND y = 0) AS fp, sum(y)::BIGINT AS attacks FROM sc GROUP BY 1)"
add("e17_replay_totals", lambda s, d: rounded(evaluate.replay_totals(evaluate.replay_windows(scores(s, d), THRESHOLD)), "precision", "recall", "alerts_per_1000", "trigger_rate"), f"WITH {SCORES_SQL}, {_RW_SQL} SELECT count(*) AS windows, sum(flows)::BIGINT AS flows, sum(alerts)::BIGINT AS alerts, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(attacks)::BIGINT AS attacks, count(*) FILTER (alerts > 0) AS windows_with_alerts, round(sum(tp) / sum(alerts), 6) AS precision, round(sum(tp) / sum(attacks), 6) AS recall, round(1000 * sum(alerts) / sum(flows), 6) AS alerts_per_1000, round(count(*) FILTER (alerts > 0) / count(*), 6) AS trigger_rate FROM rw")
add("e17b_running_replay", lambda s, d: rounded(evaluate.running_replay(evaluate.replay_windows(scores(s, d), THRESHOLD)), "precision", "recall"), f"WITH {SCORES_SQL}, {_RW_SQL}, c AS (SELECT window_id, (sum(flows) OVER w)::BIGINT AS flows_so_far, (sum(alerts) OVER w)::BIGINT AS alerts_so_far, (sum(tp) OVER w)::BIGINT AS tp_so_far, (sum(attacks) OVER w)::BIGINT AS attacks_so_far FROM rw WINDOW w AS (ORDER BY window_id)) SELECT *, round(tp_so_far / alerts_so_far, 6) AS precision, round(tp_so_far / attacks_so_far, 6) AS recall FROM c")


def streamed(s, d):
    return replay.replayed(s, f"{d}/events.parquet", 1000, F.col("value") / 500.0 >= THRESHOLD, F.col("event_type") != "view", scratch(s, "replay"))


_SO_FAR = ", ".join(f"(sum({c}) OVER w)::BIGINT AS {c}_so_far" for c in replay.COUNTS)
add("st1_streamed_replay", lambda s, d: rounded(replay.with_ratios(streamed(s, d)), "precision", "recall"), f"""WITH x AS (SELECT event_id // 1000 AS window_id, count(*) AS flows, count(*) FILTER (value / 500.0 >= 0.5) AS alerts, count(*) FILTER (value / 500.0 >= 0.5 AND event_type <> 'view') AS tp,
    count(*) FILTER (value / 500.0 >= 0.5 AND event_type = 'view') AS fp, count(*) FILTER (event_type <> 'view') AS attacks FROM events GROUP BY 1), c AS (SELECT *, {_SO_FAR} FROM x WINDOW w AS (ORDER BY window_id))
  SELECT *, round(tp_so_far / alerts_so_far, 6) AS precision, round(tp_so_far / attacks_so_far, 6) AS recall FROM c""")
add("st2_time_windows", lambda s, d: rounded(replay.time_windows(table(s, d, "events")), "total", digits=3).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm")), "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
add("t3_detections_in_order", lambda s, d: scores(s, d).where(F.col("score") >= 0.9).select("window_id", "score", "row_id").orderBy("window_id", F.desc("score"), "row_id"), f"WITH {SCORES_SQL} SELECT window_id, score, row_id FROM sc WHERE score >= 0.9")
add("w5_mid_ranks", lambda s, d: scores(s, d).groupBy("score").agg(F.count("*").alias("n")).transform(lambda g: rank.running_sums(g, "score", {"upto": "n"}, descending=False)).select("score", (F.col("upto") - (F.col("n") - 1) / 2).alias("mid_rank")), f"WITH {SCORES_SQL}, r AS (SELECT score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS mid_rank FROM sc) SELECT DISTINCT score, mid_rank FROM r")

# Packs: one per large order, with a distribution over priorities made from its numbers.
_FAMS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def detections(s, d):
    o = table(s, d, "orders").where("o_totalprice > 400000")
    weights = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: ((F.col("o_orderkey") * i) % 11 + 1).cast("double"))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    o = o.withColumn("w", weights).withColumn("distribution", F.map_from_arrays(F.array(*[F.lit(x) for x in _FAMS]), F.transform("w", lambda x: x / total)))
    contrib = F.map_from_arrays(F.array(F.lit("IN_BYTES"), F.lit("PROTOCOL=6"), F.lit("L4_DST_PORT_bucket=1")), F.array(F.col("o_totalprice") / 1e5 - 4.2, (F.col("o_custkey") % 7 - 3).cast("double"), (F.col("o_orderkey") % 5 - 2).cast("double") / 2))
    return o.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("src"), F.col("o_orderstatus").alias("dst"), F.col("o_orderpriority").alias("family"), (F.col("o_totalprice") / 500000).alias("score"), F.lit(0.8).alias("threshold"), "distribution", contrib.alias("contributions"), F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("src_to_dst_second_bytes_non_finite_or_negative"))).otherwise(F.array().cast("array<string>")).alias("failed"), (F.col("o_orderpriority") != "5-LOW").cast("int").alias("y"), (F.col("o_custkey") % 100 / 100).alias("weight"))


DET_SQL = """dw AS (SELECT *, [(o_orderkey * i) % 11 + 1 for i in [1, 2, 3, 4, 5]] AS w FROM orders WHERE o_totalprice > 400000),
  dt AS (SELECT *, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'] AS fam, [x / list_sum(w) for x in w] AS pr, o_totalprice / 500000 AS score, (o_orderpriority <> '5-LOW')::INT AS y FROM dw),
  ent AS (SELECT o_orderkey, unnest(fam) AS f, unnest(pr) AS p FROM dt), rkd AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY p DESC, f) AS r FROM ent),
  pd AS (SELECT o_orderkey, max(f) FILTER (r = 1) AS predicted, max(p) FILTER (r = 1) AS conf, coalesce(list(f ORDER BY r) FILTER (r BETWEEN 2 AND 4 AND p >= 0.05), []) AS alts FROM rkd GROUP BY 1)"""


def guidance(s, d):
    return table(s, d, "orders").select(F.col("o_orderpriority").alias("attack_family")).distinct().where("attack_family <> '2-HIGH'").withColumn("description", F.concat(F.lit("guidance for "), F.lower("attack_family")))


def packed(s, d):
    return evidence.packs(detections(s, d), guidance(s, d), "5-LOW")


_BAND = "CASE WHEN greatest((score - 0.8) / (1 - 0.8), 0) < 0.1 THEN 'narrow' WHEN greatest((score - 0.8) / (1 - 0.8), 0) < 0.5 THEN 'moderate' ELSE 'wide' END"
_CONFBAND = "CASE WHEN conf < 0.6 THEN 'low' WHEN conf < 0.9 THEN 'moderate' ELSE 'high' END"
add("x1_margin", lambda s, d: detections(s, d).select("row_id", facts.margin(F.col("score"), F.col("threshold"))["band"].alias("band")), f"WITH {DET_SQL} SELECT o_orderkey AS row_id, {_BAND} AS band FROM dt")
add("x2_confidence", lambda s, d: detections(s, d).select("row_id", facts.predicted(F.col("distribution")).alias("predicted"), facts.confidence(F.get(facts.ranked(F.col("distribution")), F.lit(0))["p"], F.col("distribution")).alias("c")).select("row_id", "predicted", F.col("c.band").alias("band"), F.transform("c.alternatives", lambda a: a["family"]).alias("alternatives")), f"WITH {DET_SQL} SELECT o_orderkey AS row_id, predicted, {_CONFBAND} AS band, alts AS alternatives FROM pd")
add("x3_borderline", lambda s, d: detections(s, d).select("row_id", facts.borderline(F.col("score"), F.col("threshold"), F.get(facts.ranked(F.col("distribution")), F.lit(0))["p"], F.col("distribution")).alias("borderline")), f"WITH {DET_SQL} SELECT o_orderkey AS row_id, {_BAND} = 'narrow' OR conf < 0.6 OR len(alts) > 0 AS borderline FROM dt JOIN pd USING (o_orderkey)")
add("x4_decoders", lambda s, d: table(s, d, "part").select("p_partkey", facts.tcp_flags(F.col("p_partkey") % 256).alias("flags"), facts.protocol(F.col("p_size")).alias("proto"), facts.port(F.col("p_size") + 400).alias("port"), facts.icmp(F.col("p_partkey")).alias("icmp"), facts.dns_type(F.col("p_size")).alias("dns"), facts.app_protocol(F.col("p_size").cast("double") / 2).alias("app")),
    """SELECT p_partkey, CASE WHEN p_partkey % 256 = 0 THEN 'none' ELSE array_to_string(list_filter([CASE WHEN (p_partkey >> i) & 1 = 1 THEN ['FIN','SYN','RST','PSH','ACK','URG','ECE','CWR'][i + 1] END for i in [0,1,2,3,4,5,6,7]], lambda x: x IS NOT NULL), '+') END AS flags,
    coalesce(map_extract_value(MAP {1:'ICMP',2:'IGMP',6:'TCP',17:'UDP',47:'GRE',58:'ICMPv6'}, p_size), 'protocol ' || p_size) AS proto, CASE p_size + 400 WHEN 443 THEN '443 (HTTPS)' WHEN 445 THEN '445 (SMB)' ELSE (p_size + 400)::VARCHAR END AS port,
    'type ' || (p_partkey // 256) || ', code ' || (p_partkey % 256) AS icmp, coalesce(map_extract_value(MAP {1:'A',2:'NS',5:'CNAME',6:'SOA',12:'PTR',15:'MX',16:'TXT',28:'AAAA',33:'SRV',255:'ANY'}, p_size), 'type ' || p_size) AS dns,
    CASE WHEN p_size // 2 <> 0 THEN coalesce(map_extract_value(MAP {1:'FTP (control)',5:'DNS',7:'HTTP'}, p_size // 2), 'application code ' || (p_size // 2)) END AS app FROM part""")
add("x4b_ftp_codes", lambda s, d: table(s, d, "part").select("p_partkey", facts.ftp_code(F.col("p_partkey") % 351 + 200).alias("ftp")), "SELECT p_partkey, CASE p_partkey % 351 + 200 " + " ".join(f"WHEN {k} THEN '{k} ({v})'" for k, v in facts.FTP_CODES.items()) + " ELSE (p_partkey % 351 + 200)::VARCHAR END AS ftp FROM part")
add("x5_number_text", lambda s, d: table(s, d, "part").select("p_partkey", facts.num(F.col("p_partkey") * 1000).alias("whole"), facts.num(F.when(F.col("p_size") > 10, F.col("p_size") / 4)).alias("part")), "SELECT p_partkey, format('{:,}', p_partkey * 1000) AS whole, CASE WHEN p_size <= 10 THEN 'not recorded' ELSE rtrim(rtrim((p_size / 4)::DECIMAL(10, 5)::VARCHAR, '0'), '.') END AS part FROM part")
add("x6_base_column", lambda s, d: table(s, d, "part").select("p_partkey", facts.base_column(F.concat(F.col("p_brand"), F.when(F.col("p_size") % 3 == 0, "_bucket=1").when(F.col("p_size") % 3 == 1, "_present").otherwise("=x"))).alias("base")), "SELECT p_partkey, p_brand AS base FROM part")
add("x7_times_phrase", lambda s, d: table(s, d, "part").select("p_partkey", facts.times_phrase(F.col("p_size") / 4, "ports").alias("phrase"), facts.plural(F.col("p_size"), "packet").alias("noun")), "SELECT p_partkey, CASE WHEN p_size / 4 BETWEEN 0.9 AND 1.1 THEN 'about as many ports as a typical host here' ELSE rtrim(rtrim((p_size / 4)::DECIMAL(10, 5)::VARCHAR, '0'), '.') || ' times as many ports as a typical host here' || CASE WHEN p_size < 4 THEN ' (fewer than typical)' ELSE '' END END AS phrase, CASE WHEN p_size = 1 THEN 'packet' ELSE 'packets' END AS noun FROM part")
add("x9_rendered_facts", lambda s, d: packed(s, d).select("detection_id", F.sha2(evidence.pack_sections(packed(s, d)), 256).alias("facts_sha256")))
add("x10_template_report", lambda s, d: packed(s, d).select("detection_id", F.size(F.split(facts.template_report(evidence.pack_sections(packed(s, d))), "\n")).alias("n_lines")))


def sample_sql(least, n, n_benign, seed):
    """The stratified sample as ``picked`` (row_id, family, taken_by)."""
    return f"""{SCORES_SQL}, ca AS (SELECT * FROM sc WHERE score >= {least}), fa AS (SELECT family, count(*) AS av FROM ca GROUP BY 1), nf AS (SELECT count(*) FILTER (family <> 'view') AS k FROM fa),
    ql AS (SELECT family, CASE WHEN family = 'view' THEN {n_benign} ELSE {n - n_benign} // k + CASE WHEN row_number() OVER (PARTITION BY family = 'view' ORDER BY family) <= {n - n_benign} % k THEN 1 ELSE 0 END END AS quota FROM fa, nf),
    r AS (SELECT row_id, family, quota, row_number() OVER (PARTITION BY family ORDER BY md5('{seed}:' || row_id), row_id) AS r FROM ca JOIN ql USING (family)), l AS (SELECT {n} - count(*) AS rest FROM r WHERE r <= quota),
    sp AS (SELECT row_id, family, row_number() OVER (ORDER BY md5('{seed}:' || row_id), row_id) AS x FROM r WHERE r > quota),
    picked AS (SELECT family, row_id, 'quota' AS taken_by FROM r WHERE r <= quota UNION ALL SELECT family, row_id, 'spare' FROM sp, l WHERE x <= rest)"""


add("v1_stratified_sample", lambda s, d: evidence.stratified_sample(scores(s, d).where(F.col("score") >= 0.5), 120, 0.25, BENIGN, 3).groupBy("family", "taken_by").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids")),
    f"WITH {sample_sql(0.5, 120, 30, 3)} SELECT family, taken_by, count(*) AS n, sum(row_id)::BIGINT AS ids FROM picked GROUP BY 1, 2")
add("v2_two_pass", lambda s, d: windowed(s, d).join(evidence.stratified_sample(scores(s, d).where(F.col("score") >= 0.9), 20, 0.2, BENIGN, 1).select("row_id"), "row_id", "left_semi").select("window_id").distinct().join(windowed(s, d), "window_id").groupBy("window_id").agg(F.count("*").alias("n")), f"WITH {sample_sql(0.9, 20, 4, 1)} SELECT window_id, count(*) AS n FROM sc WHERE window_id IN (SELECT row_id // {SIZE} FROM picked) GROUP BY 1")
add("v3_packs", lambda s, d: packed(s, d).select("detection_id", F.col("detection.predicted_class").alias("predicted_class"), F.col("guidance.description").alias("description"), F.round("detection.class_confidence", 6).alias("confidence"), F.col("detection.flagged").alias("flagged")), f"WITH {DET_SQL} SELECT 'det-' || o_orderkey AS detection_id, predicted AS predicted_class, 'guidance for ' || lower(CASE WHEN predicted = '2-HIGH' THEN '5-LOW' ELSE predicted END) AS description, round(conf, 6) AS confidence, score >= 0.8 AS flagged FROM dt JOIN pd USING (o_orderkey)")
add("j6_guidance_join", lambda s, d: packed(s, d).groupBy(F.col("guidance.description").alias("description")).agg(F.count("*").alias("n")), f"WITH {DET_SQL} SELECT 'guidance for ' || lower(CASE WHEN predicted = '2-HIGH' THEN '5-LOW' ELSE predicted END) AS description, count(*) AS n FROM pd GROUP BY 1")
_WITHHELD = ("FLOW_DURATION_MILLISECONDS", "DURATION_IN")
_NOTES_SQL = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in evidence.NOTES.items()) + " END"
add("v4_quality_notes", lambda s, d: failing(s, d).select(evidence.quality_notes(F.col("failed"), _WITHHELD).alias("q")).select("q.*").groupBy("withheld_columns", "failed_checks", "notes").agg(F.count("*").alias("n")),
    f"WITH {LINES_SQL}, {_FAILED_SQL}, s AS (SELECT list_sort(failed) AS failed_checks FROM f) SELECT {list(_WITHHELD)} AS withheld_columns, failed_checks, list_concat(['{evidence.TIMING_NOTE}'], list_filter([{_NOTES_SQL} for x in failed_checks], lambda x: x IS NOT NULL)) AS notes, count(*) AS n FROM s GROUP BY ALL")


def damaged(s, d):
    """Packs of which some have an old version, a distribution that doesn't sum to one, or a banned word."""
    k = F.substring("detection_id", 5, 20).cast("long")
    p = packed(s, d).withColumn("schema_version", F.when(k % 5 == 0, "1.0").otherwise(F.col("schema_version"))).withColumn("causal_path", F.when(k % 7 == 0, "the GNN says so"))
    halved = F.transform_values(F.col("detection.class_distribution"), lambda _, x: F.when(k % 11 == 0, x / 2).otherwise(x))
    return p.withColumn("detection", F.col("detection").withField("class_distribution", halved))


add("v5_validity", lambda s, d: evidence.validity(damaged(s, d)).groupBy("valid", "version_ok", "sums_to_one", "vocabulary_ok").agg(F.count("*").alias("n")), f"WITH {DET_SQL}, v AS (SELECT o_orderkey % 5 <> 0 AS version_ok, o_orderkey % 11 <> 0 AS sums_to_one, o_orderkey % 7 <> 0 AS vocabulary_ok FROM dt) SELECT version_ok AND sums_to_one AND vocabulary_ok AS valid, version_ok, sums_to_one, vocabulary_ok, count(*) AS n FROM v GROUP BY ALL")
add("v6_measured", lambda s, d: table(s, d, "part").select("p_partkey", facts.measured(F.when(F.col("p_size") == 7, float("nan")).otherwise(F.col("p_size") / 8)).alias("m")), "SELECT p_partkey, CASE WHEN p_size <> 7 THEN round(p_size / 8, 4) END AS m FROM part")
add("v10_evidence_summary", lambda s, d: rounded(evidence.summary(packed(s, d)), "mean_abs", "share"), f"WITH {DET_SQL}, c AS (SELECT unnest(['IN_BYTES', 'PROTOCOL', 'L4_DST_PORT']) AS feature, unnest([o_totalprice / 1e5 - 4.2, o_custkey % 7 - 3, (o_orderkey % 5 - 2) / 2]) AS v FROM dt) SELECT feature, count(*) AS packs, round(avg(abs(v)), 6) AS mean_abs, count(*) FILTER (v > 0) AS raises, count(*) FILTER (v <= 0) AS lowers, 1.0::DOUBLE AS share FROM c GROUP BY 1")
_FAMILY_SQL = "g AS (SELECT unnest(['all', CASE WHEN o_orderpriority = '5-LOW' THEN 'false positives' ELSE 'true attacks' END, 'family ' || o_orderpriority]) AS \"group\", o_custkey % 100 / 100 AS w FROM dt)"
add("v10b_weights", lambda s, d: rounded(evidence.weight_summary(packed(s, d), "5-LOW"), "mean", "std", "min", "max", "share_above_half", "p25", "median", "p75"),
    f"WITH {DET_SQL}, {_FAMILY_SQL} SELECT \"group\", count(*) AS packs, count(w) AS n, round(avg(w), 6) AS mean, round(stddev_pop(w), 6) AS std, min(w) AS min, max(w) AS max, round(avg((w > 0.5)::INT), 6) AS share_above_half, round(quantile_cont(w, 0.25), 6) AS p25, round(quantile_cont(w, 0.5), 6) AS median, round(quantile_cont(w, 0.75), 6) AS p75 FROM g GROUP BY 1")
add("v10c_named", lambda s, d: rounded(evidence.named_summary(packed(s, d), "5-LOW"), "share_correct"),
    f"WITH {DET_SQL}, m AS (SELECT unnest(CASE WHEN o_orderpriority = '5-LOW' THEN ['5-LOW'] ELSE [o_orderpriority, 'all attacks'] END) AS family, o_orderpriority AS t, predicted, conf FROM dt JOIN pd USING (o_orderkey)), c AS (SELECT family, predicted, count(*) AS n, count(*) FILTER (t = predicted) AS hit, count(*) FILTER (conf < 0.9) AS u FROM m GROUP BY ALL) SELECT family, sum(n)::BIGINT AS n, sum(hit)::BIGINT AS correct, round(sum(hit) / sum(n), 6) AS share_correct, sum(u)::BIGINT AS ambiguous, list(predicted || ':' || n ORDER BY n DESC, predicted) AS named_as FROM c GROUP BY 1")
add("v10d_features_by_family", lambda s, d: evidence.features_by_family(packed(s, d), 2, 2),
    f"WITH {DET_SQL}, c AS (SELECT o_orderkey, o_orderpriority AS family, unnest(['IN_BYTES', 'PROTOCOL', 'L4_DST_PORT']) AS feature, unnest(['IN_BYTES', 'PROTOCOL=6', 'L4_DST_PORT_bucket=1']) AS name, unnest([o_totalprice / 1e5 - 4.2, o_custkey % 7 - 3, (o_orderkey % 5 - 2) / 2]) AS v FROM dt), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(v) DESC, name) AS r FROM c), n AS (SELECT family, feature, count(*) AS n FROM r WHERE r <= 2 GROUP BY ALL) SELECT family, list(feature ORDER BY n DESC, feature)[1:2] AS features FROM n GROUP BY 1")
add("v11_outcomes", lambda s, d: detections(s, d).select(facts.outcome(F.col("y"), F.col("family") == facts.predicted(F.col("distribution")), facts.margin(F.col("score"), F.col("threshold"))["band"] == "narrow").alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n")), f"WITH {DET_SQL} SELECT CASE WHEN y = 1 AND predicted = o_orderpriority THEN 'attack_right_family' WHEN y = 1 THEN 'attack_wrong_family' WHEN {_BAND} = 'narrow' THEN 'false_positive_borderline' ELSE 'false_positive_clear' END AS outcome, count(*) AS n FROM dt JOIN pd USING (o_orderkey) GROUP BY 1")
add("v12_fp_margins", lambda s, d: detections(s, d).where("y = 0").agg(F.count_if(facts.margin(F.col("score"), F.col("threshold"))["band"] == "narrow").alias("borderline"), F.count("*").alias("n")), f"WITH {DET_SQL} SELECT count(*) FILTER ({_BAND} = 'narrow') AS borderline, count(*) AS n FROM dt WHERE y = 0")
add("t2_top_features", lambda s, d: detections(s, d).select("row_id", F.explode(facts.top_features(F.col("contributions"), 2)).alias("f")).select("row_id", "f.name", "f.direction"), f"WITH {DET_SQL}, c AS (SELECT o_orderkey AS row_id, unnest(['IN_BYTES', 'PROTOCOL=6', 'L4_DST_PORT_bucket=1']) AS name, unnest([o_totalprice / 1e5 - 4.2, o_custkey % 7 - 3, (o_orderkey % 5 - 2) / 2]) AS v FROM dt), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(v) DESC, name) AS r FROM c) SELECT row_id, name, CASE WHEN v > 0 THEN 'raised' ELSE 'lowered' END AS direction FROM r WHERE r <= 2")
_W = [0.1 * ((i * 7) % 11 - 5) for i in range(64)]
add("v7_linear_attribution", lambda s, d: table(s, d, "embeddings").select("vec_id", evidence.linear_attribution(F.transform("embedding", lambda x: x.cast("double")), _W).alias("a")).select("vec_id", F.round(F.aggregate("a", F.lit(0.0), lambda t, x: t + x), 6).alias("logit")), "SELECT vec_id, round(list_sum([embedding[i + 1]::DOUBLE * 0.1 * ((i * 7) % 11 - 5) for i in range(64)]), 6) AS logit FROM embeddings")
add("v8_deletion", lambda s, d: rounded(evidence.deletion_report(evidence.deletion(table(s, d, "embeddings").select("vec_id", evidence.linear_attribution(F.transform("embedding", lambda x: x.cast("double")), _W).alias("a")), "a", "vec_id")), "share_named_larger", "still_flagged_named", "still_flagged_random", "median_drop_named", "median_drop_random"),
    """WITH c AS (SELECT vec_id, unnest(range(64)) AS i, unnest([embedding[i + 1]::DOUBLE * (0.1::DOUBLE * ((i * 7) % 11 - 5)) for i in range(64)]) AS c FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, i) AS r FROM c),
    s AS (SELECT *, row_number() OVER (PARTITION BY vec_id, r <= 5 ORDER BY md5('0:' || vec_id || ':' || i)) AS s FROM r), d AS (SELECT vec_id, sum(c) AS logit, sum(c) FILTER (r <= 5) AS dn, sum(c) FILTER (r > 5 AND s <= 5) AS dr FROM s GROUP BY 1)
    SELECT count(*) AS n, round(avg((dn > dr)::INT), 6) AS share_named_larger, count(*) FILTER (logit >= 0) AS n_flagged, round(avg((logit - dn >= 0)::INT) FILTER (logit >= 0), 6) AS still_flagged_named, round(avg((logit - dr >= 0)::INT) FILTER (logit >= 0), 6) AS still_flagged_random, round(quantile_cont(dn, 0.5), 6) AS median_drop_named, round(quantile_cont(dr, 0.5), 6) AS median_drop_random FROM d""")

# Reports: documents as report text, the document before as evidence.


def reports(s, d):
    docs = table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("evidence"))
    return docs.join(before, "doc_id", "left")


add("r1_entities", lambda s, d: reports(s, d).select("doc_id", text.entities(F.col("text")).alias("e")).select("doc_id", F.size("e.ips").alias("n_ips"), F.size("e.mitre").alias("n_mitre")), r"SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b')))::INT AS n_ips, len(list_distinct(regexp_extract_all(text, '\bT\d{4}(?:\.\d{3})?\b')))::INT AS n_mitre FROM documents")
add("r3_groundedness", lambda s, d: reports(s, d).select("doc_id", text.groundedness(text.entities(F.col("text")), text.evidence_entities(F.coalesce("evidence", F.lit("")))).alias("g")).select("doc_id", "g.grounded", "g.n_claims", "g.fabricated_ips"))
add("u3_claimed_minus_supplied", lambda s, d: reports(s, d).select("doc_id", F.array_sort(F.array_except(text.found(F.col("text"), text.IPV4), text.found(F.coalesce("evidence", F.lit("")), text.IPV4))).alias("extra")), r"WITH e AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b')) AS x FROM documents) SELECT a.doc_id, list_sort(list_filter(a.x, lambda v: NOT list_contains(coalesce(b.x, []), v))) AS extra FROM e a LEFT JOIN e b ON b.doc_id + 1 = a.doc_id")
add("r4_hedges", lambda s, d: reports(s, d).select("doc_id", text.conveyed(F.col("text"), text.HEDGES, F.col("doc_id") % 2 == 0).alias("conveyed")), "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN " + " OR ".join(f"contains(lower(text), '{h}')" for h in text.HEDGES) + " END AS conveyed FROM documents")
add("r5_borderline_words", lambda s, d: reports(s, d).select("doc_id", F.size(text.words_in(F.col("text"), text.BORDERLINE_WORDS)).alias("n")), "SELECT doc_id, (" + " + ".join(f"contains(lower(text), '{h}')::INT" for h in text.BORDERLINE_WORDS) + ")::INT AS n FROM documents")
add("r6_degenerate", lambda s, d: reports(s, d).select("doc_id", text.is_degenerate(F.col("text")).alias("degenerate")), r"SELECT doc_id, len(regexp_extract_all(text, '\S+')) > 0 AND (len(regexp_extract_all(text, '[A-Za-z]{2,}')) / len(regexp_extract_all(text, '\S+')) < 0.4 OR (length(text) - length(replace(text, '.', ''))) / greatest(length(text), 1) > 0.2) AS degenerate FROM documents")
add("r7_leaks_and_jargon", lambda s, d: reports(s, d).select("doc_id", text.leaked(F.col("text")).alias("leaked"), (F.size(text.words_in(F.col("text"), text.JARGON)) == 0).alias("clean")), r"SELECT doc_id, regexp_matches(lower(text), '<think>|</think>|\bthe user (wants|asks|is asking)\b|\blet me (think|draft|write the)\b|\bmust not calculate\b') AS leaked, NOT (" + " OR ".join(f"contains(lower(text), '{h}')" for h in text.JARGON) + ") AS clean FROM documents")
add("r9_features_cited", lambda s, d: reports(s, d).select("doc_id", text.cites_feature(F.col("text"), "the_and", {"and": ("and", "und")}).alias("cited")), r"WITH z AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, contains(t, 'the_and') OR contains(t, 'the and') OR len(list_filter([regexp_extract_all(x, '[a-z0-9]+') for x in regexp_split_to_array(t, '[.!?\n]+')], lambda w: list_contains(w, 'the') AND (list_contains(w, 'and') OR list_contains(w, 'und')))) > 0 AS cited FROM z")
_CITED = ["the_in", "and_out", "la_to", "DST_win"]


def cited_sql(column):
    """Whether sentences ``w`` of text ``t`` cite a column."""
    need = [text.TOKEN_WORDS.get(p, (p,)) for p in column.lower().split("_")]
    all_parts = " AND ".join("(" + " OR ".join(f"list_contains(w, '{x}')" for x in words) + ")" for words in need if words)
    low = column.lower()
    return f"(contains(t, '{low}') OR contains(t, '{low.replace('_', ' ')}') OR len(list_filter(ws, lambda w: {all_parts})) > 0)"


def cited(s, d):
    shown = F.when(F.col("doc_id") % 3 > 0, F.array(*[F.lit(c) for c in _CITED])).when(F.col("doc_id") % 2 > 0, F.array(F.lit("la_to"))).otherwise(F.array().cast("array<string>"))
    return reports(s, d).select("doc_id", text.citations(F.col("text"), shown, _CITED).alias("c")).select("doc_id", "c.coverage", "c.cites_none", "c.cited")


add("r9b_citations", cited, rf"""WITH z AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), y AS (SELECT doc_id, t, [regexp_extract_all(x, '[a-z0-9]+') for x in regexp_split_to_array(t, '[.!?\n]+')] AS ws, CASE WHEN doc_id % 3 > 0 THEN {_CITED} WHEN doc_id % 2 > 0 THEN ['la_to'] ELSE [] END AS own FROM z),
    x AS (SELECT doc_id, own, list_filter([{', '.join(f"CASE WHEN {cited_sql(c)} THEN '{c}' END" for c in _CITED)}], lambda c: c IS NOT NULL AND list_contains(own, c)) AS hit FROM y)
    SELECT doc_id, CASE WHEN len(own) > 0 THEN round(len(hit) / len(own), 4) END AS coverage, CASE WHEN len(own) > 0 THEN len(hit) = 0 END AS cites_none, CASE WHEN len(own) > 0 THEN hit END AS cited FROM x""")


def runs(s, d):
    """Conversations as runs: role is the model, the turn the prompt, the conversation the detection."""
    c = table(s, d, "conversations")
    return c.select(F.col("role").alias("model"), F.when(F.col("turn") < 2, "v1").otherwise("v2").alias("prompt"), F.col("conv_id").alias("detection_id"), (F.length("text") / 100).alias("score"), (F.col("turn") % 3 != 1).alias("ok"), F.length("text").cast("double").alias("latency"), F.when(F.col("conv_id") % 50 != 7, F.length("text") * 2).alias("cost"), F.length("text").alias("tokens"), F.size(F.split("text", " ")).alias("words"), (F.col("conv_id") % 3 == 0).alias("is_fp"), (F.col("conv_id") % 5 == 0).alias("ambiguous"), F.col("turn").alias("seed"))


RUNS_SQL = "rn AS (SELECT role AS model, CASE WHEN turn < 2 THEN 'v1' ELSE 'v2' END AS prompt, conv_id AS detection_id, length(text) / 100 AS score, turn % 3 <> 1 AS ok, length(text)::DOUBLE AS latency, CASE WHEN conv_id % 50 <> 7 THEN length(text) * 2 END AS cost, length(text) AS tokens, len(string_split(text, ' ')) AS words, conv_id % 3 = 0 AS is_fp, conv_id % 5 = 0 AS ambiguous, turn AS seed FROM conversations)"
add("r15_token_medians", lambda s, d: rounded(study.token_medians(runs(s, d)), "tokens", "words", "tokens_per_word"), f"WITH {RUNS_SQL} SELECT model, round(quantile_cont(tokens, 0.5), 6) AS tokens, round(quantile_cont(words, 0.5), 6) AS words, round(quantile_cont(tokens / words, 0.5), 6) AS tokens_per_word FROM rn GROUP BY 1")
add("r16_paired_prompts", lambda s, d: rounded(study.paired_prompts(runs(s, d).groupBy("model", "prompt", "detection_id").agg(F.max("score").alias("score")), "v1", "v2"), "mean_one", "mean_two", "gain"), f"WITH {RUNS_SQL}, g AS (SELECT model, prompt, detection_id, max(score) AS score FROM rn GROUP BY ALL) SELECT a.model, count(*) AS n, round(avg(a.score), 6) AS mean_one, round(avg(b.score), 6) AS mean_two, round(avg(b.score - a.score), 6) AS gain FROM g a JOIN g b ON a.model = b.model AND a.detection_id = b.detection_id AND a.prompt = 'v1' AND b.prompt = 'v2' GROUP BY 1")
add("j8_paired_reports", lambda s, d: rounded(study.paired_reports(runs(s, d).groupBy("model", "prompt", "detection_id").agg(F.max("score").alias("score")), "v1", "v2"), "x", "y"),
    f"WITH {RUNS_SQL}, g AS (SELECT model, prompt, detection_id, max(score) AS score FROM rn GROUP BY ALL) SELECT a.model, a.detection_id, round(a.score, 6) AS x, round(b.score, 6) AS y FROM g a JOIN g b ON a.model = b.model AND a.detection_id = b.detection_id AND a.prompt = 'v1' AND b.prompt = 'v2'")
add("r17_list_price", lambda s, d: rounded(study.list_price(runs(s, d), runs(s, d).select("model").distinct().where("model <> 'system'").withColumn("price", F.length("model") * 0.001)), "all_reports", "finished", digits=4), f"WITH {RUNS_SQL} SELECT model, CASE WHEN model <> 'system' THEN round(sum(tokens * length(model) * 0.001)::DOUBLE, 4) END AS all_reports, CASE WHEN model <> 'system' THEN round(sum(CASE WHEN ok THEN tokens * length(model) * 0.001 ELSE 0 END)::DOUBLE, 4) END AS finished FROM rn GROUP BY 1")
add("r17b_estimate", lambda s, d: rounded(study.estimate(table(s, d, "benchmark"), 0.001, 0.002), "cost", digits=4), r"SELECT count(*) AS n, round((sum(len(regexp_extract_all(text, '\S+')) * 1.35 + 400) * 0.001 + count(*) * 0.7)::DOUBLE, 4) AS cost FROM benchmark")
add("r18_rescored", lambda s, d: study.rescored(table(s, d, "labels").select(F.col("doc_id").alias("detection_id"), "quality"), table(s, d, "documents").select(F.col("doc_id").alias("detection_id"), text.is_degenerate(F.col("text")).alias("degenerate"))).groupBy("quality", "degenerate").agg(F.count("*").alias("n")), r"WITH z AS (SELECT doc_id, len(regexp_extract_all(text, '\S+')) > 0 AND (len(regexp_extract_all(text, '[A-Za-z]{2,}')) / len(regexp_extract_all(text, '\S+')) < 0.4 OR (length(text) - length(replace(text, '.', ''))) / greatest(length(text), 1) > 0.2) AS degenerate FROM documents) SELECT quality, degenerate, count(*) AS n FROM labels JOIN z USING (doc_id) GROUP BY 1, 2")
add("j9_reports_with_packs", lambda s, d: study.rescored(table(s, d, "labels").select(F.col("doc_id").alias("detection_id"), "toxic"), table(s, d, "documents").select(F.col("doc_id").alias("detection_id"), "lang")).groupBy("lang").agg(F.sum("toxic").cast("long").alias("toxic")), "SELECT lang, sum(toxic)::BIGINT AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY 1")
add("u5_common_detections", lambda s, d: study.common_detections(runs(s, d).where("model <> 'system'")), f"WITH {RUNS_SQL} SELECT detection_id FROM rn WHERE model <> 'system' GROUP BY 1 HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM rn WHERE model <> 'system')")
add("t6_balanced_order", lambda s, d: rounded(study.balanced_order(table(s, d, "labels"), "toxic", "doc_id").select("doc_id", "toxic", "position"), "position"), "SELECT doc_id, toxic, round((row_number() OVER (PARTITION BY toxic ORDER BY doc_id) - 0.5) / count(*) OVER (PARTITION BY toxic), 6) AS position FROM labels")
add("w6_rank_in_label", lambda s, d: rounded(study.rank_in_label(table(s, d, "labels").select("doc_id", "toxic"), "toxic", "doc_id").orderBy("position", "toxic", "doc_id"), "position"), "SELECT doc_id, toxic, row_number() OVER w AS rank, count(*) OVER (PARTITION BY toxic) AS n_label, round((row_number() OVER w - 0.5) / count(*) OVER (PARTITION BY toxic), 6) AS position FROM labels WINDOW w AS (PARTITION BY toxic ORDER BY doc_id)")
add("t5_ranked_features", lambda s, d: evidence.summary(packed(s, d), 1).select("feature", "packs"), f"WITH {DET_SQL}, c AS (SELECT o_orderkey, unnest(['IN_BYTES', 'PROTOCOL=6', 'L4_DST_PORT_bucket=1']) AS name, unnest([o_totalprice / 1e5 - 4.2, o_custkey % 7 - 3, (o_orderkey % 5 - 2) / 2]) AS v FROM dt), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(v) DESC, name) AS r FROM c) SELECT replace(replace(regexp_extract(name, '^[^=]*'), '_bucket', ''), '_present', '') AS feature, count(*) AS packs FROM r WHERE r = 1 GROUP BY 1")
add("a11_seed_aggregate", lambda s, d: rounded(study.seed_aggregate(runs(s, d).select(F.col("model").alias("metric"), F.when(F.col("ok"), F.col("score")).alias("value"))), "mean", "std"), f"WITH {RUNS_SQL} SELECT model AS metric, round(avg(score) FILTER (ok), 6) AS mean, round(stddev_pop(score) FILTER (ok), 6) AS std, count(*) FILTER (ok) AS n FROM rn GROUP BY 1")
add("a12_transfer_pool", lambda s, d: rounded(study.transfer_pool(runs(s, d).select("model", F.col("prompt").alias("source"), F.when(F.col("seed") % 2 == 0, "v1").otherwise("v2").alias("target"), F.col("score").alias("pr_auc")), 2.0), "mean", "std"), f"WITH {RUNS_SQL} SELECT model, prompt AS source, CASE WHEN seed % 2 = 0 THEN 'v1' ELSE 'v2' END AS target, round(avg(score), 6) AS mean, round(coalesce(stddev_samp(score), 0), 6) AS std, count(*) AS n, prompt = CASE WHEN seed % 2 = 0 THEN 'v1' ELSE 'v2' END AS is_control, avg(score) <= 2 AS at_floor FROM rn GROUP BY 1, 2, 3")
add("a13_comparators", lambda s, d: study.comparators(table(s, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("pr_auc"), F.avg("p_size").alias("f1"), F.count_distinct("p_type").alias("k")).select(F.col("p_brand").alias("model"), "pr_auc", "f1", F.when(F.col("p_brand") < "Brand#4", "s").otherwise("t").alias("schema"), F.lit(0.04).alias("prevalence"), F.lit("v").alias("version")), "s", 0.04, "v", (1500.0, 25.0)).withColumns({c: F.round(c, 6) for c in ("delta_pr_auc", "delta_f1")}), "WITH b AS (SELECT p_brand AS model, avg(p_retailprice) AS pr, avg(p_size) AS f1, p_brand < 'Brand#4' AS ok FROM part GROUP BY 1) SELECT arg_max(model, (pr, model)) FILTER (ok) AS best_pr_auc, arg_max(model, (f1, model)) FILTER (ok) AS best_f1, round(1500 - max(pr) FILTER (ok), 6) AS delta_pr_auc, round(25 - max(f1) FILTER (ok), 6) AS delta_f1, list_sort(coalesce(list(model) FILTER (NOT ok), [])) AS excluded FROM b")
add("a14_rank_sum", lambda s, d: rounded(study.rank_sum(runs(s, d).select(F.col("model").alias("comparison"), F.when(F.col("prompt") == "v1", "a").otherwise("b").alias("side"), F.col("score").alias("value")), 3, 3), "u", "difference", "least_p"), f"WITH {RUNS_SQL}, r AS (SELECT model, prompt, score, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2 AS r FROM rn) SELECT model AS comparison, round(sum(r) FILTER (prompt = 'v1') - count(*) FILTER (prompt = 'v1') * (count(*) FILTER (prompt = 'v1') + 1) / 2, 6) AS u, min(score) FILTER (prompt = 'v1') > max(score) FILTER (prompt = 'v2') OR max(score) FILTER (prompt = 'v1') < min(score) FILTER (prompt = 'v2') AS separated, round(avg(score) FILTER (prompt = 'v1') - avg(score) FILTER (prompt = 'v2'), 6) AS difference, 0.1::DOUBLE AS least_p FROM r GROUP BY 1")
add("a15_reconcile", lambda s, d: study.reconcile(flows_from_events(s, d).groupBy("family").agg(F.count("*").alias("n")), flows_from_events(s, d).where("row_id <> 17").groupBy("family").agg(F.count("*").alias("n")), ["family"]), "SELECT event_type AS family, count(*) AS n_now, count(*) - 1 AS n_recorded FROM events WHERE event_type = (SELECT event_type FROM events WHERE event_id = 17) GROUP BY 1")
add("j7_paired_gain", lambda s, d: rounded(study.paired_gain(runs(s, d).where("model = 'user'").groupBy("seed").agg(F.avg("score").alias("value")), runs(s, d).where("ok").groupBy("seed").agg(F.avg("score").alias("value"))), "mean_gain", "min_gain", "max_gain"), f"WITH {RUNS_SQL}, a AS (SELECT seed, avg(score) AS x FROM rn WHERE model = 'user' GROUP BY 1), b AS (SELECT seed, avg(score) AS y FROM rn WHERE ok GROUP BY 1) SELECT count(*) AS n_pairs, round(avg(x - y), 6) AS mean_gain, round(min(x - y), 6) AS min_gain, round(max(x - y), 6) AS max_gain FROM a JOIN b USING (seed)")


def unseeded(s, d):
    """Two variants of which one records no seeds: paired by place."""
    g = lambda rows: rows.groupBy("seed").agg(F.avg("score").alias("value")).withColumn("place", F.col("seed").cast("long"))
    return study.paired_gain(g(runs(s, d).where("model = 'user'")), g(runs(s, d).where("ok")).withColumn("seed", F.lit(None).cast("int")), "seed", "place")


add("j7b_paired_by_place", lambda s, d: rounded(unseeded(s, d), "mean_gain", "min_gain", "max_gain"), f"WITH {RUNS_SQL}, a AS (SELECT row_number() OVER (ORDER BY seed) AS p, avg(score) AS x FROM rn WHERE model = 'user' GROUP BY seed), b AS (SELECT row_number() OVER (ORDER BY seed) AS p, avg(score) AS y FROM rn WHERE ok GROUP BY seed) SELECT count(*) AS n_pairs, round(avg(x - y), 6) AS mean_gain, round(min(x - y), 6) AS min_gain, round(max(x - y), 6) AS max_gain FROM a JOIN b USING (p)")


def kept(df):
    """``df`` as a table in the shared folder, cut from what it comes from."""
    path = scratch(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def baseline(kind, columns, host):
    def run(s, d):
        df = graph.host_features(windowed(s, d)) if host else flows_from_events(s, d)
        # Rows and scores are written once: every round of a fit and every metric reads them again.
        df = kept(dealt(split.contiguous_split(df).where("split IN ('train', 'test')").select("row_id", "split", "label", "family", "in_bytes", "dst_port", "proto", *columns[len(models.FLOW):]), "row_id"))
        model = models.fit(df.where("split = 'train'"), kind, columns)
        out = kept(models.scored(model, df.where("split = 'test'"), columns))
        curve = evaluate.curve(out)
        at = evaluate.metric_set(out, THRESHOLD)
        one = lambda df: df.select(*[F.col(c).cast("double") for c in df.columns]).unpivot([], df.columns, "metric", "value")
        return one(at).union(one(evaluate.average_precision(curve).select("pr_auc"))).union(one(evaluate.roc_auc(curve).select("roc_auc")))

    return run


add("e15_logreg_flow", baseline("logreg", models.FLOW, False))
add("e15_logreg_host", baseline("logreg", models.FLOW + models.HOST, True))
add("e15_forest_host", baseline("forest", models.FLOW + models.HOST, True))
add("e15_boosted_host", baseline("gbt", models.FLOW + models.HOST, True))


def compared(s, d):
    """Seed means of six model and feature pairs on contiguous splits; twins are rows that train has too."""
    df = graph.host_features(windowed(s, d))
    df = split.contiguous_split(df)
    df = quality.filtered_twins(df.where("split IS NOT NULL"), ["src", "dst", "dst_port", "proto"])
    return models.seed_means(models.compare(df, scratch(s, "fits"), rounds=5)).select("model", "features", "rows_at", "novel_only", "n_seeds", *[F.round(c, 4).alias(c) for c in ("pr_auc", "pr_auc_std", "roc_auc", "f1", "recall", "fpr_at_95")])


add("e15b_baselines", compared)
add("q22_saturation", lambda s, d: models.saturation(flows_from_events(s, d), models.FLOW))


def shapes(s, d):
    """Result documents of unlike shapes, written one a file: some lack ``cost``, some have it NULL or as text, some have a
    ``note``; a few have no entries."""
    c = table(s, d, "conversations").withColumn("doc", F.expr("conv_id div 25"))
    entry = F.struct("conv_id", "turn", F.length("text").alias("value"), F.when(F.col("turn") % 2 == 0, F.struct(F.lit("x").alias("kind"))).alias("more"))
    docs = c.groupBy("doc", "role").agg(F.collect_list(entry).alias("runs")).withColumn("model", F.concat_ws("-", "role", "doc"))
    cost = F.col("doc") * 0.5
    of = {0: F.struct("model", "runs", cost.alias("cost")), 1: F.struct("model", "runs", F.lit(None).cast("double").alias("cost")), 2: F.struct("model", "runs", F.lit("unknown").alias("cost"), F.lit("late").alias("note")), 3: F.struct("model", "runs"), 4: F.struct("model", cost.alias("cost"))}
    text = F.lit(None).cast("string")
    for k, doc in of.items():
        text = F.when(F.col("doc") % 5 == k, F.to_json(doc, {"pretty": "true", "ignoreNullFields": "false"})).otherwise(text)
    folder = scratch(s, "shapes")
    docs.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return read_shapes(s, folder)


def shaped(s, d):
    rows = entries(shapes(s, d), "runs", {"turn": "int", "value": "long", "more.kind": "string", "missing": "string"}, {"model": "string", "cost": "double", "note": "string"})
    return rows.groupBy("model", "cost", "note").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.count("`more.kind`").alias("kinds"), F.count("missing").alias("missing"))


add("s8_results_scan", shaped, "WITH c AS (SELECT conv_id // 25 AS doc, role, turn, length(text) AS value FROM conversations) SELECT role || '-' || doc AS model, CASE WHEN doc % 5 = 0 THEN doc * 0.5::DOUBLE END AS cost, CASE WHEN doc % 5 = 2 THEN 'late' END AS note, count(*) AS n, sum(value)::BIGINT AS total, count(*) FILTER (turn % 2 = 0) AS kinds, 0::BIGINT AS missing FROM c WHERE doc % 5 <> 4 GROUP BY ALL")
add("a10b_five_numbers_empty", lambda s, d: rounded(profile.five_numbers(runs(s, d).withColumn("score", F.when(F.col("model") != "system", F.col("score"))), "score", "model"), "mean", "std", "p25", "median", "p75"), f"WITH {RUNS_SQL} SELECT model, n, round(mean, 6) AS mean, round(std, 6) AS std, min, round(p25, 6) AS p25, round(median, 6) AS median, round(p75, 6) AS p75, max FROM (SELECT model, {five_sql('x')} FROM (SELECT model, CASE WHEN model <> 'system' THEN score END AS x FROM rn) GROUP BY 1)")
