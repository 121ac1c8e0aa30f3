"""Queries over flows: profile, audits, splits, windows, graph. Each has DuckDB SQL of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidegraph.operators import encode, graph, profile, quality, rank, split, version
from tidegraph.sources import sinks, tables
from tidegraph.sources.tables import BENIGN, FLOWS_SQL, flows_from_events, table

SIZE = 100


def scratch(spark, name):
    """A new path in the folder that the driver and the executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    return f"{(base or 'file:///tmp').rstrip('/')}/{name}-{uuid.uuid4().hex}"


GAP = 20
R = 6


def rounded(df, *cols, digits=R):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def windowed(spark, d):
    return split.window_id(flows_from_events(spark, d), SIZE)


def splitted(spark, d):
    return split.contiguous_split(flows_from_events(spark, d), gap=GAP)


WINDOWED_SQL = f"{FLOWS_SQL}, wf AS (SELECT *, row_id // {SIZE} AS window_id FROM flows)"
SPLIT_SQL = f"""{FLOWS_SQL}, cnt AS (SELECT count(*) AS nn FROM flows), sf AS (SELECT flows.*, CASE
  WHEN row_id < nn * 7 // 10 - {GAP} THEN 'train' WHEN row_id >= nn * 7 // 10 + {GAP} AND row_id < nn * 8 // 10 - {GAP} THEN 'val'
  WHEN row_id >= nn * 8 // 10 + {GAP} THEN 'test' END AS split FROM flows, cnt)"""
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lines(spark, d):
    """Line items as unordered flows: returned is the attack."""
    return table(spark, d, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("int")).withColumn("family", F.col("l_returnflag"))


LINES_SQL = "li AS (SELECT *, (l_returnflag = 'R')::INT AS label, l_returnflag AS family FROM lineitem)"


def long_sql(features, keep, source):
    return " UNION ALL ".join(f"SELECT {keep}, '{c}' AS feature, {c}::DOUBLE AS value FROM {source}" for c in features)


def five_sql(value):
    return f"count({value})::BIGINT AS n, avg({value}) AS mean, stddev_pop({value}) AS std, min({value}) AS min, quantile_cont({value}, 0.25) AS p25, quantile_cont({value}, 0.5) AS median, quantile_cont({value}, 0.75) AS p75, max({value}) AS max"


def wrap(sql, ints=(), rounds=(), rest=()):
    cols = [*rest, *[f"{c}::BIGINT AS {c}" for c in ints], *[f"round({c}, {R}) AS {c}" for c in rounds]]
    return f"SELECT {', '.join(cols)} FROM ({sql})"


Q: dict = {}


def add(name, fn, sql=None):
    Q[name] = (fn, sql)


HOST_COLS = ["src_fanout", "src_distinct_ports", "src_flow_count", "src_distinct_proto", "dst_fanin", "dst_flow_count"]
_HOST_SQL = """s AS (SELECT window_id, src, count(DISTINCT dst) AS src_fanout, count(DISTINCT dst_port) AS src_distinct_ports, count(*) AS src_flow_count,
  count(DISTINCT proto) AS src_distinct_proto, sum(in_bytes) AS src_bytes_total FROM wf GROUP BY ALL),
  t AS (SELECT window_id, dst, count(DISTINCT src) AS dst_fanin, count(*) AS dst_flow_count FROM wf GROUP BY ALL)"""
add(
    "g1_windowed_host_features",
    lambda s, d: rounded(graph.host_features(windowed(s, d)).select("row_id", "window_id", *HOST_COLS, "src_bytes_total", "src_ports_per_peer"), "src_bytes_total", "src_ports_per_peer", digits=4),
    f"""WITH {WINDOWED_SQL}, {_HOST_SQL} SELECT row_id, window_id, {', '.join(HOST_COLS)}, round(src_bytes_total, 4) AS src_bytes_total,
    round(src_distinct_ports / greatest(src_fanout, 1), 4) AS src_ports_per_peer FROM wf JOIN s USING (window_id, src) JOIN t USING (window_id, dst)""",
)
add(
    "j1_host_aggregate_join",
    lambda s, d: graph.host_features(windowed(s, d)).groupBy("window_id").agg(F.sum("src_fanout").alias("sum_fanout"), F.sum("dst_fanin").alias("sum_fanin")),
    f"WITH {WINDOWED_SQL}, {_HOST_SQL} SELECT window_id, sum(src_fanout)::BIGINT AS sum_fanout, sum(dst_fanin)::BIGINT AS sum_fanin FROM wf JOIN s USING (window_id, src) JOIN t USING (window_id, dst) GROUP BY 1",
)
add("s1_projected_scan", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_quantity").where("l_quantity > 45"), "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
add("s0_row_ids", lambda s, d: tables.with_row_id(table(s, d, "orders")).select("row_id", "o_orderkey"), "SELECT o_orderkey AS row_id, o_orderkey FROM orders")
add(
    "s2_family_blocks",
    lambda s, d: split.family_blocks(flows_from_events(s, d), 500, 3000)[0].groupBy("family").agg(F.count("*").alias("n")),
    f"""WITH RECURSIVE {FLOWS_SQL}, ct AS (SELECT row_id // 500 AS block_id, family, count(*) AS n FROM flows GROUP BY ALL),
    fu AS (SELECT family, row_number() OVER (ORDER BY sum(n), family) AS i, arg_max(block_id, (n, -block_id)) AS own FROM ct GROUP BY 1),
    pk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS f UNION ALL SELECT fu.i, CASE WHEN list_has_any(pk.f, (SELECT list(ct.block_id) FROM ct WHERE ct.family = fu.family)) THEN pk.f ELSE list_append(pk.f, fu.own) END FROM pk JOIN fu ON fu.i = pk.i + 1),
    fi AS (SELECT unnest(f) AS block_id FROM (SELECT f FROM pk ORDER BY i DESC LIMIT 1)), rs AS (SELECT block_id, row_number() OVER (ORDER BY block_id) AS r FROM (SELECT DISTINCT block_id FROM ct WHERE block_id NOT IN (SELECT block_id FROM fi))),
    nn AS (SELECT count(*) AS m, least(count(*), greatest(0, (3000 - (SELECT sum(n) FROM ct WHERE block_id IN (SELECT block_id FROM fi)))::BIGINT // 500)) AS k FROM rs),
    ev AS (SELECT DISTINCT (round_even(id * (m - 1) / greatest(1, k - 1), 0))::BIGINT + 1 AS r FROM nn, range((SELECT count(*) FROM rs)) t(id) WHERE id < k)
    SELECT family, count(*) AS n FROM flows WHERE row_id // 500 IN (SELECT block_id FROM fi UNION ALL SELECT block_id FROM rs JOIN ev USING (r)) GROUP BY 1""",
)
add("s3_block_stride", lambda s, d: split.block_stride(flows_from_events(s, d), 100, 7).select("row_id"), "SELECT event_id AS row_id FROM events, (SELECT (count(*) + 99) // 100 AS b FROM events) WHERE (event_id // 100) % greatest(1, b // 7) = 0 AND event_id // 100 < greatest(1, b // 7) * 7")
add("s6_even_sample", lambda s, d: split.even_sample(flows_from_events(s, d), 777).select("row_id"), "SELECT DISTINCT floor(i * (n - 1)::DOUBLE / 776)::BIGINT AS row_id FROM range(777) t(i), (SELECT count(*) AS n FROM events)")


def rewritten(spark, df, write, read):
    """``df`` as a sink wrote it."""
    path = scratch(spark, "sink")
    write(df, path)
    return read(spark.read.schema(df.schema), path)


add("s7_json_lines", lambda s, d: rewritten(s, table(s, d, "documents").select("doc_id", "text", "lang"), sinks.write_json_lines, lambda r, p: r.json(p)), "SELECT doc_id, text, lang FROM documents")
add("s7b_csv", lambda s, d: rewritten(s, table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), sinks.write_csv, lambda r, p: r.option("header", "true").option("escape", '"').csv(p)), "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
add("s7c_metrics", lambda s, d: rewritten(s, rounded(profile.label_balance(flows_from_events(s, d)), "prevalence", "imbalance_ratio"), sinks.write_metrics, lambda r, p: r.json(p)), f"WITH {FLOWS_SQL} SELECT count(*) AS n, count(*) FILTER (label = 1) AS n_attack, count(*) FILTER (label = 0) AS n_benign, round(avg(label), 6) AS prevalence, round(count(*) FILTER (label = 0) / count(*) FILTER (label = 1), 6) AS imbalance_ratio FROM flows")
add("p3_contiguous_split", lambda s, d: splitted(s, d).groupBy("split").agg(F.count("*").alias("n"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi")), f"WITH {SPLIT_SQL} SELECT split, count(*) AS n, min(row_id) AS lo, max(row_id) AS hi FROM sf GROUP BY 1")
add(
    "p4_window_split",
    lambda s, d: split.window_split(flows_from_events(s, d), SIZE, seed=7).select("row_id", "split", "new_row_id"),
    f"""WITH n AS (SELECT count(*) // {SIZE} AS nw FROM events), w AS (SELECT i AS w, row_number() OVER (ORDER BY md5('7:' || i), i) - 1 AS r, nw FROM range((SELECT nw FROM n)) t(i), n),
    s AS (SELECT w, CASE WHEN r < nw * 7 // 10 THEN 'train' WHEN r < nw * 8 // 10 THEN 'val' ELSE 'test' END AS split, nw FROM w),
    b AS (SELECT w, split, (CASE split WHEN 'train' THEN 0 WHEN 'val' THEN nw * 7 // 10 ELSE nw * 8 // 10 END + row_number() OVER (PARTITION BY split ORDER BY w) - 1) * {SIZE} AS start FROM s)
    SELECT event_id AS row_id, split, start + event_id % {SIZE} AS new_row_id FROM events JOIN b ON event_id // {SIZE} = w""",
)
add(
    "p6_holdout_counts",
    lambda s, d: split.holdout_counts(splitted(s, d), "purchase", BENIGN),
    f"""WITH {SPLIT_SQL}, k AS (SELECT *, CASE WHEN split = 'test' THEN family IN ('purchase', 'view') ELSE family <> 'purchase' END AS kept FROM sf WHERE split IS NOT NULL)
    SELECT split, count(*) AS before, count(*) FILTER (kept) AS n_rows, count(*) FILTER (kept AND family = 'purchase') AS held_out, count(*) FILTER (kept AND family = 'view') AS benign, count(*) FILTER (NOT kept) AS removed FROM k GROUP BY 1""",
)
add(
    "p7_holdout_gates",
    lambda s, d: split.holdout_gates(splitted(s, d), BENIGN, 100, 1000),
    f"WITH {SPLIT_SQL} SELECT family, n_test, n_seen, CASE WHEN n_test < 100 THEN 'skipped' WHEN n_test < 1000 THEN 'thin' ELSE 'ok' END AS status FROM (SELECT family, count(*) FILTER (split = 'test') AS n_test, count(*) FILTER (split <> 'test') AS n_seen FROM sf WHERE split IS NOT NULL AND family <> 'view' GROUP BY 1)",
)
add(
    "p8_rewindowed",
    lambda s, d: split.rewindowed(split.holdout(splitted(s, d), "purchase", BENIGN), 50).select("row_id", "split", "window_id"),
    f"""WITH {SPLIT_SQL}, k AS (SELECT * FROM sf WHERE CASE WHEN split = 'test' THEN family IN ('purchase', 'view') WHEN split IS NOT NULL THEN family <> 'purchase' END),
    r AS (SELECT row_id, split, (row_number() OVER (PARTITION BY split ORDER BY row_id) - 1) // 50 AS window_id, count(*) OVER (PARTITION BY split) // 50 AS w FROM k) SELECT row_id, split, window_id FROM r WHERE window_id < w""",
)
add(
    "p9_middle_blocks",
    lambda s, d: split.middle_blocks(flows_from_events(s, d), 1500).select("row_id", "family"),
    f"""WITH {FLOWS_SQL}, c AS (SELECT family, count(*) AS cnt, (SELECT count(*) FROM flows) AS total FROM flows GROUP BY 1),
    t AS (SELECT *, greatest(least(round_even(1500 * cnt / total, 0)::BIGINT, cnt), least(200, cnt)) AS take FROM c),
    r AS (SELECT row_id, family, row_number() OVER (PARTITION BY family ORDER BY row_id) AS r FROM flows)
    SELECT row_id, family FROM r JOIN t USING (family) WHERE r > (cnt - take) // 2 AND r <= (cnt - take) // 2 + take""",
)
add("p10_flagged", lambda s, d: flows_from_events(s, d).where(F.col("in_bytes") / 500.0 >= 0.9).select("row_id"), "SELECT event_id AS row_id FROM events WHERE value / 500.0 >= 0.9")
add(
    "p11_pending",
    lambda s, d: split.pending(table(s, d, "documents").select(F.col("doc_id").alias("detection_id")), table(s, d, "labels").select(F.col("doc_id").alias("detection_id"), (F.col("quality") == 1).alias("ok")), retry_failed=True),
    "SELECT doc_id AS detection_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
add("w1_fixed_windows", lambda s, d: split.whole_windows(splitted(s, d), SIZE, split.contiguous_bounds(flows_from_events(s, d).count(), 0.7, 0.1, 0.2, GAP)).groupBy("split").agg(F.count_distinct("window_id").alias("n_windows"), F.count("*").alias("n")), f"WITH {SPLIT_SQL}, c AS (SELECT split, count(*) AS n FROM sf WHERE split IS NOT NULL GROUP BY 1) SELECT split, n // {SIZE} AS n_windows, n // {SIZE} * {SIZE} AS n FROM c WHERE n // {SIZE} > 0")
add("w2_window_sweep", lambda s, d: rounded(graph.window_sweep(flows_from_events(s, d), [50, 100, 250], 200), "mean_nodes", "mean_pairs", "mean_max_fanout", "share_with_attack"),
    f"""WITH {FLOWS_SQL}, n AS (SELECT count(*) AS n FROM flows), sz AS (SELECT unnest([50, 100, 250]) AS size), k AS (SELECT size, n // size AS w, least(200, n // size) AS m FROM sz, n),
    keep AS (SELECT DISTINCT size, CASE WHEN m >= w THEN i ELSE floor(i * (w - 1)::DOUBLE / (m - 1))::BIGINT END AS window_id FROM k, range(200) t(i) WHERE i < m),
    f AS (SELECT size, row_id // size AS window_id, src, dst, label FROM flows, sz SEMI JOIN keep ON keep.size = sz.size AND keep.window_id = row_id // sz.size),
    p AS (SELECT size, window_id, src, dst, sum(label) AS a FROM f GROUP BY ALL),
    h AS (SELECT size, window_id, count(DISTINCT x) AS nodes FROM (SELECT size, window_id, src AS x FROM p UNION ALL SELECT size, window_id, dst FROM p) GROUP BY ALL),
    o AS (SELECT size, window_id, max(c) AS mf FROM (SELECT size, window_id, src, count(*) AS c FROM p GROUP BY ALL) GROUP BY ALL),
    e AS (SELECT size, window_id, count(*) AS pairs, sum(a) > 0 AS att FROM p GROUP BY ALL)
    SELECT size, count(*) AS n_windows, round(avg(nodes), 6) AS mean_nodes, round(avg(pairs), 6) AS mean_pairs, round(avg(mf), 6) AS mean_max_fanout, round(avg(att::INT), 6) AS share_with_attack FROM h JOIN o USING (size, window_id) JOIN e USING (size, window_id) GROUP BY size""")
add(
    "a1_column_profile",
    lambda s, d: profile.column_profile(table(s, d, "orders")).drop("dtype"),
    "SELECT \"column\", n_null, n_unique, n_unique <= 1 AS is_constant FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_unique FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")) + ")",
)
_SHAPE = ["flows_per_pair_mean", "flows_per_pair_median", "peers_per_src_mean", "peers_per_src_median", "flows_per_src_mean", "flows_per_src_median", "density"]
add(
    "a2_graph_shape",
    lambda s, d: rounded(graph_shape_of(s, d), *_SHAPE),
    f"""WITH {FLOWS_SQL}, p AS (SELECT src, dst, count(*) AS n FROM flows GROUP BY ALL), q AS (SELECT src, count(*) AS peers, sum(n) AS f FROM p GROUP BY 1),
    h AS (SELECT count(*) AS n_hosts FROM (SELECT src FROM flows UNION SELECT dst FROM flows)),
    x AS (SELECT count(*) AS n_pairs, round(avg(n), 6) AS flows_per_pair_mean, round(quantile_cont(n, 0.5), 6) AS flows_per_pair_median, max(n) AS flows_per_pair_max, count(DISTINCT dst) AS n_dst FROM p),
    y AS (SELECT count(*) AS n_src, round(avg(peers), 6) AS peers_per_src_mean, round(quantile_cont(peers, 0.5), 6) AS peers_per_src_median, max(peers) AS peers_per_src_max, round(avg(f), 6) AS flows_per_src_mean, round(quantile_cont(f::BIGINT, 0.5), 6) AS flows_per_src_median, max(f)::BIGINT AS flows_per_src_max FROM q)
    SELECT x.*, y.*, n_hosts, round(n_pairs / (n_hosts * (n_hosts - 1)), 6) AS density, CASE WHEN n_pairs / (n_hosts * (n_hosts - 1)) > 0.5 THEN 'dense' WHEN n_pairs / (n_hosts * (n_hosts - 1)) > 0.1 THEN 'moderate' ELSE 'sparse' END AS verdict FROM x, y, h""",
)


def graph_shape_of(s, d):
    return profile.graph_shape(flows_from_events(s, d))


add("t1_top_talkers", lambda s, d: profile.top_talkers(flows_from_events(s, d)), "SELECT user_id AS src, count(*) AS flows FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
add("a4_time_verdict", lambda s, d: profile.time_verdict(table(s, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp"))), ["stamp"], ["t", "value", "user_id"], "event_id"),
    "WITH e AS (SELECT event_id, ts < lag(ts) OVER (ORDER BY event_id) AS a, value < lag(value) OVER (ORDER BY event_id) AS b, user_id < lag(user_id) OVER (ORDER BY event_id) AS c FROM events), m AS (SELECT list_filter([CASE WHEN NOT bool_or(a) THEN 't' END, CASE WHEN NOT bool_or(b) THEN 'value' END, CASE WHEN NOT bool_or(c) THEN 'user_id' END], lambda x: x IS NOT NULL) AS l FROM e) SELECT CASE WHEN len(l) > 0 THEN 'ordinal' ELSE 'none' END AS verdict, list_sort(l) AS monotone_columns FROM m")
add("a5_label_balance", lambda s, d: rounded(profile.label_balance(flows_from_events(s, d)), "prevalence", "imbalance_ratio"), f"WITH {FLOWS_SQL} SELECT count(*) AS n, count(*) FILTER (label = 1) AS n_attack, count(*) FILTER (label = 0) AS n_benign, round(avg(label), 6) AS prevalence, round(count(*) FILTER (label = 0) / count(*) FILTER (label = 1), 6) AS imbalance_ratio FROM flows")
add("a6_family_balance", lambda s, d: rounded(profile.family_balance(flows_from_events(s, d)), "share", "class_weight"), "WITH c AS (SELECT event_type AS family, count(*) AS n FROM events GROUP BY 1), w AS (SELECT *, sum(n) OVER () AS t, sum(n) OVER () / (count(*) OVER () * n) AS w FROM c) SELECT family, n, round(n / t, 6) AS share, round(w / avg(w) OVER (), 6) AS class_weight, n < 1000 AS is_rare FROM w")
add("a7_split_balance", lambda s, d: profile.split_balance(splitted(s, d)), f"WITH {SPLIT_SQL} SELECT family, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test, count(*) AS n FROM sf WHERE split IS NOT NULL GROUP BY 1")
add("a7b_balance_summary", lambda s, d: rounded(profile.balance_summary(profile.split_balance(splitted(s, d)), BENIGN), "ratio"), f"WITH {SPLIT_SQL}, c AS (SELECT family, count(*) AS n FROM sf WHERE split IS NOT NULL AND family <> 'view' GROUP BY 1) SELECT first(family ORDER BY n DESC, family DESC) AS largest, max(n) AS n_largest, first(family ORDER BY n, family) AS smallest, min(n) AS n_smallest, round(max(n) / min(n), 6) AS ratio FROM c")
add("a8_split_rates", lambda s, d: rounded(profile.split_rates(splitted(s, d)), "share", "attack_rate"), f"WITH {SPLIT_SQL} SELECT coalesce(split, 'purged') AS split, count(*) AS n, round(count(*) / any_value(nn), 6) AS share, round(avg(label), 6) AS attack_rate FROM sf, cnt GROUP BY 1")
add("a9_spread", lambda s, d: rounded(flows_from_events(s, d).groupBy("family").agg(*profile.spread("in_bytes")), "mean", "std", "min", "max", "cv"), "SELECT event_type AS family, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(stddev_pop(value) / avg(value), 6) AS cv FROM events GROUP BY 1")
add("a10_five_numbers", lambda s, d: rounded(profile.five_numbers(table(s, d, "orders"), "o_totalprice", "o_orderpriority"), "mean", "std", "p25", "median", "p75", digits=4), f"SELECT o_orderpriority, n, round(mean, 4) AS mean, round(std, 4) AS std, min, round(p25, 4) AS p25, round(median, 4) AS median, round(p75, 4) AS p75, max FROM (SELECT o_orderpriority, {five_sql('o_totalprice')} FROM orders GROUP BY 1)")
_SKEW = ["value", "q2"]


def events_num(s, d):
    return flows_from_events(s, d).withColumn("value", F.col("in_bytes")).withColumn("q2", F.pow(F.col("in_bytes"), 2))


add("q1_skew", lambda s, d: rounded(quality.skew_report(events_num(s, d), _SKEW), "skew_raw", "skew_log"),
    f"""WITH {FLOWS_SQL}, l AS (SELECT 'value' AS feature, in_bytes AS value FROM flows UNION ALL SELECT 'q2', pow(in_bytes, 2) FROM flows), p AS (SELECT feature, quantile_cont(value, 0.99999) AS hi, min(value) AS lo FROM l GROUP BY 1),
    g AS (SELECT feature, skewness(value) AS a, skewness(ln(1 + least(value, hi) - least(0, lo))) AS b FROM l JOIN p USING (feature) GROUP BY 1)
    SELECT feature, round(a, 6) AS skew_raw, round(b, 6) AS skew_log, abs(a) > 2 AND abs(b) < abs(a) / 2 AS recommend_log FROM g""")
add("q2_cohens_d", lambda s, d: rounded(quality.cohens_d(lines(s, d), LINE_FEATURES), "mean_attack", "mean_benign", "d", digits=5),
    f"""WITH {LINES_SQL}, l AS ({long_sql(LINE_FEATURES, 'label', 'li')}), g AS (SELECT feature, avg(value) FILTER (label = 1) AS m1, avg(value) FILTER (label = 0) AS m0, var_samp(value) FILTER (label = 1) AS v1, var_samp(value) FILTER (label = 0) AS v0, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0 FROM l GROUP BY 1)
    SELECT feature, round(m1, 5) AS mean_attack, round(m0, 5) AS mean_benign, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 5) AS d FROM g""")
add("q3_binned_mi", lambda s, d: rounded(quality.binned_mi(flows_from_events(s, d), ["in_bytes", "dst"], 8, 200_000), "mi"),
    f"""WITH {FLOWS_SQL}, l AS ({long_sql(['in_bytes', 'dst'], 'label', 'flows')}), q AS (SELECT feature, list_distinct(quantile_cont(value, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) AS cuts FROM l GROUP BY 1),
    b AS (SELECT feature, label, len(list_filter(cuts, lambda c: c < value)) AS bin, count(*) AS n FROM l JOIN q USING (feature) GROUP BY ALL),
    m AS (SELECT feature, n / sum(n) OVER f * ln(n * sum(n) OVER f / (sum(n) OVER fb * sum(n) OVER fl)) AS t FROM b WINDOW f AS (PARTITION BY feature), fb AS (PARTITION BY feature, bin), fl AS (PARTITION BY feature, label))
    SELECT feature, round(greatest(sum(t), 0), 6) AS mi FROM m GROUP BY 1""")
add("q4_redundant_pairs", lambda s, d: rounded(quality.redundant_pairs(lines(s, d), LINE_FEATURES, 0.5), "r"), "WITH r AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for i, a in enumerate(LINE_FEATURES) for b in LINE_FEATURES[i + 1 :]) + ") SELECT a, b, round(r, 6) AS r FROM r WHERE abs(r) >= 0.5")
add("q5_derived_check", lambda s, d: rounded(quality.derived_check(table(s, d, "lineitem").withColumn("unit", F.col("l_extendedprice") / F.col("l_quantity") * (1 + F.col("l_tax"))), "l_extendedprice", "l_quantity", "unit"), "r"), "SELECT round(corr(l_extendedprice / l_quantity, l_extendedprice / l_quantity * (1 + l_tax)), 6) AS r, count(*) AS n_compared FROM lineitem WHERE l_quantity > 0")
add("q6_flag_bits", lambda s, d: rounded(quality.flag_bits_mi(flows_from_events(s, d).withColumn("flags", F.col("dst").cast("int")), "flags", 7), "mi_whole", "mi_bits", "gain"),
    f"""WITH {FLOWS_SQL}, c AS (SELECT dst AS v, label, count(*) AS n FROM flows GROUP BY ALL),
    w AS (SELECT sum(n / tt * ln(n * tt / (nv * nl))) AS mi FROM (SELECT n, sum(n) OVER () AS tt, sum(n) OVER (PARTITION BY v) AS nv, sum(n) OVER (PARTITION BY label) AS nl FROM c)),
    e AS (SELECT bit, (v >> bit) & 1 AS o, label, sum(n) AS n FROM c, range(7) t(bit) GROUP BY ALL),
    b AS (SELECT bit, greatest(sum(n / tt * ln(n * tt / (nv * nl))), 0) AS mi FROM (SELECT bit, n, sum(n) OVER (PARTITION BY bit) AS tt, sum(n) OVER (PARTITION BY bit, o) AS nv, sum(n) OVER (PARTITION BY bit, label) AS nl FROM e) GROUP BY bit)
    SELECT round(w.mi, 6) AS mi_whole, round(s.mi, 6) AS mi_bits, round(w.mi - s.mi, 6) AS gain FROM w, (SELECT sum(mi) AS mi FROM b) s""")
_AUC_SQL = "r AS (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY value) - (n - 1) / 2 AS mid FROM c), g AS (SELECT {by}, sum(mid * pos) AS s, sum(pos) AS p, sum(n) AS n FROM r GROUP BY {by}), u AS (SELECT {by}, CASE WHEN p > 0 AND n > p THEN (s - p * (p + 1) / 2) / (p * (n - p)) END AS auc FROM g)"
add("q7_rank_auc", lambda s, d: rounded(quality.rank_auc(lines(s, d), LINE_FEATURES), "auc", "abs_auc"), f"WITH {LINES_SQL}, l AS ({long_sql(LINE_FEATURES, 'label', 'li')}), c AS (SELECT feature, value, count(*) AS n, sum(label) AS pos FROM l GROUP BY ALL), {_AUC_SQL.format(by='feature')} SELECT feature, round(auc, 6) AS auc, round(greatest(auc, 1 - auc), 6) AS abs_auc FROM u")
add("q8_shortcut_coverage", lambda s, d: rounded(quality.shortcut_coverage(flows_from_events(s, d), ["dst", "src"], BENIGN), "share"),
    f"WITH {FLOWS_SQL}, l AS ({long_sql(['dst', 'src'], 'family, label', 'flows')}), t AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, value) AS r FROM l WHERE label = 1 GROUP BY 1, 2) SELECT l.feature, family, round(avg((t.r IS NOT NULL)::INT), 6) AS share, count(*) AS n FROM l LEFT JOIN t ON t.feature = l.feature AND t.value = l.value AND r <= 2 GROUP BY 1, 2")
add("q9_zero_sparsity", lambda s, d: rounded(quality.zero_sparsity(lines(s, d), ["l_discount", "l_tax"]), "zero_fraction", "attack_rate_nonzero"), f"WITH {LINES_SQL}, l AS ({long_sql(['l_discount', 'l_tax'], 'label', 'li')}) SELECT feature, round(avg((value = 0)::INT), 6) AS zero_fraction, count(DISTINCT value) AS n_distinct, count(DISTINCT value) FILTER (value <> 0) AS n_distinct_nonzero, round(avg(label) FILTER (value <> 0), 6) AS attack_rate_nonzero FROM l GROUP BY 1")


def big_orders(s, d):
    return table(s, d, "orders").withColumn("ticks", F.col("o_totalprice") * 20000).withColumn("delta", F.col("o_totalprice") - 1000)


add("q10_wrap_signatures", lambda s, d: quality.wrap_signatures(big_orders(s, d), ["ticks", "delta", "o_totalprice"]),
    "WITH l AS (SELECT 'ticks' AS feature, o_totalprice * 20000 AS value FROM orders UNION ALL SELECT 'delta', o_totalprice - 1000 FROM orders UNION ALL SELECT 'o_totalprice', o_totalprice FROM orders), g AS (SELECT feature, count(*) FILTER (value >= 2147483648) AS ge_2_31, count(*) FILTER (abs(value - 4294967296) <= 1e6) AS near_2_32, count(*) FILTER (abs(value - 4294967.296) <= 30) AS near_wrap_seconds, count(*) FILTER (value < 0) AS negative, count(*) FILTER (NOT isfinite(value)) AS non_finite FROM l GROUP BY 1) SELECT * FROM g WHERE ge_2_31 + near_2_32 + near_wrap_seconds + negative + non_finite > 0")
add("q11_wrapped_duration", lambda s, d: big_orders(s, d).withColumns({"ms": F.col("o_totalprice") * 10, "rest": 4294966 - F.floor(F.col("o_totalprice") * 10) + F.col("o_orderkey") % 50}).where(quality.wrapped_duration("ms", "delta", "rest")).select("o_orderkey"), "SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice * 10 AS t, o_totalprice - 1000 AS i, 4294966 - floor(o_totalprice * 10) + o_orderkey % 50 AS r FROM orders) WHERE abs(t + i - 4294967.296) <= 2 OR abs(t + r - 4294967.296) <= 2 OR (t > 4294967.296 - 30000 AND t <= 4294968.296)")
_ROLES = {"in_bytes": "l_extendedprice", "in_pkts": "l_quantity", "longest_pkt": "l_partkey", "max_pkt": "l_partkey", "shortest_pkt": "l_suppkey", "dst_port": "l_orderkey", "rate": "l_discount"}


def failing(s, d):
    df = lines(s, d)
    return df.withColumn("failed", quality.failed_rules(df.columns, _ROLES))


_FAILED_SQL = """f AS (SELECT *, list_filter([CASE WHEN l_quantity = 0 AND l_extendedprice > 0 THEN 'in_bytes_without_packets' END, CASE WHEN l_quantity > 0 AND l_extendedprice < 20 * l_quantity THEN 'in_bytes_below_20_per_packet' END,
  CASE WHEN l_partkey < l_suppkey THEN 'longest_below_shortest' END, CASE WHEN l_partkey > 65535 THEN 'ip_packet_over_65535' END, CASE WHEN l_orderkey < 0 OR l_orderkey > 65535 THEN 'l4_dst_port_out_of_range' END,
  CASE WHEN l_discount IS NULL OR NOT isfinite(l_discount) OR l_discount < 0 THEN 'src_to_dst_second_bytes_non_finite_or_negative' END], lambda x: x IS NOT NULL) AS failed FROM li)"""
add("q12_validity_flags", lambda s, d: failing(s, d).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "failed"), f"WITH {LINES_SQL}, {_FAILED_SQL} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, failed FROM f")
add("q13_flag_incidence", lambda s, d: rounded(quality.flag_incidence(failing(s, d), "family"), "share"), f"WITH {LINES_SQL}, {_FAILED_SQL}, s AS (SELECT family, count(*) AS t FROM f GROUP BY 1) SELECT flag, family, count(*) AS n, round(count(*) / any_value(t), 6) AS share FROM (SELECT family, unnest(failed) AS flag FROM f) JOIN s USING (family) GROUP BY 1, 2")
add("q14_family_auc", lambda s, d: rounded(quality.family_auc(lines(s, d), LINE_FEATURES, ["A", "N", "R"], 3), "auc", "abs_auc"),
    f"WITH {LINES_SQL}, l AS ({long_sql(LINE_FEATURES, 'family AS ff', 'li')}), k AS (SELECT unnest(['A', 'N', 'R']) AS family), c AS (SELECT family, feature, value, count(*) AS n, count(*) FILTER (ff = family) AS pos FROM l, k GROUP BY ALL), {_AUC_SQL.format(by='family, feature')}, z AS (SELECT *, greatest(auc, 1 - auc) AS abs_auc, row_number() OVER (PARTITION BY family ORDER BY greatest(auc, 1 - auc) DESC, feature)::INT AS rank FROM u) SELECT family, feature, round(auc, 6) AS auc, round(abs_auc, 6) AS abs_auc, rank, abs_auc >= 0.95 AS is_leak FROM z WHERE rank <= 3")
add("q15_label_disagreement", lambda s, d: quality.label_disagreement(flows_from_events(s, d).withColumn("label", F.when(F.col("dst") == 5, 1).otherwise(F.col("label"))), BENIGN), f"WITH {FLOWS_SQL} SELECT count(*) FILTER ((dst = 5 OR label = 1) <> (family <> 'view')) AS n_disagree, count(*) AS n FROM flows")
add("q16_predicate_profile", lambda s, d: rounded(quality.predicate_profile(flows_from_events(s, d), F.col("dst").cast("string").startswith("1")), "share", "share_all", "attack_rate_true", "attack_rate_false"), f"WITH {FLOWS_SQL}, m AS (SELECT *, (dst::VARCHAR LIKE '1%')::INT AS p FROM flows), r AS (SELECT round(avg(p), 6) AS share_all, round(avg(label) FILTER (p = 1), 6) AS attack_rate_true, round(avg(label) FILTER (p = 0), 6) AS attack_rate_false FROM m) SELECT family, round(avg(p), 6) AS share, any_value(share_all) AS share_all, any_value(attack_rate_true) AS attack_rate_true, any_value(attack_rate_false) AS attack_rate_false FROM m, r GROUP BY 1")
add("q17_bounds", lambda s, d: quality.bounds_violations(lines(s, d), {"l_quantity": (5, 45), "l_tax": (0, 0.05)}), "SELECT 'l_quantity' AS \"column\", count(*) FILTER (l_quantity < 5 OR l_quantity > 45) AS n FROM lineitem UNION ALL SELECT 'l_tax', count(*) FILTER (l_tax < 0 OR l_tax > 0.05) FROM lineitem")
_DUP = ["src", "dst", "proto"]
add("q18_duplicate_audit", lambda s, d: quality.duplicate_audit(splitted(s, d), _DUP), f"WITH {SPLIT_SQL}, g AS (SELECT count(*) AS n, count(*) FILTER (split = 'train') AS tr, count(*) FILTER (split = 'test') AS te FROM sf GROUP BY src, dst, proto) SELECT sum(n - 1)::BIGINT AS n_duplicates, sum(te)::BIGINT AS n_test, sum(CASE WHEN tr > 0 THEN te ELSE 0 END)::BIGINT AS n_test_in_train FROM g")
add("q19_contradictory_twins", lambda s, d: quality.contradictory_twins(flows_from_events(s, d), _DUP), f"WITH {FLOWS_SQL}, m AS (SELECT src, dst, proto FROM flows GROUP BY ALL HAVING count(DISTINCT family) > 1) SELECT family, count(*) AS n_rows FROM flows SEMI JOIN m USING (src, dst, proto) GROUP BY 1")
add("q20_duplicate_of_train", lambda s, d: quality.duplicate_of_train(splitted(s, d).where("split IS NOT NULL"), _DUP).select("row_id", "split", "duplicate_of_train"), f"WITH {SPLIT_SQL}, t AS (SELECT DISTINCT src, dst, proto FROM sf WHERE split = 'train') SELECT row_id, split, split <> 'train' AND t.src IS NOT NULL AS duplicate_of_train FROM sf LEFT JOIN t USING (src, dst, proto) WHERE split IS NOT NULL")
add("q21_alignment", lambda s, d: quality.aligned(flows_from_events(s, d), flows_from_events(s, d).where("row_id % 10 <> 3").withColumn("dst", F.when(F.col("row_id") % 7 == 0, -1).otherwise(F.col("dst"))), ["src", "dst"]), "SELECT count(*) FILTER (event_id % 10 = 3) AS only_a, 0::BIGINT AS only_b, 0::BIGINT AS diff_src, count(*) FILTER (event_id % 10 <> 3 AND event_id % 7 = 0) AS diff_dst FROM events")
add("q23_prevalence_resample", lambda s, d: split.prevalence_resample(flows_from_events(s, d), 600, 0.2, 3).select("row_id"), f"WITH {FLOWS_SQL}, r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('3:' || row_id), row_id) AS r FROM flows) SELECT row_id FROM r WHERE (label = 1 AND r <= 120) OR (label = 0 AND r <= 480)")
_VERSIONED = ["src", "dst", "dst_port", "family"]


def hash_tree(s, d, changed=False):
    """The tree of the flows in blocks of 100 rows, four children a node; ``changed`` flows differ in a few rows."""
    f = flows_from_events(s, d)
    f = f.withColumn("dst", F.when(F.col("row_id") % 3777 == 5, -1).otherwise(F.col("dst"))).where("row_id <> 901") if changed else f
    return version.tree(version.block_hashes(f, _VERSIONED, 100), 4)


def data_version(s, d):
    return table(s, d, "events").groupBy().agg(F.lit(version.version(hash_tree(s, d), {"clip": 0.99999}, {"train": [0, 7]})).alias("version"))


_LEAVES_SQL = f"""{FLOWS_SQL}, lf AS (SELECT row_id // 100 AS node, count(*) AS n, md5(count(*) || ':' || bit_xor(('0x' || md5('=' || dst || '|=' || dst_port || '|=' || family || '|=' || row_id || '|=' || src)[1:15])::BIGINT)) AS hash FROM flows GROUP BY 1),
  top AS (SELECT max(node) AS last FROM lf)"""


def tree_sql(levels=12):
    """As many levels as the largest tables need; a level is there if the one below has more than one node."""
    out = [f"t0 AS (SELECT 0 AS level, node, n, hash FROM lf)"]
    for k in range(1, levels):
        out.append(f"t{k} AS (SELECT {k} AS level, node // 4 AS node, sum(n)::BIGINT AS n, md5(string_agg(node || ':' || hash, ',' ORDER BY node)) AS hash FROM t{k - 1} WHERE {k} = 1 OR (SELECT count(*) FROM t{k - 1}) > 1 GROUP BY 2)")
    return ", ".join(out) + ", tr AS (" + " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(levels)) + ")"


add("q24_fingerprint", hash_tree, f"WITH {_LEAVES_SQL}, {tree_sql()} SELECT level, node, n, hash FROM tr")
add("q24b_data_version", data_version, f"""WITH {_LEAVES_SQL}, {tree_sql()} SELECT sha256('{{"params": {{"clip": 0.99999}}, "splits": {{"train": [0, 7]}}, "table": "' || (SELECT arg_max(hash, level) FROM tr) || '"}}')[1:16] AS version""")
add("q24c_differing_blocks", lambda s, d: version.differing_blocks(hash_tree(s, d), hash_tree(s, d, True), 4), "SELECT DISTINCT event_id // 100 AS node FROM events WHERE event_id % 3777 = 5 OR event_id = 901")
add("a1b_sketched_profile", lambda s, d: profile.merged_profile(profile.sketched_profile(table(s, d, "orders"), F.col("o_orderstatus"))).select("column", "n", "n_null", "is_constant"),
    "SELECT \"column\", n, n_null, n_unique <= 1 AS is_constant FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) FILTER ({c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_unique FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")) + ")")
add("j3_seen_in_train", lambda s, d: splitted(s, d).where("split = 'test'").join(splitted(s, d).where("split = 'train'").select(*_DUP).distinct(), _DUP, "left_semi").select("row_id"), f"WITH {SPLIT_SQL} SELECT row_id FROM sf WHERE split = 'test' AND (src, dst, proto) IN (SELECT (src, dst, proto) FROM sf WHERE split = 'train')")
_SNAP = ["mean_fanout", "std_fanout", "p90_fanout", "std_flows_per_node", "density", "attack_rate"]
add("g2_snapshot_stats", lambda s, d: rounded(graph.snapshot_stats(windowed(s, d)), *_SNAP),
    f"""WITH {WINDOWED_SQL}, p AS (SELECT window_id, src, dst, count(*) AS n, sum(label) AS a FROM wf GROUP BY ALL), h AS (SELECT window_id, src AS host, n AS o, 1 AS f FROM p UNION ALL SELECT window_id, dst, 0, 0 FROM p),
    k AS (SELECT window_id, host, sum(o) AS o, sum(f) AS f FROM h GROUP BY ALL), b AS (SELECT window_id, count(*) AS nodes, count(*) FILTER (f > 0) AS active_senders, (max(f) FILTER (f > 0))::BIGINT AS max_fanout, avg(f) FILTER (f > 0) AS mean_fanout, stddev_samp(f) FILTER (f > 0) AS std_fanout, quantile_cont(f::BIGINT, 0.9) FILTER (f > 0) AS p90_fanout, stddev_samp(o) AS std_flows_per_node FROM k GROUP BY 1),
    e AS (SELECT window_id, sum(n)::BIGINT AS edges, count(*) AS pairs, sum(a)::BIGINT AS attack_edges FROM p GROUP BY 1)
    SELECT window_id, edges, pairs, attack_edges, nodes, active_senders, max_fanout, round(mean_fanout, 6) AS mean_fanout, round(std_fanout, 6) AS std_fanout, round(p90_fanout, 6) AS p90_fanout, round(std_flows_per_node, 6) AS std_flows_per_node, round(pairs / (nodes * (nodes - 1)), 6) AS density, round(attack_edges / edges, 6) AS attack_rate FROM e JOIN b USING (window_id)""")
_LOST = "window_id % 2 = 1 AND row_id % 7 = 3"
add("g3_integrity", lambda s, d: graph.integrity(windowed(s, d), graph.snapshot_stats(windowed(s, d).where(f"NOT ({_LOST})"))),
    f"""WITH {WINDOWED_SQL}, e AS (SELECT window_id, count(*) AS n, count(*) FILTER (NOT ({_LOST})) AS kn, sum(label) AS a, sum(label) FILTER (NOT ({_LOST})) AS ka FROM wf GROUP BY 1),
    h AS (SELECT window_id, count(DISTINCT host) AS h, count(DISTINCT host) FILTER (NOT lost) AS kh FROM (SELECT window_id, src AS host, {_LOST} AS lost FROM wf UNION ALL SELECT window_id, dst, {_LOST} FROM wf) GROUP BY 1)
    SELECT window_id, n = kn AS edges_kept, h = kh AS hosts_kept, a = ka AS attacks_kept, true AS ends_present FROM e JOIN h USING (window_id)""")
add("g4_node_dictionary", lambda s, d: graph.node_dictionary(flows_from_events(s, d)), f"WITH {FLOWS_SQL} SELECT host, row_number() OVER (ORDER BY host) - 1 AS node_id FROM (SELECT src AS host FROM flows UNION SELECT dst FROM flows)")
add("g4b_local_ids", lambda s, d: graph.local_ids(windowed(s, d)), f"WITH {WINDOWED_SQL} SELECT window_id, host, row_number() OVER (PARTITION BY window_id ORDER BY host) - 1 AS local_id FROM (SELECT window_id, src AS host FROM wf UNION SELECT window_id, dst FROM wf)")
_TOPO = """p AS (SELECT window_id, src, {dst} AS dst, count(*) AS n, sum(label) AS a FROM wf GROUP BY ALL), nn AS (SELECT window_id, count(DISTINCT h) AS nodes FROM (SELECT window_id, {src} AS h FROM p UNION ALL SELECT window_id, dst FROM p) GROUP BY 1),
  o AS (SELECT window_id, max(c) AS max_out_degree, stddev_pop(c) / avg(c) AS cv FROM (SELECT window_id, src, count(*) AS c FROM p GROUP BY ALL) GROUP BY 1),
  sz AS (SELECT window_id, sum(n)::BIGINT AS edges, count(*) AS pairs, sum(a) > 0 AS has_attack FROM p GROUP BY 1), bo AS (SELECT x.window_id, count(*) AS b FROM p x JOIN p y ON x.window_id = y.window_id + 1 AND x.src = y.src AND x.dst = y.dst GROUP BY 1),
  topo AS (SELECT sz.window_id, sz.edges, sz.pairs, sz.has_attack, nodes, max_out_degree, round(cv, 6) AS out_degree_cv, round(CASE WHEN v.pairs IS NOT NULL THEN coalesce(b, 0) / (sz.pairs + v.pairs - coalesce(b, 0)) END, 6) AS jaccard, round(sz.pairs / (nodes * (nodes - 1)), 6) AS density
  FROM sz JOIN nn USING (window_id) JOIN o USING (window_id) LEFT JOIN bo USING (window_id) LEFT JOIN sz v ON v.window_id = sz.window_id - 1)"""
for _scheme, _s, _d in (("ip", "src", "dst"), ("service", "src::VARCHAR", "dst || ':' || dst_port")):
    add(f"g5_topology_{_scheme}", lambda s, d, k=_scheme: rounded(graph.topology(windowed(s, d), k), "out_degree_cv", "jaccard", "density"), f"WITH {WINDOWED_SQL}, {_TOPO.format(src=_s, dst=_d)} SELECT * FROM topo")
add("g6_separation", lambda s, d: rounded(graph.separation(graph.topology(split.window_id(flows_from_events(s, d), 10))), "mean_max_out_degree", "mean_edges"), f"WITH {FLOWS_SQL}, wf AS (SELECT *, row_id // 10 AS window_id FROM flows), {_TOPO.format(src='src', dst='dst')} SELECT has_attack, count(*) AS n_windows, round(avg(max_out_degree), 6) AS mean_max_out_degree, round(avg(edges), 6) AS mean_edges FROM topo GROUP BY 1")
add("g7_scheme_sizes", lambda s, d: rounded(graph.scheme_sizes(flows_from_events(s, d)), "factor"), f"WITH {FLOWS_SQL}, a AS (SELECT count(*) AS nodes_ip FROM (SELECT src FROM flows UNION SELECT dst FROM flows)), b AS (SELECT count(*) AS nodes_service FROM (SELECT src::VARCHAR FROM flows UNION SELECT dst || ':' || dst_port FROM flows)) SELECT nodes_ip, nodes_service, round(nodes_service / nodes_ip, 6) AS factor FROM a, b")
_CTX = """b AS (SELECT window_id, {h} AS host, count(*) AS flow_count, sum(in_bytes) AS total_bytes, count(DISTINCT {p}) AS distinct_peers, count(DISTINCT dst_port) AS distinct_ports FROM wf GROUP BY ALL),
  ctx AS (SELECT *, quantile_cont(distinct_peers, 0.5) OVER (PARTITION BY window_id) AS median_fanout FROM b)"""
for _side, _h, _p in (("src", "src", "dst"), ("dst", "dst", "src")):
    add(f"g8_host_context_{_side}", lambda s, d, h=_h, p=_p: rounded(graph.host_context(windowed(s, d), h, p), "total_bytes", "median_fanout", "times_typical", digits=4), f"WITH {WINDOWED_SQL}, {_CTX.format(h=_h, p=_p)} SELECT window_id, host, flow_count, round(total_bytes, 4) AS total_bytes, distinct_peers, distinct_ports, round(median_fanout, 4) AS median_fanout, round(distinct_peers / median_fanout, 4) AS times_typical FROM ctx")


def targets(s, d):
    return windowed(s, d).where(F.col("in_bytes") / 500.0 >= 0.2)


_TARGETS_SQL = "tg AS (SELECT * FROM wf WHERE in_bytes / 500.0 >= 0.2), tc AS (SELECT DISTINCT t.row_id AS detection, t.src AS s, t.dst AS d, f.* FROM tg t JOIN wf f ON t.window_id = f.window_id AND t.row_id <> f.row_id AND (f.src IN (t.src, t.dst) OR f.dst IN (t.src, t.dst)))"
add("j5_touching", lambda s, d: graph.touching(windowed(s, d), targets(s, d)), f"WITH {WINDOWED_SQL}, {_TARGETS_SQL} SELECT detection, window_id, row_id FROM tc")
add("g9_ego_graph", lambda s, d: graph.ego_graph(windowed(s, d), targets(s, d), 28),
    f"""WITH {WINDOWED_SQL}, {_TARGETS_SQL}, n AS (SELECT detection, s, d, src, dst, h FROM (SELECT detection, s, d, row_id, src, dst, src AS h FROM tc UNION SELECT detection, s, d, row_id, src, dst, dst FROM tc) WHERE h <> s AND h <> d),
    a AS (SELECT detection, h AS host, count(*) AS flows, bool_or(s IN (src, dst)) AS x, bool_or(d IN (src, dst)) AS y FROM n GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY detection ORDER BY flows DESC, host)::INT AS rank, count(*) OVER (PARTITION BY detection) AS m FROM a)
    SELECT detection, host, flows, CASE WHEN x AND y THEN 'both' WHEN x THEN 'source' ELSE 'destination' END AS side, rank, greatest(m - 28, 0) AS n_omitted FROM r WHERE rank <= 28""")
#: Places of touching flows: those of the source by (peer, row_id), then the destination's own; drawn by start and step.
_DRAWN_SQL = f"""pl AS (SELECT *, src = s OR dst = s AS at_s, CASE WHEN src = s THEN dst WHEN dst = s THEN src WHEN src = d THEN dst ELSE src END AS peer, md5('1:' || detection) AS h, count(*) OVER (PARTITION BY detection) AS n_neighbours FROM tc),
  pn AS (SELECT *, row_number() OVER (PARTITION BY detection ORDER BY at_s DESC, peer, row_id) - 1 AS place, ('0x' || h[1:12])::BIGINT AS start, {list(graph.STEPS)}[('0x' || h[16:19])::BIGINT % {len(graph.STEPS)} + 1] AS step FROM pl),
  dw AS (SELECT detection, j, (start + j * step) % n_neighbours AS place FROM (SELECT DISTINCT detection, start, step, n_neighbours FROM pn), (SELECT unnest(range(50)) AS j) WHERE j < n_neighbours),
  rk AS (SELECT pn.*, (j + 1)::INT AS rank FROM pn JOIN dw USING (detection, place))"""
add("g11_neighbour_candidates", lambda s, d: graph.ranked_neighbours(windowed(s, d), targets(s, d), 1), f"WITH {WINDOWED_SQL}, {_TARGETS_SQL} SELECT detection, window_id, row_id, row_number() OVER (PARTITION BY detection ORDER BY md5('1:' || detection || ':' || row_id), row_id)::INT AS rank, count(*) OVER (PARTITION BY detection) AS n_neighbours FROM tc")
add("g10_neighbourhood_means", lambda s, d: rounded(graph.neighbourhood_means(windowed(s, d), ["in_bytes"]).select("row_id", "src_in_bytes_1", "dst_in_bytes_1"), "src_in_bytes_1", "dst_in_bytes_1", digits=5), f"WITH {WINDOWED_SQL}, m AS (SELECT window_id, host, avg(b) AS m FROM (SELECT window_id, src AS host, in_bytes AS b FROM wf UNION ALL SELECT window_id, dst, in_bytes FROM wf) GROUP BY ALL) SELECT row_id, round(x.m, 5) AS src_in_bytes_1, round(y.m, 5) AS dst_in_bytes_1 FROM wf JOIN m x ON x.window_id = wf.window_id AND x.host = src JOIN m y ON y.window_id = wf.window_id AND y.host = dst")
add("j4_consecutive_jaccard", lambda s, d: rounded(graph.consecutive_jaccard(split.window_id(flows_from_events(s, d), 1000)), "jaccard"), f"WITH {FLOWS_SQL}, wf AS (SELECT *, row_id // 1000 AS window_id FROM flows), {_TOPO.format(src='src', dst='dst')} SELECT window_id, jaccard FROM topo")
add("u1_distinct_hosts", lambda s, d: flows_from_events(s, d).select(F.explode(F.array("src", "dst")).alias("host")).distinct(), f"WITH {FLOWS_SQL} SELECT src AS host FROM flows UNION SELECT dst FROM flows")
add("u4_vocabulary_overlap", lambda s, d: splitted(s, d).where("split = 'train'").select("dst").distinct().join(splitted(s, d).where("split = 'test'").select("dst").distinct(), "dst"), f"WITH {SPLIT_SQL} SELECT dst FROM sf WHERE split = 'train' INTERSECT SELECT dst FROM sf WHERE split = 'test'")
add("w7_lagged_windows", lambda s, d: graph.snapshot_stats(windowed(s, d)).select("window_id", "edges", "pairs").withColumn("previous", F.col("window_id") - 1).alias("a").join(graph.snapshot_stats(windowed(s, d)).select(F.col("window_id").alias("previous"), F.col("pairs").alias("pairs_before")), "previous", "left").select("window_id", "pairs", "pairs_before"), f"WITH {WINDOWED_SQL}, p AS (SELECT window_id, count(DISTINCT (src, dst)) AS pairs FROM wf GROUP BY 1) SELECT window_id, pairs, lag(pairs) OVER (ORDER BY window_id) AS pairs_before FROM p")


def fitted(s, d):
    df = splitted(s, d).withColumn("proto_s", F.col("proto").cast("string"))
    return encode.Pipeline(["in_bytes"], ["in_bytes"], ["proto_s", "family"]).fit(df.where("split = 'train'")), df


_FIT_SQL = f"""{SPLIT_SQL}, ft AS (SELECT quantile_cont(in_bytes, 0.99999) AS hi, -least(0, min(in_bytes)) AS sh FROM sf WHERE split = 'train'),
  st AS (SELECT hi, sh, avg(ln(1 + greatest(least(in_bytes, hi) + sh, 0))) AS m, stddev_pop(ln(1 + greatest(least(in_bytes, hi) + sh, 0))) AS sd FROM sf, ft WHERE split = 'train' GROUP BY hi, sh)"""


def _params(s, d):
    p, _ = fitted(s, d)
    c = p.params["in_bytes"]
    one = table(s, d, "events").limit(1).select(F.lit("in_bytes").alias("column"), *[F.lit(x).alias(k) for k, x in (("clip_hi", c.clip_hi), ("log_shift", c.log_shift), ("mean", c.mean), ("std", c.std))])
    return rounded(one, "clip_hi", "log_shift", "mean", "std")


add("f1_fit_continuous", _params, f"WITH {_FIT_SQL} SELECT 'in_bytes' AS \"column\", round(hi, 6) AS clip_hi, round(sh, 6) AS log_shift, round(m, 6) AS mean, round(sd, 6) AS std FROM st")
_VOCAB_SQL = "vc AS (SELECT family AS value, row_number() OVER (ORDER BY count(*) DESC, family)::INT AS code FROM sf WHERE split = 'train' GROUP BY 1 HAVING count(*) >= 0.001 * (SELECT count(*) FROM sf WHERE split = 'train'))"
add("f2_fit_vocabulary", lambda s, d: encode.vocabulary(splitted(s, d).where("split = 'train'"), ["family"]), f"WITH {SPLIT_SQL}, {_VOCAB_SQL} SELECT 'family' AS \"column\", value, code FROM vc")


def _transformed(s, d):
    p, df = fitted(s, d)
    return p.transform(df)


add("f3_transform", lambda s, d: _transformed(s, d).select("row_id", F.round(F.col("in_bytes_z").cast("double"), 4).alias("z"), "family_code"), f"WITH {_FIT_SQL}, {_VOCAB_SQL} SELECT row_id, round(((ln(1 + greatest(least(in_bytes, hi) + sh, 0)) - m) / sd)::FLOAT::DOUBLE, 4) AS z, coalesce(code, 0) AS family_code FROM sf CROSS JOIN st LEFT JOIN vc ON value = family")
add("f4_port_buckets", lambda s, d: flows_from_events(s, d).withColumn("port", F.col("dst_port") * 150).groupBy(encode.bucket_port("port").alias("bucket")).agg(F.count("*").alias("n")), "SELECT CASE WHEN floor(value)::INT * 150 < 1024 THEN 0 WHEN floor(value)::INT * 150 < 49152 THEN 1 ELSE 2 END AS bucket, count(*) AS n FROM events GROUP BY 1")
add("f5_presence", lambda s, d: lines(s, d).groupBy(encode.present("l_discount").alias("present")).agg(F.count("*").alias("n")), "SELECT (l_discount <> 0)::INT AS present, count(*) AS n FROM lineitem GROUP BY 1")


def _one_hot(s, d):
    p, df = fitted(s, d)
    return p.transform(df).withColumn("hot", p.one_hot("family")).select(F.posexplode("hot").alias("code", "x")).groupBy("code").agg(F.sum("x").cast("long").alias("n"))


add("f6_one_hot", _one_hot, f"WITH {SPLIT_SQL}, {_VOCAB_SQL}, c AS (SELECT coalesce(code, 0) AS code, count(*) AS n FROM sf LEFT JOIN vc ON value = family GROUP BY 1) SELECT i::INT AS code, coalesce(n, 0)::BIGINT AS n FROM range((SELECT max(code) + 1 FROM vc)) t(i) LEFT JOIN c ON c.code = i")


def _restored(s, d):
    p, df = fitted(s, d)
    return p.restore(p.transform(df)).where(F.abs(F.col("in_bytes_restored") - F.col("in_bytes")) > F.lit(2e-3) * F.greatest(F.lit(1.0), F.col("in_bytes"))).groupBy("in_bytes_exact").agg(F.count("*").alias("n_off"))


add("f8_restore", _restored, f"""WITH {_FIT_SQL}, z AS (SELECT in_bytes AS x, hi, sh, m, sd, ((ln(1 + greatest(least(in_bytes, hi) + sh, 0)) - m) / sd)::FLOAT::DOUBLE AS z FROM sf, st), b AS (SELECT *, exp(z * sd + m) - 1 - sh AS y FROM z),
  r AS (SELECT x, least(x, hi) < hi AS in_bytes_exact, CASE WHEN abs(y - round(y)) < 1e-3 * greatest(abs(y), 1) THEN round(y) ELSE y END AS y FROM b)
  SELECT in_bytes_exact, count(*) AS n_off FROM r WHERE abs(y - x) > 2e-3 * greatest(1, x) GROUP BY 1""")
add("f10_standardised", lambda s, d: rounded(encode.standardised(splitted(s, d), ["dst"], F.col("split") == "train").select("row_id", "dst_z"), "dst_z"), f"WITH {SPLIT_SQL}, t AS (SELECT avg(ln(1 + dst)) AS m, stddev_pop(ln(1 + dst)) AS sd FROM sf WHERE split = 'train') SELECT row_id, round((ln(1 + dst) - m) / sd, 6) AS dst_z FROM sf, t")
add("j2_vocabulary_lookup", lambda s, d: encode.apply_vocabulary(splitted(s, d), encode.vocabulary(splitted(s, d).where("split = 'train'"), ["family"]), "family").select("row_id", "family_code"), f"WITH {SPLIT_SQL}, {_VOCAB_SQL} SELECT row_id, coalesce(code, 0) AS family_code FROM sf LEFT JOIN vc ON value = family")
add("f12_oov_report", lambda s, d: rounded(encode.oov_report(flows_from_events(s, d), encode.vocabulary(splitted(s, d).where("split = 'train'"), ["src", "dst"]), ["src", "dst"]), "oov_rate"),
    f"WITH {SPLIT_SQL}, l AS ({long_sql(['src', 'dst'], 'split', 'sf')}), v AS (SELECT feature, value, count(*) AS n, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, value::BIGINT::VARCHAR) AS r FROM l WHERE split = 'train' GROUP BY 1, 2 HAVING count(*) >= 0.001 * (SELECT count(*) FROM sf WHERE split = 'train')), vv AS (SELECT feature, value FROM v WHERE r <= 63), c AS (SELECT feature, value, count(*) AS n FROM l GROUP BY 1, 2) SELECT c.feature AS \"column\", round(sum(CASE WHEN vv.value IS NULL THEN n ELSE 0 END) / sum(n), 6) AS oov_rate, count(*) AS n_distinct, count(vv.value) AS n_shared, (SELECT count(*) FROM vv x WHERE x.feature = c.feature) AS vocab_size FROM c LEFT JOIN vv ON vv.feature = c.feature AND vv.value = c.value GROUP BY c.feature")
add("f11_frozen_encode", lambda s, d: encode.Pipeline(["v"], ["v"], []).fit(table(s, d, "events").select(F.col("value").alias("v"))).transform(table(s, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("v"))).select("o_orderkey", F.round(F.col("v_z").cast("double"), 4).alias("z")),
    "WITH f AS (SELECT quantile_cont(value, 0.99999) AS hi, -least(0, min(value)) AS sh FROM events), t AS (SELECT hi, sh, avg(ln(1 + least(value, hi) + sh)) AS m, stddev_pop(ln(1 + least(value, hi) + sh)) AS sd FROM events, f GROUP BY 1, 2) SELECT o_orderkey, round(((ln(1 + greatest(least(o_totalprice / 1000, hi) + sh, 0)) - m) / sd)::FLOAT::DOUBLE, 4) AS z FROM orders, t")
add("w4_global_rank", lambda s, d: rank.hash_rank(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), 5, ["o_orderkey"], ["o_orderstatus"]), "SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('5:' || o_orderkey), o_orderkey) AS rank FROM orders")
add("q20b_encoded_twins", lambda s, d: quality.filtered_twins(_transformed(s, d).withColumn("z", F.round(F.col("in_bytes_z").cast("double"), 2)).where("split IS NOT NULL"), ["z", "family_code"]).select("row_id", "split", "duplicate_of_train"),
    f"WITH {_FIT_SQL}, {_VOCAB_SQL}, e AS (SELECT row_id, split, round(((ln(1 + greatest(least(in_bytes, hi) + sh, 0)) - m) / sd)::FLOAT::DOUBLE, 2) AS z, coalesce(code, 0) AS c FROM sf CROSS JOIN st LEFT JOIN vc ON value = family WHERE split IS NOT NULL) SELECT row_id, split, split <> 'train' AND (z, c) IN (SELECT (z, c) FROM e WHERE split = 'train') AS duplicate_of_train FROM e")
