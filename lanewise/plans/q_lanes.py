"""Aggregations, windows and lane inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lanewise.operators import aggregates, fusion, intervals, pano, relational, windows
from lanewise.plans.adapters import Registry, sql, table, v_edge, v_graph, v_map, v_track

QUERIES = Registry()
q = QUERIES.add
ORDER = ["ofs", "pid", "rid", "tie"]
_O = "ORDER BY ofs, pid, rid, tie"

_FILTERED = f"""pos AS (SELECT * FROM v_map WHERE lane_num > 0),
st AS (SELECT *, avg(lane_num) OVER (PARTITION BY eid) AS m, stddev_samp(lane_num) OVER (PARTITION BY eid) AS s, min(lane_num) OVER (PARTITION BY eid) AS lo, max(lane_num) OVER (PARTITION BY eid) AS hi FROM pos),
far AS (SELECT *, coalesce(lo <> hi AND NOT (lane_num > m - 2 * s AND lane_num < m + 2 * s), FALSE) AS is_far FROM st),
nb AS (SELECT eid, ofs, lane_num, lag(lane_num) OVER (PARTITION BY eid {_O}) AS prev, lead(lane_num) OVER (PARTITION BY eid {_O}) AS nxt FROM pos),
broken AS (SELECT DISTINCT eid, ofs FROM nb WHERE prev IS DISTINCT FROM lane_num AND nxt IS DISTINCT FROM lane_num),
flt AS (SELECT eid, rid, pid, ofs, lane_num, tie, TRUE AS outlier FROM v_map WHERE lane_num <= 0 UNION ALL SELECT far.eid, rid, pid, far.ofs, lane_num, tie, is_far OR broken.eid IS NOT NULL FROM far LEFT JOIN broken ON broken.eid = far.eid AND broken.ofs = far.ofs)"""
_MODE = """cnt AS (SELECT eid, lane_num, count(*) AS n FROM flt WHERE NOT outlier GROUP BY 1, 2),
md AS (SELECT eid, lane_num AS mode, n AS freq FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY n DESC, lane_num) AS rn FROM cnt) WHERE rn = 1),
lanes AS (SELECT eid, CASE WHEN freq > 1 AND mode <> 0 THEN mode - 1 END AS lane_num FROM md)"""


@q(sql("v_map v_edge", f"WITH {_FILTERED}, {_MODE} SELECT e.eid, e.road_type, CASE WHEN contains(e.road_type, 'LOW') AND (l.lane_num IS NULL OR l.lane_num > 2) THEN 1 ELSE l.lane_num END AS lane_num FROM v_edge e LEFT JOIN lanes l ON l.eid = e.eid"))
def fusion_lane_inference(spark: SparkSession, d: str) -> DataFrame:
    """Lane number per edge: outlier filter, mode, join to the edges, link rule (the adapter's links are the LOW priorities)."""
    out = fusion.lanes_by_edge(v_map(spark, d), ORDER)
    edges = v_edge(spark, d).select("eid", "road_type")
    link = F.contains("road_type", F.lit("LOW")) & (F.col("lane_num").isNull() | (F.col("lane_num") > 2))
    return edges.join(out, "eid", "left").select("eid", "road_type", F.when(link, 1).otherwise(F.col("lane_num")).alias("lane_num"))


@q(sql("v_map", f"WITH {_FILTERED} SELECT eid, rid, pid, ofs, lane_num, tie, outlier FROM flt"))
def w12_lane_filter(spark: SparkSession, d: str) -> DataFrame:
    return windows.lane_filter(v_map(spark, d), ["eid"], ORDER, "lane_num")


@q("SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2")
def a01_count_per_group(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@q(sql("v_map", "WITH c AS (SELECT eid, lane_num, count(*) AS n FROM v_map GROUP BY 1, 2), m AS (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY n DESC, lane_num) AS rn FROM c) SELECT eid, CASE WHEN n > 1 AND lane_num <> 0 THEN lane_num - 1 END AS lane_num FROM m WHERE rn = 1"))
def a02_lane_mode(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.lane_mode(v_map(spark, d), ["eid"], "lane_num")


@q(sql("v_map", "WITH c AS (SELECT rid, lane_num, count(*) AS n FROM v_map GROUP BY 1, 2), m AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY n DESC, lane_num) AS rn FROM c), s AS (SELECT s_suppkey AS rid FROM supplier) SELECT s.rid, m.lane_num - 1 AS lane_num FROM s LEFT JOIN m ON m.rid = s.rid AND rn = 1"))
def a03_road_lanes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").selectExpr("s_suppkey rid").join(aggregates.road_lanes(v_map(spark, d), ["rid"], "lane_num"), "rid", "left")


@q("SELECT event_id, user_id FROM (SELECT *, avg(value) OVER (PARTITION BY user_id) AS m, stddev_samp(value) OVER (PARTITION BY user_id) AS s FROM events) WHERE s IS NULL OR (value > m - 1.5 * s AND value < m + 1.5 * s)")
def a04_within_sigmas(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.within_sigmas(table(spark, d, "events"), ["user_id"], "value", 1.5).select("event_id", "user_id")


@q(sql("v_map", "WITH c AS (SELECT rid, lane_num, count(*) AS n FROM v_map GROUP BY 1, 2), m AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY n DESC, lane_num) AS rn FROM c), d AS (SELECT rid, CAST(trunc(quantile_cont(lane_num, 0.5)) AS INTEGER) AS median FROM v_map GROUP BY 1) SELECT d.rid, median, lane_num AS mode FROM d JOIN m ON m.rid = d.rid AND rn = 1"))
def a05_median_and_mode(spark: SparkSession, d: str) -> DataFrame:
    m = v_map(spark, d)
    return m.groupBy("rid").agg(aggregates.median_int("lane_num").alias("median")).join(aggregates.value_modes(m, ["rid"], "lane_num").select("rid", "mode"), "rid")


@q(sql("v_map", f"SELECT eid, array_to_string(list(lane_num {_O}), ',') AS items FROM v_map GROUP BY 1"))
def a06_ordered_list(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.ordered_list(v_map(spark, d), ["eid"], ORDER, "lane_num")


@q(sql("v_map", "SELECT eid, count(DISTINCT rid) AS n FROM v_map GROUP BY 1 HAVING count(DISTINCT rid) > 1"))
def a07_multi_matched(spark: SparkSession, d: str) -> DataFrame:
    return v_map(spark, d).groupBy("eid").agg(F.count_distinct("rid").alias("n")).where("n > 1")


@q(sql("v_map", "SELECT rid, array_to_string(list_sort(list(DISTINCT lane_num)), ',') AS vals, coalesce(round(stddev_samp(lane_num), 6), -1) AS dev, count(*) AS n FROM v_map GROUP BY 1"))
def a08_group_summary(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.group_summary(v_map(spark, d), "rid", "lane_num")


@q(sql("v_map", "SELECT eid, pid, rid, tie, max(ofs) OVER (PARTITION BY eid) - ofs AS back FROM v_map"))
def a09_reverse_order(spark: SparkSession, d: str) -> DataFrame:
    return windows.reverse_order(v_map(spark, d), ["eid"], "ofs", F.lit(True), "back").select("eid", "pid", "rid", "tie", "back")


_PATH = "path AS (SELECT l_orderkey AS eid, l_linenumber % 3 - 1 AS step, l_partkey % 11 / 10.0::DOUBLE AS breakpoint FROM lineitem WHERE l_quantity > 20)"


def _path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_quantity > 20").selectExpr("l_orderkey eid", "l_linenumber % 3 - 1 step", "l_partkey % 11 / 10.0D breakpoint")


_COVER = f"""{_PATH}, w AS (SELECT *, count(*) OVER p AS c, sum(CASE WHEN step = 0 THEN 1 ELSE 0 END) OVER p AS z, sum(CASE WHEN step = -1 THEN 1 ELSE 0 END) OVER p AS m, max(CASE WHEN step = 0 THEN breakpoint END) OVER p AS ba, max(CASE WHEN step = -1 THEN breakpoint END) OVER p AS bb FROM path WINDOW p AS (PARTITION BY eid)),
iv AS (SELECT eid, CASE WHEN c = 2 AND z = 1 AND m = 1 THEN least(ba, bb) WHEN step = 0 THEN breakpoint ELSE 0 END AS a, CASE WHEN c = 2 AND z = 1 AND m = 1 THEN greatest(ba, bb) WHEN step = -1 THEN breakpoint ELSE 1 END AS b FROM w),
r AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY eid ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM iv),
g AS (SELECT *, sum(new) OVER (PARTITION BY eid ORDER BY a, b, new DESC ROWS UNBOUNDED PRECEDING) AS i FROM r), u AS (SELECT eid, i, min(a) AS a, max(b) AS b FROM g GROUP BY 1, 2),
cov AS (SELECT eid, round(sum(b - a), 6) AS percentage, sum(b - a) > 0.65 AS visited FROM u GROUP BY 1)"""


@q(f"WITH {_COVER} SELECT * FROM cov")
def a10_coverage(spark: SparkSession, d: str) -> DataFrame:
    return intervals.path_coverage(_path(spark, d), threshold=0.65).withColumn("percentage", F.round("percentage", 6))


@q(f"WITH {_PATH} SELECT eid, count(*) FILTER (WHERE step = -1) AS n0, count(*) FILTER (WHERE step = 0) AS n1, count(*) FILTER (WHERE step = 1) AS n2, count(*) AS nsum FROM path GROUP BY 1")
def a11_pivot_steps(spark: SparkSession, d: str) -> DataFrame:
    return relational.pivot_counts(_path(spark, d), "eid", "step", [-1, 0, 1], "n")


@q(f"WITH {_PATH} SELECT eid, coalesce(CAST(nullif(count(*) FILTER (WHERE step = -1), 0) AS VARCHAR), '--') AS a, coalesce(CAST(nullif(count(*) FILTER (WHERE step = 0), 0) AS VARCHAR), '--') AS b, coalesce(CAST(nullif(count(*) FILTER (WHERE step = 1), 0) AS VARCHAR), '--') AS c, count(*) AS nsum FROM path GROUP BY 1 HAVING count(*) > 1")
def r37_overlap_report(spark: SparkSession, d: str) -> DataFrame:
    p = relational.pivot_counts(_path(spark, d), "eid", "step", [-1, 0, 1], "n").where("nsum > 1")
    dash = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0)).cast("string"), F.lit("--"))
    return p.select("eid", dash("n0").alias("a"), dash("n1").alias("b"), dash("n2").alias("c"), "nsum")


@q(f"WITH {_COVER} SELECT o_orderkey AS eid FROM orders LEFT JOIN cov ON cov.eid = o_orderkey WHERE NOT coalesce(visited, FALSE)")
def r41_unvisited_edges(spark: SparkSession, d: str) -> DataFrame:
    cov = intervals.path_coverage(_path(spark, d), threshold=0.65)
    return v_edge(spark, d).select("eid").join(cov, "eid", "left").where(~F.coalesce("visited", F.lit(False))).select("eid")


@q("SELECT min(value) AS lo, max(value) AS hi, min(user_id) AS first_user, max(user_id) AS last_user FROM events")
def a12_bounds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.min("user_id").alias("first_user"), F.max("user_id").alias("last_user"))


_DEG = "deg AS (SELECT node, CAST(sum(i) AS BIGINT) AS indegree, CAST(sum(o) AS BIGINT) AS outdegree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM g UNION ALL SELECT dst, 1, 0 FROM g) GROUP BY 1)"


@q(sql("v_graph", f"WITH g AS (SELECT * FROM v_graph), {_DEG} SELECT * FROM deg"))
def a13_degrees(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.degrees(v_graph(spark, d))


@q(sql("v_graph", f"WITH g AS (SELECT * FROM v_graph WHERE src < dst), {_DEG} SELECT node FROM deg WHERE indegree = 0 AND outdegree <> 0"))
def a14_origins(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.degrees(v_graph(spark, d).where("src < dst")).where("indegree = 0 and outdegree <> 0").select("node")


@q("""WITH c AS (SELECT user_id AS node, event_type AS cls, sum(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END) AS n FROM events GROUP BY 1, 2)
SELECT node, CASE WHEN n = 0 THEN '' ELSE cls END AS activity FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, cls) AS rn FROM c) WHERE rn = 1""")
def a15_majority_class(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.majority_class(table(spark, d, "events").selectExpr("user_id node", "event_type cls"), "node", "cls", ("view",))


@q("SELECT label, round(avg(embedding[1]), 6) AS x, round(avg(embedding[2]), 6) AS y FROM embeddings GROUP BY 1")
def a16_centroid(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.groupBy("label").agg(F.round(F.avg(F.col("embedding")[0].cast("double")), 6).alias("x"), F.round(F.avg(F.col("embedding")[1].cast("double")), 6).alias("y"))


@q(sql("v_map", "SELECT eid, arg_min(pid, ofs * 10000000 + pid) AS src, arg_max(pid, ofs * 10000000 + pid) AS dst, count(*) AS n FROM v_map GROUP BY 1"))
def a18_line_ends(spark: SparkSession, d: str) -> DataFrame:
    m = v_map(spark, d)
    key = F.struct("ofs", "pid")
    return m.groupBy("eid").agg(F.min_by("pid", key).alias("src"), F.max_by("pid", key).alias("dst"), F.count(F.lit(1)).alias("n"))


@q("SELECT user_id, round(sum(cos(radians(event_id % 360)) * value) / sum(value), 6) AS sim FROM events GROUP BY 1")
def a19_weighted_cosine(spark: SparkSession, d: str) -> DataFrame:
    w = F.cos(F.radians(F.col("event_id") % 360)) * F.col("value")
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum(w) / F.sum("value"), 6).alias("sim"))


@q("SELECT n FROM (SELECT l_suppkey AS n FROM lineitem UNION SELECT l_linenumber FROM lineitem)")
def a20_two_columns_distinct(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.selectExpr("l_suppkey n").unionByName(li.selectExpr("cast(l_linenumber as long) n")).distinct()


@q(sql("v_map", "SELECT eid, rid, array_to_string(list_sort(list(DISTINCT pid)), ';') AS pids FROM v_map GROUP BY 1, 2"))
def a22_multimap(spark: SparkSession, d: str) -> DataFrame:
    return v_map(spark, d).groupBy("eid", "rid").agg(F.array_join(F.array_sort(F.collect_set("pid")), ";").alias("pids"))


@q(sql("v_map", "SELECT rid, min(ofs) AS a, max(ofs + lane_num) AS b FROM v_map GROUP BY 1"))
def a23_interval_extremes(spark: SparkSession, d: str) -> DataFrame:
    return v_map(spark, d).groupBy("rid").agg(F.min("ofs").alias("a"), F.max(F.col("ofs") + F.col("lane_num")).alias("b"))


@q("SELECT o_orderpriority AS cls, count(DISTINCT o_custkey) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def a24_ids_by_class(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).groupBy(F.col("o_orderpriority").alias("cls")).agg(F.count_distinct("o_custkey").alias("n"))
    return sets


# Windows


@q(sql("v_map", f"SELECT eid, pid, rid, tie, coalesce(lag(lane_num) OVER w = lane_num, FALSE) OR coalesce(lead(lane_num) OVER w = lane_num, FALSE) AS continuous FROM v_map WINDOW w AS (PARTITION BY eid {_O})"))
def w01_continuity(spark: SparkSession, d: str) -> DataFrame:
    return windows.continuous(v_map(spark, d), ["eid"], ORDER, "lane_num").select("eid", "pid", "rid", "tie", "continuous")


@q("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn = 1")
def w02_top_one(spark: SparkSession, d: str) -> DataFrame:
    return relational.keep_first(table(spark, d, "events"), ["user_id"], [F.col("value").desc(), F.col("event_id")]).select("user_id", "event_id")


@q("""SELECT user_id, array_to_string(list(event_id ORDER BY ts, event_id), ',') AS last_two FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 2 GROUP BY 1""")
def w03_top_k(spark: SparkSession, d: str) -> DataFrame:
    top = relational.top_k(table(spark, d, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 2)
    return aggregates.ordered_list(top, ["user_id"], ["ts"], "event_id").withColumnRenamed("items", "last_two")


@q(sql("v_track", """WITH a AS (SELECT *, abs(v - lag(v) OVER w) AS step, row_number() OVER w AS rn FROM v_track WINDOW w AS (PARTITION BY traj ORDER BY ts, event_id))
SELECT traj, event_id, round(sum(coalesce(step, 0)) OVER (PARTITION BY traj ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS run FROM a WHERE rn = 1 OR step <> 0"""))
def w04_running_distance(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("traj").orderBy("ts", "event_id")
    t = windows.running_distance(v_track(spark, d), ["traj"], ["ts", "event_id"], F.abs(F.col("v") - F.lag("v").over(w)), "run")
    return t.select("traj", "event_id", F.round("run", 4).alias("run"))


@q("SELECT event_id, round(CASE WHEN event_type <> 'view' THEN sqrt(value / max(value) OVER (PARTITION BY user_id)) ELSE 1 END, 6) AS p FROM events")
def w05_max_normalise(spark: SparkSession, d: str) -> DataFrame:
    e = windows.max_normalised(table(spark, d, "events"), ["user_id"], "value", F.col("event_type") != "view", "p")
    return e.select("event_id", F.round("p", 6).alias("p"))


@q(sql("v_map", "SELECT eid, pid, rid, tie, CASE WHEN eid % 2 = 0 THEN max(ofs) OVER (PARTITION BY eid) - ofs ELSE ofs END AS ord FROM v_map"))
def w06_reverse_flagged(spark: SparkSession, d: str) -> DataFrame:
    return windows.reverse_order(v_map(spark, d), ["eid"], "ofs", F.col("eid") % 2 == 0, "ord").select("eid", "pid", "rid", "tie", "ord")


@q("""WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, CAST(floor(value / 40) AS INTEGER) AS v FROM events), k AS (SELECT * FROM p WHERE v <> 0),
n AS (SELECT *, CASE WHEN lag(pos) OVER w + 1 = pos AND lag(v) OVER w = v THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY user_id ORDER BY pos)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT user_id, min(pos) AS start, max(pos) + 1 AS stop, min(v) AS value FROM r GROUP BY user_id, run""")
def w07_run_lengths(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = table(spark, d, "events").select("user_id", F.row_number().over(w).alias("pos"), F.floor(F.col("value") / 40).cast("int").alias("v"))
    return windows.run_lengths(p, ["user_id"], "pos", "v")


@q("""WITH h AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 360 END AS h FROM events), f AS (SELECT *, count(nullif(h, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM h)
SELECT event_id, coalesce(max(nullif(h, 0)) OVER (PARTITION BY user_id, g), 0) AS heading FROM f""")
def w08_fill_heading(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("h", F.expr("case when event_id % 3 = 0 then 0 else event_id % 360 end"))
    return windows.fill_zero(e, ["user_id"], ["ts", "event_id"], "h", "heading").select("event_id", "heading")


@q(sql("v_map", "WITH f AS (SELECT *, min(ofs * 100000000 + pid) OVER (PARTITION BY eid, rid) AS seen FROM v_map) SELECT eid, rid, pid, ofs, tie, row_number() OVER (PARTITION BY eid ORDER BY seen, rid, ofs, pid, tie) AS place FROM f"))
def w09_first_appearance(spark: SparkSession, d: str) -> DataFrame:
    f = v_map(spark, d).withColumn("seen", F.min(F.col("ofs") * 100000000 + F.col("pid")).over(Window.partitionBy("eid", "rid")))
    return f.select("eid", "rid", "pid", "ofs", "tie", F.row_number().over(Window.partitionBy("eid").orderBy("seen", "rid", "ofs", "pid", "tie")).alias("place"))


@q(sql("v_map", "WITH s AS (SELECT *, avg(lane_num) OVER w AS m, stddev_samp(lane_num) OVER w AS sd, min(lane_num) OVER w AS lo, max(lane_num) OVER w AS hi FROM v_map WINDOW w AS (PARTITION BY rid)) SELECT eid, pid, rid, tie, coalesce(lo <> hi AND NOT (lane_num > m - 1.25 * sd AND lane_num < m + 1.25 * sd), FALSE) AS outlier FROM s"))
def w10_sigma_outlier(spark: SparkSession, d: str) -> DataFrame:
    return windows.sigma_outlier(v_map(spark, d), ["rid"], "lane_num", 1.25).select("eid", "pid", "rid", "tie", "outlier")


@q(sql("v_map", "WITH r AS (SELECT *, dense_rank() OVER (PARTITION BY rid ORDER BY ofs) AS u, dense_rank() OVER (PARTITION BY rid ORDER BY ofs DESC) AS d FROM v_map), t AS (SELECT * FROM r WHERE u > 1 AND d > 1), m AS (SELECT *, quantile_cont(lane_num, 0.5) OVER (PARTITION BY rid) AS md FROM t) SELECT eid, pid, rid, tie FROM m WHERE abs(lane_num - md) < 2"))
def w11_trim_and_median(spark: SparkSession, d: str) -> DataFrame:
    return windows.near_median(windows.trim_ends(v_map(spark, d), ["rid"], "ofs", 1), ["rid"], "lane_num", 2).select("eid", "pid", "rid", "tie")


@q("""WITH r AS (SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), p AS (SELECT a.event_id, a.rn, b.value, b.rn AS brn, least(a.rn, 3) AS n FROM r a JOIN r b ON a.user_id = b.user_id AND b.rn BETWEEN a.rn - 2 AND a.rn)
SELECT event_id, round(sum(value * (brn - rn + n)) / (max(n) * (max(n) + 1) / 2.0), 6) AS mean FROM p GROUP BY event_id""")
def w13_recent_mean(spark: SparkSession, d: str) -> DataFrame:
    return windows.recent_mean(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 3, "m").select("event_id", F.round("m", 6).alias("mean"))


@q("SELECT event_id, (value < q1 - 0.5 * (q3 - q1)) OR (value > q3 + 0.5 * (q3 - q1)) AS outlier FROM (SELECT *, quantile_cont(value, 0.25) OVER (PARTITION BY user_id) AS q1, quantile_cont(value, 0.75) OVER (PARTITION BY user_id) AS q3 FROM events)")
def w13_iqr_fence(spark: SparkSession, d: str) -> DataFrame:
    return windows.iqr_outlier(table(spark, d, "events"), ["user_id"], "value", 0.5).select("event_id", "outlier")


@q("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events")
def w14_sequence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("seq"))


# Composite operators


_WAYS = "e AS (SELECT c_custkey AS eid, c_nationkey AS rid, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS ord FROM customer), nb AS (SELECT eid, lag(eid) OVER (PARTITION BY rid ORDER BY ord) AS prev_eid, lead(eid) OVER (PARTITION BY rid ORDER BY ord) AS next_eid FROM e)"


@q(sql("v_map", f"""WITH {_WAYS}, tg AS (SELECT eid FROM e), t AS (SELECT tg.eid, prev_eid, next_eid FROM tg JOIN nb ON nb.eid = tg.eid),
lastt AS (SELECT eid, lane_num FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY ofs DESC, tie DESC) AS k FROM v_map) WHERE k <= 2), firstt AS (SELECT eid, lane_num FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY ofs, tie) AS k FROM v_map) WHERE k <= 1),
seen AS (SELECT t.eid, l.lane_num FROM t JOIN lastt l ON l.eid = t.prev_eid UNION ALL SELECT t.eid, m.lane_num FROM t JOIN v_map m ON m.eid = t.eid UNION ALL SELECT t.eid, f.lane_num FROM t JOIN firstt f ON f.eid = t.next_eid),
c AS (SELECT eid, lane_num, count(*) AS n FROM seen GROUP BY 1, 2), m AS (SELECT eid, CASE WHEN n > 1 AND lane_num <> 0 THEN lane_num - 1 END AS by_mode FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY n DESC, lane_num) AS rn FROM c) WHERE rn = 1),
p AS (SELECT eid, max(lane_num) AS by_prev FROM v_map GROUP BY 1)
SELECT t.eid, coalesce(by_mode, by_prev) AS lane_num FROM t LEFT JOIN m ON m.eid = t.eid LEFT JOIN p ON p.eid = t.prev_eid"""))
def r29_missing_lanes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    nb = c.select(F.col("c_custkey").alias("eid"), F.lag("c_custkey").over(w).alias("prev_eid"), F.lead("c_custkey").over(w).alias("next_eid"))
    m = v_map(spark, d)
    lanes = m.groupBy("eid").agg(F.max("lane_num").alias("lane_num"))
    return fusion.infer_missing(nb.select("eid"), nb, m, lanes)


@q(sql("v_map", "WITH c AS (SELECT eid, rid, avg(tie) AS mean, min(tie) AS m FROM v_map GROUP BY 1, 2), b AS (SELECT v.eid, v.rid, min(v.pid) AS best FROM v_map v JOIN c ON c.eid = v.eid AND c.rid = v.rid AND v.tie = c.m GROUP BY 1, 2) SELECT c.eid, row_number() OVER (PARTITION BY c.eid ORDER BY mean, c.rid) AS rank, c.rid AS root, best AS rid FROM c JOIN b ON b.eid = c.eid AND b.rid = c.rid"))
def r30_candidate_ranking(spark: SparkSession, d: str) -> DataFrame:
    m = v_map(spark, d).selectExpr("eid", "rid root", "pid rid", "tie distance")
    return fusion.rank_candidates(m).select("eid", "rank", "root", "rid")


@q("""WITH p AS (SELECT l_orderkey AS rid, l_partkey AS pid, min(l_linenumber) AS ord FROM lineitem GROUP BY 1, 2), k AS (SELECT p_partkey AS pid, p_size * 7.0::DOUBLE AS mv FROM part WHERE p_partkey % 3 <> 0),
w AS (SELECT p.pid, p.rid, l.dir, k.mv, row_number() OVER (PARTITION BY p.rid ORDER BY ord, p.pid) - 1 AS ord, count(*) OVER (PARTITION BY p.rid) AS n FROM p JOIN (SELECT p_partkey AS pid, p_partkey * 13 % 360 AS dir FROM part) l ON l.pid = p.pid LEFT JOIN k ON k.pid = p.pid),
first_pano AS (SELECT *, coalesce(mv, 0) AS h FROM w WHERE ord = 0 AND n > 1),
reversed AS (SELECT rid FROM first_pano WHERE cos(radians(CASE WHEN abs(h - dir) > 180 THEN 360 - abs(h - dir) ELSE abs(h - dir) END)) + 1 < 0.15),
m AS (SELECT w.*, r.rid IS NOT NULL AS revert, CASE WHEN ord = n - 1 THEN coalesce(mv, -1) WHEN ord = 0 THEN coalesce(mv, 0) END AS h FROM w LEFT JOIN reversed r ON r.rid = w.rid)
SELECT pid, rid, CAST(CASE WHEN revert THEN n - 1 - ord ELSE ord END AS INTEGER) AS ord, CAST(CASE WHEN revert AND (h IS NULL OR h < 0) THEN (dir + 360 - 180) % 360 ELSE coalesce(h, dir) END AS INTEGER) AS move_dir, revert FROM m""")
def r33_heading_repair(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    p = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("ord")).join(part.selectExpr("p_partkey l_partkey", "p_partkey * 13 % 360 DIR"), "l_partkey")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("ord", "l_partkey")) - 1
    panos = p.select(F.col("l_partkey").alias("PID"), F.col("l_orderkey").alias("RID"), place.alias("Order"), "DIR")
    keys = part.where("p_partkey % 3 <> 0").selectExpr("p_partkey PID", "p_size * 7.0D MoveDir")
    out = pano.repair_headings(panos, keys)
    return out.select(F.col("PID").alias("pid"), F.col("RID").alias("rid"), F.col("Order").alias("ord"), F.col("MoveDir").alias("move_dir"), "revert")


@q("""WITH o AS (SELECT o_orderkey AS id, o_custkey AS v FROM orders), n AS (SELECT l_orderkey AS id, max(l_suppkey) AS v FROM lineitem WHERE l_quantity > 40 GROUP BY 1), k AS (SELECT * FROM o WHERE id NOT IN (SELECT id FROM n))
SELECT id, v, 'https://example.invalid/' || id AS url FROM k UNION ALL SELECT id, v, 'https://example.invalid/' || id FROM n""")
def r39_update_stored(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "orders").selectExpr("o_orderkey id", "o_custkey v")
    new = table(spark, d, "lineitem").where("l_quantity > 40").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_suppkey").alias("v"))
    return relational.upsert(stored, new, ["id"]).withColumn("url", F.concat(F.lit("https://example.invalid/"), F.col("id").cast("string")))


@q("SELECT p_partkey AS pid FROM part WHERE p_partkey * 13 % 360 <> p_size * 7 AND p_size * 7 <> -1 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48)")
def r40_wrong_headings(spark: SparkSession, d: str) -> DataFrame:
    wrong = table(spark, d, "part").where("p_partkey * 13 % 360 <> p_size * 7 and p_size * 7 <> -1").selectExpr("p_partkey pid")
    return wrong.join(table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 48").selectExpr("l_partkey pid"), "pid", "left_anti")


@q("""WITH m AS (SELECT l_returnflag AS link, l_suppkey % 7 AS grp, l_linenumber AS idx, l_orderkey AS rid, l_partkey, l_extendedprice FROM lineitem), f AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY link, grp, idx) AS rn FROM (SELECT DISTINCT link, grp, idx, rid FROM m)),
p AS (SELECT o_orderkey AS rid, o_custkey AS pid, 1 AS ord FROM orders UNION ALL SELECT o_orderkey, o_custkey + 1, 2 FROM orders), r AS (SELECT f.link, f.grp, f.idx, p.rid, p.pid, p.ord, row_number() OVER (PARTITION BY p.pid ORDER BY f.link, f.grp, f.idx, p.ord, p.rid) AS k FROM f JOIN p ON p.rid = f.rid WHERE f.rn = 1)
SELECT pid FROM r WHERE k = 1 AND pid NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 1)""")
def r45_batch_regroup(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").selectExpr("l_returnflag link", "l_suppkey % 7 grp", "l_linenumber idx", "l_orderkey rid").distinct()
    o = table(spark, d, "orders")
    panos = o.selectExpr("o_orderkey rid", "o_custkey pid", "1 ord").unionByName(o.selectExpr("o_orderkey rid", "o_custkey + 1 pid", "2 ord"))
    return pano.expand_roads(m, panos, table(spark, d, "customer").where("c_nationkey = 1").selectExpr("c_custkey pid")).select("pid")


@q(sql("v_map", "WITH s AS (SELECT rid, quantile_cont(lane_num, 0.5) AS md, count(*) AS n, count(*) FILTER (WHERE lane_num = 0) AS errors FROM v_map GROUP BY 1) SELECT rid, CAST(trunc(md) AS INTEGER) AS median, n, errors FROM s WHERE errors < n"))
def r35_road_statistics(spark: SparkSession, d: str) -> DataFrame:
    g = v_map(spark, d).groupBy("rid").agg(aggregates.median_int("lane_num").alias("median"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("lane_num") == 0, 1)).alias("errors"))
    return g.where("errors < n")


@q("SELECT o_orderkey AS id, CASE WHEN o_orderkey > 100 AND n IS NOT NULL THEN CASE WHEN o_orderstatus = 'F' THEN n ELSE n * 2 END ELSE 1 END AS lanes FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def r27_rough_tune(spark: SparkSession, d: str) -> DataFrame:
    from lanewise.operators.simulation import tune_lanes

    edges = table(spark, d, "orders").selectExpr("case when o_orderkey > 100 then o_orderkey else -o_orderkey end rid", "o_orderstatus = 'F' oneway", "1 lanes")
    med = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("rid")).agg(F.max("l_linenumber").alias("median"))
    return tune_lanes(edges, med).select(F.abs("rid").alias("id"), "lanes")
