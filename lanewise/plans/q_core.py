"""Relational core: scans, predicates, joins, set operations, table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lanewise import constants as C
from lanewise.functions import geo
from lanewise.operators import filters, relational
from lanewise.plans.adapters import Registry, sql, table, v_edge, v_graph, v_map, v_point
from lanewise.sources import sinks, tables

QUERIES = Registry()
q = QUERIES.add


def _case(table: dict, key: str, default: str) -> str:
    value = lambda v: str(v).upper() if isinstance(v, bool) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {value(v)}" for k, v in table.items()) + f" ELSE {default} END"


# Sources and sinks


@q("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'O' AND o_totalprice BETWEEN 50000 AND 150000")
def s01_table_scan(spark: SparkSession, d: str) -> DataFrame:
    return tables.scan(spark, f"{d}/orders.parquet", ["o_orderkey", "o_totalprice", "o_orderstatus"], "o_orderstatus = 'O'", box=(50000.0, float("-inf"), 150000.0, float("inf")), x="o_totalprice", y="o_totalprice")


@q(sql("v_point", "SELECT id, x, y FROM v_point WHERE x >= 113.89 AND x <= 113.91 AND y >= 22.48 AND y <= 22.51"))
def s02_features_by_box(spark: SparkSession, d: str) -> DataFrame:
    return v_point(spark, d).where(geo.in_bbox("x", "y", (113.89, 22.48, 113.91, 22.51))).select("id", "x", "y")


@q("SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s03_load_nested_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", F.from_json("props", "k long")["k"].alias("k"))


@q("SELECT d.doc_id, d.n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def s23_unpredicted_queue(spark: SparkSession, d: str) -> DataFrame:
    return tables.unpredicted(table(spark, d, "documents"), tables.memo(spark, f"{d}/labels.parquet"), ["doc_id"]).select("doc_id", "n_chars")


@q("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def s10_memo_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(tables.memo(spark, f"{d}/labels.parquet"), "doc_id", "left").select("doc_id", "quality", "toxic")


@q("SELECT c_mktsegment AS name, count(*) AS n, min(c_custkey) AS first_id FROM customer GROUP BY 1")
def s11_memo_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first_id"))


_NEW = "SELECT o_orderkey + CASE WHEN o_orderkey % 10 = 0 THEN 1000000000 ELSE 0 END AS id, o_totalprice * 2 AS price, 'new' AS origin FROM orders WHERE o_orderkey % 5 = 0"


@q(f"WITH n AS ({_NEW}), s AS (SELECT o_orderkey AS id, o_totalprice AS price, 'stored' AS origin FROM orders) SELECT * FROM n UNION ALL SELECT * FROM s WHERE id NOT IN (SELECT id FROM n)")
def k02_upsert(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    new = o.where("o_orderkey % 5 = 0").selectExpr("o_orderkey + case when o_orderkey % 10 = 0 then 1000000000 else 0 end id", "o_totalprice * 2 price", "'new' origin")
    return relational.upsert(o.selectExpr("o_orderkey id", "o_totalprice price", "'stored' origin"), new, ["id"])


@q("SELECT DISTINCT l_orderkey AS id, '[' || l_linenumber || ',' || l_suppkey || ']' AS pair FROM lineitem")
def k03_store_nested_as_text(spark: SparkSession, d: str) -> DataFrame:
    return sinks.stored_form(table(spark, d, "lineitem").selectExpr("l_orderkey id", "array(cast(l_linenumber as long), l_suppkey) pair"))


@q(sql("v_map v_edge", "SELECT e.eid, e.road_type, CAST(m.lanes AS INTEGER) AS lane_num FROM v_edge e JOIN (SELECT eid, max(lane_num) AS lanes FROM v_map GROUP BY eid) m ON m.eid = e.eid"))
def k12_publish(spark: SparkSession, d: str) -> DataFrame:
    lanes = v_map(spark, d).groupBy("eid").agg(F.max("lane_num").alias("lanes"))
    return v_edge(spark, d).join(lanes, "eid").select("eid", "road_type", F.col("lanes").cast("int").alias("lane_num"))


@q("SELECT c_custkey AS id, c_nationkey AS v FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT s_suppkey + 1000000, s_nationkey FROM supplier")
def k13_table_maintenance(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "customer").selectExpr("c_custkey id", "c_nationkey v")
    less = relational.delete(stored, stored.where("v = 3").select("id"), ["id"])
    return relational.insert_absent(less, table(spark, d, "supplier").selectExpr("s_suppkey + 1000000 id", "s_nationkey v"), ["id"])


@q("SELECT l_orderkey AS id, i AS lane FROM (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY 1), unnest(generate_series(0, n - 1)) AS u(i)")
def k13_lane_children(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_linenumber").alias("n"))
    return n.select("id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("lane"))


# Projection and filters


@q("SELECT event_id FROM events WHERE (event_type IN ('view', 'click') OR value < 10) AND NOT (user_id BETWEEN 10 AND 20) AND value = value AND props LIKE '%k%'")
def p01_predicates(spark: SparkSession, d: str) -> DataFrame:
    return relational.matches(table(spark, d, "events"), "(event_type in ('view', 'click') or value < 10) and not (user_id between 10 and 20) and value is not null and props like '%k%'").select("event_id")


@q("SELECT c_name AS name, c_custkey AS eid, c_acctbal AS balance FROM customer")
def p02_project_rename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").withColumnsRenamed({"c_custkey": "eid", "c_name": "name", "c_acctbal": "balance"}).drop("c_mktsegment", "c_nationkey").select("name", "eid", "balance")


@q("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def p03_drop_constant_columns(spark: SparkSession, d: str) -> DataFrame:
    return filters.drop_constant_columns(table(spark, d, "nation").withColumns({"fixed": F.lit(1), "nothing": F.lit(None).cast("string")}))


_TYPE = "CASE p_partkey % 7 WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk_link' WHEN 2 THEN 'primary' WHEN 3 THEN 'secondary_link' WHEN 4 THEN 'residential' WHEN 5 THEN 'footway' ELSE 'nothing' END"


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").withColumn("t", F.expr(_TYPE))


@q(f"SELECT p_partkey, t, {_case(C.ROAD_LEVEL, 't', '50')} * 1.0 AS level, {_case(C.LINK_TYPE_NO, _case({k: repr(v) for k, v in C.HIGHWAY_CLASS.items()}, 't', 'NULL'), 'NULL')} AS type_no FROM (SELECT p_partkey, {_TYPE} AS t FROM part)")
def p04_class_levels(spark: SparkSession, d: str) -> DataFrame:
    kind = filters.lookup(F.col("t"), C.HIGHWAY_CLASS)
    return _typed(spark, d).select("p_partkey", "t", filters.road_level(F.col("t")).alias("level"), filters.lookup(kind, C.LINK_TYPE_NO).cast("int").alias("type_no"))


_ONEWAY = "CASE p_size % 8 WHEN 0 THEN 'yes' WHEN 1 THEN '1' WHEN 2 THEN '-1' WHEN 3 THEN 'reversible' WHEN 4 THEN 'no' WHEN 5 THEN '0' WHEN 6 THEN 'alternating' END"


@q(f"""SELECT p_partkey, coalesce(o IN ('yes', '1', 'true', '-1', 'reversible'), FALSE) AS strict,
CASE WHEN o IN ('yes', 'true', '1', '-1', 'reversed') THEN TRUE WHEN o IN ('no', 'false', '0', 'reversible', 'alternating') THEN FALSE ELSE coalesce({_case(C.DEFAULT_ONEWAY, 't', 'NULL')}, FALSE) END AS builder,
coalesce(o IN ('yes', '1'), FALSE) AS simulator FROM (SELECT p_partkey, {_ONEWAY} AS o, {_TYPE} AS t FROM part)""")
def p05_oneway_rules(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o")
    return _typed(spark, d).withColumn("o", F.expr(_ONEWAY)).select("p_partkey", filters.oneway_strict(o).alias("strict"), filters.oneway_builder(o, F.col("t")).alias("builder"), filters.oneway_simulator(o).alias("simulator"))


@q(sql("v_point", "SELECT id, x, y FROM v_point WHERE x BETWEEN 113.885 AND 113.905 AND y BETWEEN 22.49 AND 22.52"))
def p06_clip_to_box(spark: SparkSession, d: str) -> DataFrame:
    return v_point(spark, d).where(geo.in_bbox("x", "y", (113.885, 22.49, 113.905, 22.52))).select("id", "x", "y")


_RING = ((113.88, 22.48), (113.93, 22.49), (113.91, 22.53), (113.89, 22.515))


@q(sql("v_point", "SELECT id, (" + " + ".join(f"CASE WHEN (({ay} > y) <> ({by} > y)) AND x < ({bx} - {ax}) * (y - {ay}) / CAST({by} - {ay} AS DOUBLE) + {ax} THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in zip(_RING, (_RING[-1], *_RING[:-1]), strict=True)) + ") % 2 = 1 AS available FROM v_point"))
def p07_geofence_split(spark: SparkSession, d: str) -> DataFrame:
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _RING])
    return v_point(spark, d).select("id", geo.in_ring("x", "y", ring).alias("available"))


def _agents_sql() -> str:
    parts = []
    for agent, rule in C.AGENT_EXCLUDES.items():
        tests = [f"coalesce({ {'highway': 't', 'service': 's', 'access': 'a'}[k]} IN ({', '.join(repr(v) for v in bad)}), FALSE)" for k, bad in rule.items() if k in ("highway", "service", "access")]
        parts.append(f"CASE WHEN NOT ({' OR '.join(tests)}) THEN '{agent}' END")
    return f"SELECT p_partkey, concat_ws(';', {', '.join(parts)}, CASE WHEN contains(t, 'track') THEN 'track' END) AS uses FROM (SELECT p_partkey, {_AGENT_T} AS t, {_AGENT_S} AS s, {_AGENT_A} AS a FROM part)"


_AGENT_T = "CASE p_partkey % 5 WHEN 0 THEN 'cycleway' WHEN 1 THEN 'track' WHEN 2 THEN 'steps' WHEN 3 THEN 'primary' ELSE 'service' END"
_AGENT_S = "CASE p_size % 3 WHEN 0 THEN 'private' WHEN 1 THEN 'driveway' END"
_AGENT_A = "CASE p_size % 7 WHEN 0 THEN 'private' END"


@q(_agents_sql())
def p09_agent_types(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumns({"t": F.expr(_AGENT_T), "s": F.expr(_AGENT_S), "a": F.expr(_AGENT_A)})
    return p.select("p_partkey", filters.agent_types({"highway": F.col("t"), "service": F.col("s"), "access": F.col("a")}, F.col("t")).alias("uses"))


@q("SELECT s_suppkey, CAST(floor(TRY_CAST(nullif(regexp_extract(s_name, '\\d+\\.?\\d*'), '') AS DOUBLE)) AS INTEGER) AS n FROM supplier")
def p10_first_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", filters.lanes_of(F.col("s_name")).alias("n"))


@q(f"SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN p_size END, {_case(C.DEFAULT_LANES | {'residential': 2}, 'k', 'NULL')}) AS lanes, {_case(C.DEFAULT_SPEED, 'k', 'NULL')} * 1.0 AS speed FROM (SELECT p_partkey, p_size, {_case({k: repr(v) for k, v in C.HIGHWAY_CLASS.items()}, 't', 'NULL')} AS k FROM (SELECT p_partkey, p_size, {_TYPE} AS t FROM part))")
def p11_class_defaults(spark: SparkSession, d: str) -> DataFrame:
    k = filters.lookup(F.col("t"), C.HIGHWAY_CLASS)
    given = F.when(F.col("p_size") % 3 == 0, F.col("p_size"))
    return _typed(spark, d).select("p_partkey", F.coalesce(given, filters.lookup(k, C.DEFAULT_LANES | {"residential": 2}).cast("int")).alias("lanes"), filters.lookup(k, C.DEFAULT_SPEED).alias("speed"))


@q(f"SELECT p_partkey, CASE WHEN contains(t, 'link') AND (n IS NULL OR n > 2) THEN 1 ELSE n END AS lane_num FROM (SELECT p_partkey, {_TYPE} AS t, nullif(p_size % 6, 0) AS n FROM part)")
def p12_link_rule(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d).select("p_partkey", filters.link_rule(F.col("t"), F.nullif(F.col("p_size") % 6, F.lit(0))).alias("lane_num"))


@q("SELECT c_custkey, CASE WHEN len(w) >= 2 THEN w[len(w) - 1] END AS part FROM (SELECT c_custkey, string_split(replace(c_name, '#', '_') || '_9.jpg', '_') AS w FROM customer)")
def p13_name_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", filters.name_part(F.concat(F.replace(F.col("c_name"), F.lit("#"), F.lit("_")), F.lit("_9.jpg")), 2).alias("part"))


@q("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE n <= 3 OR l_linenumber % 3 = 1")
def p15_thinning(spark: SparkSession, d: str) -> DataFrame:
    return filters.thin(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), "l_orderkey", "l_linenumber")


@q("SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE l_discount < 0.05 AND l_tax < 0.03")
def p17_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_discount < 0.05D and l_tax < 0.03D").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")


@q(f"SELECT p_partkey, contains(t, 'link') AS link, {_case(C.ROAD_LEVEL, 't', '50')} < 6 AS major FROM (SELECT p_partkey, {_TYPE} AS t FROM part)")
def p18_class_flags(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d).select("p_partkey", F.contains("t", F.lit("link")).alias("link"), (filters.road_level(F.col("t")) < 6).alias("major"))


@q(sql("v_graph", "SELECT src, dst, length FROM v_graph WHERE src = 17 OR dst = 17"))
def p19_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return v_graph(spark, d).where("src = 17 or dst = 17").select("src", "dst", "length")


@q("SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS node_id FROM customer WHERE c_acctbal > 0 AND c_nationkey < 20")
def p20_dense_ids(spark: SparkSession, d: str) -> DataFrame:
    return filters.dense_ids(table(spark, d, "customer"), F.expr("c_acctbal > 0 and c_nationkey < 20"), ["c_custkey"], "node_id").select(F.col("c_custkey").alias("id"), "node_id")


# Joins


@q("SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def j01_inner(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@q("SELECT a.l_orderkey, a.l_partkey, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY 1, 2")
def j02_inner_multi_key(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return a.join(a.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))


@q("SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1) ON o_custkey = c_custkey")
def j03_left_fill(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").where("o_totalprice > 200000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return relational.left_fill(table(spark, d, "customer").select("c_custkey"), n, ["c_custkey"], {"n": 0})


@q(sql("v_graph", "SELECT coalesce(a.node, b.node) AS node, coalesce(i, 0) AS indegree, coalesce(o, 0) AS outdegree FROM (SELECT dst AS node, count(*) AS i FROM v_graph GROUP BY 1) a FULL JOIN (SELECT src AS node, count(*) AS o FROM v_graph GROUP BY 1) b ON a.node = b.node"))
def j04_full_degrees(spark: SparkSession, d: str) -> DataFrame:
    g = v_graph(spark, d)
    i, o = g.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("indegree")), g.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("outdegree"))
    return relational.full_fill(i, o, ["node"], {"indegree": 0, "outdegree": 0})


@q("SELECT o_orderkey AS eid, a.c_acctbal AS v_0, b.c_acctbal AS v_1 FROM orders JOIN customer a ON a.c_custkey = o_custkey JOIN customer b ON b.c_custkey = o_orderkey % 1000 + 1")
def j05_both_ends(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "orders").selectExpr("o_orderkey eid", "o_custkey s", "o_orderkey % 1000 + 1 e")
    return relational.both_ends(edges, table(spark, d, "customer").selectExpr("c_custkey node", "c_acctbal v"), "node", "s", "e", ["v"]).select("eid", "v_0", "v_1")


@q("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def j06_left_anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


_KNOWN = "SELECT user_id AS node FROM events GROUP BY 1 HAVING count(*) % 3 = 0"


@q(sql("v_graph", f"SELECT src, dst, length FROM v_graph WHERE src IN ({_KNOWN}) AND dst IN ({_KNOWN})"))
def j07_known_ends(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "events").groupBy(F.col("user_id").alias("node")).count().where("count % 3 = 0")
    return relational.known_ends(v_graph(spark, d).select("src", "dst", "length"), known, "node", "src", "dst")


@q(sql("v_graph", f"SELECT src, dst, length FROM v_graph WHERE src IN ({_KNOWN}) OR dst IN ({_KNOWN})"))
def j07_touching(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "events").groupBy(F.col("user_id").alias("node")).count().where("count % 3 = 0")
    return relational.touching(v_graph(spark, d).select("src", "dst", "length"), known, "node", "src", "dst")


@q("SELECT l_orderkey, l_linenumber, l_extendedprice, coalesce(p_size, -1) AS size FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON p_partkey = l_partkey")
def j14_lookup_default(spark: SparkSession, d: str) -> DataFrame:
    dim = table(spark, d, "part").where("p_size > 25").selectExpr("p_partkey l_partkey", "p_size size")
    return relational.left_fill(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey"), dim, ["l_partkey"], {"size": -1}).drop("l_partkey")


@q("""WITH e AS (SELECT c_custkey AS eid, c_nationkey AS rid, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS ord, c_custkey % 911 AS s, c_custkey % 913 AS e, c_mktsegment AS t FROM customer),
own AS (SELECT *, lag(eid) OVER (PARTITION BY rid ORDER BY ord) AS p, lead(eid) OVER (PARTITION BY rid ORDER BY ord) AS n FROM e),
pm AS (SELECT a.eid, CASE WHEN count(*) = 1 THEN min(b.eid) WHEN count(*) FILTER (WHERE a.t = b.t) = 1 THEN min(b.eid) FILTER (WHERE a.t = b.t) END AS m FROM own a JOIN e b ON a.s = b.e AND a.eid <> b.eid WHERE a.p IS NULL GROUP BY a.eid),
nm AS (SELECT a.eid, CASE WHEN count(*) = 1 THEN min(b.eid) WHEN count(*) FILTER (WHERE a.t = b.t) = 1 THEN min(b.eid) FILTER (WHERE a.t = b.t) END AS m FROM own a JOIN e b ON a.e = b.s AND a.eid <> b.eid WHERE a.n IS NULL GROUP BY a.eid)
SELECT own.eid, coalesce(p, pm.m) AS prev_eid, coalesce(n, nm.m) AS next_eid FROM own LEFT JOIN pm ON pm.eid = own.eid LEFT JOIN nm ON nm.eid = own.eid""")
def j15_neighbour_edges(spark: SparkSession, d: str) -> DataFrame:
    from lanewise.operators.fusion import edge_neighbours

    return edge_neighbours(_ways(spark, d))


def _ways(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return c.select(F.col("c_custkey").alias("eid"), F.col("c_nationkey").alias("rid"), F.row_number().over(w).alias("ord"), (F.col("c_custkey") % 911).alias("s"), (F.col("c_custkey") % 913).alias("e"), F.col("c_mktsegment").alias("road_type"))


_STARTS, _CONN, _SINGLE = "SELECT user_id AS road, user_id AS pid FROM events WHERE event_id % 7 = 0 GROUP BY 1", "SELECT src AS prev_pid, dst AS pid FROM v_graph WHERE n > 0", "SELECT user_id + 1000 AS rid, user_id AS pid FROM events WHERE user_id % 4 = 0 GROUP BY 2"


@q(sql("v_graph", f"""WITH st AS ({_STARTS}), c AS ({_CONN}), si AS ({_SINGLE}), one AS (SELECT road, c.pid AS next FROM st JOIN c ON st.pid = c.prev_pid)
SELECT DISTINCT road, next, NULL::BIGINT AS via FROM one UNION SELECT DISTINCT road, c.pid, si.rid FROM one JOIN si ON si.pid = one.next JOIN c ON c.prev_pid = si.pid"""))
def j16_link_expansion(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    starts = e.where("event_id % 7 = 0").selectExpr("user_id road", "user_id pid").distinct()
    singles = e.where("user_id % 4 = 0").selectExpr("user_id + 1000 rid", "user_id pid").distinct()
    return relational.expand_links(starts, v_graph(spark, d).selectExpr("src prev_pid", "dst pid"), singles)


@q(sql("v_graph", "WITH p AS (SELECT src, dst FROM v_graph WHERE n = 1), r AS (SELECT src, dst, length FROM v_graph) SELECT r.*, FALSE AS reversed FROM r JOIN p ON r.src = p.src AND r.dst = p.dst UNION ALL SELECT r.*, TRUE FROM r JOIN p ON r.src = p.dst AND r.dst = p.src"))
def j19_both_directions(spark: SparkSession, d: str) -> DataFrame:
    g = v_graph(spark, d)
    return relational.either_direction(g.where("n = 1").select("src", "dst"), g.select("src", "dst", "length")).select("src", "dst", "length", "reversed")


@q("""WITH e AS (SELECT c_custkey AS eid, c_nationkey AS rid, c_mktsegment AS t, c_custkey * 7 % 3001 AS s, c_custkey * 11 % 3001 AS e, c_custkey % 5 + 3 AS lanes FROM customer),
i AS (SELECT a.eid, sum(b.lanes) AS i FROM e a JOIN e b ON a.s = b.e AND a.rid <> b.rid AND a.t <> b.t GROUP BY 1), o AS (SELECT a.eid, sum(b.lanes) AS o FROM e a JOIN e b ON a.e = b.s AND a.rid <> b.rid AND a.t <> b.t GROUP BY 1)
SELECT e.eid, CAST(e.lanes - greatest(coalesce(i, 0), coalesce(o, 0)) AS BIGINT) AS gain FROM e LEFT JOIN i ON i.eid = e.eid LEFT JOIN o ON o.eid = e.eid WHERE coalesce(i, o) IS NOT NULL AND e.lanes - greatest(coalesce(i, 0), coalesce(o, 0)) > 0""")
def j20_ramp_gain(spark: SparkSession, d: str) -> DataFrame:
    from lanewise.operators.simulation import ramp_gain

    e = table(spark, d, "customer").selectExpr("c_custkey eid", "c_nationkey rid", "c_mktsegment road_type", "c_custkey * 7 % 3001 s", "c_custkey * 11 % 3001 e", "c_custkey % 5 + 3 lanes")
    return ramp_gain(e).select("eid", F.col("gain").cast("long").alias("gain"))


@q("""WITH a AS (SELECT l_partkey AS k, l_linenumber * 10 AS a0, l_linenumber * 10 + 7 AS a1, l_suppkey AS value FROM lineitem WHERE l_returnflag = 'A'),
b AS (SELECT l_partkey AS k, l_linenumber * 8 AS b0, l_linenumber * 8 + 9 AS b1, l_suppkey AS base FROM lineitem WHERE l_returnflag <> 'A')
SELECT a.k AS k, greatest(a0, b0) AS start, least(a1, b1) AS "end", value, base FROM a JOIN b ON a.k = b.k AND a0 < b1 AND b0 < a1""")
def j21_interval_split(spark: SparkSession, d: str) -> DataFrame:
    from lanewise.operators.intervals import split_overlaps

    li = table(spark, d, "lineitem")
    a = li.where("l_returnflag = 'A'").selectExpr("l_partkey k", "l_linenumber * 10 start", "l_linenumber * 10 + 7 end", "l_suppkey value")
    b = li.where("l_returnflag <> 'A'").selectExpr("l_partkey k", "l_linenumber * 8 start", "l_linenumber * 8 + 9 end", "l_suppkey base")
    return split_overlaps(a, b, "k", bucket=10.0)


# Sorting, limits, set operations


@q("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'P'")
def t01_multi_key_sort(spark: SparkSession, d: str) -> DataFrame:
    kept = filters.dense_ids(table(spark, d, "orders"), F.expr("o_orderstatus = 'P'"), [F.col("o_orderpriority"), F.col("o_totalprice").desc(), F.col("o_orderkey")], "place")
    return kept.select("o_orderkey", (F.col("place") + 1).alias("place"))


@q("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_custkey % 2 = 0 AND o_custkey > 0 THEN o_orderkey ELSE -o_orderkey END) AS place FROM orders")
def t02_signed_order(spark: SparkSession, d: str) -> DataFrame:
    from lanewise.operators.simulation import signed_order

    o = table(spark, d, "orders").withColumn("rid", F.expr("case when o_custkey % 2 = 0 then o_custkey else -o_custkey end"))
    return o.select("o_orderkey", F.row_number().over(Window.partitionBy("rid").orderBy(signed_order(F.col("rid"), F.col("o_orderkey")))).alias("place"))


@q("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def t03_head(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@q("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1")
def t05_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return relational.keep_first(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@q("SELECT s_suppkey AS id, s_name AS name, NULL::VARCHAR AS seg FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def u01_union_all(spark: SparkSession, d: str) -> DataFrame:
    return relational.union_tables(table(spark, d, "supplier").selectExpr("s_suppkey id", "s_name name"), table(spark, d, "customer").selectExpr("c_custkey id", "c_name name", "c_mktsegment seg"))


@q("SELECT s_nationkey AS n FROM supplier UNION SELECT c_nationkey FROM customer")
def u02_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return relational.union_tables(table(spark, d, "supplier").selectExpr("s_nationkey n"), table(spark, d, "customer").selectExpr("c_nationkey n")).distinct()


@q("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def u03_difference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_partkey k").join(table(spark, d, "lineitem").where("l_quantity > 45").selectExpr("l_partkey k"), "k", "left_anti")


@q("SELECT user_id AS k FROM events WHERE value < 5 INTERSECT SELECT user_id FROM events WHERE value > 90")
def u04_intersection(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.where("value < 5").selectExpr("user_id k").intersect(e.where("value > 90").selectExpr("user_id k"))


@q("SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def u05_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_suppkey", "l_returnflag").distinct()


# Text, dates, nested values


@q("SELECT c_custkey, c_name LIKE 'Cust%' AS prefix, regexp_matches(c_name, '\\d{3}') AS digits, contains(c_mktsegment, 'MACH') AS hit FROM customer")
def x01_text_tests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.startswith("c_name", F.lit("Cust")).alias("prefix"), F.col("c_name").rlike(r"\d{3}").alias("digits"), F.contains("c_mktsegment", F.lit("MACH")).alias("hit"))


@q("SELECT l_orderkey AS id, array_to_string(list_sort(list(DISTINCT l_suppkey)), ';') AS pids, CAST(list_sum(list_distinct(list(l_suppkey))) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def x02_id_lists(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("l_suppkey")), ";").alias("pids"))
    return ids.withColumn("total", F.aggregate(F.transform(F.split("pids", ";"), lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x))


@q("SELECT vec_id, 'https://example.invalid/pano/' || vec_id || '_' || (vec_id * 37 % 360) || '.jpg' AS url FROM embeddings")
def x05_urls(spark: SparkSession, d: str) -> DataFrame:
    return v_point(spark, d).select(F.col("id").alias("vec_id"), F.format_string("https://example.invalid/pano/%d_%d.jpg", F.col("id"), F.col("heading")).alias("url"))


@q("SELECT p_partkey, array_to_string(list_transform(string_split(p_type, ' '), lambda w: left(w, 1)), '') AS ini FROM part")
def x06_initials(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", filters.initials(F.col("p_type"), " ").alias("ini"))


@q("SELECT o_orderkey, CAST(epoch(strptime(strftime(o_orderdate, '%Y%m%d') || ' 08:30:15', '%Y%m%d %H:%M:%S')) AS BIGINT) AS s FROM orders")
def d01_parse_time(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").withColumn("time", F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit(" 08:30:15")))
    return tables.tracks(t).select("o_orderkey", F.unix_timestamp("time").alias("s"))


@q("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def n09_json_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


def _nested(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))).alias("panos"))


_ORD = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@q("SELECT DISTINCT l_orderkey AS rid, l_partkey AS pid, l_linenumber AS ord FROM lineitem")
def n01_nested_explode(spark: SparkSession, d: str) -> DataFrame:
    return _nested(spark, d).select(F.col("l_orderkey").alias("rid"), F.explode("panos").alias("p")).select("rid", F.col("p.l_partkey").alias("pid"), F.col("p.l_linenumber").alias("ord")).distinct()


@q(f"SELECT l_orderkey AS rid, (list(l_partkey {_ORD}))[1] AS first_pid, (list(l_partkey {_ORD}))[-1] AS last_pid, count(*) AS n FROM lineitem GROUP BY 1")
def n02_first_and_last(spark: SparkSession, d: str) -> DataFrame:
    return _nested(spark, d).select(F.col("l_orderkey").alias("rid"), F.element_at("panos", 1)["l_partkey"].alias("first_pid"), F.element_at("panos", -1)["l_partkey"].alias("last_pid"), F.size("panos").cast("long").alias("n"))


@q(f"WITH g AS (SELECT l_orderkey AS rid, list(l_partkey {_ORD}) AS p FROM lineitem GROUP BY 1) SELECT rid, p[1] AS src, p[-1] AS dst, FALSE AS link FROM g UNION ALL SELECT rid, p[-1], unnest(p[2:]) AS dst, TRUE FROM g")
def n03_record_to_edges(spark: SparkSession, d: str) -> DataFrame:
    p = F.transform("panos", lambda x: x["l_partkey"])
    road = F.struct(F.element_at(p, 1).alias("src"), F.element_at(p, -1).alias("dst"), F.lit(False).alias("link"))
    links = F.transform(F.slice(p, F.lit(2), F.size(p)), lambda x: F.struct(F.element_at(p, -1).alias("src"), x.alias("dst"), F.lit(True).alias("link")))
    return _nested(spark, d).select(F.col("l_orderkey").alias("rid"), F.inline(F.concat(F.array(road), links)))


@q("SELECT DISTINCT l_orderkey AS eid, l_suppkey AS root, l_partkey AS pid FROM lineitem")
def n04_maps_to_rows(spark: SparkSession, d: str) -> DataFrame:
    inner = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.collect_set("l_partkey").alias("pids"))
    maps = inner.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_suppkey", "pids"))).alias("m"))
    return maps.select(F.col("l_orderkey").alias("eid"), F.explode("m").alias("root", "pids")).select("eid", "root", F.explode("pids").alias("pid"))


@q("SELECT vec_id, len(embedding) AS n FROM embeddings")
def n05_array_size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("n"))


@q(f"WITH g AS (SELECT l_orderkey AS rid, list(l_partkey {_ORD}) AS p, list(l_suppkey {_ORD}) AS s FROM lineitem GROUP BY 1) SELECT rid, array_to_string(list_concat(p[1:2], s[1:1]), ',') AS items FROM g")
def n06_array_concat(spark: SparkSession, d: str) -> DataFrame:
    p, s = F.transform("panos", lambda x: x["l_partkey"]), F.transform("panos", lambda x: x["l_suppkey"])
    return _nested(spark, d).select(F.col("l_orderkey").alias("rid"), F.array_join(F.concat(F.slice(p, 1, 2), F.slice(s, 1, 1)), ",").alias("items"))


@q(f"WITH r AS (SELECT l_orderkey AS rid, row_number() OVER (PARTITION BY l_orderkey {_ORD}) - 1 AS ord, l_partkey AS s, lead(l_partkey) OVER (PARTITION BY l_orderkey {_ORD}) AS e FROM lineitem) SELECT * FROM r WHERE e IS NOT NULL")
def n07_consecutive_pairs(spark: SparkSession, d: str) -> DataFrame:
    from lanewise.sources.osm_files import way_edges

    return way_edges(_nested(spark, d).select(F.col("l_orderkey").alias("id"), F.transform("panos", lambda x: x["l_partkey"]).alias("refs")))


@q(f"SELECT l_orderkey AS rid, '[' || array_to_string(list(l_partkey {_ORD}), ',') || ']' AS t FROM lineitem GROUP BY 1")
def n10_list_to_text(spark: SparkSession, d: str) -> DataFrame:
    return _nested(spark, d).select(F.col("l_orderkey").alias("rid"), F.to_json(F.transform("panos", lambda x: x["l_partkey"])).alias("t"))


@q(f"WITH g AS (SELECT l_orderkey AS rid, list(l_partkey {_ORD}) AS p FROM lineitem GROUP BY 1) SELECT rid, CASE WHEN len(p) < 3 THEN p[2] ELSE p[len(p) // 2 + 1] END AS mid FROM g")
def n11_middle(spark: SparkSession, d: str) -> DataFrame:
    from lanewise.functions.line import middle

    return _nested(spark, d).select(F.col("l_orderkey").alias("rid"), middle(F.transform("panos", lambda x: x["l_partkey"])).alias("mid"))


