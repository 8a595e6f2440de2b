"""Network operators on the adapters; those without SQL form are tested by value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lanewise.constants import METRES_PER_DEGREE, WGS84_A, WGS84_E
from lanewise.functions import geo, line
from lanewise.operators import filters, fusion, graph, intervals, matching, osm, pano, simulation, spatial
from lanewise.plans.adapters import Registry, sql, table, v_graph, v_line, v_map
from lanewise.sources import tables

QUERIES = Registry()
q = QUERIES.add

STEP = 0.001


def grid_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Customers as OSM nodes on a grid of 100 columns; some have a signal."""
    signal = F.when(F.col("c_custkey") % 17 == 0, F.create_map(F.lit("highway"), F.lit("traffic_signals"))).otherwise(F.create_map().cast("map<string,string>"))
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), (113.9 + F.col("c_custkey") % 100 * STEP).alias("x"), (22.5 + F.floor(F.col("c_custkey") / 100) * STEP).alias("y"), signal.alias("tags")
    )


def grid_ways(spark: SparkSession, d: str) -> DataFrame:
    """Orders as OSM ways along rows or columns of the grid."""
    o = table(spark, d, "orders")
    step = F.when(F.col("o_orderkey") % 20 == 0, 1).otherwise(100)
    kind = F.element_at(F.array(*[F.lit(k) for k in ("primary", "secondary", "residential", "footway", "service")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    tags = F.create_map(F.lit("highway"), F.when(F.col("o_totalprice") > 150000, "primary").otherwise(kind), F.lit("lanes"), (F.col("o_custkey") % 4 + 1).cast("string"), F.lit("oneway"), F.when(F.col("o_custkey") % 3 == 0, "yes").otherwise("no"))
    return o.select(F.col("o_orderkey").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.col("o_custkey") + k * step).alias("refs"), tags.alias("tags"))


#: Nodes and ways of the grid as SQL.
_NODES = "nd AS (SELECT c_custkey AS node, CAST(113.9 AS DOUBLE) + CAST(c_custkey % 100 AS DOUBLE) * CAST(0.001 AS DOUBLE) AS x, CAST(22.5 AS DOUBLE) + CAST(c_custkey // 100 AS DOUBLE) * CAST(0.001 AS DOUBLE) AS y FROM customer)"
_REFS = "refs AS (SELECT o_orderkey AS way, k, o_custkey + k * CASE WHEN o_orderkey % 20 = 0 THEN 1 ELSE 100 END AS node FROM orders, unnest([0, 1, 2, 3, 4]) AS u(k))"
_CROSS = f"{_NODES}, {_REFS}, pl AS (SELECT way, k, refs.node, x, y FROM refs JOIN nd ON nd.node = refs.node), en AS (SELECT *, k = min(k) OVER w OR k = max(k) OVER w AS is_end FROM pl WINDOW w AS (PARTITION BY way)), cr AS (SELECT node FROM en GROUP BY 1 HAVING count(*) > 1 OR bool_or(is_end))"


@q()
def r21_network_links(spark: SparkSession, d: str) -> DataFrame:
    net = osm.build_network(grid_nodes(spark, d), grid_ways(spark, d), min_nodes=3)
    return net.links.select("link_id", "way", "from_node_id", "to_node_id", "lanes", "free_speed", "link_type", "length", "from_biway")


def chained_ways(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as two ways in line, which meet at a node of their own: nodes and ways. Some have a signal there, or two names."""
    o = table(spark, d, "orders").dropDuplicates(["o_orderkey"])
    nodes = o.select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    signal = F.when((F.col("k") == 2) & (F.col("o_orderkey") % 7 == 0), F.create_map(F.lit("highway"), F.lit("traffic_signals"))).otherwise(F.create_map().cast("map<string,string>"))
    nodes = nodes.select((F.col("o_orderkey") * 10 + F.col("k")).alias("id"), (113.9 + F.col("o_orderkey") % 1000 * STEP + F.col("k") * STEP / 10).alias("x"), (22.5 + F.floor(F.col("o_orderkey") / 1000) * STEP).alias("y"), signal.alias("tags"))
    ways = o.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    lanes = F.when(F.col("j") == 0, F.col("o_custkey") % 4 + 1).otherwise(F.col("o_custkey") % 3 + 1)
    name = F.when((F.col("j") == 1) & (F.col("o_orderkey") % 5 == 0), "other").otherwise(F.col("o_orderstatus"))
    tags = F.create_map(F.lit("highway"), F.lit("primary"), F.lit("name"), name, F.lit("lanes"), lanes.cast("string"), F.lit("oneway"), F.when(F.col("o_custkey") % 3 == 0, "yes").otherwise("no"))
    refs = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.col("o_orderkey") * 10 + F.col("j") * 2 + k)
    return nodes, ways.select((F.col("o_orderkey") * 2 + F.col("j")).alias("id"), refs.alias("refs"), tags.alias("tags"))


@q("""WITH o AS (SELECT DISTINCT o_orderkey AS o, o_custkey AS c FROM orders), w AS (SELECT o, c % 3 = 0 AS oneway, c % 4 + 1 AS a, c % 3 + 1 AS b, o % 7 <> 0 AND o % 5 <> 0 AS joined FROM o),
l AS (SELECT *, CASE WHEN oneway THEN a ELSE CAST(ceil(a / 2.0) AS BIGINT) END AS la, CASE WHEN oneway THEN b ELSE CAST(ceil(b / 2.0) AS BIGINT) END AS lb FROM w),
u AS (SELECT CAST(2 * o AS VARCHAR) AS members, 1 AS n_members, la AS lanes, CAST(la AS VARCHAR) AS lane_list FROM l WHERE NOT joined UNION ALL SELECT CAST(2 * o + 1 AS VARCHAR), 1, lb, CAST(lb AS VARCHAR) FROM l WHERE NOT joined
UNION ALL SELECT CAST(2 * o AS VARCHAR), 1, la, CAST(la AS VARCHAR) FROM l WHERE NOT joined AND NOT oneway UNION ALL SELECT CAST(2 * o + 1 AS VARCHAR), 1, lb, CAST(lb AS VARCHAR) FROM l WHERE NOT joined AND NOT oneway
UNION ALL SELECT (2 * o) || ';' || (2 * o + 1), 2, la, CASE WHEN la = lb THEN CAST(la AS VARCHAR) ELSE la || ',' || lb END FROM l WHERE joined
UNION ALL SELECT (2 * o + 1) || ';' || (2 * o), 2, lb, CASE WHEN la = lb THEN CAST(la AS VARCHAR) ELSE lb || ',' || la END FROM l WHERE joined AND NOT oneway)
SELECT members, n_members, CAST(lanes AS INTEGER) AS lanes, lane_list, CAST(CASE WHEN contains(lane_list, ',') THEN 1 ELSE 0 END AS INTEGER) AS changes FROM u""")
def r09_combined_links(spark: SparkSession, d: str) -> DataFrame:
    net = osm.build_network(*chained_ways(spark, d), combine=True)
    return net.links.select("members", "n_members", "lanes", F.array_join("lane_list", ",").alias("lane_list"), F.size("change_points").alias("changes"))


@q("""WITH o AS (SELECT DISTINCT o_orderkey AS o, o_custkey % 3 = 0 AS oneway FROM orders WHERE o_orderkey % 1000 <= 500),
l AS (SELECT 2 * o AS way, oneway, 10 * o AS a, 10 * o + 2 AS b, 3 AS points FROM o UNION ALL SELECT 2 * o + 1, oneway, 10 * o + 2, CASE WHEN o % 1000 < 500 THEN 10 * o + 4 END, CASE WHEN o % 1000 < 500 THEN 3 ELSE 2 END FROM o)
SELECT way, a AS from_osm, b AS to_osm, points FROM l UNION ALL SELECT way, b, a, points FROM l WHERE NOT oneway""")
def r21_network_of_a_region(spark: SparkSession, d: str) -> DataFrame:
    # the region ends between the third and the fourth node of the chains in its last column, whose second way is cut there
    net = osm.build_network(*chained_ways(spark, d), box=(0.0, 0.0, 113.9 + 500 * STEP + 2.5 * STEP / 10, 90.0))
    end = lambda c: net.nodes.select(F.col("node_id").alias(f"{c}_node_id"), F.col("osm_node_id").alias(f"{c}_osm"))
    return net.links.join(end("from"), "from_node_id").join(end("to"), "to_node_id").select("way", "from_osm", "to_osm", F.size("coords").alias("points"))


@q("""WITH o AS (SELECT DISTINCT o_orderkey AS o, o_custkey AS c FROM orders), w AS (SELECT o, c % 3 = 0 AS oneway, c % 4 + 1 AS a, c % 3 + 1 AS b FROM o WHERE o % 7 <> 0 AND o % 5 <> 0),
l AS (SELECT *, CASE WHEN oneway THEN a ELSE CAST(ceil(a / 2.0) AS BIGINT) END AS la, CASE WHEN oneway THEN b ELSE CAST(ceil(b / 2.0) AS BIGINT) END AS lb FROM w)
SELECT CAST(lb - la AS INTEGER) AS l_lanes_added, 0 AS r_lanes_added FROM l WHERE la <> lb UNION ALL SELECT CAST(la - lb AS INTEGER), 0 FROM l WHERE la <> lb AND NOT oneway""")
def r10_lane_segments(spark: SparkSession, d: str) -> DataFrame:
    return osm.build_network(*chained_ways(spark, d), combine=True).segments.select("l_lanes_added", "r_lanes_added")


@q(f"""WITH {_CROSS}, m AS (SELECT pl.*, cr.node IS NOT NULL AS c, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY way) AS n, first(pl.node) OVER w AS a, last(pl.node) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM pl LEFT JOIN cr ON cr.node = pl.node WINDOW w AS (PARTITION BY way ORDER BY k)),
ok AS (SELECT way FROM m GROUP BY 1 HAVING max(n) > 1 AND NOT (min(a) = min(z) AND NOT bool_or(c AND i > 0 AND i < n - 1))),
cuts AS (SELECT DISTINCT way, i FROM m WHERE way IN (SELECT way FROM ok) AND (c OR i = 0 OR i = n - 1)), parts AS (SELECT way, row_number() OVER (PARTITION BY way ORDER BY i) - 1 AS part, lead(i) OVER (PARTITION BY way ORDER BY i) - i + 1 AS n FROM cuts)
SELECT way, CAST(part AS INTEGER) AS part, CAST(n AS INTEGER) AS n FROM parts WHERE n > 1""")
def r18_split_ways(spark: SparkSession, d: str) -> DataFrame:
    placed = osm.way_nodes(grid_ways(spark, d), grid_nodes(spark, d))
    return osm.split_ways(placed, osm.crossings(placed)).select("way", "part", F.size("nodes").alias("n"))


@q(sql("v_seg", """WITH s AS (SELECT *, x > -0.1 AND x < 0.1 AND y > -0.1 AND y < 0.1 AS ins FROM v_seg), f AS (SELECT id, min(i) FILTER (NOT ins) AS fo, max(i) FILTER (NOT ins) AS lo FROM s GROUP BY 1),
e AS (SELECT id, 0 AS piece, fo AS points, fo - 1 AS a, fo AS b FROM f WHERE fo > 1 UNION ALL SELECT id, 1, 9 - lo, lo + 1, lo FROM f WHERE lo < 8),
c AS (SELECT e.id, piece, points, p.x AS x, p.y AS y, r.x - p.x AS dx, r.y - p.y AS dy FROM e JOIN s p ON p.id = e.id AND p.i = a JOIN s r ON r.id = e.id AND r.i = b),
t AS (SELECT *, least(1, CASE WHEN dx > 0 THEN (0.1::DOUBLE - x) / dx WHEN dx < 0 THEN (-0.1::DOUBLE - x) / dx ELSE 'inf'::DOUBLE END, CASE WHEN dy > 0 THEN (0.1::DOUBLE - y) / dy WHEN dy < 0 THEN (-0.1::DOUBLE - y) / dy ELSE 'inf'::DOUBLE END) AS t FROM c)
SELECT id, piece, CAST(points AS INTEGER) AS points, round(x + t * dx, 4) AS border_x, round(y + t * dy, 4) AS border_y FROM t UNION ALL SELECT id, 0, 8, NULL, NULL FROM f WHERE fo IS NULL"""))
def r19_cut_at_region(spark: SparkSession, d: str) -> DataFrame:
    nodes = F.transform("coords", lambda p, i: F.struct(i.cast("long").alias("node"), p["x"].alias("x"), p["y"].alias("y")))
    pieces = v_line(spark, d).select("id", F.inline(osm.pieces_in_box(nodes, (-0.1, -0.1, 0.1, 0.1))))
    border = F.filter("nodes", lambda n: n["node"].isNull())
    return pieces.select("id", "piece", F.size("nodes").alias("points"), F.round(F.get(border, F.lit(0))["x"], 4).alias("border_x"), F.round(F.get(border, F.lit(0))["y"], 4).alias("border_y"))


@q()
def r02_trajectories(spark: SparkSession, d: str) -> DataFrame:
    g = v_graph(spark, d)
    topo = g.selectExpr("src * 1000 + dst rid", "src", "dst", "n % 2 = 1 link", "1 / (1 + length / 100) similarity")
    nodes = topo.select(F.col("src").alias("node")).union(topo.select("dst")).distinct()
    return pano.trajectories(topo, graph.components(nodes, topo))


@q()
def r12_longest_path(spark: SparkSession, d: str) -> DataFrame:
    g = v_graph(spark, d).where("src < dst").groupBy(F.col("dst")).agg(F.min_by("src", F.struct("length", "src")).alias("src"), F.min("length").alias("length"))
    tree = graph.components(g.select(F.col("src").alias("node")).union(g.select("dst")).distinct(), g)
    return graph.longest_path(g.join(tree.select(F.col("node").alias("src"), "component"), "src"), "component")


@q()
def r14_map_matching(spark: SparkSession, d: str) -> DataFrame:
    nodes = grid_nodes(spark, d)
    pairs = osm.way_nodes(grid_ways(spark, d), nodes)
    w = Window.partitionBy("way").orderBy("k")
    steps = pairs.select("node", "x", "y", F.lead("node").over(w).alias("dst"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("dst is not null").dropDuplicates(["node", "dst"])
    steps = steps.where("abs(x2 - x) < 0.01")  # no road runs from the end of a row of the grid to the start of the next
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    edges = steps.select((F.col("node") * 1000000 + F.col("dst")).alias("eid"), F.col("node").alias("src"), "dst", F.array(point("x", "y"), point("x2", "y2")).alias("coords"))
    # every road can be driven both ways
    edges = edges.unionByName(edges.select((-F.col("eid")).alias("eid"), F.col("dst").alias("src"), F.col("src").alias("dst"), F.reverse("coords").alias("coords")))
    # a track along a row starts anew in the next row, ten kilometres off
    row = F.when(F.col("way") % 20 == 0, F.floor(F.col("node") / 100)).otherwise(0)
    points = pairs.select((F.col("way") * 100000 + row).alias("traj"), F.col("k").cast("long").alias("seq"), (F.col("x") + 0.0001).alias("x"), (F.col("y") - 0.0001).alias("y"))
    # observations are one edge of a hundred metres apart, some 16 m beside it
    return matching.match(points, edges, radius_m=20.0)


@q()
def r16_direction_repair(spark: SparkSession, d: str) -> DataFrame:
    e = v_graph(spark, d).selectExpr("src % 29 k", "src", "dst", "cast(src % 12 as double) x0", "cast(src % 7 as double) y0", "cast(dst % 12 as double) x1", "cast(dst % 7 as double) y1")
    return graph.repair_directions(e, "k")


@q(f"""WITH {_NODES}, r AS (SELECT o_orderkey AS way, o_custkey AS c, CASE WHEN o_orderkey % 20 = 0 THEN 1 ELSE 100 END AS s FROM orders), refs AS (SELECT way, k, CASE WHEN k < 5 THEN c + k * s WHEN k = 5 THEN c + 101 ELSE c END AS node FROM r, unnest([0, 1, 2, 3, 4, 5, 6]) AS u(k)),
p AS (SELECT way, k, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2, count(*) OVER (PARTITION BY way) AS n FROM refs JOIN nd ON nd.node = refs.node WINDOW w AS (PARTITION BY way ORDER BY k)), g AS (SELECT *, sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) AS d FROM p WHERE n > 2 AND x2 IS NOT NULL)
SELECT way AS osm_way_id, 'yes' AS building, round(sum(d * (x + x2) / 2) / sum(d), 6) AS x, round(sum(d * (y + y2) / 2) / sum(d), 6) AS y FROM g GROUP BY 1""")
def r22_pois(spark: SparkSession, d: str) -> DataFrame:
    ways = grid_ways(spark, d).withColumn("tags", F.create_map(F.lit("building"), F.lit("yes"))).withColumn("refs", F.concat("refs", F.array(F.col("refs")[0] + 101, F.col("refs")[0])))
    return osm.pois(ways, grid_nodes(spark, d)).select("osm_way_id", "building", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@q()
def r25_lane_sections(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = table(spark, d, "events").select(F.col("user_id").alias("rid"), F.row_number().over(w).alias("pos"), F.floor(F.col("value") / 40).cast("int").alias("lanes")).withColumn("at", F.col("pos") * 12.0)
    return simulation.lane_sections(p, 12.0)


@q()
def r26_insert_nodes(spark: SparkSession, d: str) -> DataFrame:
    ways = grid_ways(spark, d)
    places = grid_nodes(spark, d).select(F.col("id").alias("node"), "x", "y")
    roads = ways.select(F.col("id").alias("rid"), F.concat(F.slice("refs", 1, 2), F.slice("refs", 4, 2)).alias("nodes"))
    return simulation.insert_nodes(roads, ways.select(F.col("id").alias("rid"), F.col("refs")[2].alias("node")), places).select("rid", F.array_join("nodes", ",").alias("nodes"))


@q(sql("v_map", """WITH c AS (SELECT eid, rid AS root, avg(tie) AS mean FROM v_map GROUP BY 1, 2), r AS (SELECT eid, root, row_number() OVER (PARTITION BY eid ORDER BY mean, root) AS rank FROM c),
iv AS (SELECT eid, rid AS root, ofs / 10.0::DOUBLE AS a, least(1.0::DOUBLE, ofs / 10.0::DOUBLE + lane_num / 10.0::DOUBLE) AS b FROM v_map), u AS (SELECT r.eid, t.rank AS upto, a, b FROM r JOIN iv ON iv.eid = r.eid AND iv.root = r.root JOIN r t ON t.eid = r.eid AND r.rank <= t.rank),
m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY eid, upto ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM u), g AS (SELECT *, sum(new) OVER (PARTITION BY eid, upto ORDER BY a, b, new DESC ROWS UNBOUNDED PRECEDING) AS i FROM m),
s AS (SELECT eid, upto, i, max(b) - min(a) AS len FROM g GROUP BY 1, 2, 3), v AS (SELECT eid, upto AS rank, sum(len) AS c FROM s GROUP BY 1, 2), o AS (SELECT r.eid, r.rank, r.root, coalesce(v.c, 0) AS c FROM r LEFT JOIN v ON v.eid = r.eid AND v.rank = r.rank)
SELECT eid, rank, root, round(c, 6) AS coverage FROM (SELECT *, coalesce(lag(c) OVER (PARTITION BY eid ORDER BY rank), 0) AS before FROM o) WHERE before <= 0.75"""))
def r30_greedy_coverage(spark: SparkSession, d: str) -> DataFrame:
    m = v_map(spark, d)
    ranked = fusion.rank_candidates(m.selectExpr("eid", "rid root", "pid rid", "tie distance"))
    matched = m.selectExpr("eid", "rid root", "ofs / 10D start", "least(1D, ofs / 10D + lane_num / 10D) end")
    # coverages are tenths: a threshold between two of them does not hang on their last digit
    return fusion.greedy_coverage(ranked, matched, 0.75).withColumn("coverage", F.round("coverage", 6))


@q()
def r31_road_match(spark: SparkSession, d: str) -> DataFrame:
    # lines of some metres, side by side, so that each has a few neighbours
    small = lambda c: F.transform(F.slice(c, 1, 3), lambda p: F.struct((p["x"] / 2000 + F.col("id") * 0.0002).alias("x"), (p["y"] / 2000).alias("y")))
    edges = v_line(spark, d, 4).select(F.col("id").alias("eid"), small("coords").alias("coords"))
    roads = v_line(spark, d, 4, 8).select(F.col("id").alias("rid"), small("coords").alias("line"))
    return spatial.road_match(edges, roads).select("eid", "rid", F.round("angle", 4).alias("angle"), F.round("frechet", 4).alias("frechet"))


@q()
def r32_main_roads(spark: SparkSession, d: str) -> DataFrame:
    return graph.main_roads(v_graph(spark, d).selectExpr("src % 17 k", "src", "dst", "length"), "k", 50.0)


@q(sql("v_map", """WITH t AS (SELECT v.eid, ofs, pid, p_size FROM v_map v JOIN part ON p_partkey = pid), g AS (SELECT eid AS root, array_to_string(list(pid ORDER BY ofs, pid, p_size), ';') AS rids, count(*) AS n_roads, sum(p_size) AS n_panos, count(*) AS points FROM t GROUP BY 1)
SELECT min(root) AS root, rids, CAST(max(n_roads) AS INTEGER) AS n_roads, CAST(max(n_panos) AS BIGINT) AS n_panos, CAST(max(points) AS INTEGER) AS points FROM g GROUP BY rids"""))
def r34_trajectory_table(spark: SparkSession, d: str) -> DataFrame:
    trajs = v_map(spark, d).selectExpr("eid root", "ofs seq", "pid rid")
    roads = table(spark, d, "part").selectExpr("p_partkey ID", "p_size n", "array(named_struct('x', cast(p_size as double), 'y', 1D)) line")
    return pano.trajectory_table(trajs, roads).select("root", "rids", "n_roads", "n_panos", F.size("line").alias("points"))


@q("""WITH e AS (SELECT c_nationkey AS city, c_custkey AS eid, CASE WHEN c_custkey % 3 = 0 THEN 'primary_link' WHEN c_custkey % 3 = 1 THEN 'secondary' ELSE 'service' END AS road_type FROM customer),
t AS (SELECT *, CASE road_type WHEN 'primary_link' THEN 3.3::DOUBLE WHEN 'secondary' THEN 4.0::DOUBLE ELSE 7.0::DOUBLE END AS level, contains(road_type, 'link') AS is_link FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY substr(md5('1:' || eid), 1, 8), eid) AS rn FROM t WHERE level < 6)
SELECT city, eid, road_type, level, is_link FROM r WHERE rn <= 10""")
def r42_test_set(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "customer").selectExpr("c_nationkey city", "c_custkey eid", "case when c_custkey % 3 = 0 then 'primary_link' when c_custkey % 3 = 1 then 'secondary' else 'service' end road_type")
    return filters.draw_test_set(e, 10)


@q(sql("v_map", """WITH way AS (SELECT rid, min(ofs) AS road_seq FROM v_map WHERE eid = 7 GROUP BY 1), p AS (SELECT rid, pid, ofs AS ord, pid % 360 AS dir, count(*) OVER (PARTITION BY rid) AS n FROM v_map)
SELECT road_seq, p.rid, pid, ord, dir, p_size % 5 AS lane_num FROM way JOIN p ON p.rid = way.rid JOIN part ON p_partkey = pid AND p_partkey % 360 = dir WHERE n <= 3 OR ord % 3 = 1"""))
def r43_predictions_along(spark: SparkSession, d: str) -> DataFrame:
    way = v_map(spark, d).where("eid = 7").selectExpr("ofs seq", "rid")
    panos = v_map(spark, d).selectExpr("rid", "pid", "ofs ord", "pid % 360 dir")
    memo = table(spark, d, "part").selectExpr("p_partkey pid", "p_partkey % 360 dir", "p_size % 5 lane_num")
    return pano.predictions_along(way, panos, memo)


@q("""WITH RECURSIVE e AS (SELECT o_orderkey AS eid, o_orderkey AS s, (o_orderkey * 31 + o_custkey) % 15000 AS e FROM orders), i AS (SELECT e AS node, min(eid) AS link FROM e GROUP BY 1 HAVING count(*) = 1), o AS (SELECT s AS node, min(eid) AS nxt FROM e GROUP BY 1 HAVING count(*) = 1),
st AS (SELECT link, nxt FROM i JOIN o ON o.node = i.node WHERE link <> nxt), w AS (SELECT eid, eid AS grp, 0 AS place FROM e WHERE eid NOT IN (SELECT nxt FROM st) UNION ALL SELECT st.nxt, w.grp, w.place + 1 FROM w JOIN st ON st.link = w.eid)
SELECT eid, grp, place FROM w UNION ALL SELECT eid, eid, 0 FROM e WHERE eid NOT IN (SELECT eid FROM w)""")
def r44_chained_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.chain_edges(table(spark, d, "orders").selectExpr("o_orderkey eid", "o_orderkey s", "(o_orderkey * 31 + o_custkey) % 15000 e"))


@q(sql("v_map", """WITH s AS (SELECT eid, pid, max(CASE WHEN rid = 7 THEN 1 ELSE 0 END) AS a, max(CASE WHEN rid = 11 THEN 1 ELSE 0 END) AS b FROM v_map WHERE rid IN (7, 11) GROUP BY 1, 2)
SELECT eid, CAST(sum(a * b) AS BIGINT) AS shared, CAST(sum(a * (1 - b)) AS BIGINT) AS only_first, CAST(sum(b * (1 - a)) AS BIGINT) AS only_second FROM s GROUP BY 1"""))
def r47_trajectory_overlap(spark: SparkSession, d: str) -> DataFrame:
    return pano.trajectory_overlap(v_map(spark, d).selectExpr("eid", "cast(rid as string) root", "pid"), "7", "11")


def _pairs_of_lines(shift: int) -> str:
    """Lines of three points against those of the three points after ``shift`` numbers, segment by segment: whether they cross, and how near their ends come."""
    points = "SELECT vec_id AS {id}, i, CAST(embedding[{k} + 2 * i - 1] AS DOUBLE) AS x, CAST(embedding[{k} + 2 * i] AS DOUBLE) AS y FROM embeddings, unnest([1, 2, 3]) AS u(i)"
    segments = "SELECT {id}, x AS {p}x, y AS {p}y, lead(x) OVER w AS {q}x, lead(y) OVER w AS {q}y FROM ({points}) WINDOW w AS (PARTITION BY {id} ORDER BY i)"
    sa = segments.format(id="id", p="m", q="n", points=points.format(id="id", k=0))
    sb = segments.format(id="rid", p="u", q="v", points=points.format(id="rid", k=shift))
    side = lambda p, q, r: f"(({q}x - {p}x) * ({r}y - {p}y) - ({q}y - {p}y) * ({r}x - {p}x))"
    at = lambda p, a, b: f"greatest(0, least(1, (({p}x - {a}x) * ({b}x - {a}x) + ({p}y - {a}y) * ({b}y - {a}y)) / (pow({b}x - {a}x, 2) + pow({b}y - {a}y, 2))))"
    far = lambda p, a, b: f"sqrt(pow({p}x - {a}x - {at(p, a, b)} * ({b}x - {a}x), 2) + pow({p}y - {a}y - {at(p, a, b)} * ({b}y - {a}y), 2))"
    crosses = f"{side('m', 'n', 'u')} * {side('m', 'n', 'v')} <= 0 AND {side('u', 'v', 'm')} * {side('u', 'v', 'n')} <= 0"
    near = ", ".join(far(p, a, b) for p, a, b in (("m", "u", "v"), ("n", "u", "v"), ("u", "m", "n"), ("v", "m", "n")))
    return f"sa AS ({sa}), sb AS ({sb}), pr AS (SELECT id, rid, {crosses} AS crosses, least({near}) AS d FROM sa, sb WHERE nx IS NOT NULL AND vx IS NOT NULL), nl AS (SELECT id, rid, CASE WHEN bool_or(crosses) THEN 0 ELSE min(d) END AS distance FROM pr GROUP BY 1, 2)"


@q(sql("v_seg", f"WITH s AS (SELECT id, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM v_seg WHERE i <= 4 WINDOW w AS (PARTITION BY id ORDER BY i)) SELECT id, CAST(sum(greatest(1, round(sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) * {METRES_PER_DEGREE} / 1000.0) - 1)) + 1 AS INTEGER) AS points FROM s WHERE x2 IS NOT NULL GROUP BY 1"))
def g15_densified(spark: SparkSession, d: str) -> DataFrame:
    return v_line(spark, d, 4).select("id", F.size(line.densify(F.col("coords"), 1000.0)).alias("points"))


@q()
def g16_cut_to_overlap(spark: SparkSession, d: str) -> DataFrame:
    a = v_line(spark, d, 4)
    return a.join(a.select((F.col("id") - 1).alias("id"), F.col("coords").alias("other")), "id").select("id", F.size(line.cut_to_overlap(F.col("coords"), F.col("other"))).alias("points"))


@q(sql("v_seg", """WITH m AS (SELECT a.id, (a.x + b.x) / 2 AS px, (a.y + b.y) / 2 AS py FROM v_seg a JOIN v_seg b ON b.id = a.id AND a.i = 1 AND b.i = 4), s AS (SELECT id - 1 AS id, i - 1 AS i, x, y, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM v_seg WHERE i <= 4 WINDOW w AS (PARTITION BY id ORDER BY i)),
t AS (SELECT m.id, i, ((px - x) * dx + (py - y) * dy) / (dx * dx + dy * dy) AS t FROM m JOIN s ON s.id = m.id WHERE dx IS NOT NULL)
SELECT id, round(coalesce(arg_min((i + t) / 3, i) FILTER (WHERE t BETWEEN 0 AND 1), CASE WHEN arg_min(t, i) < 0 THEN 0 ELSE 1 END), 6) AS at FROM t GROUP BY 1"""))
def g17_relative_position(spark: SparkSession, d: str) -> DataFrame:
    a = v_line(spark, d, 4)
    return a.join(a.select((F.col("id") - 1).alias("id"), F.col("coords").alias("other")), "id").select("id", F.round(line.relative_position(F.col("coords"), F.col("other")), 6).alias("at"))


@q()
def g18_offset_line(spark: SparkSession, d: str) -> DataFrame:
    return v_line(spark, d, 4).select("id", line.to_wkt(line.offset_right(F.col("coords"), 500.0)).alias("wkt"))


@q(f"""WITH {_NODES}, a AS (SELECT node, radians(y) AS phi, radians(x - 111) AS lam, pow({WGS84_E}::DOUBLE, 2) AS e FROM nd),
b AS (SELECT *, e / (1 - e) AS ep, {WGS84_A}::DOUBLE / sqrt(1 - e * pow(sin(phi), 2)) AS n, pow(tan(phi), 2) AS t, cos(phi) * lam AS a,
  {WGS84_A}::DOUBLE * ((1 - e / 4 - 3 * pow(e, 2) / 64 - 5 * pow(e, 3) / 256) * phi - (3 * e / 8 + 3 * pow(e, 2) / 32 + 45 * pow(e, 3) / 1024) * sin(2 * phi) + (15 * pow(e, 2) / 256 + 45 * pow(e, 3) / 1024) * sin(4 * phi) - 35 * pow(e, 3) / 3072 * sin(6 * phi)) AS m FROM a),
c AS (SELECT *, ep * pow(cos(phi), 2) AS c FROM b)
SELECT node AS id, round(0.9996::DOUBLE * n * (a + (1 - t + c) * pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * pow(a, 5) / 120) + 500000, 2) AS x,
  round(0.9996::DOUBLE * (m + n * tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * pow(a, 6) / 720)), 2) AS y FROM c""")
def g23_utm(spark: SparkSession, d: str) -> DataFrame:
    return grid_nodes(spark, d).select("id", geo.utm("x", "y").alias("p")).select("id", "p.x", "p.y")


@q(f"""WITH {_NODES}, a AS (SELECT *, x - 105 AS u, y - 35 AS v, radians(y) AS r FROM nd),
b AS (SELECT *, (20 * sin(6 * u * pi()) + 20 * sin(2 * u * pi())) * 2 / 3 AS wave, 1 - {geo.GCJ_EE}::DOUBLE * pow(sin(r), 2) AS mg FROM a),
c AS (SELECT *, -100 + 2 * u + 3 * v + 0.2::DOUBLE * v * v + 0.1::DOUBLE * u * v + 0.2::DOUBLE * sqrt(abs(u)) + wave + (20 * sin(v * pi()) + 40 * sin(v / 3 * pi())) * 2 / 3 + (160 * sin(v / 12 * pi()) + 320 * sin(v * pi() / 30)) * 2 / 3 AS dy,
  300 + u + 2 * v + 0.1::DOUBLE * u * u + 0.1::DOUBLE * u * v + 0.1::DOUBLE * sqrt(abs(u)) + wave + (20 * sin(u * pi()) + 40 * sin(u / 3 * pi())) * 2 / 3 + (150 * sin(u / 12 * pi()) + 300 * sin(u / 30 * pi())) * 2 / 3 AS dx FROM b),
g AS (SELECT node, x + dx * 180 / ({geo.GCJ_A}::DOUBLE / sqrt(mg) * cos(r) * pi()) AS gx, y + dy * 180 / ({geo.GCJ_A}::DOUBLE * (1 - {geo.GCJ_EE}::DOUBLE) / (mg * sqrt(mg)) * pi()) AS gy FROM c),
z AS (SELECT node, sqrt(gx * gx + gy * gy) + 0.00002::DOUBLE * sin(gy * pi() * 3000 / 180) AS z, atan2(gy, gx) + 0.000003::DOUBLE * cos(gx * pi() * 3000 / 180) AS th FROM g)
SELECT node AS id, round(z * cos(th) + 0.0065::DOUBLE, 7) AS x, round(z * sin(th) + 0.006::DOUBLE, 7) AS y FROM z""")
def g25_provider_coordinates(spark: SparkSession, d: str) -> DataFrame:
    return grid_nodes(spark, d).select("id", geo.wgs_to_bd("x", "y").alias("p")).select("id", F.round("p.x", 7).alias("x"), F.round("p.y", 7).alias("y"))


@q("""WITH s AS (SELECT DISTINCT l_orderkey AS eid, l_linenumber * 10 AS a, l_linenumber * 10 + 4 AS b, CAST(trunc(l_quantity) AS INTEGER) % 6 AS v FROM lineitem),
met AS (SELECT eid, least(12, min(a)) AS a, greatest(33, max(b)) AS b, max(struct_pack(a := a, b := b, v := v)).v AS v FROM s WHERE b >= 12 AND a <= 33 GROUP BY 1),
n AS (SELECT e.eid, coalesce(met.a, 12) AS a, coalesce(met.b, 33) AS b, coalesce(met.v, 9) AS v FROM (SELECT DISTINCT eid FROM s) e LEFT JOIN met ON met.eid = e.eid),
u AS (SELECT * FROM s WHERE b < 12 OR a > 33 UNION ALL SELECT * FROM n)
SELECT eid, CAST(row_number() OVER (PARTITION BY eid ORDER BY a, b, v) - 1 AS INTEGER) AS k, a AS start, b AS "end", v AS value FROM u""")
def g29_inserted_interval(spark: SparkSession, d: str) -> DataFrame:
    spans = v_map(spark, d).groupBy("eid").agg(F.array_sort(F.collect_set(F.struct((F.col("ofs") * 10).alias("start"), (F.col("ofs") * 10 + 4).alias("end"), F.col("lane_num").alias("value")))).alias("s"))
    new = F.struct(F.lit(12).alias("start"), F.lit(33).alias("end"), F.lit(9).alias("value"))
    return spans.select("eid", F.posexplode(intervals.insert_interval(F.col("s"), new)).alias("k", "x")).select("eid", "k", "x.start", "x.end", "x.value")


@q(f"WITH {_pairs_of_lines(10)} SELECT DISTINCT rid FROM nl WHERE id % 7 = 3 AND distance <= 3000.0 / 110000")
def p08_road_filter(spark: SparkSession, d: str) -> DataFrame:
    edges = v_line(spark, d, 3).selectExpr("id eid", "cast(id % 7 as string) name", "'primary' road_type", "coords")
    return spatial.filter_roads(edges, v_line(spark, d, 3, 10).selectExpr("id rid", "coords line"), name="3", buffer_m=3000.0)[1].select("rid")


@q("SELECT id, -o_custkey AS rid, CAST(n AS INTEGER) AS \"order\", 'Ramp' AS postfix FROM (SELECT *, '-' || o_custkey || '#' || n || '-Ramp' AS id FROM (SELECT *, o_orderkey % 9 AS n FROM orders))")
def p14_edge_ids(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "orders").select(F.format_string("-%d#%d-Ramp", F.col("o_custkey"), F.col("o_orderkey") % 9).alias("id"))
    return e.select("id", filters.edge_id_parts(F.col("id")).alias("p")).select("id", "p.rid", "p.order", "p.postfix")


@q("SELECT o_orderkey FROM orders WHERE CAST('0x' || substr(md5('42:' || o_orderkey), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.05")
def p16_sample(spark: SparkSession, d: str) -> DataFrame:
    return filters.split_fraction(table(spark, d, "orders"), ["o_orderkey"], 0.05)[0].select("o_orderkey")


@q(f"WITH {_pairs_of_lines(12)} SELECT id, rid, round(distance, 9) AS distance FROM nl WHERE distance <= 0.01")
def j09_candidate_lines(spark: SparkSession, d: str) -> DataFrame:
    return spatial.near_line_pairs(v_line(spark, d, 3), v_line(spark, d, 3, 12).selectExpr("id rid", "coords line"), 0.01, size=0.2).select("id", "rid", F.round("distance", 9).alias("distance"))


@q("SELECT o_orderkey, CAST(k AS INTEGER) AS k, CASE k WHEN 0 THEN CAST(o_custkey AS DOUBLE) ELSE 5 END AS x0, CASE k WHEN 0 THEN CAST(o_orderkey AS DOUBLE) ELSE 8 END AS y1 FROM orders, unnest([0, 1]) AS u(k)")
def x04_road_shapes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").select("o_orderkey", F.format_string("1|2|%d,2,3,%d;5,6,7,8;", F.col("o_custkey"), F.col("o_orderkey")).alias("t"))
    return t.select("o_orderkey", F.posexplode(tables.road_shapes(F.col("t"))).alias("k", "s")).select("o_orderkey", "k", F.col("s.start.x").alias("x0"), F.col("s.end.y").alias("y1"))


@q(sql("v_map", """WITH p AS (SELECT eid, list(pid ORDER BY pid) AS p FROM v_map GROUP BY 1 HAVING count(*) > 3) SELECT eid, CAST(part AS INTEGER) AS part, array_to_string(CASE part WHEN 0 THEN p[1:3] ELSE p[3:] END, ',') AS pids FROM p, unnest([0, 1]) AS u(part)"""))
def n08_split_at(spark: SparkSession, d: str) -> DataFrame:
    ids = v_map(spark, d).groupBy("eid").agg(F.sort_array(F.collect_list("pid")).alias("p")).where("size(p) > 3")
    return ids.select("eid", F.posexplode(line.split_at(F.col("p"), F.array(F.lit(2)))).alias("part", "pids")).select("eid", "part", F.array_join("pids", ",").alias("pids"))
