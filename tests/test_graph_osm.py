"""Graph, network, observation and simulator operators on hand-made rows."""

import math
import random
import struct
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lanewise.operators import filters, fusion, graph, matching, osm, pano, relational, simulation, spatial, windows
from lanewise.sources import networks, osm_files, sinks, tables

XML = """<?xml version="1.0"?>
<osm><bounds minlat="22.0" minlon="113.0" maxlat="23.0" maxlon="114.0"/>
<node id="1" lat="22.500" lon="113.900"/><node id="2" lat="22.500" lon="113.901"/><node id="3" lat="22.500" lon="113.902"><tag k="highway" v="traffic_signals"/></node>
<node id="4" lat="22.500" lon="113.903"/><node id="5" lat="22.501" lon="113.902"/><node id="6" lat="22.499" lon="113.902"/>
<node id="7" lat="22.5005" lon="113.9005"/><node id="8" lat="22.5007" lon="113.9005"/><node id="9" lat="22.5007" lon="113.9007"/>
<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="99"/><nd ref="4"/><tag k="highway" v="primary"/><tag k="name" v="Main"/><tag k="oneway" v="yes"/><tag k="lanes" v="3"/></way>
<way id="11"><nd ref="5"/><nd ref="3"/><nd ref="6"/><tag k="highway" v="residential"/><tag k="lanes" v="3"/><tag k="maxspeed" v="30 km"/></way>
<way id="12"><nd ref="1"/><nd ref="5"/><tag k="highway" v="footway"/></way>
<way id="13"><nd ref="7"/><nd ref="8"/><nd ref="9"/><nd ref="7"/><tag k="building" v="yes"/><tag k="amenity" v="school"/></way>
<way id="14"><nd ref="7"/><nd ref="8"/></way><way id="15"><nd ref="9"/><nd ref="8"/></way><way id="16"><nd ref="9"/><nd ref="7"/></way>
<relation id="20"><member type="way" ref="14" role="outer"/><member type="way" ref="15" role="outer"/><member type="way" ref="16" role="outer"/><tag k="building" v="house"/></relation>
</osm>"""


@pytest.fixture(scope="module")
def osm_tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("osm") / "map.osm"
    path.write_text(XML)
    assert osm_files.read_bounds(spark, str(path)) == (113.0, 22.0, 114.0, 23.0)
    return osm_files.read_xml(spark, str(path))


def test_xml_to_csv(spark, osm_tables, tmp_path):
    nodes, ways, relations = osm_tables
    assert nodes.count() == 9 and ways.count() == 7 and relations.first().members[0].role == "outer"
    net = osm.build_network(nodes, ways, relations, with_pois=True)
    links = {(r.way, r.src, r.dst): r for r in net.links.collect()}
    assert set(links) == {(10, 1, 3), (10, 3, 4), (11, 5, 3), (11, 3, 5), (11, 3, 6), (11, 6, 3)}
    assert (links[10, 1, 3].lanes, links[11, 5, 3].lanes, links[11, 5, 3].free_speed) == (3, 2, 30.0)
    assert sorted(r.link_id for r in links.values()) == list(range(6))
    assert {r.osm_node_id: r.ctrl_type for r in net.nodes.collect()} == {1: 0, 3: 1, 4: 0, 5: 0, 6: 0}
    assert {(r.osm_way_id, r.osm_relation_id, r.building, r.amenity) for r in net.pois.collect()} == {(13, None, "yes", "school"), (None, 20, "house", None)}
    networks.write_gmns(net, str(tmp_path))
    header = [f for f in (tmp_path / "link.csv").iterdir() if f.suffix == ".csv"][0].read_text().splitlines()[0]
    assert header.split(",")[:4] == ["name", "link_id", "osm_way_id", "from_node_id"]
    back_nodes, back_links = networks.read_gmns(spark, str(tmp_path))
    assert back_links.count() == 6 and back_nodes.where("size(incoming) = 3").count() == 1
    assert not (tmp_path / "segment.csv").exists()


def test_components_below_a_size_go(osm_tables):
    nodes, ways, _ = osm_tables
    assert osm.build_network(nodes, ways, min_nodes=6).links.count() == 0
    assert osm.build_network(nodes, ways, min_nodes=5).links.count() == 6


def _varint(n):
    out = b""
    while True:
        b, n = n & 127, n >> 7
        out += bytes([b | (128 if n else 0)])
        if not n:
            return out


def _field(k, v):
    return _varint(k << 3 | 2) + _varint(len(v)) + v if isinstance(v, bytes) else _varint(k << 3) + _varint(v)


def _packed(values, signed=False):
    return b"".join(_varint((v << 1) ^ (v >> 63) if signed else v) for v in values)


def _deltas(values):
    return [b - a for a, b in zip([0, *values], values, strict=False)]


def test_pbf_matches_xml(spark, tmp_path):
    strings = [b"", b"highway", b"primary", b"outer", b"traffic_signals"]
    dense = _field(1, _packed(_deltas([5, 7]), True)) + _field(8, _packed(_deltas([225000000, 225010000]), True)) + _field(9, _packed(_deltas([1139000000, 1139010000]), True)) + _field(10, _packed([0, 1, 4, 0]))
    way = _field(1, 10) + _field(2, _packed([1])) + _field(3, _packed([2])) + _field(8, _packed(_deltas([5, 7]), True))
    rel = _field(1, 20) + _field(8, _packed([3])) + _field(9, _packed(_deltas([10]), True)) + _field(10, _packed([1]))
    block = _field(1, b"".join(_field(1, s) for s in strings)) + _field(2, _field(2, dense)) + _field(2, _field(3, way) + _field(4, rel))
    path = tmp_path / "map.pbf"
    with path.open("wb") as f:
        for kind, blob in ((b"OSMHeader", _field(1, b"x")), (b"OSMData", _field(2, len(block)) + _field(3, zlib.compress(block)))):
            head = _field(1, kind) + _field(3, len(blob))
            f.write(struct.pack(">I", len(head)) + head + blob)
    nodes, ways, relations = osm_files.read_pbf(spark, str(path))
    assert [(r.id, round(r.x, 6), round(r.y, 6), r.tags) for r in nodes.orderBy("id").collect()] == [(5, 113.9, 22.5, {}), (7, 113.901, 22.501, {"highway": "traffic_signals"})]
    assert [(r.id, r.refs, r.tags) for r in ways.collect()] == [(10, [5, 7], {"highway": "primary"})]
    assert [(m.type, m.ref, m.role) for m in relations.first().members] == [("way", 10, "outer")]


LINKS = "link long, src long, dst long, lanes int, length double"
SAME = ("*", "'Main' name", "3 link_type", "39D free_speed", "'auto' allowed_uses", "0 biway", "link * 10 way", "array(named_struct('x', cast(src as double), 'y', 0D), named_struct('x', cast(dst as double), 'y', 0D)) coords")


def combined(spark, rows, signals=(9,)):
    return graph.combine_links(spark.createDataFrame(rows, LINKS).selectExpr(*SAME), spark.createDataFrame([(n,) for n in signals], "node long"))


def test_chains_are_combined(spark):
    rows = [(1, 1, 2, 3, 10.0), (2, 2, 3, 3, 20.0), (3, 3, 4, 2, 5.0), (4, 4, 5, 3, 1.0), (5, 4, 6, 3, 1.0)]
    out = {r.link: r for r in combined(spark, rows).collect()}
    assert set(out) == {1, 4, 5}
    assert (out[1].members, out[1].length, out[1].lanes, out[1].lane_list, out[1].change_points, out[1].dst) == ("10;20;30", 35.0, 3, [3, 2], [30.0], 4)
    assert [p.x for p in out[1].coords] == [1.0, 2.0, 3.0, 4.0]
    segments = graph.lane_segments(combined(spark, rows)).collect()
    assert [(s.link, s.start_lr, s.end_lr, s.l_lanes_added, s.r_lanes_added) for s in segments] == [(1, 30.0, 35.0, -1, 0)]
    assert {r.members for r in combined(spark, rows, (2,)).collect()} == {"10", "20;30", "40", "50"}


def test_lane_lists_and_segments_of_combined_links(spark):
    rows = [(1, 1, 2, 2, 5.0), (2, 2, 3, 3, 5.0), (3, 3, 4, 3, 5.0), (4, 11, 12, 2, 1.0), (5, 12, 13, 4, 2.0), (6, 13, 14, 2, 3.0), (7, 21, 22, None, 1.0), (8, 22, 23, None, 1.0), (9, 31, 32, None, 1.0), (10, 32, 33, 2, 1.0)]
    out = {r.link: r for r in combined(spark, rows).collect()}
    assert (out[1].lane_list, out[1].change_points) == ([2, 3], [5.0])
    assert (out[4].lane_list, out[4].change_points) == ([2, 4, 2], [1.0, 3.0])
    assert (out[7].members, out[7].lane_list, out[7].change_points) == ("70;80", [None], []) and {9, 10} <= set(out)
    got = sorted((s.link, s.start_lr, s.end_lr, s.l_lanes_added, s.r_lanes_added) for s in graph.lane_segments(combined(spark, rows)).collect())
    assert got == [(1, 5.0, 15.0, 1, 0), (4, 1.0, 3.0, 2, 0), (4, 3.0, 6.0, 0, 0)]


def test_a_loop_stays_two_links(spark):
    rows = [(1, 9, 2, 1, 1.0), (2, 2, 3, 1, 1.0), (3, 3, 4, 1, 1.0), (4, 4, 9, 1, 1.0)]
    assert {(r.members, r.src, r.dst) for r in combined(spark, rows).collect()} == {("10;20;30", 9, 4), ("40", 4, 9)}


def test_two_way_roads_combine_both_directions(spark):
    rows = [(1, 1, 2), (2, 2, 3), (3, 3, 2), (4, 2, 1)]
    links = spark.createDataFrame(rows, "link long, src long, dst long").selectExpr("*", "2 lanes", "1D length", "'a' name", "3 link_type", "39D free_speed", "'auto' allowed_uses", "1 biway")
    got = {r.members for r in graph.combine_links(links, spark.createDataFrame([(9,)], "node long")).collect()}
    assert got == {"1;2", "3;4"}


def test_longest_path_and_components(spark):
    edges = spark.createDataFrame([("a", 1, 2, 1.0), ("a", 2, 3, 5.0), ("a", 2, 4, 1.0), ("b", 7, 8, 1.0)], "k string, src long, dst long, length double")
    got = {}
    for r in graph.longest_path(edges, "k").orderBy("k", "seq").collect():
        got.setdefault(r.k, []).append(r.node)
    assert sorted(got["a"]) in ([1, 2, 3], [2, 3, 4]) and len(got["a"]) == 3 and sorted(got["b"]) == [7, 8]
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)], "src long, dst long")
    nodes = spark.range(70).withColumnRenamed("id", "node")
    labels = {r.node: r.component for r in graph.components(nodes, chain).collect()}
    assert {labels[k] for k in range(61)} == {0} and labels[65] == 65


EDGES = "k string, src long, dst long, x0 double, y0 double, x1 double, y1 double"


def test_direction_repair_flips_the_straight_edge(spark):
    rows = [("r", 1, 2, 0.0, 0.0, 1.0, 0.0), ("r", 3, 2, 2.0, 0.0, 1.0, 0.0), ("r", 5, 2, 1.0, 3.0, 1.0, 0.0)]
    table = spark.createDataFrame(rows, EDGES)
    flipped = lambda out: sorted((r.k, r.src, r.dst) for r in out.collect() if r.flipped)
    # a walk of one edge is no road yet
    assert flipped(graph.repair_directions(table, "k")) == []
    # 0-1-2, and 3-2 against it: the edge that the walk came by stays
    road = [("r", 0, 1, -1.0, 0.0, 0.0, 0.0), *rows, ("s", 1, 2, 0.0, 0.0, 1.0, 0.0), ("s", 2, 3, 1.0, 0.0, 2.0, 0.0), ("s", 4, 3, 3.0, 0.0, 2.0, 0.0), ("s", 5, 4, 4.0, 0.0, 3.0, 0.0)]
    table = spark.createDataFrame(road, EDGES)
    starts = spark.createDataFrame([("r", 0), ("s", 1)], "k string, node long")
    assert flipped(graph.repair_directions(table, "k", starts)) == [("r", 2, 3), ("s", 3, 4), ("s", 4, 5)]
    out = {(r.k, r.src, r.dst): (r.x0, r.x1) for r in graph.repair_directions(table, "k", starts).collect()}
    assert out["r", 2, 3] == (1.0, 2.0) and len(out) == 8


def test_edge_ids(spark):
    rows = spark.createDataFrame([("-208128052#5-AddedOffRampEdge",), ("7",), ("",), ("12#3",)], "e string")
    got = [tuple(r.p) for r in rows.select(filters.edge_id_parts(F.col("e")).alias("p")).collect()]
    assert got == [(-208128052, 5, "AddedOffRampEdge"), (7, 0, None), (-1, 0, None), (12, 3, None)]


def test_cluster_ids(spark):
    rows = spark.createDataFrame([("cluster_5_9", [4, 5, 9, 7]), ("7", [4, 7]), ("8", [4])], "c string, o array<long>")
    assert [r[0] for r in rows.select(simulation.resolve_cluster(F.col("c"), F.col("o"))).collect()] == [2, 1, None]


def test_simulator_xml_round_trip(spark, tmp_path):
    (tmp_path / "e.xml").write_text('<edges><edge id="-5#2" from="a" to="b" type="highway.primary" numLanes="2" speed="13.9" shape="0,0 1,1.5"><lane index="0" speed="9.0"/><lane index="1" speed="9.0"/><param key="origId" value="5"/></edge></edges>')
    (tmp_path / "n.xml").write_text('<nodes><node id="a" x="1.0" y="2.0" type="priority"/></nodes>')
    edges, nodes = networks.read_simulator(spark, str(tmp_path / "e.xml"), str(tmp_path / "n.xml"))
    e = edges.first()
    assert (e.rid, e.order, e.num_lanes, e.params, len(e.lanes), e.coords[1].y) == (-5, 2, 2, {"origId": "5"}, 2, 1.5) and nodes.first().x == 1.0
    networks.write_simulator(edges, str(tmp_path / "out"))
    again, _ = networks.read_simulator(spark, str(tmp_path / "out"), str(tmp_path / "n.xml"))
    assert again.first().id == "-5#2" and len(again.first().lanes) == 2


def test_lane_children(spark):
    lanes = spark.createDataFrame([("a", 0, 9.0), ("a", 1, 8.0), ("b", 0, 7.0), ("b", 1, 7.0)], "id string, idx int, speed double")
    got = sorted(map(tuple, simulation.set_lanes(lanes, spark.createDataFrame([("a", 4), ("b", 1)], "id string, n int")).collect()))
    assert got == [("a", 0, 9.0), ("a", 1, 8.0), ("a", 2, 8.0), ("a", 3, 8.0), ("b", 0, 7.0)]


def test_sections_and_ids(spark):
    points = spark.createDataFrame([(1, k, 10.0 * k, 3 if k < 6 else 2) for k in range(20)], "rid long, pos int, at double, lanes int")
    assert [(r.start, r.stop, r.lanes) for r in simulation.lane_sections(points).collect()] == [(0, 6, 3)]
    parts = spark.createDataFrame([(1, 0, 0.0, 60.0), (1, 1, 60.0, 100.0), (1, 2, 100.0, 110.0)], "rid long, seq int, start double, stop double")
    out = simulation.rebuild_ids(parts, spark.createDataFrame([(1, 1)], "rid long, order int")).orderBy("start").collect()
    assert [(r.id, r.start, r.stop) for r in out] == [("1#0", 0.0, 60.0), ("1#2", 60.0, 110.0)]


def test_missing_nodes_are_placed(spark):
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0), (3, 20.0, 0.0), (4, 14.0, 1.0), (5, 25.0, 0.0), (6, -3.0, 0.0)], "node long, x double, y double")
    roads = spark.createDataFrame([(7, [1, 2, 3])], "rid long, nodes array<long>")
    missing = spark.createDataFrame([(7, 4), (7, 5), (7, 6)], "rid long, node long")
    assert simulation.insert_nodes(roads, missing, places).first().nodes == [6, 1, 2, 4, 3, 5]


def test_missing_nodes_of_many_roads_need_no_python_group_each(spark):
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0), (3, 20.0, 0.0), (4, 14.0, 1.0), (5, 5.0, 2.0), (6, 0.0, 0.0)], "node long, x double, y double")
    roads = spark.createDataFrame([(1, [1, 2, 3]), (2, [1]), (3, [99]), (4, [1, 6, 2]), (5, [3, 2, 1])], "rid long, nodes array<long>")
    missing = spark.createDataFrame([(1, 4), (1, 5), (2, 3), (2, 2), (3, 2), (3, 1), (4, 5), (5, 98)], "rid long, node long")
    found = simulation.insert_nodes(roads, missing, places)
    assert {r.rid: r.nodes for r in found.collect()} == {1: [1, 5, 2, 4, 3], 2: [1, 2, 3], 3: [1, 2], 4: [1, 6, 5, 2], 5: [3, 2, 1]}
    assert "InPandas" not in found._jdf.queryExecution().executedPlan().toString()


def test_nested_text_and_roads(spark):
    text = "[{'ID': 'r1', 'IsCurrent': 1, 'Panos': [{'PID': 'b', 'Order': 2, 'DIR': 10, 'X': 5, 'Y': 6, 'Type': None}, {'PID': 'a', 'Order': 1, 'DIR': 20, 'X': 3, 'Y': 4, 'Type': 'street'}]}, {'ID': 'r2', 'IsCurrent': 0, 'Panos': []}]"
    links = "[{'PID': 'z', 'RID': 'r9', 'X': 9, 'Y': 9, 'DIR': 0}]"
    nodes = spark.createDataFrame([("a", text, links)], "ID string, t string, l string").select("ID", pano.parse_nested(F.col("t"), pano.ROADS).alias("Roads"), pano.parse_nested(F.col("l"), pano.LINKS).alias("Links"))
    assert {(r.PID, r.RID, r.Order) for r in pano.explode_panos(nodes).collect()} == {("a", "r1", 1), ("b", "r1", 2)}
    road = pano.road_table(nodes).first()
    assert (road.ID, road.src, road.dst, road.n, [(p.x, p.y) for p in road.line]) == ("r1", "a", "b", 2, [(3.0, 4.0), (5.0, 6.0)])
    assert {tuple(r) for r in pano.road_and_links(nodes).collect()} == {("r1", "a", "b", False), ("r9", "a", "z", True)}


def test_headings_are_repaired(spark):
    panos = spark.createDataFrame([("a", "r", 0, 10), ("b", "r", 1, 12), ("c", "r", 2, 14), ("d", "s", 0, 90), ("e", "s", 1, 90)], "PID string, RID string, Order int, DIR int")
    keys = spark.createDataFrame([("a", 190.0), ("d", 92.0), ("e", 88.0)], "PID string, MoveDir double")
    got = {r.PID: (r.Order, r.MoveDir, r.revert) for r in pano.repair_headings(panos, keys).collect()}
    assert got == {"a": (2, 190, True), "b": (1, 192, True), "c": (0, 194, True), "d": (0, 92, False), "e": (1, 88, False)}


def test_headings_of_reversed_and_single_panos(spark):
    rows = [("a", "r", 0, 190), ("b", "r", 1, 190), ("c", "r", 2, 190), ("alone", "s", 0, 50), ("k", "t", 0, 60), ("m", "u", 0, 10), ("n", "u", 1, 10), ("o", "u", 2, 10)]
    panos = spark.createDataFrame(rows, "PID string, RID string, Order int, DIR int")
    keys = spark.createDataFrame([("a", 10.0), ("k", 70.0), ("m", 12.0)], "PID string, MoveDir double")
    got = {r.PID: (r.Order, r.MoveDir, r.revert) for r in pano.repair_headings(panos, keys).collect()}
    assert [got[p] for p in "abc"] == [(2, 10, True), (1, 10, True), (0, 10, True)]
    assert got["alone"] == (0, -1, False) and got["k"] == (0, 70, False)
    assert [got[p] for p in "mno"] == [(0, 12, False), (1, 10, False), (2, -1, False)]


def test_topology_turns_and_normalises(spark):
    panos = spark.createDataFrame([("a", 90.0, 0.0, 0.0), ("b", 90.0, 10.0, 0.0), ("c", 90.0, 0.0, 10.0), ("d", 0.0, 5.0, 5.0)], "pid string, dir double, x double, y double")
    edges = spark.createDataFrame([("r", "a", "b", False, 0.0), ("l1", "a", "c", True, 20.0), ("l2", "a", "b", True, 20.0), ("l3", "d", "b", True, 5.0)], "rid string, src string, dst string, link boolean, dist double")
    there = {r.rid: r for r in pano.topology(edges, panos).collect()}
    # the road of no length sets the largest density; c lies north, at a right angle to the heading
    std = math.exp(-0.25)
    assert there["r"].similarity == 1 and there["r"].dist_prob == pytest.approx(0.0199471, abs=1e-7)
    assert there["l1"].similarity == pytest.approx(std * 0.5) and there["l2"].similarity == pytest.approx(std)
    assert there["l3"].cos_sim == pytest.approx(0.5) and there["l3"].turn_sim == pytest.approx((1 + math.cos(math.radians(135))) / 2)
    back = {r.rid: r for r in pano.topology(edges, panos, forward=False).collect()}
    assert back["l3"].turn_sim == pytest.approx((1 + math.cos(math.radians(45))) / 2)
    assert back["l2"].dist_prob_std == pytest.approx(std)


def test_trajectories(spark):
    rows = [("r1", "a", "b", False, 1.0), ("r2", "c", "d", False, 1.0), ("l", "b", "c", True, 0.9), ("l2", "b", "x", True, 0.6), ("r3", "p", "q", False, 1.0)]
    topo = spark.createDataFrame(rows, "rid string, src string, dst string, link boolean, similarity double")
    nodes = topo.select(F.col("src").alias("node")).union(topo.select("dst")).distinct()
    labels = graph.components(nodes, topo)
    got = {}
    for r in pano.trajectories(topo, labels).orderBy("root", "seq").collect():
        got.setdefault(r.root, []).append(r.rid)
    assert got == {"r1": ["r1", "r2"], "r3": ["r3"]}
    roads = spark.createDataFrame([(x, 2, [(0.0, 0.0), (1.0, 1.0)]) for x in ("r1", "r2", "r3")], "ID string, n int, line array<struct<x:double,y:double>>")
    t = {r.root: (r.rids, r.n_roads, r.n_panos, len(r.line)) for r in pano.trajectory_table(pano.trajectories(topo, labels), roads).collect()}
    assert t == {"r1": ("r1;r2", 2, 4, 4), "r3": ("r3", 1, 2, 2)}


def _plain_chains(pdf, threshold):
    """Greedy chains as the rule has them: every neighbour is looked at again at each step."""
    rows = pdf.sort_values(["rid", "src", "dst"])
    order = lambda c, end: {n: list(g[["src", "dst", "rid", "link", c]].itertuples(index=False, name=None)) for n, g in rows.sort_values(["link", c, "rid"], ascending=[True, False, True]).groupby(end)}
    ahead, behind, seen, out = order("similarity", "src"), order("similarity_back", "dst"), set(), []

    def walk(pid, table, side):
        found, steps = [], set()
        while True:
            for row in table.get(pid, ()):
                other, rid, link, sim = row[side], *row[2:]
                if sim < threshold or (not link and rid in seen) or (other, pid) in steps or (pid, other) in steps:
                    continue
                steps.add((pid, other))
                if not link:
                    seen.add(rid)
                    found.append(rid)
                pid = other
                break
            else:
                return found

    for r in rows[~rows.link & (rows.src != rows.dst)].drop_duplicates("rid").itertuples():
        if r.rid not in seen:
            seen.add(r.rid)
            chain = [*reversed(walk(r.src, behind, 0)), r.rid, *walk(r.dst, ahead, 1)]
            out += [(chain[0], k, rid) for k, rid in enumerate(chain)]
    return out


def test_chains_of_a_dense_component_do_not_look_at_everything_again():
    rng = random.Random(4)
    pairs = sorted({(a, b) for a in range(120) for b in rng.sample(range(120), 40) if a != b})
    rows = [(a * 1000 + b, a, b, rng.random() > 0.08, rng.random() + 0.25, rng.random() + 0.25) for a, b in pairs]
    pdf = pd.DataFrame(rows, columns=["rid", "src", "dst", "link", "similarity", "similarity_back"])
    began = time.perf_counter()
    want = _plain_chains(pdf, 0.7)
    middle = time.perf_counter()
    got = pano._chains(0.7)(pdf)
    assert list(got.itertuples(index=False, name=None)) == want
    assert time.perf_counter() - middle < (middle - began) / 3


def test_lane_filter_and_mode(spark):
    rows = [(1, k, v) for k, v in enumerate([3, 3, 3, 9, 3, 0, None])] + [(2, 0, 2), (3, 0, 4), (3, 1, 4)]
    points = spark.createDataFrame(rows, "eid long, ofs int, lane_num int")
    got = {r.eid: r.lane_num for r in fusion.lanes_by_edge(points, ["ofs"]).collect()}
    assert got == {1: 2, 3: 3}
    edges = spark.createDataFrame([(1, "primary"), (2, "primary_link"), (3, "motorway_link")], "eid long, road_type string")
    assert {r.eid: r.lane_num for r in fusion.infer_lanes(points, edges, ["ofs"]).collect()} == {1: 2, 2: 1, 3: 1}


def test_lane_filter_literals(spark):
    """FIXTURES C2, and two equal rows around a far one: they are no neighbours."""
    groups = {1: [4, 4, 3, 4], 2: [3], 3: [2, 2], 4: [0, 3, 3], 5: [5, 4, 4, 5], 6: [None], 7: [3] * 9 + [9], 8: [3, 3, 3, 3, 3, 3, 2, 9, 2, 3, 3, 3]}
    rows = [(g, (k + 1) / 10, v) for g, values in groups.items() for k, v in enumerate(values)] + [(9, 0.1, 2), (9, 0.2, 2), (9, 0.2, 5), (9, 0.3, 4)]
    points = spark.createDataFrame(rows, "eid long, offset double, lane_num int")
    kept = {}
    for r in windows.lane_filter(points, ["eid"], ["offset", "lane_num"], "lane_num").where("not outlier").orderBy("offset").collect():
        kept.setdefault(r.eid, []).append(r.lane_num)
    # in group 9 the place .2 also has a row unlike its neighbours: both go
    assert kept == {1: [4, 4], 3: [2, 2], 4: [3, 3], 5: [4, 4], 7: [3] * 9, 8: [3] * 9, 9: [2]}
    lanes = {r.eid: r.lane_num for r in fusion.lanes_by_edge(points.where("eid < 8"), ["offset"]).collect()}
    assert lanes == {1: 3, 3: 1, 4: 2, 5: 3, 7: 2}


def test_edge_types_by_the_way_back(spark):
    edges = [(1, "a", "b", 20.0), (2, "b", "a", 45.0), (3, "c", "d", 20.0), (4, "d", "c", 60.0)]  # one hop: under twice the limit, and not
    edges += [(5, "e", "f", 20.0), (6, "f", "g", 40.0), (7, "g", "h", 40.0), (8, "h", "e", 20.0)]  # three hops of 100
    edges += [(9, "i", "j", 20.0), (10, "j", "k", 40.0), (11, "k", "l", 40.0), (12, "l", "i", 40.0)]  # three hops of 120
    edges += [(13, "m", "n", 30.0), (14, "n", "m", 10.0)]  # not shorter than the limit
    edges += [(15, "o", "p", 5.0), (16, "p", "q", 20.0), (17, "q", "r", 20.0), (18, "r", "o", 40.0)]  # three hops of 80, five of 50
    edges += [(19 + k, a, b, 10.0) for k, (a, b) in enumerate(zip("pstuv", "stuvo", strict=True))]
    edges += [(30, "w", "x", 1.0), (31, "x", "w", 1.0), (32, "x", "y", 1.0)]
    table = spark.createDataFrame(edges, "eid long, src string, dst string, length double")
    got = {r.eid: r.edge_type for r in fusion.edge_types(table, spark.createDataFrame([("w",), ("y",)], "node string")).collect()}
    assert {k: got[k] for k in (1, 2, 3, 5, 9, 13, 14, 15, 30, 31, 32)} == {1: 1, 2: 0, 3: 0, 5: 2, 9: 0, 13: 0, 14: 1, 15: 0, 30: 4, 31: 3, 32: 3}


def test_cheapest_below_goes_on_for_any_number_of_hops(spark):
    line = spark.createDataFrame([(f"n{k:02}", f"n{k + 1:02}", 1.0) for k in range(30)] + [("n00", "n30", 40.0)], "src string, dst string, length double")
    pairs = spark.createDataFrame([("n00", "n30", 40.0), ("n00", "n10", 10.0), ("n05", "n30", 25.5)], "root string, goal string, bound double")
    got = {(r.root, r.goal): r.cost for r in graph.cheapest_below(line, pairs).collect()}
    assert got == {("n00", "n30"): 30.0, ("n05", "n30"): 25.0}


def test_cheapest_below_explores_no_more_than_the_pairs_need(spark, monkeypatch):
    """A pair with a short way and a large bound: what lies within half of the bound is not explored."""
    rng = random.Random(3)
    net = [(a, b, rng.expovariate(0.02)) for a in range(60) for b in rng.sample(range(60), 12) if a != b]
    edges = spark.createDataFrame(net, "src long, dst long, length double")
    asked = [(a, b, rng.choice([10.0, 25.0, 60.0, 90.0])) for a in range(0, 60, 3) for b in range(1, 60, 7) if a != b]
    sizes = []
    settle = graph.settle
    monkeypatch.setattr(graph, "settle", lambda *a: (lambda out: (sizes.append(out.count()), out)[1])(settle(*a)))
    got = {(r.root, r.goal): r.cost for r in graph.cheapest_below(edges, spark.createDataFrame(asked, "root long, goal long, bound double")).collect()}
    want = {}
    for a in {a for a, _, _ in asked}:
        cost = {n: math.inf for n in range(60)} | {a: 0.0}
        for _ in range(60):
            for s, d, w in net:
                cost[d] = min(cost[d], cost[s] + w)
        want |= {(a, b): cost[b] for x, b, bound in asked if x == a and cost[b] < bound}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    roots, goals = {a for a, _, _ in asked}, {b for _, b, _ in asked}
    assert len(sizes) > 1 and max(sizes) < (len(roots) + len(goals)) * 60 / 2


def test_map_matching_follows_the_road(spark):
    m = 1 / 110000
    edges = spark.createDataFrame([(1, 1, 2, [(0.0, 0.0), (100 * m, 0.0)]), (2, 2, 3, [(100 * m, 0.0), (200 * m, 0.0)]), (3, 3, 4, [(200 * m, 0.0), (300 * m, 0.0)]), (4, 2, 9, [(100 * m, 0.0), (100 * m, 100 * m)])], "eid long, src long, dst long, coords array<struct<x:double,y:double>>")
    points = spark.createDataFrame([("t", 0, 20 * m, 5 * m), ("t", 1, 90 * m, -4 * m), ("t", 2, 210 * m, 6 * m), ("t", 3, 280 * m, 3 * m)], "traj string, seq long, x double, y double")
    path = matching.match(points, edges).orderBy("seq").collect()
    assert [(r.eid, r.step) for r in path] == [(1, 0), (2, 1), (3, -1)]
    assert path[0].breakpoint == pytest.approx(0.2, abs=0.01) and path[-1].breakpoint == pytest.approx(0.8, abs=0.01)


def test_map_matching_of_a_sparse_track(spark):
    m = 1 / 110000
    edges = spark.createDataFrame([(k, k, k + 1, [(100 * k * m, 0.0), (100 * (k + 1) * m, 0.0)]) for k in range(1, 10)], "eid long, src long, dst long, coords array<struct<x:double,y:double>>")
    points = spark.createDataFrame([("t", 0, 120 * m, 5 * m), ("t", 1, 980 * m, -4 * m)], "traj string, seq long, x double, y double")
    for bound in (100.0, 2000.0):  # what the table of ways does not span is searched for
        got = [(r.eid, r.step) for r in matching.match(points, edges, radius_m=15.0, ways_m=bound).orderBy("seq").collect()]
        assert got == [(1, 0), *[(k, 1) for k in range(2, 9)], (9, -1)]


def test_road_match_prefers_the_parallel_road(spark):
    m = 1 / 110000
    edges = spark.createDataFrame([(1, [(0.0, 0.0), (60 * m, 0.0)])], "eid long, coords array<struct<x:double,y:double>>")
    roads = spark.createDataFrame([("near", [(0.0, 2 * m), (60 * m, 2 * m)]), ("cross", [(30 * m, -20 * m), (30 * m, 20 * m)]), ("far", [(0.0, 90 * m), (60 * m, 90 * m)])], "rid string, line array<struct<x:double,y:double>>")
    got = {r.rid: r for r in spatial.road_match(edges, roads).collect()}
    assert set(got) == {"near", "cross"} and got["near"].frechet < 4 and got["cross"].frechet == float("inf")


def test_memo_computes_what_it_lacks(spark, tmp_path):
    for name in ("memo.csv", "memo.parquet"):
        path, asked = str(tmp_path / name), []

        def compute(missing, asked=asked):
            asked.append(sorted(r.pid for r in missing.collect()))
            return missing.withColumn("lanes", F.col("pid") * 2)

        ids = lambda *v: spark.createDataFrame([(x,) for x in v], "pid long")
        assert {(r.pid, r.lanes) for r in sinks.remembered(spark, ids(1, 2), path, ["pid"], compute).collect()} == {(1, 2), (2, 4)}
        assert {(r.pid, r.lanes) for r in sinks.remembered(spark, ids(2, 3), path, ["pid"], compute).collect()} == {(2, 4), (3, 6)}
        assert sinks.remembered(spark, ids(1, 3), path, ["pid"], compute).count() == 2
        assert asked == [[1, 2], [3], []]


def test_memo_keeps_the_types_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "memo.csv")
    double = lambda missing: missing.withColumns({"note": F.concat(F.lit('"a",\n'), "pid"), "lanes": F.length("pid").cast("int")})
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "pid string")
    assert [r.pid for r in sinks.remembered(spark, ids("0911"), path, ["pid"], double).collect()] == ["0911"]
    more = lambda missing: double(missing).withColumn("lanes", F.col("lanes").cast("string")).select("lanes", "note", "pid")
    got = sinks.remembered(spark, ids("0911", "1e3", ""), path, ["pid"], more)
    assert got.dtypes == [("pid", "string"), ("note", "string"), ("lanes", "int")]
    assert {(r.pid, r.note, r.lanes) for r in got.collect()} == {("0911", '"a",\n0911', 4), ("1e3", '"a",\n1e3', 3), ("", '"a",\n', 0)}
    with pytest.raises(ValueError, match="columns"):
        sinks.save_memo(ids("7"), path)
    (tmp_path / "plain.csv").write_text("pid,n\n007,1\n")
    assert [tuple(r) for r in tables.memo(spark, str(tmp_path / "plain.csv")).collect()] == [("007", "1")]
    assert [tuple(r) for r in tables.memo(spark, str(tmp_path / "plain.csv"), "pid string, n int").collect()] == [("007", 1)]


def test_lines_rings_and_geometry_tables(spark):
    from lanewise.functions import line

    rows = [([(0.0, 0.0)],), ([(0.0, 0.0), (1.0, 0.0)],), ([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)],), ([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)],)]
    t = spark.createDataFrame(rows, "n array<struct<x:double,y:double>>")
    got = [(r.a and len(r.a), r.b and len(r.b)) for r in t.select(line.of_nodes(F.col("n")).alias("a"), line.ring_of_nodes(F.col("n")).alias("b")).collect()]
    assert got == [(None, None), (2, None), (3, 4), (4, 4)]
    assert tables.geometry_table(spark, [(0, 0), (1, 1)]).count() == 1 and tables.geometry_table(spark, [[(0, 0)], [(1, 1), (2, 2)]]).count() == 2


def test_greedy_coverage_stops_when_covered(spark):
    ranked = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "eid long, rank int, root string")
    matched = spark.createDataFrame([(1, "a", 0.0, 0.5), (1, "b", 0.4, 0.9), (1, "c", 0.9, 1.0)], "eid long, root string, start double, end double")
    got = fusion.greedy_coverage(ranked, matched).orderBy("rank").collect()
    assert [(r.root, round(r.coverage, 6)) for r in got] == [("a", 0.5), ("b", 0.9)]


def test_sources_and_sinks(spark, tmp_path):
    table = spark.createDataFrame([(1, 0.5, 0.5), (2, 5.0, 5.0)], "ID long, x double, y double")
    path = str(tmp_path / "t.parquet")
    assert sinks.save(table, path) and not sinks.save(table, path, "errorifexists")
    assert [r.ID for r in tables.scan(spark, path, ["ID"], ring=[(0, 0), (2, 0), (2, 2), (0, 2)]).collect()] == [1]
    sinks.save_upserted(spark, spark.createDataFrame([(2, 7.0, 7.0), (3, 1.0, 1.0)], "ID long, x double, y double"), path, ["ID"])
    assert {(r.ID, r.x) for r in spark.read.parquet(path).collect()} == {(1, 0.5), (2, 7.0), (3, 1.0)}
    (tmp_path / "t.parquet").rename(tmp_path / "t.parquet.old")  # as if the writer had died before the new table took its place
    assert sinks.recover(spark, path) and spark.read.parquet(path).count() == 3
    (tmp_path / "t.parquet").rename(tmp_path / "t.parquet.old")
    table.write.parquet(path + ".new")
    assert sinks.recover(spark, path) and spark.read.parquet(path).count() == 2 and not (tmp_path / "t.parquet.old").exists()
    assert not sinks.recover(spark, str(tmp_path / "none"))
    lines = spark.createDataFrame([("a", [(0.0, 0.0), (9.0, 9.0)])], "name string, coords array<struct<x:double,y:double>>")
    sinks.write_geojson(lines, "coords", str(tmp_path / "g"))
    (tmp_path / "f.json").write_text('{"type":"FeatureCollection","features":[' + "".join(f.read_text() for f in (tmp_path / "g").glob("part*")).strip() + "]}")
    f = tables.geojson(spark, str(tmp_path / "f.json")).first()
    assert (f.kind, f.properties["name"], [(p.x, p.y) for p in f.coords]) == ("LineString", "a", [(0.0, 0.0), (9.0, 9.0)])
    assert lines.where(tables.touches_box(F.col("coords"), (4.0, 3.0, 6.0, 5.0))).count() == 1
    assert lines.where(tables.touches_box(F.col("coords"), (6.0, 1.0, 8.0, 2.0))).count() == 0
    shapes = spark.createDataFrame([("1|2|1,2,3,4;5,6,7,8;",)], "t string").select(tables.road_shapes(F.col("t")).alias("s")).first().s
    assert [(s.start.x, s.end.y) for s in shapes] == [(1.0, 4.0), (5.0, 8.0)]


def test_lane_labels(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"imagePath":"a.jpg","shapes":[{"label":"1","points":[[100,200],[120.4,300]]}]}')
    row = tables.annotations(spark, str(tmp_path / "a.json")).first()
    assert [(p.x, p.y) for p in row.points] == [(125.0, 250.0), (150.0, 375.0)]
    out = spark.createDataFrame([("a.jpg", [[-2, 5]], [240, 250])], "f string, lanes array<array<int>>, rows array<int>")
    got = out.select(sinks.lane_json(F.col("f"), F.col("lanes"), F.col("rows")), sinks.lane_text(F.col("lanes")[0], F.col("rows"))).first()
    assert tuple(got) == ('{"lanes":[[-2,5]],"h_samples":[240,250],"raw_file":"a.jpg"}', "5 250")
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "x.json").write_text(got[0] + "\n")
    assert tables.lane_files(spark, str(tmp_path / "l")).first().num == 1


def test_files_and_tracks(spark, tmp_path):
    (tmp_path / "09005700_123_80.jpg").write_bytes(b"x")
    f = tables.files(spark, str(tmp_path)).first()
    assert (f.pid, f.dir) == ("09005700_123", "80")
    (tmp_path / "t.csv").write_bytes("粤B1,20190601 08:30:15,113.9,22.5\n".encode("gb2312"))
    t = tables.tracks(tables.headerless_csv(spark, str(tmp_path / "t.csv"), ["plate", "time", "x", "y"])).first()
    assert t.plate == "粤B1" and t.time.minute == 30


def test_table_maintenance(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "id long, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(relational.upsert(stored, new, ["id"])) == [(1, "a"), (2, "B"), (3, "c")]
    assert rows(relational.insert_absent(stored, new, ["id"])) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(relational.delete(stored, new, ["id"])) == [(1, "a")]


def test_road_filter_and_samples(spark):
    m = 1 / 110000
    edges = spark.createDataFrame([(1, "A", "primary", [(0.0, 0.0), (90 * m, 0.0)]), (2, "B", "primary", [(0.0, 500 * m), (90 * m, 500 * m)])], "eid long, name string, road_type string, coords array<struct<x:double,y:double>>")
    roads = spark.createDataFrame([("r", [(0.0, 20 * m), (9 * m, 20 * m)]), ("s", [(0.0, 530 * m), (9 * m, 530 * m)])], "rid string, line array<struct<x:double,y:double>>")
    kept, near = spatial.filter_roads(edges, roads, name="A", road_type="secondary")
    assert [r.eid for r in kept.collect()] == [1] and [r.rid for r in near.collect()] == ["r"]
    ids = spark.range(1000)
    assert filters.sample_rows(ids, ["id"], 7).collect() == filters.sample_rows(ids.repartition(5), ["id"], 7).collect()
    a, b = filters.split_fraction(ids, ["id"], 0.05)
    assert 20 < a.count() < 90 and a.count() + b.count() == 1000 and filters.bernoulli(ids, ["id"], 1000, 1000).count() == 1000
    cities = ids.selectExpr("id % 2 city", "id eid", "case when id % 3 = 0 then 'primary_link' else 'service' end road_type")
    drawn = filters.draw_test_set(cities, 5)
    assert drawn.count() == 10 and drawn.where("not is_link").count() == 0


def test_main_roads_and_chains(spark):
    schema = "k string, src long, dst long, length double"
    main = lambda rows: {(r.src, r.dst): (r.is_main, r.path) for r in graph.main_roads(spark.createDataFrame(rows, schema), "k").collect()}
    assert main([("k", 1, 2, 40.0), ("k", 2, 3, 40.0), ("k", 2, 9, 10.0), ("k", 5, 6, 60.0)]) == {(1, 2): (True, 0), (2, 3): (True, 0), (5, 6): (True, 1), (2, 9): (False, None)}
    # one walk from the only origin, over the undirected tree, in both directions; no second round for 2-4
    assert main([("k", 1, 2, 60.0), ("k", 2, 3, 60.0), ("k", 2, 4, 55.0), ("k", 3, 2, 60.0)]) == {(1, 2): (True, 0), (2, 3): (True, 0), (3, 2): (True, 0), (2, 4): (False, None)}
    # an origin with two edges takes two turns
    assert main([("k", 1, 2, 60.0), ("k", 1, 3, 70.0), ("k", 3, 4, 10.0), ("k", 3, 5, 55.0)]) == {(1, 2): (True, 0), (1, 3): (True, 0), (3, 5): (True, 0), (3, 4): (False, None)}
    assert main([("k", 1, 2, 20.0)]) == {(1, 2): (False, None)}
    chained = graph.chain_edges(spark.createDataFrame([(10, 1, 2), (11, 2, 3), (12, 3, 4), (13, 3, 5)], "eid long, s long, e long"))
    assert {tuple(r) for r in chained.collect()} == {(10, 10, 0), (11, 10, 1), (12, 12, 0), (13, 13, 0)}


def _plain_main_roads(rows, least):
    """Main roads as the rule has them: neighbours are put together anew for each turn."""
    rows = sorted(rows)
    ends, main, left, k = {d for _, d, _ in rows}, {}, rows, 0
    for origin in [s for s, _, _ in rows if s not in ends]:
        path, length = graph._longest(left, origin)
        if length > least:
            main |= {p: k for a, b in zip(path, path[1:], strict=False) for p in ((a, b), (b, a))}
            left = [r for r in left if (r[0], r[1]) not in main]
            k += 1
    return {(s, d): main.get((s, d)) for s, d, _ in rows}


def test_main_roads_of_a_large_group_as_by_the_plain_rule(spark):
    rng = random.Random(9)
    small = [[(a, b, float(rng.randrange(1, 40))) for a in range(25) for b in rng.sample(range(40), 2) if a != b] for _ in range(8)]
    large = [(a, b, float(rng.randrange(1, 90))) for a in range(0, 3000, 10) for b in rng.sample(range(3000), 12) if a != b]
    rows = [(g, *r) for g, own in enumerate([*small, large]) for r in own]
    want = {(g, *p): k for g, own in enumerate([*small, large]) for p, k in _plain_main_roads(own, 50.0).items()}
    got = {(r.k, r.src, r.dst): r.path for r in graph.main_roads(spark.createDataFrame(rows, "k long, src long, dst long, length double"), "k").collect()}
    assert got == want and len(set(want.values())) > 50
    src, dst, length = (np.array(c) for c in zip(*sorted(large), strict=True))
    origins = sorted(set(src.tolist()) - set(dst.tolist()))[:20]
    began = time.perf_counter()
    plain = [graph._longest(sorted(large), o) for o in origins]
    middle = time.perf_counter()
    net = graph._Undirected(src, dst, length.astype(float), 3000)
    assert [net.longest(o) for o in origins] == plain
    assert time.perf_counter() - middle < (middle - began) / 2


def test_combined_links_are_written_once_before_and_once_after(spark, monkeypatch):
    o = spark.range(40).select(F.col("id").alias("o"))
    nodes = o.select(F.explode(F.expr("sequence(o * 10, o * 10 + 4)")).alias("id")).selectExpr("id", "id / 1000D x", "22D y", "cast(map() as map<string,string>) tags")
    ways = o.selectExpr("o * 2 + 1 id", "sequence(o * 10 + 2, o * 10 + 4) refs").unionByName(o.selectExpr("o * 2 id", "sequence(o * 10, o * 10 + 2) refs"))
    ways = ways.withColumn("tags", F.expr("map('highway', 'primary', 'oneway', 'yes', 'lanes', cast(id % 2 + 1 as string))"))
    written = []
    cut = graph.cut
    for module in (graph, filters):
        monkeypatch.setattr(module, "cut", lambda df: (written.append(df.columns), cut(df))[1])
    net = osm.build_network(nodes, ways, combine=True)
    got = {(r.members, r.n_members, tuple(r.lane_list), len(r.coords)) for r in net.links.collect()}
    assert got == {(f"{2 * k};{2 * k + 1}", 2, (1, 2), 5) for k in range(40)} and net.segments.count() == 40
    assert [r.link_id for r in net.links.orderBy("way").collect()] == list(range(40))
    # as made, combined, and with their places in order
    assert sum("coords" in c for c in written) == 3


def test_lookups_and_overlap(spark):
    stored = spark.createDataFrame([("a", 1)], "ID string, X long")
    have, lack = pano.look_up(spark.createDataFrame([("a",), ("b",), ("b",)], "PID string"), stored)
    assert [r.ID for r in have.collect()] == ["a"] and [r.PID for r in lack.collect()] == ["b"]
    pids = spark.createDataFrame([(1, "t", 7), (1, "u", 7), (1, "t", 8), (2, "u", 9)], "eid long, root string, pid long")
    assert {tuple(r) for r in pano.trajectory_overlap(pids, "t", "u").collect()} == {(1, 1, 1, 0), (2, 0, 0, 1)}


def test_parts_are_cut_at_the_region(spark):
    box = (0.0, 0.0, 4.0, 4.0)

    def pieces(*points):
        p = F.array(*[F.struct(F.lit(k).cast("long").alias("node"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for k, (x, y) in enumerate(points)])
        return {r.piece: [(n.node, n.x, n.y) for n in r.nodes] for r in spark.range(1).select(F.inline(osm.pieces_in_box(p, box))).collect()}

    assert pieces((1, 1), (2, 1)) == {0: [(0, 1.0, 1.0), (1, 2.0, 1.0)]}
    assert pieces((1, 1), (2, 1), (5, 4)) == {0: [(0, 1.0, 1.0), (1, 2.0, 1.0), (None, 4.0, 3.0)]}
    assert pieces((-2, 1), (1, 1), (2, 1)) == {1: [(None, 0.0, 1.0), (1, 1.0, 1.0), (2, 2.0, 1.0)]}
    assert pieces((1, 1), (6, 1), (2, 2), (8, 2), (3, 3)) == {0: [(0, 1.0, 1.0), (None, 4.0, 1.0)], 1: [(None, 4.0, 2.8), (4, 3.0, 3.0)]}
    assert pieces((-2, 1), (1, 1), (2, 1), (5, 4)) == {} and pieces((-1, 1), (-2, 1)) == {}


def test_network_of_a_region_has_nodes_on_its_border(spark):
    tags = {"highway": "primary", "lanes": "2", "oneway": "no"}
    places = [(1, 1.0, 1.0), (2, 2.0, 1.0), (3, 5.0, 1.0), (4, 5.0, 2.0), (5, 3.0, 2.0), (6, 1.0, 3.0), (7, -1.0, 3.0)]
    nodes = spark.createDataFrame([(i, x, y, {}) for i, x, y in places], "id long, x double, y double, tags map<string,string>")
    ways = spark.createDataFrame([(10, [1, 2, 3, 4, 5], tags), (11, [5, 6, 7], tags | {"oneway": "yes"}), (12, [3, 4], tags)], "id long, refs array<long>, tags map<string,string>")
    net = osm.build_network(nodes, ways, box=(0.0, 0.0, 4.0, 4.0))
    out = {r.node_id: (r.osm_node_id, r.x, r.y) for r in net.nodes.collect()}
    assert sorted(out.values(), key=str) == sorted([(1, 1.0, 1.0), (5, 3.0, 2.0), (None, 4.0, 1.0), (None, 4.0, 2.0), (None, 0.0, 3.0)], key=str)
    assert {out[k][0] for k in (0, 1)} == {1, 5} and sorted(out) == [0, 1, 2, 3, 4]
    lines = sorted((r.way, [(p.x, p.y) for p in r.coords], out[r.from_node_id][1:], out[r.to_node_id][1:]) for r in net.links.collect())
    head, tail = [(1.0, 1.0), (2.0, 1.0), (4.0, 1.0)], [(4.0, 2.0), (3.0, 2.0)]
    want = [(10, line, line[0], line[-1]) for line in (head, head[::-1], tail, tail[::-1])] + [(11, [(3.0, 2.0), (1.0, 3.0), (0.0, 3.0)], (3.0, 2.0), (0.0, 3.0))]
    assert lines == sorted(want)
    assert net.links.select("link_id").distinct().count() == 5


def plain_sections(lanes, least, place=10.0):
    """Sections of one road, by the rule as it is written."""
    values = sorted(lanes)
    middle = (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2
    runs = []
    for k, v in enumerate(lanes):
        if v != middle and v != 0:
            if runs and runs[-1][1] == k and runs[-1][2] == v:
                runs[-1][1] = k + 1
            else:
                runs.append([k, k + 1, v])
    runs = [r for r in runs if r[1] - 1 > r[0]]
    if len(runs) > 1:
        mean = sum(r[2] for r in runs) / len(runs)
        std = (sum((r[2] - mean) ** 2 for r in runs) / (len(runs) - 1)) ** 0.5
        runs = [r for r in runs if mean - 2 * std < r[2] < mean + 2 * std]
    size = lambda r: (r[1] - 1 - r[0]) * place
    keep, short = [r for r in runs if size(r) >= least], [r for r in runs if size(r) < least]
    if not keep:
        return []
    for new in short:
        before, after, own = [], [], list(new)
        for x in keep:
            if x[1] < own[0]:
                before.append(x)
            elif x[0] > own[1]:
                after.append(x)
            else:
                own = [min(x[0], own[0]), max(x[1], own[1]), x[2]]
        keep = [*before, own, *after]
    return sorted(tuple(r) for r in keep if r not in short)


def test_sections_absorb_short_ones(spark):
    import random

    rng = random.Random(8)
    roads = {0: [3, 3, 3, 3, 2, 2, 2, 2, 2, 4, 4, 3, 3, 3, 3, 3], 1: [2, 2, 3, 3, 2, 2, 3, 3], 2: [3] * 9, 3: [3, 3, 3, 3, 3, 2, 2, 2, 2, 3]}
    for k in range(4, 40):
        roads[k] = [v for _ in range(rng.randrange(1, 9)) for v in [rng.choice([0, 1, 2, 3, 3, 4])] * rng.randrange(1, 6)]
    points = spark.createDataFrame([(rid, k, 10.0 * k, v) for rid, vs in roads.items() for k, v in enumerate(vs)], "rid long, pos int, at double, lanes int")
    got = {}
    for r in simulation.lane_sections(points).collect():
        got.setdefault(r.rid, []).append((r.start, r.stop, r.lanes))
    want = {rid: s for rid, vs in roads.items() if (s := plain_sections(vs, 20.0))}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert want[0] == [(4, 11, 2)] and 1 not in want and want[3] == [(5, 9, 2)]
    flat = points.withColumns({"x": F.col("at") / 110000, "y": F.lit(0.0)}).drop("at")
    assert {tuple(r) for r in simulation.lane_sections(flat, 19.999).collect()} == {(k, *s) for k, v in want.items() for s in v}


def test_banded_polynomial(spark):
    from lanewise.functions import geo

    bands = [(10.0, [1.0, 2.0, 0.0, 3.0, 0, 0, 0, 0, 0, 10.0]), (0.0, [0.0, 1.0, 0.0, 1.0, 0, 0, 0, 0, 0, 1.0])]
    got = spark.range(1).select(geo.banded_polynomial(F.lit(-5.0), F.lit(20.0), bands).alias("a"), geo.banded_polynomial(F.lit(5.0), F.lit(-2.0), bands).alias("b")).first()
    assert (got.a.x, got.a.y, got.b.x, got.b.y) == (-11.0, 6.0, 5.0, -2.0)


def test_backup(spark):
    spark.createDataFrame([(1,)], "id long").write.mode("overwrite").saveAsTable("roads_t")
    sinks.backup(spark, "roads_t")
    assert spark.table("back_roads_t").count() == 1
    spark.sql("drop table roads_t")
    spark.sql("drop table back_roads_t")


def test_walks_go_on_at_forks_and_have_no_longest_length(spark):
    # 2 forks to 3 (one way in) and 4 (two ways in); 3 goes on to 5, 5 back to 1
    edges = spark.createDataFrame([(1, 2), (2, 3), (2, 4), (9, 4), (3, 5), (5, 1), (4, 6), (9, 8)], "src long, dst long")
    starts = spark.createDataFrame([(1,), (9,)], "root long")
    walk = lambda **k: {tuple(r) for r in graph.follow_single(edges, starts, **k).collect()}
    assert walk() == {(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, 5), (9, 0, 9), (9, 1, 8)}
    assert walk(forks=False) == {(1, 0, 1), (1, 1, 2), (9, 0, 9)}
    long = spark.range(205).selectExpr("id src", "id + 1 dst").coalesce(1)
    assert graph.follow_single(long, spark.createDataFrame([(0,)], "root long")).count() == 206


def test_nearest_finds_targets_however_far(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e6, -3e7), (3, None, 1.0), (4, float("nan"), 1.0), (5, float("inf"), 1.0)], "pid long, x double, y double")
    targets = spark.createDataFrame([(7, 0.0, 0.01), (8, 500.0, 0.0), (9, None, None), (10, float("nan"), 0.0)], "tid long, x double, y double")
    assert {(r.pid, r.tid) for r in spatial.nearest(points, targets, 0.05).collect()} == {(1, 7), (2, 8)}
    assert spatial.nearest(points, targets.limit(0), 0.05).count() == 0
    assert spatial.nearest(points.limit(0), targets, 0.05).count() == 0


def test_observation_queries_take_every_edge(spark, sf_dir):
    from lanewise.plans import q_network as n

    edges = {r.l_orderkey for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey").distinct().collect()}
    assert {r.eid for r in n.g29_inserted_interval(spark, sf_dir).select("eid").collect()} == edges
    assert {r.root % 10 for r in n.r34_trajectory_table(spark, sf_dir).select("root").collect()} == set(range(10))
