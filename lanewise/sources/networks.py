"""Network files: GMNS CSV in and out, simulator XML in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise import constants as C
from lanewise.functions import line
from lanewise.operators.filters import edge_id_parts
from lanewise.operators.osm import Network

NODE_SCHEMA = "name string, node_id long, osm_node_id long, osm_highway string, zone_id string, ctrl_type int, node_type string, activity_type string, is_boundary int, x_coord double, y_coord double, main_node_id long, poi_id long"
LINK_SCHEMA = "name string, link_id long, osm_way_id string, from_node_id long, to_node_id long, dir_flag string, length double, lanes int, free_speed double, capacity string, link_type_name string, link_type int, geometry string, allowed_uses string, from_biway int"
EDGE_XML = "_id string, _from string, _to string, _type string, _numLanes int, _speed double, _shape string, _priority int, lane array<struct<_index:int,_speed:double>>, param array<struct<_key:string,_value:string>>"
NODE_XML = "_id string, _x double, _y double, _type string"


def _fill(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def write_gmns(network: Network, folder: str, mode: str = "overwrite") -> None:
    """``node, link, segment, poi`` as CSV with fixed headers; booleans as 0 and 1; segments only if links were combined, POIs only if there are any."""
    nodes = network.nodes.withColumnsRenamed({"x": "x_coord", "y": "y_coord"})
    links = network.links.withColumns({"geometry": line.to_wkt(F.col("coords")), "osm_way_id": F.col("way")})
    tables = {"node": (nodes, C.GMNS_NODE), "link": (links, C.GMNS_LINK)}
    if network.segments is not None:
        segments = network.segments.withColumn("ref_node_id", F.col("from_node_id")).withColumn("segment_id", F.xxhash64("link_id", "start_lr"))
        tables["segment"] = (segments, C.GMNS_SEGMENT)
    if network.pois is not None and not network.pois.isEmpty():
        ring = F.concat(F.lit("POLYGON (("), F.array_join(F.transform("ring", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit("))"))
        centre = F.concat(F.lit("POINT ("), F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string")), F.lit(")"))
        tables["poi"] = (network.pois.withColumns({"geometry": ring, "centroid": centre}), C.GMNS_POI)
    for name, (df, columns) in tables.items():
        _fill(df, columns).write.mode(mode).csv(f"{folder}/{name}.csv", header=True)


def read_gmns(spark: SparkSession, folder: str, encoding: str = "utf-8") -> tuple[DataFrame, DataFrame]:
    """``node`` and ``link`` tables; nodes with their incoming and outgoing links, links with coordinates."""
    nodes = spark.read.csv(f"{folder}/node.csv", header=True, schema=NODE_SCHEMA, encoding=encoding)
    links = spark.read.csv(f"{folder}/link.csv", header=True, schema=LINK_SCHEMA, encoding=encoding).withColumn("coords", line.from_wkt(F.col("geometry")))
    ins = links.groupBy(F.col("to_node_id").alias("node_id")).agg(F.sort_array(F.collect_list("link_id")).alias("incoming"))
    outs = links.groupBy(F.col("from_node_id").alias("node_id")).agg(F.sort_array(F.collect_list("link_id")).alias("outgoing"))
    return nodes.join(ins, "node_id", "left").join(outs, "node_id", "left"), links


def read_simulator(spark: SparkSession, edge_path: str, node_path: str) -> tuple[DataFrame, DataFrame]:
    """Edge and node tables of a simulator network: attributes, params as a map, parsed id, shape as a line."""
    raw = spark.read.format("xml").option("rowTag", "edge").schema(EDGE_XML).load(edge_path)
    p = edge_id_parts(F.col("_id"))
    params = F.map_from_entries(F.transform(F.coalesce("param", F.array().cast("array<struct<_key:string,_value:string>>")), lambda x: F.struct(x["_key"], x["_value"])))
    edges = raw.select(
        F.col("_id").alias("id"), p["rid"].alias("rid"), p["order"].alias("order"), p["postfix"].alias("postfix"), F.col("_from").alias("from"), F.col("_to").alias("to"), F.col("_type").alias("type"),
        F.col("_numLanes").alias("num_lanes"), F.col("_speed").alias("speed"), line.parse_shape(F.col("_shape")).alias("coords"), params.alias("params"), F.col("lane").alias("lanes"),
    )
    nodes = spark.read.format("xml").option("rowTag", "node").schema(NODE_XML).load(node_path)
    return edges, nodes.select(F.col("_id").alias("id"), F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_type").alias("type"))


def write_simulator(edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Edges as XML elements with attributes and lane children."""
    out = edges.select(F.col("id").alias("_id"), F.col("from").alias("_from"), F.col("to").alias("_to"), F.col("type").alias("_type"), F.col("num_lanes").alias("_numLanes"), F.col("speed").alias("_speed"), line.format_shape(F.col("coords")).alias("_shape"), F.col("lanes").alias("lane"))
    out.write.mode(mode).format("xml").option("rootTag", "edges").option("rowTag", "edge").save(path)
