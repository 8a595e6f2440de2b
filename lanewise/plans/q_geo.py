"""Geometry, spatial joins and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise import constants as C
from lanewise.functions import geo, line
from lanewise.operators import fusion, graph, intervals, masks, osm, pano, routing, spatial
from lanewise.plans.adapters import Registry, sql, table, v_graph, v_line, v_point

QUERIES = Registry()
q = QUERIES.add

_PAIR = "pr AS (SELECT a.id AS id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, c.x AS x3, c.y AS y3 FROM v_point a JOIN v_point b ON b.id = a.id + 1 JOIN v_point c ON c.id = a.id + 2)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each point with the next two: A, B, C."""
    p = v_point(spark, d)
    nxt = lambda k: p.select((F.col("id") - (k - 1)).alias("id"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    return nxt(1).join(nxt(2), "id").join(nxt(3), "id")


def _hav(a: str, b: str, c: str, e: str, r: float) -> str:
    return f"2 * {r} * asin(sqrt(least(1, pow(sin(radians({e} - {b}) / 2), 2) + cos(radians({b})) * cos(radians({e})) * pow(sin(radians({c} - {a}) / 2), 2))))"


@q(sql("v_point", f"WITH {_PAIR} SELECT id, round({_hav('x1', 'y1', 'x2', 'y2', C.EARTH_RADIUS_M)}, 3) AS m FROM pr"))
def g01_haversine(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("id", F.round(geo.haversine("x1", "y1", "x2", "y2"), 3).alias("m"))


@q(sql("v_point", f"WITH {_PAIR} SELECT id, round({_hav('x1', 'y1', 'x2', 'y2', C.EARTH_RADIUS_KM)}, 6) AS km FROM pr"))
def g02_haversine_km(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("id", F.round(geo.haversine_km("x1", "y1", "x2", "y2"), 6).alias("km"))


_AZ = "CASE WHEN x1 = x2 AND y1 = y2 THEN 0 WHEN degrees(atan2(x2 - x1, y2 - y1)) < 0 THEN degrees(atan2(x2 - x1, y2 - y1)) + 360 ELSE degrees(atan2(x2 - x1, y2 - y1)) END"


@q(sql("v_point", f"WITH {_PAIR} SELECT id, round({_AZ}, 6) AS az FROM pr"))
def g03_azimuth(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("id", F.round(geo.azimuth("x1", "y1", "x2", "y2"), 6).alias("az"))


@q("SELECT vec_id, round(radians(least(abs(a - b) % 360, 360 - abs(a - b) % 360)), 9) AS gap FROM (SELECT vec_id, vec_id * 37 % 360 AS a, vec_id * 91 % 360 AS b FROM embeddings)")
def g04_azimuth_gap(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(geo.azimuth_gap(F.col("vec_id") * 37 % 360, F.col("vec_id") * 91 % 360), 9).alias("gap"))


_SEGS = "sg AS (SELECT id, i, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM v_seg WINDOW w AS (PARTITION BY id ORDER BY i))"


@q(sql("v_seg", f"WITH {_SEGS} SELECT id, array_to_string(list(CAST(CAST(round({_AZ}) AS INTEGER) AS VARCHAR) ORDER BY i), ',') AS az FROM sg WHERE x2 IS NOT NULL GROUP BY 1"))
def g05_azimuth_list(spark: SparkSession, d: str) -> DataFrame:
    return v_line(spark, d).select("id", F.array_join(F.transform(line.azimuths(F.col("coords")), lambda a: F.round(a).cast("int").cast("string")), ",").alias("az"))


_COSW = f"cos(radians(least(abs(({_AZ}) - id * 37 % 360) % 360, 360 - abs(({_AZ}) - id * 37 % 360) % 360)))"


@q(sql("v_seg", f"WITH {_SEGS} SELECT id, round(avg({_COSW}), 6) AS plain, round(sum({_COSW} * {_hav('x1', 'y1', 'x2', 'y2', C.EARTH_RADIUS_M)}) / sum({_hav('x1', 'y1', 'x2', 'y2', C.EARTH_RADIUS_M)}), 6) AS weighted FROM sg WHERE x2 IS NOT NULL GROUP BY 1"))
def g06_heading_cosine(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("id") * 37 % 360
    return v_line(spark, d).select("id", F.round(line.heading_cosine(h, F.col("coords"), False), 6).alias("plain"), F.round(line.heading_cosine(h, F.col("coords")), 6).alias("weighted"))


_T = "((x1 - x2) * (x3 - x2) + (y1 - y2) * (y3 - y2)) / ((x3 - x2) * (x3 - x2) + (y3 - y2) * (y3 - y2))"


@q(sql("v_point", f"WITH {_PAIR} SELECT id, round(x2 + {_T} * (x3 - x2), 6) AS fx, round(y2 + {_T} * (y3 - y2), 6) AS fy FROM pr"))
def g07_foot(spark: SparkSession, d: str) -> DataFrame:
    f = geo.foot("x1", "y1", "x2", "y2", "x3", "y3")
    return _pairs(spark, d).select("id", f["x"].alias("fx"), f["y"].alias("fy"))


@q(sql("v_point", f"WITH {_PAIR} SELECT id, round({_T}, 6) AS t FROM pr"))
def g08_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("id", F.round(geo.project_ratio("x1", "y1", "x2", "y2", "x3", "y3"), 6).alias("t"))


@q(sql("v_point", f"WITH {_PAIR} SELECT id, {_T} >= -0.1 AND {_T} <= 1.1 AS ok FROM pr"))
def g09_foot_on_chord(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("id", geo.foot_on_chord("x1", "y1", "x2", "y2", "x3", "y3", 0.1).alias("ok"))


@q(sql("v_point", f"WITH {_PAIR}, t AS (SELECT *, greatest(0, least(1, {_T})) AS u FROM pr) SELECT id, round(sqrt(pow(x1 - (x2 + u * (x3 - x2)), 2) + pow(y1 - (y2 + u * (y3 - y2)), 2)), 9) AS dist FROM t"))
def g10_point_segment(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("id", F.round(geo.point_segment_distance("x1", "y1", "x2", "y2", "x3", "y3"), 9).alias("dist"))


@q(sql("v_point", f"WITH {_PAIR}, s AS (SELECT id, {_hav('x2', 'y2', 'x3', 'y3', C.EARTH_RADIUS_M)} AS a, {_hav('x1', 'y1', 'x2', 'y2', C.EARTH_RADIUS_M)} AS b, {_hav('x1', 'y1', 'x3', 'y3', C.EARTH_RADIUS_M)} AS c FROM pr), h AS (SELECT *, (a + b + c) / 2 AS s FROM s) SELECT id, round(2 * sqrt(greatest(0, s * (s - a) * (s - b) * (s - c))) / a, 3) AS h FROM h"))
def g11_heron_height(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("id", F.round(geo.heron_height("x1", "y1", "x2", "y2", "x3", "y3"), 3).alias("h"))


@q(sql("v_point", f"WITH {_PAIR}, v AS (SELECT id, x2 - x1 AS a, y2 - y1 AS b, x3 - x2 AS c, y3 - y2 AS d FROM pr) SELECT id, round(degrees(acos(greatest(-1, least(1, (a * c + b * d) / (sqrt(a * a + b * b) * sqrt(c * c + d * d)))))), 6) AS angle FROM v"))
def g12_vector_angle(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _pairs(spark, d).select("id", F.round(geo.vector_angle(c("x2") - c("x1"), c("y2") - c("y1"), c("x3") - c("x2"), c("y3") - c("y2")), 6).alias("angle"))


def _line_pairs(spark: SparkSession, d: str) -> DataFrame:
    a = v_line(spark, d)
    return a.join(a.select((F.col("id") - 1).alias("id"), F.col("coords").alias("other")), "id")


@q(sql("v_seg", """WITH c AS (SELECT a.id, a.i, b.i AS j, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM v_seg a JOIN v_seg b ON b.id = a.id + 1), f AS (SELECT id, i, min(d) AS d FROM c GROUP BY 1, 2), g AS (SELECT id, j, min(d) AS d FROM c GROUP BY 1, 2)
SELECT id, round(110000 * greatest((SELECT max(d) FROM f WHERE f.id = k.id), (SELECT max(d) FROM g WHERE g.id = k.id)), 3) AS m FROM (SELECT DISTINCT id FROM c) k"""))
def g13_hausdorff(spark: SparkSession, d: str) -> DataFrame:
    return _line_pairs(spark, d).select("id", F.round(line.hausdorff_m(F.col("coords"), F.col("other")), 3).alias("m"))


@q("""WITH RECURSIVE c AS (SELECT a.vec_id AS id, i, j, sqrt(pow(CAST(a.embedding[2 * i - 1] AS DOUBLE) - b.embedding[2 * j - 1], 2) + pow(CAST(a.embedding[2 * i] AS DOUBLE) - b.embedding[2 * j], 2)) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, unnest([1, 2, 3, 4]) AS u(i), unnest([1, 2, 3, 4]) AS v(j)),
w AS (SELECT id, i, j, d FROM c WHERE i = 1 AND j = 1 UNION ALL SELECT c.id, c.i, c.j, greatest(w.d, c.d) FROM w JOIN c ON c.id = w.id AND ((c.i = w.i + 1 AND c.j = w.j) OR (c.i = w.i AND c.j = w.j + 1) OR (c.i = w.i + 1 AND c.j = w.j + 1)))
SELECT id, round(min(d), 9) AS dist FROM w WHERE i = 4 AND j = 4 GROUP BY 1""")
def g14_frechet(spark: SparkSession, d: str) -> DataFrame:
    a = v_line(spark, d, 4)
    p = a.join(a.select((F.col("id") - 1).alias("id"), F.col("coords").alias("other")), "id")
    return p.select("id", F.round(line.frechet(F.col("coords"), F.col("other")), 9).alias("dist"))


_MERC = "SELECT id, i, 6378137.0 * radians(x) AS mx, 6378137.0 * ln(tan(pi() / 4 + radians(y) / 2) * pow((1 - 0.0818191908426215 * sin(radians(y))) / (1 + 0.0818191908426215 * sin(radians(y))), 0.0818191908426215 / 2)) AS my FROM v_seg"


@q(sql("v_seg", f"WITH m AS ({_MERC}), s AS (SELECT id, sqrt(pow(lead(mx) OVER w - mx, 2) + pow(lead(my) OVER w - my, 2)) AS l FROM m WINDOW w AS (PARTITION BY id ORDER BY i)) SELECT id, round(sum(l), 2) AS m FROM s GROUP BY 1"))
def g19_projected_length(spark: SparkSession, d: str) -> DataFrame:
    return v_line(spark, d).select("id", F.round(line.length_mercator(F.col("coords")), 2).alias("m"))


@q("SELECT event_id, round(1 / (sqrt(2 * pi()) * 20) * exp(-pow(value, 2) / (2 * pow(20, 2))), 9) AS p FROM events")
def g21_observation_probability(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(geo.observation_probability("value"), 9).alias("p"))


_TOPO = """WITH e AS (SELECT o_orderkey AS id, o_custkey AS src, o_custkey % 360 AS dir_0, o_orderkey % 360 AS dir_1, o_orderstatus <> 'F' AS link, o_totalprice / 10000 AS dist, o_orderkey % 89 - o_custkey % 97 AS dx, o_orderkey % 83 - o_custkey % 101 AS dy FROM orders),
a AS (SELECT *, 1 / (sqrt(2 * pi()) * 20) * exp(-pow(dist, 2) / (2 * pow(20, 2))) AS prob, CASE WHEN dx = 0 AND dy = 0 THEN 0 WHEN atan2(dx, dy) < 0 THEN degrees(atan2(dx, dy)) + 360 ELSE degrees(atan2(dx, dy)) END AS az FROM e),
g AS (SELECT *, abs(dir_0 - dir_1) AS gap, abs({heading} - az) AS turn FROM a),
s AS (SELECT *, (cos(radians(CASE WHEN gap > 180 THEN 360 - gap ELSE gap END)) + 1) / 2 AS cos_sim, (cos(radians(CASE WHEN turn > 180 THEN 360 - turn ELSE turn END)) + 1) / 2 AS turn_sim, sqrt(prob / max(prob) OVER (PARTITION BY {end})) AS std FROM g)
SELECT id, round(CASE WHEN link THEN cos_sim * cos_sim * std * turn_sim ELSE 1 END, 6) AS similarity FROM s"""


def _topo(spark: SparkSession, d: str, forward: bool) -> DataFrame:
    """Orders as edges from their customer; every customer and order is a pano with a heading and a place."""
    o = table(spark, d, "orders").selectExpr("o_orderkey rid", "o_custkey src", "-o_orderkey - 1 dst", "o_orderstatus <> 'F' link", "o_totalprice / 10000 dist")
    heads = o.selectExpr("src pid", "src % 360 dir", "src % 97 x", "src % 101 y").distinct()
    ends = o.selectExpr("dst pid", "rid % 360 dir", "rid % 89 x", "rid % 83 y")
    return pano.topology(o, heads.unionByName(ends), forward=forward).select(F.col("rid").alias("id"), F.round("similarity", 6).alias("similarity"))


@q(_TOPO.format(heading="dir_0", end="src"))
def g22_edge_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _topo(spark, d, True)


@q(_TOPO.format(heading="dir_1", end="id"))
def g22_edge_similarity_back(spark: SparkSession, d: str) -> DataFrame:
    return _topo(spark, d, False)


@q("SELECT vec_id, vec_id * 256 * pow(2, 18 - vec_id % 5) AS m FROM embeddings")
def g26_tiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", geo.tile_to_mercator(F.col("vec_id"), F.col("vec_id") % 5).alias("m"))


@q(sql("v_point", """WITH b AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM v_point), g AS (SELECT b.*, i, j FROM b, unnest(generate_series(0, greatest(CAST(ceil((x1 - x0) / 0.05) AS INTEGER) - 1, 0))) AS u(i), unnest(generate_series(0, greatest(CAST(ceil((y1 - y0) / 0.05) AS INTEGER) - 1, 0))) AS v(j))
SELECT i, j, round(x0 + i * 0.05, 6) AS x0, round(y0 + j * 0.05, 6) AS y0, round(least(x0 + (i + 1) * 0.05, x1), 6) AS x1, round(least(y0 + (j + 1) * 0.05, y1), 6) AS y1 FROM g"""))
def g27_fishnet(spark: SparkSession, d: str) -> DataFrame:
    b = v_point(spark, d).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return spatial.fishnet(b, 0.05, 0.05).select("i", "j", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@q(sql("v_seg", "SELECT id, array_to_string(list(CAST(round(x * 1000) AS INTEGER) ORDER BY i DESC), ',') AS xs FROM v_seg GROUP BY 1"))
def g28_reverse_line(spark: SparkSession, d: str) -> DataFrame:
    return v_line(spark, d).select("id", F.array_join(F.transform(F.reverse("coords"), lambda p: F.round(p["x"] * 1000).cast("int").cast("string")), ",").alias("xs"))


@q("SELECT user_id, round(regr_slope(value, event_id), 6) AS slope, round(regr_intercept(value, event_id), 4) AS intercept FROM events GROUP BY 1")
def g33_linear_fit(spark: SparkSession, d: str) -> DataFrame:
    y, x = F.col("value"), F.col("event_id").cast("double")
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"))


@q(sql("v_point", f"WITH {_PAIR} SELECT id, round((y2 - y1) / (x2 - x1), 6) AS slope, abs((y2 - y1) / (x2 - x1)) BETWEEN 0.3 AND 3 AS band FROM pr WHERE x1 <> x2"))
def g34_slopes(spark: SparkSession, d: str) -> DataFrame:
    s = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
    return _pairs(spark, d).where("x1 <> x2").select("id", F.round(s, 6).alias("slope"), F.abs(s).between(0.3, 3).alias("band"))


@q("SELECT vec_id, (vec_id * 37 % 360 + 360 - 180) % 360 AS back FROM embeddings")
def g36_opposite(spark: SparkSession, d: str) -> DataFrame:
    return v_point(spark, d).select(F.col("id").alias("vec_id"), geo.opposite("heading").alias("back"))


@q(sql("v_point", f"WITH {_PAIR} SELECT id, round(CASE WHEN id % 2 = 0 THEN sqrt(pow(x1 - x2, 2) + pow(y1 - y2, 2)) ELSE {_hav('x1', 'y1', 'x2', 'y2', C.EARTH_RADIUS_M)} END, 3) AS dist FROM pr"))
def g37_point_distance(spark: SparkSession, d: str) -> DataFrame:
    px = F.when(F.col("id") % 2 == 0, F.col("x1"))
    return _pairs(spark, d).select("id", F.round(geo.planar_or_haversine(px, "y1", "x2", "y2", "x1", "y1", "x2", "y2"), 3).alias("dist"))


@q("SELECT l_orderkey AS id, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS sx, CAST(sum(l_suppkey) AS BIGINT) AS sy FROM lineitem GROUP BY 1")
def g38_shape_text(spark: SparkSession, d: str) -> DataFrame:
    shapes = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.collect_list(F.concat_ws(",", F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string"))), " ").alias("shape"))
    p = shapes.withColumn("p", line.parse_shape(F.col("shape")))
    total = lambda c: F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x[c]).cast("long")
    return p.select("id", F.size("p").cast("long").alias("n"), total("x").alias("sx"), total("y").alias("sy"))


# Spatial joins


#: Points and lines side by side, so that each has equally many neighbours at every size.
_L = "ln AS (SELECT a.id, a.i, a.x + CAST(0.02 AS DOUBLE) * a.id AS x1, a.y AS y1, b.x + CAST(0.02 AS DOUBLE) * b.id AS x2, b.y AS y2 FROM v_seg a JOIN v_seg b ON b.id = a.id AND b.i = a.i + 1 WHERE a.i < 4)"
_PT = "pt AS (SELECT vec_id AS pid, CAST(embedding[20] AS DOUBLE) + CAST(0.02 AS DOUBLE) * vec_id AS px, CAST(embedding[21] AS DOUBLE) AS py FROM embeddings)"
_D = "sqrt(pow(px - (x1 + u * (x2 - x1)), 2) + pow(py - (y1 + u * (y2 - y1)), 2))"
_NEAR = f"{_L}, {_PT}, pj AS (SELECT pid, id, px, py, x1, y1, x2, y2, greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS u FROM pt, ln), dd AS (SELECT pid, id, min({_D}) AS distance FROM pj GROUP BY 1, 2)"


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    points = table(spark, d, "embeddings").selectExpr("vec_id pid", "cast(embedding[19] as double) + 0.02D * vec_id x", "cast(embedding[20] as double) y")
    along = F.transform("coords", lambda p: F.struct((p["x"] + F.lit(0.02) * F.col("id")).alias("x"), p["y"].alias("y")))
    return points, v_line(spark, d, 4).select(F.col("id").alias("eid"), along.alias("coords"))


@q(sql("v_seg", f"WITH {_NEAR} SELECT pid, id AS eid, round(distance, 6) AS distance FROM dd WHERE distance <= 0.05"))
def j08_points_near_lines(spark: SparkSession, d: str) -> DataFrame:
    p, ln = _near(spark, d)
    return spatial.points_near_lines(p, ln, 0.05).select("pid", "eid", F.round("distance", 6).alias("distance"))


#: A place is in a capsule's polygon if it is behind all its 32 edges at the ends and not beyond its sides.
_HALF_PLANES = """nr AS (SELECT pid, px, py, x1, y1, x2, y2, atan2(y2 - y1, x2 - x1) AS turn FROM (SELECT *, greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS u FROM pt, ln) WHERE sqrt(pow(px - (x1 + u * (x2 - x1)), 2) + pow(py - (y1 + u * (y2 - y1)), 2)) <= 0.05),
hp AS (SELECT *, turn + (k + 0.5) * pi() / 16 AS a FROM nr, unnest(generate_series(0, 31)) AS v(k)),
pc AS (SELECT pid, max(px * cos(a) + py * sin(a) - greatest(x1 * cos(a) + y1 * sin(a), x2 * cos(a) + y2 * sin(a))) AS beyond FROM hp GROUP BY pid, x1, y1, x2, y2)"""


@q(sql("v_seg", f"WITH {_L}, {_PT}, {_HALF_PLANES} SELECT DISTINCT pid FROM pc WHERE beyond <= 0.05 * cos(pi() / 32)"))
def a17_points_in_mask(spark: SparkSession, d: str) -> DataFrame:
    p, ln = _near(spark, d)
    return masks.in_mask(p, masks.buffer_mask(ln, 0.05), 0.4).select("pid")


@q(sql("v_seg", "SELECT a.id AS eid, round(2 * 0.05 * sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) + 16 * sin(pi() / 16) * 0.05 * 0.05, 8) AS area FROM v_seg a JOIN v_seg b ON b.id = a.id AND a.i = 1 AND b.i = 2"))
def g20_buffer_area(spark: SparkSession, d: str) -> DataFrame:
    mask = masks.buffer_mask(v_line(spark, d, 2).withColumnRenamed("id", "eid"), 0.05, ["eid"])
    return mask.groupBy("eid").agg(F.round(F.sum(masks.trapezoid_area()), 8).alias("area"))


@q(sql("v_seg", f"WITH {_NEAR} SELECT pid, eid, distance FROM (SELECT pid, id AS eid, round(distance, 6) AS distance, row_number() OVER (PARTITION BY pid ORDER BY distance, id) AS rn FROM dd WHERE distance <= 0.1) WHERE rn = 1"))
def j10_nearest_line(spark: SparkSession, d: str) -> DataFrame:
    p, ln = _near(spark, d)
    return spatial.nearest_line(p, ln.withColumn("seq", F.col("eid")), 0.1).select("pid", "eid", F.round("distance", 6).alias("distance"))


@q("""WITH p AS (SELECT vec_id AS pid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings WHERE vec_id % 2 = 0), t AS (SELECT vec_id AS tid, CAST(embedding[1] AS DOUBLE) AS tx, CAST(embedding[2] AS DOUBLE) AS ty FROM embeddings WHERE vec_id % 2 = 1)
SELECT pid, tid FROM (SELECT pid, tid, row_number() OVER (PARTITION BY pid ORDER BY sqrt(pow(x - tx, 2) + pow(y - ty, 2)), tid) AS rn FROM p, t) WHERE rn = 1""")
def j11_nearest_node(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").selectExpr("vec_id", "cast(embedding[0] as double) x", "cast(embedding[1] as double) y")
    return spatial.nearest(e.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "pid"), e.where("vec_id % 2 = 1").withColumnRenamed("vec_id", "tid"), 0.05).select("pid", "tid")


@q(sql("v_seg", f"SELECT a.id, a.i, b.i AS j, round({_hav('a.x', 'a.y', 'b.x', 'b.y', C.EARTH_RADIUS_M)}, 2) AS m FROM v_seg a JOIN v_seg b ON a.id = b.id"))
def j12_distance_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = v_line(spark, d).select("id", F.posexplode("coords").alias("i", "p"), "coords")
    out = rows.select("id", (F.col("i") + 1).alias("i"), "p", F.posexplode("coords").alias("j", "r"))
    return out.select("id", "i", (F.col("j") + 1).alias("j"), F.round(geo.haversine(F.col("p.x"), F.col("p.y"), F.col("r.x"), F.col("r.y")), 2).alias("m"))


@q(sql("v_point", "WITH a AS (SELECT i, 113.85 + 0.02 * i AS x0, 113.87 + 0.02 * i AS x1 FROM unnest(generate_series(0, 4)) AS u(i)) SELECT i AS area, count(*) AS n FROM a JOIN v_point ON x > x0 AND x < x1 AND y > 22.45 AND y < 22.55 GROUP BY 1"))
def j13_points_per_area(spark: SparkSession, d: str) -> DataFrame:
    x0 = F.lit(113.85) + F.lit(0.02) * F.col("area")
    x1 = F.lit(113.87) + F.lit(0.02) * F.col("area")
    corner = lambda x, y: F.struct(x.alias("x"), F.lit(y).alias("y"))
    areas = spark.range(5).withColumnRenamed("id", "area").withColumn("ring", F.array(corner(x0, 22.45), corner(x1, 22.45), corner(x1, 22.55), corner(x0, 22.55)))
    return spatial.count_in_areas(v_point(spark, d), areas, 0.05).select("area", "n")


# Graphs


@q(sql("v_graph", """WITH RECURSIVE g AS (SELECT src, dst FROM v_graph), b AS (SELECT 7::BIGINT AS node, 0 AS layer UNION SELECT g.dst, b.layer + 1 FROM b JOIN g ON g.src = b.node WHERE b.layer < 4)
SELECT node, min(layer) AS layer FROM b GROUP BY 1"""))
def r01_bfs_layers(spark: SparkSession, d: str) -> DataFrame:
    return graph.bfs_layers(v_graph(spark, d), spark.range(1).select(F.lit(7).cast("long").alias("node")), 4)


#: Users linked by their events, and customers, most of them alone.
_CC = """WITH RECURSIVE g AS (SELECT src, dst FROM v_graph), n AS (SELECT user_id AS node FROM events UNION SELECT c_custkey FROM customer), bw AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g),
r AS (SELECT node, node AS other FROM n UNION SELECT r.node, bw.dst FROM r JOIN bw ON bw.src = r.other), cc AS (SELECT node, min(other) AS component FROM r GROUP BY 1)"""


def _cc(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "events").selectExpr("user_id node").union(table(spark, d, "customer").selectExpr("c_custkey node")).distinct(), v_graph(spark, d)


@q(sql("v_graph", f"{_CC} SELECT node, component FROM cc"))
def r05_component_labels(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(*_cc(spark, d))


@q(sql("v_graph", f"{_CC}, k AS (SELECT component FROM cc GROUP BY 1 HAVING count(*) >= 5) SELECT node FROM cc WHERE component IN (SELECT component FROM k)"))
def r06_drop_small_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.drop_small_components(*_cc(spark, d), 5)[0]


_INT = """WITH RECURSIVE s AS (SELECT user_id AS node FROM events GROUP BY 1 HAVING user_id % 2 = 0), g AS (SELECT src, dst FROM v_graph WHERE length <= 4 AND src IN (SELECT node FROM s) AND dst IN (SELECT node FROM s)), bw AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g),
r AS (SELECT src AS node, src AS other FROM bw UNION SELECT r.node, bw.dst FROM r JOIN bw ON bw.src = r.other), cc AS (SELECT node, min(other) AS component FROM r GROUP BY 1)"""


@q(sql("v_graph", f"{_INT} SELECT node, dense_rank() OVER (ORDER BY component) - 1 AS main_node_id FROM cc"))
def r07_complex_intersections(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").selectExpr("user_id node").distinct().where("node % 2 = 0")
    return graph.complex_intersections(v_graph(spark, d), s, 4.0)


@q(sql("v_graph", f"{_INT}, m AS (SELECT node, component AS new FROM cc) SELECT coalesce(a.new, g.src) AS src, coalesce(b.new, g.dst) AS dst, count(*) AS n FROM v_graph g LEFT JOIN m a ON a.node = g.src LEFT JOIN m b ON b.node = g.dst WHERE a.new IS NULL OR b.new IS NULL OR a.new <> b.new GROUP BY 1, 2"))
def r08_consolidate(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").selectExpr("user_id node").distinct()
    g = v_graph(spark, d)
    groups = graph.complex_intersections(g, s.where("node % 2 = 0"), 4.0)
    _, links = graph.consolidate(s.selectExpr("node", "cast(node as double) x", "cast(node as double) y"), g, groups)
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@q(sql("v_graph", """WITH a AS (SELECT 3::BIGINT AS node, 0.0::DOUBLE AS cost), b AS (SELECT g.dst AS node, min(a.cost + g.length) AS cost FROM a JOIN v_graph g ON g.src = a.node GROUP BY 1), c AS (SELECT g.dst AS node, min(b.cost + g.length) AS cost FROM b JOIN v_graph g ON g.src = b.node GROUP BY 1)
SELECT node, round(min(cost), 6) AS cost FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY 1"""))
def r13_short_paths(spark: SparkSession, d: str) -> DataFrame:
    roots = spark.range(1).select(F.lit(3).cast("long").alias("root"))
    return graph.short_paths(v_graph(spark, d), roots, 2).select("node", F.round("cost", 6).alias("cost"))


@q(sql("v_graph", """WITH RECURSIVE p AS (SELECT dst AS root, src AS goal FROM v_graph),
r AS (SELECT DISTINCT root, root AS node, CAST(0 AS DOUBLE) AS cost, 0 AS k FROM p
UNION ALL SELECT r.root, g.dst, min(cost + length), k + 1 FROM r JOIN v_graph g ON g.src = r.node WHERE k < 24 GROUP BY r.root, g.dst, k)
SELECT p.root, p.goal, round(min(r.cost), 6) AS cost, round(min(r.cost), 6) AS path_cost, true AS hangs_together FROM p JOIN r ON r.root = p.root AND r.node = p.goal GROUP BY 1, 2"""))
def r13_cheapest_paths(spark: SparkSession, d: str) -> DataFrame:
    e = v_graph(spark, d).selectExpr("src * 100000 + dst eid", "src", "dst", "length")
    pairs = e.selectExpr("dst root", "src goal")  # the way back along every edge
    found = routing.cheapest_paths(e, pairs)
    # what the edges of each path add up to, and whether they lead from node to node
    steps = found.select("root", "goal", "path", F.posexplode("via").alias("k", "eid")).join(e, "eid")
    fits = (F.col("src") == F.get("path", F.col("k"))) & (F.col("dst") == F.get("path", F.col("k") + 1))
    read = steps.groupBy("root", "goal").agg(F.round(F.sum("length"), 6).alias("path_cost"), F.min(fits).alias("hangs_together"))
    return found.select("root", "goal", F.round("cost", 6).alias("cost")).join(read, ["root", "goal"])


@q(sql("v_graph", """WITH RECURSIVE o AS (SELECT src, min(dst) AS dst FROM v_graph WHERE length < 3 GROUP BY 1 HAVING count(*) = 1), w AS (SELECT user_id AS root, 0 AS seq, user_id AS node, [user_id] AS seen FROM events GROUP BY 1
UNION ALL SELECT w.root, w.seq + 1, o.dst, list_append(w.seen, o.dst) FROM w JOIN o ON o.src = w.node WHERE NOT list_contains(w.seen, o.dst)) SELECT root, seq, node FROM w"""))
def r15_follow_single(spark: SparkSession, d: str) -> DataFrame:
    starts = table(spark, d, "events").selectExpr("user_id root").distinct()
    return graph.follow_single(v_graph(spark, d).where("length < 3"), starts, forks=False)


@q()
def r15_traversed_roads(spark: SparkSession, d: str) -> DataFrame:
    return graph.follow_single(v_graph(spark, d).where("length < 3"), table(spark, d, "events").selectExpr("user_id root").distinct())


_WAY = "w AS (SELECT l_orderkey AS way, l_partkey AS node, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"


@q(f"WITH {_WAY} SELECT node FROM w GROUP BY 1 HAVING count(*) > 1 OR bool_or(k = 1 OR k = n)")
def r17_crossings(spark: SparkSession, d: str) -> DataFrame:
    return osm.crossings(_placed(spark, d)).select("node")


def _placed(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("way"), F.row_number().over(w).alias("k"), F.col("l_partkey").alias("node"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))


@q("SELECT o_orderkey AS way, back, CASE WHEN o_orderstatus = 'F' THEN lanes ELSE CAST(ceil(lanes / 2.0) AS INTEGER) END AS lanes FROM (SELECT *, o_orderkey % 5 + 1 AS lanes FROM orders), unnest([0, 1]) AS u(back) WHERE NOT (o_orderstatus = 'F' AND back = 1)")
def r20_links_per_direction(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    node = lambda k: F.struct(F.lit(k).cast("long").alias("node"), F.lit(float(k)).alias("x"), F.lit(0.0).alias("y"))
    parts = o.select(F.col("o_orderkey").alias("way"), F.lit(0).alias("part"), F.array(node(1), node(2)).alias("nodes"))
    ways = o.select(
        F.col("o_orderkey").alias("id"), F.array().cast("array<bigint>").alias("refs"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("lanes_tag"), F.lit(None).cast("int").alias("fwd"), F.lit(None).cast("int").alias("bwd"), F.lit(1).alias("lanes_default"),
        (F.col("o_orderstatus") == "F").alias("oneway"), F.lit(False).alias("reversed"), F.lit(30.0).alias("free_speed"), F.lit("primary").alias("link_type_name"), F.lit(3).alias("link_type"), F.lit("").alias("name"), F.lit("auto").alias("allowed_uses"),
    )
    return osm.make_links(parts, ways).select("way", "back", "lanes")


@q("""WITH p AS (SELECT vec_id AS pid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings WHERE vec_id % 2 = 0), t AS (SELECT vec_id AS tid, CAST(embedding[1] AS DOUBLE) AS tx, CAST(embedding[2] AS DOUBLE) AS ty FROM embeddings WHERE vec_id % 2 = 1),
n AS (SELECT pid, tid FROM (SELECT pid, tid, row_number() OVER (PARTITION BY pid ORDER BY sqrt(pow(x - tx, 2) + pow(y - ty, 2)), tid) AS rn FROM p, t) WHERE rn = 1)
SELECT pid AS poi_id, 'poi:' || pid AS src, CAST(tid AS VARCHAR) AS dst, 20 AS link_type FROM n UNION ALL SELECT pid, CAST(tid AS VARCHAR), 'poi:' || pid, 20 FROM n""")
def r23_connect_pois(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").selectExpr("vec_id", "cast(embedding[0] as double) x", "cast(embedding[1] as double) y")
    centres = e.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "poi_id")
    near = spatial.nearest(centres.withColumnRenamed("poi_id", "pid"), e.where("vec_id % 2 = 1").withColumnRenamed("vec_id", "tid"), 0.05)
    return osm.connect_pois(centres, near).select("poi_id", "src", "dst", "link_type")


@q("SELECT o_orderkey AS rid, o_custkey AS s, o_orderkey % 100 AS e, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS direction FROM orders UNION ALL SELECT -o_orderkey, o_orderkey % 100, o_custkey, 2 FROM orders WHERE o_orderstatus <> 'F'")
def r24_both_directions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "orders").selectExpr("o_orderkey rid", "o_custkey s", "o_orderkey % 100 e", "0 `order`", "o_orderstatus = 'F' oneway", "array(named_struct('x', 0D, 'y', 0D)) coords")
    return osm.both_directions(e).select("rid", "s", "e", "direction")


@q(sql("v_graph", """WITH e AS (SELECT src * 1000 + dst AS eid, src, dst, length FROM v_graph), s AS (SELECT user_id AS node FROM events GROUP BY 1 HAVING user_id % 11 = 0), p1 AS (SELECT src AS a, dst AS b, struct_pack(cost := min(length), hops := 1) AS w FROM e WHERE length < 20 GROUP BY 1, 2),
p2 AS (SELECT a, b, min(w) AS w FROM (SELECT * FROM p1 UNION ALL SELECT x.a, y.b, struct_pack(cost := x.w.cost + y.w.cost, hops := x.w.hops + y.w.hops) FROM p1 x JOIN p1 y ON x.b = y.a AND x.w.cost + y.w.cost < 20) GROUP BY 1, 2),
p4 AS (SELECT a, b, min(w) AS w FROM (SELECT * FROM p2 UNION ALL SELECT x.a, y.b, struct_pack(cost := x.w.cost + y.w.cost, hops := x.w.hops + y.w.hops) FROM p2 x JOIN p2 y ON x.b = y.a AND x.w.cost + y.w.cost < 20) GROUP BY 1, 2),
p8 AS (SELECT a, b, min(w) AS w FROM (SELECT * FROM p4 UNION ALL SELECT x.a, y.b, struct_pack(cost := x.w.cost + y.w.cost, hops := x.w.hops + y.w.hops) FROM p4 x JOIN p4 y ON x.b = y.a AND x.w.cost + y.w.cost < 20) GROUP BY 1, 2),
p16 AS (SELECT a, b, min(w) AS w FROM (SELECT * FROM p8 UNION ALL SELECT x.a, y.b, struct_pack(cost := x.w.cost + y.w.cost, hops := x.w.hops + y.w.hops) FROM p8 x JOIN p8 y ON x.b = y.a AND x.w.cost + y.w.cost < 20) GROUP BY 1, 2)
SELECT e.eid, CASE WHEN e.dst IN (SELECT node FROM s) THEN 3 WHEN e.src IN (SELECT node FROM s) THEN 4 WHEN e.length > 5 THEN 0 WHEN p.w.hops = 1 AND e.length < 5 AND p.w.cost < 10 THEN 1 WHEN p.w.hops = 3 AND e.length < 5 AND p.w.cost < 20 THEN 2 ELSE 0 END AS edge_type
FROM e LEFT JOIN p16 p ON p.a = e.dst AND p.b = e.src"""))
def r28_edge_types(spark: SparkSession, d: str) -> DataFrame:
    e = v_graph(spark, d).selectExpr("src * 1000 + dst eid", "src", "dst", "length")
    s = table(spark, d, "events").selectExpr("user_id node").distinct().where("node % 11 = 0")
    return fusion.edge_types(e, s, 5.0)


@q(sql("v_graph", "SELECT src AS node, count(*) AS degree, array_to_string(list_sort(list(DISTINCT dst)), ',') AS near FROM (SELECT src, dst FROM v_graph UNION SELECT dst, src FROM v_graph) GROUP BY 1"))
def r46_neighbours(spark: SparkSession, d: str) -> DataFrame:
    g = v_graph(spark, d)
    both = g.select("src", "dst").union(g.select("dst", "src")).distinct()
    return both.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("near"))


@q(sql("v_graph", "WITH g AS (SELECT src, dst FROM v_graph WHERE length > 2 AND NOT (src = 5 AND dst = 6) UNION SELECT 1000, 1001), r AS (SELECT dst AS src, src AS dst FROM g) SELECT src, count(*) AS outdegree, max(dst) AS far FROM r GROUP BY 1"))
def r36_graph_primitives(spark: SparkSession, d: str) -> DataFrame:
    g = v_graph(spark, d).where("length > 2 and not (src = 5 and dst = 6)").select("src", "dst").union(spark.range(1).select(F.lit(1000).cast("long").alias("src"), F.lit(1001).cast("long").alias("dst"))).distinct()
    return g.select(F.col("dst").alias("src"), F.col("src").alias("dst")).groupBy("src").agg(F.count(F.lit(1)).alias("outdegree"), F.max("dst").alias("far"))


@q(sql("v_graph", """WITH g AS (SELECT src, dst FROM v_graph WHERE length < 4), n AS (SELECT user_id AS node FROM events GROUP BY 1), i AS (SELECT dst AS node, count(*) AS i, min(src) AS f FROM g GROUP BY 1), o AS (SELECT src AS node, count(*) AS o, min(dst) AS t FROM g GROUP BY 1)
SELECT n.node, CASE WHEN i IS NULL OR o IS NULL OR (i = 1 AND o = 1 AND f = t) THEN 1 ELSE 0 END AS is_boundary FROM n LEFT JOIN i ON i.node = n.node LEFT JOIN o ON o.node = n.node"""))
def r38_boundary_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.boundary_nodes(v_graph(spark, d).where("length < 4"), table(spark, d, "events").selectExpr("user_id node").distinct())


@q("""WITH iv AS (SELECT l_suppkey AS k, l_linenumber * 10 AS a, l_linenumber * 10 + CAST(trunc(l_quantity) AS INTEGER) AS b FROM lineitem), r AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM iv),
g AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY a, b, new DESC ROWS UNBOUNDED PRECEDING) AS i FROM r) SELECT k, min(a) AS a, max(b) AS b FROM g GROUP BY k, i""")
def a10_interval_union(spark: SparkSession, d: str) -> DataFrame:
    iv = table(spark, d, "lineitem").selectExpr("l_suppkey k", "l_linenumber * 10 a", "l_linenumber * 10 + cast(l_quantity as int) b")
    return intervals.union_intervals(iv, ["k"], "a", "b")


@q("SELECT vec_id AS id, CASE WHEN n >= 2 THEN n END AS line_points, CASE WHEN n >= 3 THEN n + 1 END AS ring_points FROM (SELECT vec_id, CAST(vec_id % 5 AS INTEGER) AS n FROM embeddings)")
def g35_lines_and_rings(spark: SparkSession, d: str) -> DataFrame:
    nodes = v_line(spark, d).select("id", F.slice("coords", F.lit(1), (F.col("id") % 5).cast("int")).alias("n"))
    return nodes.select("id", F.size(line.of_nodes(F.col("n"))).alias("line_points"), F.size(line.ring_of_nodes(F.col("n"))).alias("ring_points"))


@q(sql("v_seg", f"WITH {_SEGS} SELECT id, round(sum({_hav('x1', 'y1', 'x2', 'y2', C.EARTH_RADIUS_M)}), 2) AS m FROM sg WHERE x2 IS NOT NULL GROUP BY 1"))
def a21_link_length(spark: SparkSession, d: str) -> DataFrame:
    return v_line(spark, d).select("id", F.round(line.length_m(F.col("coords")), 2).alias("m"))
