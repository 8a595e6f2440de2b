"""Polylines (arrays of ``struct<x,y>``) as higher-order expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise.constants import METRES_PER_DEGREE

from . import geo
from .geo import let

POINT = "struct<x:double,y:double>"


def _xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def from_flat(values: Column, points: int | None = None) -> Column:
    """Points from an array x0, y0, x1, y1, ...; the first ``points`` of them."""
    n = F.size(values).cast("int") if points is None else F.lit(2 * points)
    return F.transform(F.sequence(F.lit(0), (F.floor(n / 2) - 1).cast("int")), lambda k: _xy(F.get(values, 2 * k), F.get(values, 2 * k + 1)))


def parse_shape(text: Column) -> Column:
    """``x,y x,y ...`` to points; null for a null or empty text."""
    return F.when(F.length(F.trim(text)) > 0, F.transform(F.split(F.trim(text), r"\s+"), lambda p: _xy(F.split(p, ",")[0].cast("double"), F.split(p, ",")[1].cast("double"))))


def format_shape(line: Column, digits: int = 2) -> Column:
    return F.array_join(F.transform(line, lambda p: F.concat_ws(",", F.round(p["x"], digits).cast("string"), F.round(p["y"], digits).cast("string"))), " ")


def to_wkt(line: Column) -> Column:
    """``POINT`` of one point, else ``LINESTRING``."""
    body = F.array_join(F.transform(line, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", ")
    return F.when(F.size(line) == 1, F.concat(F.lit("POINT ("), body, F.lit(")"))).otherwise(F.concat(F.lit("LINESTRING ("), body, F.lit(")")))


def from_wkt(text: Column) -> Column:
    body = F.regexp_extract(text, r"\(+([^()]*)\)", 1)
    return F.when(F.length(body) > 0, F.transform(F.split(body, r"\s*,\s*"), lambda p: _xy(F.split(F.trim(p), r"\s+")[0].cast("double"), F.split(F.trim(p), r"\s+")[1].cast("double"))))


def of_nodes(nodes: Column, least: int = 2) -> Column:
    """The line of a node list ``array<struct<..., x, y>>``; null if it has fewer than ``least`` nodes."""
    return F.when(F.size(nodes) >= least, F.transform(nodes, lambda n: _xy(n["x"], n["y"])))


def ring_of_nodes(nodes: Column) -> Column:
    """The closed ring of a node list; null if it has fewer than three nodes."""
    ring = of_nodes(nodes, 3)
    return let(ring, lambda r: F.when(F.element_at(r, 1) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1))))


def segments(line: Column) -> Column:
    """Consecutive pairs as ``struct<a,b>``."""
    return let(line, lambda p: F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda k: F.struct(F.get(p, k - 1).alias("a"), F.get(p, k).alias("b")))).otherwise(F.array().cast(f"array<struct<a:{POINT},b:{POINT}>>")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def length_m(line: Column) -> Column:
    """Sum of the segments' great-circle lengths."""
    return _sum(F.transform(segments(line), lambda s: geo.haversine(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])))


def length_km(line: Column) -> Column:
    return _sum(F.transform(segments(line), lambda s: geo.haversine_km(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])))


def length_mercator(line: Column) -> Column:
    """Length after projection to EPSG:3395."""
    project = lambda p: geo.mercator(p["x"], p["y"])
    return length_planar(F.transform(line, project))


def length_planar(line: Column) -> Column:
    return _sum(F.transform(segments(line), lambda s: F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])))


def azimuths(line: Column) -> Column:
    """Heading of every segment; null for fewer than two points."""
    return F.when(F.size(line) > 1, F.transform(segments(line), lambda s: geo.azimuth(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])))


def heading_cosine(heading: Column, line: Column, weighted: bool = True) -> Column:
    """Mean cosine between a heading and the segments' headings, weighted by the segments' lengths if asked."""
    parts = F.transform(
        segments(line),
        lambda s: F.struct(
            F.cos(geo.azimuth_gap(geo.azimuth(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]), heading)).alias("c"),
            (geo.haversine(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]) if weighted else F.lit(1.0)).alias("w"),
        ),
    )
    return let(parts, lambda p: _sum(F.transform(p, lambda x: x["c"] * x["w"])) / F.nullif(_sum(F.transform(p, lambda x: x["w"])), F.lit(0.0)))


def hausdorff(a: Column, b: Column, scale: float = 1.0) -> Column:
    """Largest distance of a point of one line to the nearest point of the other, both ways."""

    def directed(p: Column, q: Column) -> Column:
        return F.array_max(F.transform(p, lambda x: F.array_min(F.transform(q, lambda y: F.hypot(x["x"] - y["x"], x["y"] - y["y"])))))

    return F.greatest(directed(a, b), directed(b, a)) * scale


def hausdorff_m(a: Column, b: Column) -> Column:
    return hausdorff(a, b, METRES_PER_DEGREE)


def frechet(a: Column, b: Column, scale: float = 1.0) -> Column:
    """Discrete Frechet distance: a fold over the first line that carries one row of the dynamic programme; null if a line is empty."""
    nothing = F.array().cast("array<double>")

    def row(before: Column, p: Column) -> Column:
        def cell(acc: Column, q: Column) -> Column:
            d = F.hypot(p["x"] - q["x"], p["y"] - q["y"])
            k = F.size(acc)
            up, left, corner = F.get(before, k), F.get(acc, k - 1), F.get(before, k - 1)
            reach = F.when(F.size(before) == 0, left).when(k == 0, up).otherwise(F.least(up, left, corner))
            return F.concat(acc, F.array(F.greatest(d, F.coalesce(reach, d))))

        return F.aggregate(b, nothing, cell)

    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.element_at(F.aggregate(a, nothing, row), -1) * scale)


def frechet_strict(a: Column, b: Column) -> Column:
    """As ``frechet``, and an error for empty lines or lines of different sizes."""
    bad = (F.size(a) == 0) | (F.size(b) == 0) | (F.size(a) != F.size(b))
    return F.when(bad, F.raise_error(F.lit("curves must be of equal, positive size")).cast("double")).otherwise(frechet(a, b))


def densify(line: Column, step_m: float = 1.0) -> Column:
    """Evenly spaced points about ``step_m`` apart: per segment round(d) - 1 of them, one at least; the last point closes the line."""

    def fill(s: Column) -> Column:
        d = F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]) * METRES_PER_DEGREE / step_m
        n = F.greatest(F.lit(1), (F.round(d) - 1).cast("int"))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: _xy(s["a"]["x"] + (s["b"]["x"] - s["a"]["x"]) * k / n, s["a"]["y"] + (s["b"]["y"] - s["a"]["y"]) * k / n))

    return F.concat(F.flatten(F.transform(segments(line), fill)), F.array(F.element_at(line, -1)))


def line_distance(px: Column, py: Column, line: Column) -> Column:
    """Planar distance of a point to a polyline."""
    return F.array_min(F.transform(segments(line), lambda s: geo.point_segment_distance(px, py, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])))


def locate(px: Column, py: Column, line: Column) -> Column:
    """Relative position (0 to 1) of a point's nearest place on a line, by planar length."""

    def at(s: Column) -> Column:
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), geo.project_ratio(px, py, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])))
        return F.struct(
            geo.point_segment_distance(px, py, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]).alias("d"), t.alias("t"), F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]).alias("l")
        )

    def best(parts: Column) -> Column:
        whole = _sum(F.transform(parts, lambda p: p["l"]))
        nearest = F.array_min(F.transform(parts, lambda p, i: F.struct(p["d"].alias("d"), i.alias("i"))))["i"]
        before = F.aggregate(F.slice(parts, 1, nearest), F.lit(0.0), lambda acc, p: acc + p["l"])
        hit = F.get(parts, nearest)
        return (before + hit["t"] * hit["l"]) / F.nullif(whole, F.lit(0.0))

    return let(F.transform(segments(line), at), best)


def relative_position(line: Column, along: Column) -> Column:
    """Position of a line's chord midpoint along another line: k + t of the first segment whose chord holds its foot, 0 before and the number of segments behind, over that number."""
    a, b = F.element_at(line, 1), F.element_at(line, -1)
    mid = F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))

    def find(m: Column) -> Column:
        ratios = F.transform(segments(along), lambda s, i: F.struct(i.alias("i"), geo.project_ratio(m["x"], m["y"], s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]).alias("t")))

        def pick(r: Column) -> Column:
            hit = F.get(F.filter(r, lambda x: (x["t"] >= 0) & (x["t"] <= 1)), F.lit(0))
            return F.coalesce((hit["i"] + hit["t"]) / F.size(r), F.when(F.get(r, F.lit(0))["t"] < 0, F.lit(0.0)).otherwise(F.lit(1.0)))

        return let(ratios, pick)

    return let(mid, find)


def cut_to_overlap(a: Column, b: Column) -> Column:
    """The points of ``a`` whose feet fall on the chord of ``b``, closed by the feet of b's ends that fall on a's chord."""

    def ends(line: Column) -> tuple[Column, Column]:
        return F.element_at(line, 1), F.element_at(line, -1)

    (a0, a1), (b0, b1) = ends(a), ends(b)
    inside = F.filter(a, lambda p: geo.foot_on_chord(p["x"], p["y"], b0["x"], b0["y"], b1["x"], b1["y"]))
    feet = lambda p: F.when(geo.foot_on_chord(p["x"], p["y"], a0["x"], a0["y"], a1["x"], a1["y"]), F.array(geo.foot(p["x"], p["y"], a0["x"], a0["y"], a1["x"], a1["y"], 12))).otherwise(F.array().cast(f"array<{POINT}>"))
    marked = F.transform(F.concat(feet(b0), inside, feet(b1)), lambda p: F.struct(geo.project_ratio(p["x"], p["y"], a0["x"], a0["y"], a1["x"], a1["y"]).alias("t"), p["x"].alias("x"), p["y"].alias("y")))
    return F.transform(F.array_sort(marked), lambda p: _xy(p["x"], p["y"]))


def offset_right(line: Column, metres: float, digits: int = 7) -> Column:
    """Parallel line on the right: every vertex moves along the mean normal of its segments, mitred; rings and single points stay."""
    d = metres / METRES_PER_DEGREE

    def shift(p: Column) -> Column:
        n = F.size(p)

        def vertex(v: Column, i: Column) -> Column:
            before, after = F.get(p, F.greatest(i - 1, F.lit(0))), F.get(p, F.least(i + 1, n - 1))
            unit = lambda s, e: let(F.hypot(e["x"] - s["x"], e["y"] - s["y"]), lambda h: F.struct(F.when(h > 0, (e["y"] - s["y"]) / h).otherwise(0.0).alias("x"), F.when(h > 0, (s["x"] - e["x"]) / h).otherwise(0.0).alias("y")))

            def moved(u: Column) -> Column:
                nx, ny = u["a"]["x"] + u["b"]["x"], u["a"]["y"] + u["b"]["y"]
                dot = 1 + u["a"]["x"] * u["b"]["x"] + u["a"]["y"] * u["b"]["y"]
                single = (i == 0) | (i == n - 1)
                k = F.when(single, F.lit(d)).otherwise(d / F.greatest(dot, F.lit(0.25)))
                return _xy(F.round(v["x"] + nx * k, digits), F.round(v["y"] + ny * k, digits))

            return let(F.struct(unit(before, v).alias("a"), unit(v, after).alias("b")), moved)

        first, last = F.element_at(p, 1), F.element_at(p, -1)
        ring = (n < 2) | ((first["x"] == last["x"]) & (first["y"] == last["y"]))
        return F.when(ring, p).otherwise(F.transform(p, vertex))

    return let(line, shift)


def split_at(items: Column, cuts: Column) -> Column:
    """An array cut at the given 0-based places; neighbours share the element at the cut. Ends are always cuts."""

    def parts(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda k: F.slice(items, F.get(c, k - 1) + 1, F.get(c, k) - F.get(c, k - 1) + 1))

    return let(F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), cuts, F.array(F.size(items) - 1)))), parts)


def middle(items: Column) -> Column:
    """The element in the middle; of fewer than three the second, if any."""
    return F.when(F.size(items) < 3, F.get(items, F.lit(1))).otherwise(F.get(items, F.floor(F.size(items) / 2).cast("int")))


def resample_rows(points: Column, first: int = 240, last: int = 710, step: int = 10, missing: int = -2) -> Column:
    """x of a lane at every row of a y grid by linear interpolation between its points; ``missing`` outside."""

    def at(y: Column) -> Column:
        spans = F.filter(segments(points), lambda s: (F.least(s["a"]["y"], s["b"]["y"]) <= y) & (F.greatest(s["a"]["y"], s["b"]["y"]) >= y))
        hit = F.get(spans, F.lit(0))
        rise = hit["b"]["y"] - hit["a"]["y"]
        return F.coalesce(F.when(rise == 0, hit["a"]["x"]).otherwise(hit["a"]["x"] + (hit["b"]["x"] - hit["a"]["x"]) * (y - hit["a"]["y"]) / rise).cast("int"), F.lit(missing))

    return F.transform(F.sequence(F.lit(first), F.lit(last), F.lit(step)), at)


def lane_curve(c: Column, width: float, height: float, samples: int = 50) -> Column:
    """Points of x(y) = a / (y - b)^2 + c / (y - b) + d + e y - f between rows ``lower`` and ``upper`` of ``c``, scaled; those within the image stay."""
    ys = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: c["lower"] + (c["upper"] - c["lower"]) * k / (samples - 1))
    x = lambda y: c["a"] / F.pow(y - c["b"], 2) + c["c"] / (y - c["b"]) + c["d"] + c["e"] * y - c["f"]
    return F.filter(F.transform(ys, lambda y: _xy(x(y) * width, y * height)), lambda p: (p["x"] >= 0) & (p["x"] < width) & (p["y"] >= 0) & (p["y"] <= height))
