"""Scalar geometry as Catalyst expressions: distances, headings, feet of perpendiculars, projections."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise.constants import EARTH_RADIUS_KM, EARTH_RADIUS_M, WGS84_A, WGS84_E


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body`` many times."""
    return F.transform(F.array(value), body)[0]


def haversine(lon1, lat1, lon2, lat2, radius: float = EARTH_RADIUS_M) -> Column:
    """Great-circle distance between two points in degrees, in the unit of ``radius``."""
    lon1, lat1, lon2, lat2 = map(_c, (lon1, lat1, lon2, lat2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def haversine_km(lon1, lat1, lon2, lat2) -> Column:
    return haversine(lon1, lat1, lon2, lat2, EARTH_RADIUS_KM)


def azimuth(x1, y1, x2, y2) -> Column:
    """Heading from the first to the second point: degrees clockwise from north in [0, 360), 0 for one point twice."""
    x1, y1, x2, y2 = map(_c, (x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    angle = F.degrees(F.atan2(dx, dy))
    return F.when((dx == 0) & (dy == 0), F.lit(0.0)).when(angle < 0, angle + 360.0).otherwise(angle)


def azimuth_gap(a, b, degrees: bool = False) -> Column:
    """Difference of two headings folded to at most half a turn; radians unless ``degrees``."""
    d = F.abs(_c(a) - _c(b)) % 360
    d = F.least(d, 360 - d)
    return d if degrees else F.radians(d)


def opposite(heading) -> Column:
    return (_c(heading) + 360 - 180) % 360


def project_ratio(px, py, ax, ay, bx, by) -> Column:
    """Where the foot of P falls on the line A-B: 0 at A, 1 at B, unclamped; 1 if A is B."""
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    return F.when(n == 0, F.lit(1.0)).otherwise(((px - ax) * dx + (py - ay) * dy) / n)


def foot(px, py, ax, ay, bx, by, digits: int = 6) -> Column:
    """Foot of P on the infinite line A-B, rounded, as ``struct<x,y>``; A itself if A is B."""
    ax, ay, bx, by = map(_c, (ax, ay, bx, by))
    t = F.when((ax == bx) & (ay == by), F.lit(0.0)).otherwise(project_ratio(px, py, ax, ay, bx, by))
    return F.struct(F.round(ax + t * (bx - ax), digits).alias("x"), F.round(ay + t * (by - ay), digits).alias("y"))


def foot_on_chord(px, py, ax, ay, bx, by, margin: float = 0.0) -> Column:
    """Whether the foot falls on A-B, lengthened by ``margin`` of its length at both ends."""
    t = project_ratio(px, py, ax, ay, bx, by)
    return (t >= -margin) & (t <= 1 + margin)


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Planar distance of P to the segment A-B."""
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), project_ratio(px, py, ax, ay, bx, by)))
    return F.hypot(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay)))


def heron_height(px, py, ax, ay, bx, by) -> Column:
    """Height of P over A-B in metres, from the triangle's great-circle sides; the distance to A if A is B."""
    a, b, c = haversine(ax, ay, bx, by), haversine(px, py, ax, ay), haversine(px, py, bx, by)
    s = (a + b + c) / 2
    return F.when(a == 0, b).otherwise(2 * F.sqrt(F.greatest(F.lit(0.0), s * (s - a) * (s - b) * (s - c))) / a)


def vector_angle(ux, uy, vx, vy) -> Column:
    """Angle between two vectors in degrees, 0 to 180; null if one has no length."""
    ux, uy, vx, vy = map(_c, (ux, uy, vx, vy))
    norm = F.hypot(ux, uy) * F.hypot(vx, vy)
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / norm))
    return F.when(norm > 0, F.degrees(F.acos(cos)))


def observation_probability(distance, sigma: float = 20.0) -> Column:
    """Gaussian density of a distance in metres."""
    return F.exp(-0.5 * F.pow(_c(distance) / sigma, 2)) / (math.sqrt(2 * math.pi) * sigma)


def turn_similarity(heading_a, heading_b) -> Column:
    """(1 + cos of the heading difference) / 2."""
    return (1 + F.cos(azimuth_gap(heading_a, heading_b))) / 2


def edge_similarity(cos_sim, dist_prob, turn) -> Column:
    return F.pow(_c(cos_sim), 2) * _c(dist_prob) * _c(turn)


def mercator(lon, lat) -> Column:
    """Ellipsoidal Mercator (EPSG:3395) metres as ``struct<x,y>``."""
    lon, phi = _c(lon), F.radians(_c(lat))
    es = WGS84_E * F.sin(phi)
    y = WGS84_A * F.log(F.tan(math.pi / 4 + phi / 2) * F.pow((1 - es) / (1 + es), WGS84_E / 2))
    return F.struct((WGS84_A * F.radians(lon)).alias("x"), y.alias("y"))


def web_mercator(lon, lat) -> Column:
    """Spherical Mercator (EPSG:900913) metres as ``struct<x,y>``."""
    return F.struct((WGS84_A * F.radians(_c(lon))).alias("x"), (WGS84_A * F.log(F.tan(math.pi / 4 + F.radians(_c(lat)) / 2))).alias("y"))


def utm(lon, lat, zone: int = 49, offset: tuple[float, float] = (0.0, 0.0), digits: int = 2) -> Column:
    """Transverse Mercator metres of a northern UTM zone plus a fixed offset, rounded, as ``struct<x,y>`` (series to order 6)."""
    e2 = WGS84_E**2
    ep2, k0 = e2 / (1 - e2), 0.9996
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon) - F.lit(float(zone * 6 - 183)))
    n = WGS84_A / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t, c, a = F.pow(F.tan(phi), 2), ep2 * F.pow(F.cos(phi), 2), F.cos(phi) * lam
    m = WGS84_A * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    x = k0 * n * (a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(a, 5) / 120) + 500000.0
    y = k0 * (m + n * F.tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(a, 6) / 720))
    return F.struct(F.round(x + offset[0], digits).alias("x"), F.round(y + offset[1], digits).alias("y"))


#: Published constants of the GCJ02 offset: semi-major axis and squared eccentricity of its ellipsoid, and the BD09 angle factor.
GCJ_A, GCJ_EE, BD_PI = 6378245.0, 0.00669342162296594323, math.pi * 3000.0 / 180.0


def _gcj_shift(lon: Column, lat: Column) -> tuple[Column, Column]:
    x, y, pi = lon - 105.0, lat - 35.0, math.pi
    wave = (20 * F.sin(6 * x * pi) + 20 * F.sin(2 * x * pi)) * 2 / 3
    dlat = -100 + 2 * x + 3 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * F.sqrt(F.abs(x)) + wave
    dlat = dlat + (20 * F.sin(y * pi) + 40 * F.sin(y / 3 * pi)) * 2 / 3 + (160 * F.sin(y / 12 * pi) + 320 * F.sin(y * pi / 30)) * 2 / 3
    dlon = 300 + x + 2 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * F.sqrt(F.abs(x)) + wave
    dlon = dlon + (20 * F.sin(x * pi) + 40 * F.sin(x / 3 * pi)) * 2 / 3 + (150 * F.sin(x / 12 * pi) + 300 * F.sin(x / 30 * pi)) * 2 / 3
    rad = F.radians(lat)
    magic = 1 - GCJ_EE * F.pow(F.sin(rad), 2)
    return dlon * 180 / (GCJ_A / F.sqrt(magic) * F.cos(rad) * pi), dlat * 180 / ((GCJ_A * (1 - GCJ_EE)) / (magic * F.sqrt(magic)) * pi)


def wgs_to_gcj(lon, lat) -> Column:
    lon, lat = _c(lon), _c(lat)
    dx, dy = _gcj_shift(lon, lat)
    return F.struct((lon + dx).alias("x"), (lat + dy).alias("y"))


def gcj_to_wgs(lon, lat) -> Column:
    """One step of the inverse: exact to about a metre."""
    lon, lat = _c(lon), _c(lat)
    dx, dy = _gcj_shift(lon, lat)
    return F.struct((lon - dx).alias("x"), (lat - dy).alias("y"))


def gcj_to_bd(lon, lat) -> Column:
    lon, lat = _c(lon), _c(lat)
    z = F.hypot(lon, lat) + 0.00002 * F.sin(lat * BD_PI)
    theta = F.atan2(lat, lon) + 0.000003 * F.cos(lon * BD_PI)
    return F.struct((z * F.cos(theta) + 0.0065).alias("x"), (z * F.sin(theta) + 0.006).alias("y"))


def bd_to_gcj(lon, lat) -> Column:
    x, y = _c(lon) - 0.0065, _c(lat) - 0.006
    z = F.hypot(x, y) - 0.00002 * F.sin(y * BD_PI)
    theta = F.atan2(y, x) - 0.000003 * F.cos(x * BD_PI)
    return F.struct((z * F.cos(theta)).alias("x"), (z * F.sin(theta)).alias("y"))


def wgs_to_bd(lon, lat) -> Column:
    return let(wgs_to_gcj(lon, lat), lambda p: gcj_to_bd(p["x"], p["y"]))


def bd_to_wgs(lon, lat) -> Column:
    return let(bd_to_gcj(lon, lat), lambda p: gcj_to_wgs(p["x"], p["y"]))


def tile_to_mercator(index, zoom, tile: int = 256, top: int = 18) -> Column:
    """Map-tile index to the provider's Mercator unit: index x 256 x 2^(18 - zoom)."""
    return _c(index) * tile * F.pow(F.lit(2.0), top - _c(zoom))


def in_bbox(x, y, box: tuple[float, float, float, float]) -> Column:
    """Closed box test (xmin, ymin, xmax, ymax) as range predicates, which reach the scan."""
    x, y = _c(x), _c(y)
    return (x >= box[0]) & (x <= box[2]) & (y >= box[1]) & (y <= box[3])


def in_ring(x, y, ring: Column) -> Column:
    """Ray-casting test of a point against a ring of ``struct<x,y>``; the ring need not repeat its first point."""
    x, y = _c(x), _c(y)

    def odd(r: Column) -> Column:
        n = F.size(r)

        def crosses(a: Column, i: Column) -> Column:
            b = F.get(r, F.pmod(i + n - 1, n))
            return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

        return F.size(F.filter(r, crosses)) % 2 == 1

    return let(ring, odd)


def planar_or_haversine(x1, y1, x2, y2, lon1, lat1, lon2, lat2) -> Column:
    """Planar distance where projected coordinates exist, else great-circle metres."""
    return F.coalesce(F.hypot(_c(x1) - _c(x2), _c(y1) - _c(y2)), haversine(lon1, lat1, lon2, lat2))


def banded_polynomial(x, y, bands: list[tuple[float, list[float]]]) -> Column:
    """A provider's Mercator conversion: the first band whose lower bound |y| reaches gives ten coefficients.

    x' = sign(x) (c0 + c1 |x|); y' = sign(y) (c2 + c3 t + ... + c8 t^6) with t = |y| / c9. The coefficient tables are the provider's and are not part of this
    package: pass them, highest band first.
    """
    x, y = _c(x), _c(y)

    def apply(c: list[float]) -> Column:
        t = F.abs(y) / c[9]
        powers = sum((c[2 + k] * F.pow(t, k) for k in range(1, 7)), F.lit(c[2]))
        return F.struct((F.signum(x) * (c[0] + c[1] * F.abs(x))).alias("x"), (F.signum(y) * powers).alias("y"))

    out = None
    for low, c in bands:
        out = F.when(F.abs(y) >= low, apply(c)) if out is None else out.when(F.abs(y) >= low, apply(c))
    return out
