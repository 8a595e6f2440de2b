"""Geometry functions against literal values and plain Python."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanewise.functions import geo, line
from lanewise.operators import intervals


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


def pts(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def test_frechet_literals(spark):
    p, q = pts((1, 1), (2, 1), (2, 2)), pts((2, 2), (0, 1), (2, 4))
    assert one(spark, line.frechet(p, q), line.frechet(p, p)) == (2.0, 0.0)
    assert one(spark, line.frechet(p, pts().cast("array<struct<x:double,y:double>>"))) is None
    with pytest.raises(Exception, match="equal, positive size"):
        one(spark, line.frechet_strict(p, pts((0, 0))))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), min_size=2, max_size=5), st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), min_size=2, max_size=5))
def test_frechet_bounds_hausdorff(spark, a, b):
    f, h, back = one(spark, line.frechet(pts(*a), pts(*b)), line.hausdorff(pts(*a), pts(*b)), line.frechet(pts(*b), pts(*a)))
    assert f >= h - 1e-9 and f == pytest.approx(back)


def test_headings(spark):
    got = one(spark, *[geo.azimuth(F.lit(0.0), F.lit(0.0), F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 1), (1, 0), (0, -1), (-1, 0), (0, 0))])
    assert got == (0.0, 90.0, 180.0, 270.0, 0.0)
    assert one(spark, geo.azimuth_gap(F.lit(350), F.lit(20), True), geo.opposite(F.lit(10)), geo.opposite(F.lit(200))) == (30, 190, 20)


def test_haversine_is_symmetric(spark):
    a, b = one(spark, geo.haversine(F.lit(113.9), F.lit(22.5), F.lit(114.1), F.lit(22.6)), geo.haversine(F.lit(114.1), F.lit(22.6), F.lit(113.9), F.lit(22.5)))
    assert a == pytest.approx(b) and 23_000 < a < 24_000


def test_projection(spark):
    foot, t, on, d, dd = one(
        spark,
        geo.foot(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(0.0)), geo.project_ratio(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(0.0)),
        geo.foot_on_chord(F.lit(5.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(0.0)), geo.point_segment_distance(F.lit(7.0), F.lit(4.0), F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(0.0)),
        geo.project_ratio(F.lit(1.0), F.lit(1.0), F.lit(2.0), F.lit(2.0), F.lit(2.0), F.lit(2.0)),
    )
    assert (foot.x, foot.y, t, on, d, dd) == (1.0, 0.0, 0.25, False, 5.0, 1.0)


def test_coordinate_systems_round_trip(spark):
    x, y = F.lit(113.95), F.lit(22.55)
    bd = geo.wgs_to_bd(x, y)
    back = geo.let(bd, lambda p: geo.bd_to_wgs(p["x"], p["y"]))
    moved, home = one(spark, bd, back)
    assert abs(moved.x - 113.95) > 0.005 and home.x == pytest.approx(113.95, abs=2e-5) and home.y == pytest.approx(22.55, abs=2e-5)
    utm = one(spark, geo.utm(F.lit(111.0), F.lit(0.0)))
    assert (utm.x, utm.y) == (500000.0, 0.0)
    east = one(spark, geo.utm(F.lit(114.0), F.lit(22.5), offset=(-800000.0, -2480000.0)))
    assert 8_000 < east.x < 10_000 and 9_000 < east.y < 12_000
    assert one(spark, geo.mercator(F.lit(1.0), F.lit(0.0))["x"]) == pytest.approx(111319.49, abs=0.01)


def test_densify_spaces_a_line_by_about_a_metre(spark):
    got = one(spark, line.densify(pts((0, 0), (10 / 110000, 0), (10 / 110000, 1e-7))))
    assert len(got) == 9 + 1 + 1 and got[0].x == 0 and got[-1].y == 1e-7


def test_cut_and_position(spark):
    a, b = pts((0, 0), (1, 0), (2, 0), (3, 0), (4, 0)), pts((1.5, 1), (3.5, 1))
    cut = one(spark, line.cut_to_overlap(a, b))
    assert [(p.x, p.y) for p in cut] == [(1.5, 0.0), (2.0, 0.0), (3.0, 0.0), (3.5, 0.0)]
    assert one(spark, line.relative_position(b, a), line.relative_position(pts((-3, 0), (-1, 0)), a), line.relative_position(pts((9, 0), (9, 1)), a)) == (0.625, 0.0, 1.0)


def test_offset_right(spark):
    m = 1 / 110000
    got = one(spark, line.offset_right(pts((0, 0), (0, 10 * m), (10 * m, 10 * m)), 1.0, 9))
    assert [(round(p.x / m, 2), round(p.y / m, 2)) for p in got] == [(1.0, 0.0), (1.0, 9.0), (10.0, 9.0)]
    ring = pts((0, 0), (1, 0), (1, 1), (0, 0))
    assert one(spark, line.offset_right(ring, 5.0) == ring)


def test_split_shares_the_ends(spark):
    got = one(spark, line.split_at(F.array(*[F.lit(x) for x in "abcde"]), F.array(F.lit(2))))
    assert got == [["a", "b", "c"], ["c", "d", "e"]]


def test_shapes_and_wkt(spark):
    p = line.parse_shape(F.lit("1.5,2 3,4.25"))
    text, wkt, none, back = one(spark, line.format_shape(p), line.to_wkt(p), line.parse_shape(F.lit(" ")), line.from_wkt(line.to_wkt(p)) == p)
    assert (text, wkt, none, back) == ("1.5,2.0 3.0,4.25", "LINESTRING (1.5 2.0, 3.0 4.25)", None, True)


def test_label_rows(spark):
    got = one(spark, line.resample_rows(pts((100, 250), (200, 350))))
    assert len(got) == 48 and got[0] == -2 and got[1] == 100 and got[6] == 150 and got[11] == 200 and got[12] == -2


def test_lane_curve_stays_in_the_image(spark):
    c = F.struct(*[F.lit(float(v)).alias(k) for k, v in {"a": 0, "b": 0, "c": 0, "d": 0.5, "e": 0, "f": 0, "lower": 0.2, "upper": 1.0}.items()])
    got = one(spark, line.lane_curve(c, 1280, 720))
    assert len(got) == 50 and {p.x for p in got} == {640.0} and got[0].y == pytest.approx(144)


def test_middle(spark):
    a = lambda *v: F.array(*[F.lit(x) for x in v])
    assert one(spark, line.middle(a(1)), line.middle(a(1, 2)), line.middle(a(1, 2, 3)), line.middle(a(1, 2, 3, 4))) == (None, 2, 2, 3)


def test_insert_interval_takes_the_absorbed_value(spark):
    span = lambda a, b, v: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(v).alias("value"))
    got = one(spark, intervals.insert_interval(F.array(span(0, 2, "a"), span(5, 7, "b"), span(9, 9, "c")), span(4, 6, "new")))
    assert [tuple(x) for x in got] == [(0, 2, "a"), (4, 7, "b"), (9, 9, "c")]
    free = one(spark, intervals.insert_interval(F.array(span(0, 2, "a")), span(4, 6, "new")))
    assert [tuple(x) for x in free] == [(0, 2, "a"), (4, 6, "new")]
    # FIXTURES C3: of several absorbed ones the last one's value; what the grown span reaches is absorbed too
    several = one(spark, intervals.insert_interval(F.array(span(0, 5, 3), span(8, 12, 2)), span(4, 9, 7)))
    assert [tuple(x) for x in several] == [(0, 12, 2)]
    reached = one(spark, intervals.insert_interval(F.array(span(0, 1, 1), span(3, 20, 2), span(15, 25, 3), span(30, 31, 4)), span(4, 9, 7)))
    assert [tuple(x) for x in reached] == [(0, 1, 1), (3, 25, 3), (30, 31, 4)]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=8), st.randoms())
def test_interval_union_ignores_order(spark, spans, rnd):
    rows = [(1, min(a, b) / 9, max(a, b) / 9) for a, b in spans]
    mixed = list(rows)
    rnd.shuffle(mixed)
    total = lambda r: intervals.coverage(spark.createDataFrame(r, "k int, a double, b double"), ["k"], "a", "b").first().percentage
    assert total(rows) == pytest.approx(total(mixed)) and total(rows) <= 1 + 1e-9
    steps = {x for _, a, b in rows for x in range(round(a * 9), round(b * 9))}
    assert total(rows) * 9 == pytest.approx(len(steps))


def test_coverage_between_two_breakpoints(spark):
    path = spark.createDataFrame([(1, 0, 0.2), (1, -1, 0.9), (2, 1, None), (3, 0, 0.5), (4, -1, 0.25), (4, 0, 0.75), (4, 1, None)], "eid long, step int, breakpoint double")
    got = {r.eid: (round(r.percentage, 6), r.visited) for r in intervals.path_coverage(path).collect()}
    assert got == {1: (0.7, True), 2: (1.0, True), 3: (0.5, False), 4: (1.0, True)}


def test_change_intervals_are_split_at_existing_ones(spark):
    changes = spark.createDataFrame([(1, 24, 32, "x")], "k long, start int, end int, value string")
    existing = spark.createDataFrame([(1, 0, 30, "p"), (1, 30, 33, "q")], "k long, start int, end int, base string")
    want = {(24, 30, "p"), (30, 32, "q")}
    for bucket in (None, 4.0):
        got = intervals.split_overlaps(changes, existing, "k", bucket).collect()
        assert {(r.start, r.end, r.base) for r in got} == want and len(got) == 2


def test_point_in_ring(spark):
    ring = pts((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))
    got = one(spark, *[geo.in_ring(F.lit(float(x)), F.lit(float(y)), ring) for x, y in ((1, 1), (2, 3), (5, 1), (3.5, 3))])
    assert got == (True, False, False, True)


def test_heading_cosine_is_one_along_the_line(spark):
    got = one(spark, line.heading_cosine(F.lit(90), pts((0, 0), (1, 0), (2, 0))), line.heading_cosine(F.lit(270), pts((0, 0), (1, 0)), False))
    assert got == (pytest.approx(1.0), pytest.approx(-1.0))
    assert math.isclose(one(spark, line.length_m(pts((0, 0), (1, 0)))), 111195.08, abs_tol=0.2)
