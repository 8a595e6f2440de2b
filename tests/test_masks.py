"""Buffers and dissolved masks against plain computations."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lanewise.operators import masks

COORDS = "array<struct<x:double,y:double>>"
CIRCLE = 16 * math.sin(math.pi / 16)  # the area of a circle of radius 1 drawn with 32 edges


def table(spark, lines):
    return spark.createDataFrame(lines, f"eid long, coords {COORDS}")


def area(mask):
    return mask.agg(F.sum(masks.trapezoid_area())).first()[0] or 0.0


def inside(p, a, b, r, arc=masks.ARC):
    """Whether a place lies in the hull of the two circles' polygons, by its half planes."""
    turn, n = math.atan2(b[1] - a[1], b[0] - a[0]), 4 * arc
    for k in range(n):
        c, s = math.cos(turn + (k + 0.5) * 2 * math.pi / n), math.sin(turn + (k + 0.5) * 2 * math.pi / n)
        if p[0] * c + p[1] * s - max(a[0] * c + a[1] * s, b[0] * c + b[1] * s) > r * math.cos(math.pi / n):
            return False
    return abs((p[0] - a[0]) * -math.sin(turn) + (p[1] - a[1]) * math.cos(turn)) <= r


def plain_area(segments, r, steps=4000):
    """By strips: each capsule's cut through the middle of a strip, as an interval."""
    shapes = [masks._capsule(*a, *b, r, masks.ARC) for a, b in segments]
    lo, hi = min(s[0][0] for s in shapes), max(s[0][-1] for s in shapes)
    total, width = 0.0, (hi - lo) / steps
    for k in range(steps):
        x, end = lo + (k + 0.5) * width, -math.inf
        cuts = []
        for lx, ly, ux, uy in shapes:
            if lx[0] < x < lx[-1]:
                at = lambda xs, ys: next(y0 + (x - x0) * (y1 - y0) / (x1 - x0) for x0, y0, x1, y1 in zip(xs, ys, xs[1:], ys[1:], strict=False) if x0 <= x <= x1)  # noqa: E731, B023
                cuts.append((at(lx, ly), at(ux, uy)))
        for a, b in sorted(cuts):
            total += max(0.0, b - max(a, end)) * width
            end = max(end, b)
    return total


def test_single_buffers(spark):
    lines = [(1, [(0.0, 0.0), (3.0, 0.0)]), (2, [(0.0, 0.0), (0.0, 3.0)]), (3, [(1.0, 1.0), (-2.0, 5.0)]), (4, [(2.0, 2.0)]), (5, [(2.0, 2.0), (2.0, 2.0)]), (6, None), (7, []), (8, [(float("nan"), 1.0), (2.0, 2.0)])]
    for size in (None, 0.3, 50.0):
        mask = masks.buffer_mask(table(spark, lines), 0.5, ["eid"], size)
        got = {r.eid: r.a for r in mask.groupBy("eid").agg(F.sum(masks.trapezoid_area()).alias("a")).collect()}
        assert got.keys() == {1, 2, 3, 4, 5}
        for k, length in ((1, 3), (2, 3), (3, 5), (4, 0), (5, 0)):
            assert got[k] == pytest.approx(length + CIRCLE * 0.25, rel=1e-9)
    rings = masks.buffer_mask(table(spark, lines[:1]), 0.5).select(masks.trapezoid_ring().alias("ring")).collect()
    assert all(len(r.ring) == 5 and r.ring[0] == r.ring[-1] for r in rings)


def test_dissolved_mask_equals_a_plain_union(spark):
    rng = random.Random(3)
    lines = []
    for k in range(25):
        at, pts = (rng.uniform(0, 4), rng.uniform(0, 4)), []
        for _ in range(rng.randrange(2, 5)):
            pts.append(at)
            at = (at[0] + rng.choice([0.0, rng.gauss(0, 0.8)]), at[1] + rng.choice([0.0, rng.gauss(0, 0.8)]))
        lines.append((k, pts))
    segments = [s for _, p in lines for s in zip(p, p[1:], strict=False)]
    want = plain_area(segments, 0.2)
    points = [(k, rng.uniform(-1, 5), rng.uniform(-1, 5)) for k in range(600)]
    held = {k for k, x, y in points if any(inside((x, y), a, b, 0.2) for a, b in segments)}
    for size in (None, 0.5, 20.0):
        mask = masks.buffer_mask(table(spark, lines), 0.2, size=size).persist()
        assert area(mask) == pytest.approx(want, rel=1e-4)
        got = [r.pid for r in masks.in_mask(spark.createDataFrame(points, "pid long, x double, y double"), mask, 1.0).collect()]
        assert len(got) == len(set(got)) and set(got) == held
        mask.unpersist()
    assert len(held) > 100


def test_hot_cells(spark):
    """Very many shapes in one cell: collinear ones, copies, and a fan through one place."""
    row = [(k, [(k / 400, 0.0), (k / 400 + 1, 0.0)]) for k in range(400)] + [(k, [(0.0, 0.0), (1.0, 0.0)]) for k in range(400, 900)]
    mask = masks.buffer_mask(table(spark, row), 0.5, size=8.0)
    assert area(mask) == pytest.approx(399 / 400 + 1 + CIRCLE * 0.25, rel=1e-9)
    fan = [(k, [(0.0, 0.0), (2 * math.cos(k), 2 * math.sin(k))]) for k in range(150)]
    segments = [tuple(p) for _, p in fan]
    mask = masks.buffer_mask(table(spark, fan), 0.1, size=8.0).persist()
    assert area(mask) == pytest.approx(plain_area(segments, 0.1, 1500), rel=1e-4)
    rng = random.Random(4)
    points = [(k, rng.uniform(-2.2, 2.2), rng.uniform(-2.2, 2.2)) for k in range(300)]
    got = {r.pid for r in masks.in_mask(spark.createDataFrame(points, "pid long, x double, y double"), mask, 0.5).collect()}
    assert got == {k for k, x, y in points if any(inside((x, y), a, b, 0.1) for a, b in segments)}
    mask.unpersist()


def test_metric_mask_and_odd_input(spark):
    at = [(1, [(113.9, 22.5)]), (None, [(113.9, 22.5), (113.9, 22.5)])]
    mask = masks.metric_mask(table(spark, at), 25.0, ["eid"])
    spans = {r.eid: (r.a, r.b) for r in mask.groupBy("eid").agg((F.max("x1") - F.min("x0")).alias("a"), (F.max(F.greatest("hi0", "hi1")) - F.min(F.least("lo0", "lo1"))).alias("b")).collect()}
    wide = math.degrees(50 / masks.SPHERE_M)
    assert set(spans) == {1, None} and all(a == pytest.approx(wide, rel=1e-6) and b == pytest.approx(wide * math.cos(math.radians(22.5)), rel=1e-4) for a, b in spans.values())
    assert masks.buffer_mask(table(spark, []), 1.0).collect() == []
    with pytest.raises(ValueError):
        masks.buffer_mask(table(spark, at), 0.0)
