"""Buffers of lines as geometry, and masks dissolved from many of them.

A buffer is the union of its segments' capsules, with round ends drawn by ``ARC`` edges a quarter circle. A mask is a table of trapezoids with two vertical sides that
do not overlap: ``x0, x1, lo0, lo1, hi0, hi1``, between the heights ``lo`` and ``hi`` at the sides. Capsules meet in the grid cells that they touch, and each cell is dissolved by itself.
A cell of very many shapes is dissolved in blocks; what they become is dealt to the four quarters of the cell and dissolved again. Near any place
a union is simple, however many capsules meet there, so that small enough cells hold few shapes, and no task more than blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions import line
from lanewise.functions.geo import let
from lanewise.operators.spatial import cell, covering_cells, passed_cells
from lanewise.session import cut

#: Edges of a quarter circle; shapes that are dissolved together; how often a full cell is cut in four.
ARC, FULL, DEEPEST = 8, 32, 24
#: Edges that are held against all others at once.
TOGETHER = 64
#: Radius of the sphere of the web's Mercator projection, in metres: a fixed value.
SPHERE_M = 6378137.0

SIDES = ("x0", "x1", "lo0", "lo1", "hi0", "hi1")


def _capsule(ax: float, ay: float, bx: float, by: float, radius: float, arc: int) -> tuple:
    """Lower and upper border of a capsule's polygon, each as places and heights from left to right."""
    turn = math.atan2(by - ay, bx - ax)
    angles = turn + (np.arange(4 * arc + 2) - arc - (np.arange(4 * arc + 2) > 2 * arc)) * (math.pi / (2 * arc))
    at_b = np.arange(4 * arc + 2) <= 2 * arc
    xs, ys = np.where(at_b, bx, ax) + radius * np.cos(angles), np.where(at_b, by, ay) + radius * np.sin(angles)
    n = len(xs)
    left_low, right_low = np.lexsort((ys, xs))[0], np.lexsort((-ys, xs))[-1]
    right_high, left_high = np.lexsort((ys, xs))[-1], np.lexsort((-ys, xs))[0]
    low = (left_low + np.arange((right_low - left_low) % n + 1)) % n
    high = (right_high + np.arange((left_high - right_high) % n + 1))[::-1] % n
    return xs[low], ys[low], xs[high], ys[high]


def _events(box: tuple, shapes: list[tuple]) -> np.ndarray:
    """Where borders begin, end or cross one another or the cell's, from the cell's left to its right."""
    x0, y0, x1, y1 = box
    parts = [(xs[:-1], ys[:-1], xs[1:], ys[1:]) for s in shapes for xs, ys in (s[:2], s[2:])]
    ax, ay, bx, by = (np.concatenate(p) for p in zip(*parts, strict=True))
    near = (bx > x0) & (ax < x1) & (np.maximum(ay, by) >= y0) & (np.minimum(ay, by) <= y1) & (bx > ax)
    ax, ay, bx, by = (np.concatenate([v[near], e]) for v, e in ((ax, [x0, x0]), (ay, [y0, y1]), (bx, [x1, x1]), (by, [y0, y1])))
    slope = (by - ay) / (bx - ax)
    height = ay - y0 - slope * (ax - x0)  # at the cell's left, from its floor
    found = [np.array([x0, x1]), ax, bx, *[s[0] for s in shapes], *[s[2] for s in shapes]]
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(0, len(slope), TOGETHER):
            some = (slice(k, k + TOGETHER), None)
            x = x0 + (height[k:] - height[some]) / (slope[some] - slope[k:])
            found.append(x[(x > np.maximum(ax[some], ax[k:])) & (x < np.minimum(bx[some], bx[k:]))])
    every = np.concatenate(found)
    return np.unique(every[(every >= x0) & (every <= x1)])


def dissolve_cell(box: tuple, shapes: list[tuple]) -> list[tuple]:
    """The union of convex shapes (as ``_capsule`` gives them) within a cell, by a sweep: between two events no border crosses another, so that
    the shapes are intervals there, in one order. Stretches with the same borders are one trapezoid."""
    x0, y0, x1, y1 = box
    sides = np.array([x0, x1])
    shapes = [s for s in shapes if s[0][0] < x1 and s[0][-1] > x0 and s[1].min() < y1 and s[3].max() > y0]
    for s in shapes:  # convex: what covers the corners covers the cell
        if s[0][0] <= x0 and s[0][-1] >= x1 and (np.interp(sides, s[0], s[1]) <= y0).all() and (np.interp(sides, s[2], s[3]) >= y1).all():
            return [(x0, x1, y0, y0, y1, y1)]
    if not shapes:
        return []
    at = _events(box, shapes)
    at = at[np.concatenate([[True], np.diff(at) > 1e-12 * (x1 - x0)])]
    at[-1] = x1
    mid = (at[1:] + at[:-1]) / 2
    if not len(mid):
        return []
    ends = np.stack([at[:-1], mid, at[1:]])
    low, high = (np.stack([np.interp(ends, s[k], s[k + 1]) for s in shapes]).clip(y0, y1) for k in (0, 2))
    inside = np.stack([(mid > s[0][0]) & (mid < s[0][-1]) for s in shapes]) & (high[:, 1] > low[:, 1])
    # which edge a border is at each stretch: none where the cell cuts it
    edge = [np.stack([np.searchsorted(s[k], mid) for s in shapes]) for k in (0, 2)]
    edge[0][low[:, 1] <= y0] = -1
    edge[1][high[:, 1] >= y1] = -1
    # intervals in their order, joined where one begins no higher than the highest end below it
    order = np.argsort(np.where(inside, low[:, 1], np.inf), axis=0, kind="stable")
    sort = lambda v: np.take_along_axis(v, order, 0)
    there, start, end = sort(inside), sort(low[:, 1]), sort(np.where(inside, high[:, 1], -np.inf))
    top = np.vstack([np.full((1, len(mid)), -np.inf), np.maximum.accumulate(end)])
    highest = np.maximum.accumulate(np.where(end > top[:-1], np.arange(len(shapes))[:, None], 0))
    begins = there & (start > top[:-1])
    stretch, rank = np.nonzero(begins.T)
    if not len(stretch):
        return []
    after = np.concatenate([np.where(stretch[1:] == stretch[:-1], rank[1:], len(shapes)), [len(shapes)]])
    under, over = order[rank, stretch], order[highest[after - 1, stretch], stretch]
    # stretches side by side with the same two edges are one
    names = [np.where(e[k, stretch] < 0, -1, k * 1_000_000 + e[k, stretch]) for e, k in zip(edge, (under, over), strict=True)]
    own = np.lexsort((stretch, *names))
    stretch, under, over, names = stretch[own], under[own], over[own], [n[own] for n in names]
    goes_on = (np.diff(stretch) == 1) & (np.diff(names[0]) == 0) & (np.diff(names[1]) == 0)
    first, last = np.flatnonzero(np.concatenate([[True], ~goes_on])), np.flatnonzero(np.concatenate([~goes_on, [True]]))
    j, k = stretch[first], stretch[last]
    return list(zip(*(v.tolist() for v in (at[j], at[k + 1], low[under[first], 0, j], low[under[last], 2, k], high[over[first], 0, j], high[over[last], 2, k])), strict=True))


def _dissolved(by: Sequence[str], side: float, radius: float, arc: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                box = (r.qx * side, r.qy * side, (r.qx + 1) * side, (r.qy + 1) * side)
                shapes = []
                for s in r.shapes:
                    p = [s[f"p{k}"] for k in range(6)]
                    shapes.append(_capsule(*p[:4], radius, arc) if s["capsule"] else (np.array(p[:2]), np.array(p[2:4]), np.array(p[:2]), np.array(p[4:])))
                own = tuple(getattr(r, f"k{i}") for i in range(len(by)))
                rows += [(*own, r.qx, r.qy, r.n, *t) for t in dissolve_cell(box, shapes)]
            yield pd.DataFrame(rows, columns=[*[f"k{i}" for i in range(len(by))], "qx", "qy", "n", *SIDES])

    return run


def buffer_mask(lines: DataFrame, radius: float, by: Sequence[str] = (), size: float | None = None, arc: int = ARC, coords: str = "coords") -> DataFrame:
    """The dissolved buffers of all lines, or of those with the same ``by``: ``by, x0, x1, lo0, lo1, hi0, hi1``, trapezoids that do not overlap.

    Lines of one point have round buffers; null lines, empty ones and segments with a place that is null or not finite have none. ``size`` is the
    side of the cells, two radii if not given. No rows give no trapezoids; equal segments count once.
    """
    if not radius > 0:
        raise ValueError("a buffer needs a positive radius")
    size = size or 2 * radius
    keys = [f"k{i}" for i in range(len(by))]
    where = ["qx", "qy"]
    named = lines.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(coords).alias("p"))
    own = let(F.col("p"), lambda p: F.when(F.size(p) == 1, F.array(F.struct(F.get(p, F.lit(0)).alias("a"), F.get(p, F.lit(0)).alias("b")))).otherwise(line.segments(p)))
    segments = named.where(F.size("p") > 0).select(*keys, F.explode(own).alias("s")).select(*keys, *[(F.col(f"s.{e}.{c}").cast("double") + 0.0).alias(f"{e}{c}") for e in "ab" for c in "xy"])
    finite = segments.where(F.coalesce(F.abs("ax") + F.abs("ay") + F.abs("bx") + F.abs("by") < F.lit(float("inf")), F.lit(False)))
    turned = (F.col("ax") > F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") > F.col("by")))
    ends = [F.when(turned, F.col(b)).otherwise(F.col(a)).alias(f"p{k}") for k, (a, b) in enumerate((("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay")))]
    capsules = finite.select(*keys, *ends).distinct()
    place = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    cells = F.explode(passed_cells(F.array(place("p0", "p1"), place("p2", "p3")), radius, size)).alias("c")
    shape = [f"p{k}" for k in range(6)]
    state = capsules.select(*keys, cells, F.lit(True).alias("capsule"), *shape[:4], *[F.lit(0.0).alias(c) for c in shape[4:]]).select(*keys, F.col("c.cx").alias("qx"), F.col("c.cy").alias("qy"), "capsule", *shape)
    kinds = [f"{k} {named.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*kinds, "qx long, qy long, n long", *[f"{c} double" for c in SIDES]])
    masks: list[DataFrame] = []
    for level in range(DEEPEST + 1):
        state = cut(state)
        side = size / 2**level
        # null keys are keys, too: counts meet their rows by equality that knows null
        counts = state.groupBy(*keys, *where).agg(F.count(F.lit(1)).alias("n")).select(*[F.col(c).alias(f"__{c}") for c in (*keys, *where)], "n")
        met = F.lit(True)
        for c in (*keys, *where):
            met = met & F.col(c).eqNullSafe(F.col(f"__{c}"))
        block = F.pmod(F.xxhash64(*shape), F.ceil(F.col("n") / FULL)) if level < DEEPEST else F.lit(0)
        blocks = state.join(counts, met).groupBy(*keys, *where, block.alias("block"), "n").agg(F.collect_list(F.struct("capsule", *shape)).alias("shapes"))
        parts = cut(blocks.drop("block").mapInPandas(_dissolved(by, side, radius, arc), schema))
        last = level == DEEPEST
        masks.append(parts if last else parts.where(F.col("n") <= FULL))
        rest = parts.where(F.col("n") > FULL)
        if last or rest.isEmpty():
            break
        half = side / 2
        quarters = F.explode(F.array(*[F.struct((2 * F.col("qx") + i).alias("cx"), (2 * F.col("qy") + j).alias("cy")) for i in (0, 1) for j in (0, 1)]))
        dealt = rest.select(*keys, quarters.alias("c"), *SIDES)
        left, floor = F.col("c.cx") * half, F.col("c.cy") * half
        touches = (F.col("x0") < left + half) & (F.col("x1") > left) & (F.least("lo0", "lo1") < floor + half) & (F.greatest("hi0", "hi1") > floor)
        state = dealt.where(touches).select(*keys, F.col("c.cx").alias("qx"), F.col("c.cy").alias("qy"), F.lit(False).alias("capsule"), *[F.col(c).alias(p) for c, p in zip(SIDES, shape, strict=True)])
    out = masks[0]
    for m in masks[1:]:
        out = out.unionByName(m)
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], *SIDES)


def trapezoid_area() -> Column:
    """The area of a mask's row."""
    return (F.col("x1") - F.col("x0")) * ((F.col("hi0") - F.col("lo0")) + (F.col("hi1") - F.col("lo1"))) / 2


def trapezoid_ring() -> Column:
    """A mask's row as a closed ring of places, against the clock."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return F.array(corner("x0", "lo0"), corner("x1", "lo1"), corner("x1", "hi1"), corner("x0", "hi0"), corner("x0", "lo0"))


def in_mask(points: DataFrame, mask: DataFrame, size: float, by: Sequence[str] = ()) -> DataFrame:
    """The rows of ``points (..., x, y)`` that lie in the mask (in that of the same ``by``), its border included, each once.

    Cells of side ``size`` bring them together; about the side that the mask was made with is best.
    """
    box = F.struct(F.col("x0"), F.least("lo0", "lo1").alias("y0"), F.col("x1"), F.greatest("hi0", "hi1").alias("y1"))
    m = mask.withColumn("__cell", F.explode(covering_cells(box, size)))
    p = points.withColumn("__cell", cell(F.col("x"), F.col("y"), size))
    t = (p["x"] - m["x0"]) / (m["x1"] - m["x0"])
    within = (p["__cell"] == m["__cell"]) & p["x"].between(m["x0"], m["x1"]) & (p["y"] >= m["lo0"] + t * (m["lo1"] - m["lo0"])) & (p["y"] <= m["hi0"] + t * (m["hi1"] - m["hi0"]))
    for c in by:
        within = within & p[c].eqNullSafe(m[c])
    return p.join(m, within, "left_semi").drop("__cell")


def metric_mask(lines: DataFrame, metres: float, by: Sequence[str] = (), arc: int = ARC, coords: str = "coords") -> DataFrame:
    """As ``buffer_mask``, of a radius in the metres of the web's Mercator projection: lines and mask in degrees, the buffers drawn on the projected plane."""
    forth = F.transform(coords, lambda p: F.struct((SPHERE_M * F.radians(p["x"])).alias("x"), (SPHERE_M * F.log(F.tan(F.lit(math.pi / 4) + F.radians(p["y"]) / 2))).alias("y")))
    mask = buffer_mask(lines.select(*by, forth.alias(coords)), metres, by, None, arc, coords)
    lat = lambda c: F.degrees(2 * F.atan(F.exp(F.col(c) / SPHERE_M)) - math.pi / 2).alias(c)
    return mask.select(*by, *[F.degrees(F.col(c) / SPHERE_M).alias(c) for c in SIDES[:2]], *[lat(c) for c in SIDES[2:]])
