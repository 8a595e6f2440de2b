"""Lane numbers of road edges from matched observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import aggregates, filters, windows
from .graph import cheapest_below, cut


def lanes_by_edge(points: DataFrame, order: list, k: float = 2.0) -> DataFrame:
    """``eid, lane_num`` of edges with observations: outliers filtered, then the lane mode."""
    kept = windows.lane_filter(points, ["eid"], order, "lane_num", k).where(~F.col("outlier"))
    return aggregates.lane_mode(kept, ["eid"], "lane_num")


def infer_lanes(points: DataFrame, edges: DataFrame, order: list, road_type: str = "road_type") -> DataFrame:
    """Lane number of every edge (null without evidence), links corrected."""
    found = lanes_by_edge(points, order)
    return edges.join(found, "eid", "left").withColumn("lane_num", filters.link_rule(F.col(road_type), F.col("lane_num")))


def edge_neighbours(edges: DataFrame) -> DataFrame:
    """Edge before and after every edge ``(eid, rid, ord, s, e, road_type)``: ``eid, prev_eid, next_eid``.

    In the same way by order; else the only edge that meets at the node; else the only one of its class; else null.
    """
    w = Window.partitionBy("rid").orderBy("ord")
    own = edges.select("eid", "s", "e", "road_type", F.lag("eid").over(w).alias("prev_own"), F.lead("eid").over(w).alias("next_own"))

    def meet(node: str, other: str, name: str) -> DataFrame:
        a = own.where(F.col("prev_own" if node == "s" else "next_own").isNull()).select("eid", F.col(node).alias("node"), "road_type")
        b = edges.select(F.col("eid").alias("o"), F.col(other).alias("node"), F.col("road_type").alias("o_type"))
        same = F.when(F.col("road_type") == F.col("o_type"), F.col("o"))
        m = a.join(b, "node").where("eid <> o").groupBy("eid").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("one"), F.count(same).alias("ns"), F.min(same).alias("same"))
        return m.select("eid", F.when(F.col("n") == 1, F.col("one")).when(F.col("ns") == 1, F.col("same")).alias(name))

    out = own.join(meet("s", "e", "prev_met"), "eid", "left").join(meet("e", "s", "next_met"), "eid", "left")
    return out.select("eid", F.coalesce("prev_own", "prev_met").alias("prev_eid"), F.coalesce("next_own", "next_met").alias("next_eid"))


def infer_missing(targets: DataFrame, neighbours: DataFrame, points: DataFrame, lanes: DataFrame) -> DataFrame:
    """Lanes of edges without a number: mode of the last two observations of the edge before, its own, and the first of the edge
    after; else the lanes of the edge before.

    ``targets (eid)``, ``points (eid, ofs, tie, lane_num)``, ``lanes (eid, lane_num)``.
    """
    n = targets.join(neighbours, "eid", "left")
    first = Window.partitionBy("eid").orderBy("ofs", "tie")
    last = Window.partitionBy("eid").orderBy(F.col("ofs").desc(), F.col("tie").desc())
    tail = points.withColumn("k", F.row_number().over(last)).where("k <= 2").select(F.col("eid").alias("prev_eid"), "lane_num")
    head = points.withColumn("k", F.row_number().over(first)).where("k <= 1").select(F.col("eid").alias("next_eid"), "lane_num")
    seen = (
        n.join(tail, "prev_eid").select("eid", "lane_num")
        .unionByName(n.join(points.select("eid", "lane_num"), "eid").select("eid", "lane_num"))
        .unionByName(n.join(head, "next_eid").select("eid", "lane_num"))
    )
    mode = aggregates.lane_mode(seen, ["eid"], "lane_num").withColumnRenamed("lane_num", "by_mode")
    before = lanes.select(F.col("eid").alias("prev_eid"), F.col("lane_num").alias("by_prev"))
    return n.join(mode, "eid", "left").join(before, "prev_eid", "left").select("eid", F.coalesce("by_mode", "by_prev").alias("lane_num"))


def edge_types(edges: DataFrame, signals: DataFrame, limit: float = 30.0) -> DataFrame:
    """``eid, edge_type``: 3 ends at a signal, 4 starts at one; else, of edges shorter than ``limit``, 1 whose cheapest way back has one hop and costs
    less than twice the limit, 2 whose cheapest way back has three hops and costs less than four times the limit; else 0.

    ``edges (eid, src, dst, length)``, ``signals (node)``. Ways of one and three hops are joined from both ends, only for the edges in question; a way of
    another number of hops is looked for below their cost only. Of ways of one cost that with fewer hops counts.
    """
    s = signals.select("node").distinct()
    marked = edges.join(s.select(F.col("node").alias("dst"), F.lit(True).alias("at_end")), "dst", "left").join(s.select(F.col("node").alias("src"), F.lit(True).alias("at_start")), "src", "left")
    short = marked.where((F.col("length") < limit) & F.col("at_end").isNull() & F.col("at_start").isNull())
    pairs = cut(short.select(F.col("dst").alias("root"), F.col("src").alias("goal")).distinct())
    e = cut(edges.where(F.col("length") < 4 * limit).groupBy("src", "dst").agg(F.min("length").alias("length")))
    hop = lambda a, b, w: e.select(F.col("src").alias(a), F.col("dst").alias(b), F.col("length").alias(w))
    one = pairs.join(hop("root", "goal", "c1"), ["root", "goal"])
    two = hop("root", "m", "w1").join(pairs.select("root").distinct(), "root", "left_semi").join(hop("m", "n", "w2"), "m").where(F.col("w1") + F.col("w2") < 4 * limit)
    two = cut(two.groupBy("root", "n").agg(F.min(F.col("w1") + F.col("w2")).alias("c2")))
    three = pairs.join(hop("n", "goal", "w3"), "goal").join(two, ["root", "n"]).groupBy("root", "goal").agg(F.min(F.col("c2") + F.col("w3")).alias("c3"))
    ways = pairs.join(one, ["root", "goal"], "left").join(two.withColumnRenamed("n", "goal"), ["root", "goal"], "left").join(three, ["root", "goal"], "left")
    never = F.lit(float("inf"))
    c1, c2, c3 = (F.coalesce(c, never) for c in ("c1", "c2", "c3"))
    kind = F.when((c1 <= c2) & (c1 <= c3) & (c1 < 2 * limit), 1).when((c3 < c1) & (c3 < c2) & (c3 < 4 * limit), 2)
    found = cut(ways.select("root", "goal", kind.alias("kind"), F.least(c1, c3).alias("bound")).where("kind is not null"))
    typed = found.join(cheapest_below(edges, found), ["root", "goal"], "left_anti") if not found.isEmpty() else found
    out = marked.join(typed.select(F.col("root").alias("dst"), F.col("goal").alias("src"), "kind"), ["src", "dst"], "left")
    return out.select("eid", F.when(F.col("at_end"), 3).when(F.col("at_start"), 4).when(F.col("length") < limit, F.coalesce("kind", F.lit(0))).otherwise(0).alias("edge_type"))


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """Trajectories per edge by mean distance, the best road of each: ``eid, rank, root, rid, distance``.

    ``candidates (eid, root, rid, distance)``.
    """
    best = candidates.groupBy("eid", "root").agg(F.min(F.struct("distance", "rid")).alias("b"), F.avg("distance").alias("mean"))
    w = Window.partitionBy("eid").orderBy("mean", "root")
    return best.withColumn("rank", F.row_number().over(w)).select("eid", "rank", "root", F.col("b.rid").alias("rid"), F.col("mean").alias("distance"))


def greedy_coverage(ranked: DataFrame, matched: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Trajectories taken per edge in order of rank until its coverage exceeds the threshold: ``eid, rank, root, coverage``.

    ``ranked (eid, rank, root)``, ``matched (eid, root, start, end)``: stretches each covers. Coverage of what was taken
    grows with the rank, so the stop is a window over running unions: a trajectory is taken while the ones before it cover too little.
    """
    from .intervals import coverage

    rows = ranked.select("eid", "rank", "root").join(matched, ["eid", "root"])
    top = ranked.select("eid", F.col("rank").alias("upto"))
    upto = rows.join(top, "eid").where("rank <= upto")
    covered = coverage(upto.select("eid", "upto", "start", "end"), ["eid", "upto"], "start", "end").withColumnRenamed("upto", "rank")
    w = Window.partitionBy("eid").orderBy("rank")
    out = ranked.select("eid", "rank", "root").join(covered, ["eid", "rank"], "left").withColumn("c", F.coalesce("percentage", F.lit(0.0)))
    return out.withColumn("before", F.coalesce(F.lag("c").over(w), F.lit(0.0))).where(F.col("before") <= threshold).select("eid", "rank", "root", F.col("c").alias("coverage"))
