"""Edits of the traffic-simulation network: sections, lanes, node order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lanewise.constants import METRES_PER_DEGREE
from lanewise.functions.geo import let

from . import intervals, windows


def signed_order(rid: Column, order: Column) -> Column:
    """Sort key of edges along a road: ascending on positive ids, descending on negative ones."""
    return F.when(rid > 0, order).otherwise(-order)


def tune_lanes(edges: DataFrame, medians: DataFrame) -> DataFrame:
    """Lanes of roads set to the observed median, doubled on two-way roads; only positive road ids change.

    ``edges (rid, oneway, lanes)``, ``medians (rid, median)``.
    """
    m = edges.join(medians, "rid", "left")
    new = F.when(F.col("oneway"), F.col("median")).otherwise(F.col("median") * 2)
    return m.withColumn("lanes", F.when((F.col("rid") > 0) & F.col("median").isNotNull(), new).otherwise(F.col("lanes"))).drop("median")


def set_lanes(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lane children of edges, rebuilt for the wanted number: kept indices stay, missing ones copy the last: ``id, idx, speed``.

    ``edges (id, idx, speed)`` one row per lane; ``wanted (id, n)``.
    """
    last = edges.groupBy("id").agg(F.max(F.struct("idx", "speed")).alias("l"))
    have = edges.join(wanted, "id", "left").where(F.col("n").isNull() | (F.col("idx") < F.col("n"))).select("id", "idx", "speed")
    more = last.join(wanted, "id").where(F.col("n") > F.col("l.idx") + 1).select("id", F.explode(F.sequence(F.col("l.idx") + 1, F.col("n") - 1)).alias("idx"), F.col("l.speed").alias("speed"))
    return have.unionByName(more)


def ramp_gain(edges: DataFrame) -> DataFrame:
    """``eid, gain``: lanes beyond the larger sum of lanes that other roads of other types bring in or take away, if positive.

    ``edges (eid, rid, road_type, s, e, lanes)``.
    """
    other = edges.select(F.col("rid").alias("r2"), F.col("road_type").alias("t2"), F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("lanes").alias("l2"))
    differ = (F.col("rid") != F.col("r2")) & (F.col("road_type") != F.col("t2"))
    ins = edges.join(other, (F.col("s") == F.col("e2")) & differ).groupBy("eid").agg(F.sum("l2").alias("i"))
    outs = edges.join(other, (F.col("e") == F.col("s2")) & differ).groupBy("eid").agg(F.sum("l2").alias("o"))
    both = edges.select("eid", "lanes").join(ins, "eid", "left").join(outs, "eid", "left")
    gain = F.col("lanes") - F.greatest(F.coalesce("i", F.lit(0)), F.coalesce("o", F.lit(0)))
    return both.where(F.coalesce("i", "o").isNotNull()).select("eid", gain.alias("gain")).where("gain > 0")


def lane_sections(points: DataFrame, least_m: float = 20.0, deviations: float = 2.0) -> DataFrame:
    """Sections of a road whose lanes differ from its median: ``rid, start, stop, lanes``.

    ``points (rid, pos, lanes)`` in order, with places ``x, y`` in degrees or metres ``at`` along the road. The median is taken as it is, so that at 2.5 both 2 and 3 differ. Runs of one number
    from place to place are sections, those without length are none. Of two or more, those stay whose lane number lies within (not on) so many deviations of
    the numbers' mean; where all have one number none does. Sections of at least ``least_m`` metres are kept; shorter ones are absorbed by what they touch, one after another, or go.
    """
    w = Window.partitionBy("rid")
    differ = points.withColumn("__m", F.percentile(F.col("lanes"), F.lit(0.5)).over(w)).withColumn("v", F.when(F.col("lanes") != F.col("__m"), F.col("lanes")).otherwise(F.lit(0)))
    runs = windows.run_lengths(differ, ["rid"], "pos", "v")
    flat = "at" not in points.columns
    place = (lambda c: F.struct("x", "y").alias(c)) if flat else (lambda c: F.col("at").alias(c))
    ends = runs.join(points.select("rid", F.col("pos").alias("start"), place("a")), ["rid", "start"]).join(points.select("rid", (F.col("pos") + 1).alias("stop"), place("b")), ["rid", "stop"])
    length = F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")) * METRES_PER_DEGREE if flat else F.col("b") - F.col("a")
    long = ends.withColumn("length", length).where("length <> 0")
    spread = long.withColumns({"__n": F.count(F.lit(1)).over(w), "__avg": F.avg("value").over(w), "__std": F.stddev_samp("value").over(w)})
    near = (F.col("value") > F.col("__avg") - deviations * F.col("__std")) & (F.col("value") < F.col("__avg") + deviations * F.col("__std"))
    rows = spread.where((F.col("__n") == 1) | near)
    item = F.struct("start", F.col("stop").alias("end"), F.col("value").alias("value"))
    lists = rows.groupBy("rid").agg(F.array_sort(F.collect_list(F.when(F.col("length") >= least_m, item))).alias("keep"), F.array_sort(F.collect_list(F.when(F.col("length") < least_m, item))).alias("short"))
    grown = F.aggregate("short", F.col("keep"), intervals.insert_interval)
    whole = lists.where(F.size("keep") > 0).select("rid", F.inline(F.filter(grown, lambda x: ~F.array_contains(F.col("short"), x))))
    return whole.select("rid", "start", F.col("end").alias("stop"), F.col("value").alias("lanes"))


def rebuild_ids(sections: DataFrame, used: DataFrame, least_tail: float = 25.0) -> DataFrame:
    """Ids ``rid#order`` for the sections of a split road, orders in use avoided; a last section shorter than ``least_tail`` joins the one before.

    ``sections (rid, seq, start, stop)``, ``used (rid, order)``: ``rid, id, start, stop``.
    """
    orders = used.groupBy("rid").agg(F.collect_set("order").alias("used"))
    rows = sections.join(orders, "rid", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        rid, taken = int(pdf.rid.iloc[0]), set(pdf.used.iloc[0] if pdf.used.iloc[0] is not None else ())
        parts = [[float(a), float(b)] for a, b in zip(pdf.start, pdf.stop, strict=True)]
        if len(parts) > 1 and parts[-1][1] - parts[-1][0] < least_tail:
            tail = parts.pop()
            parts[-1][1] = tail[1]
        ids, k = [], 0
        for _ in parts:
            while k in taken:
                k += 1
            ids.append(f"{rid}#{k}")
            k += 1
        return pd.DataFrame({"rid": rid, "id": ids, "start": [p[0] for p in parts], "stop": [p[1] for p in parts]})

    return rows.groupBy("rid").applyInPandas(run, "rid long, id string, start double, stop double")


def insert_nodes(roads: DataFrame, missing: DataFrame, places: DataFrame) -> DataFrame:
    """Node lists of roads with missing nodes put where they project: between the neighbours whose chord holds their foot.

    ``roads (rid, nodes)``, ``missing (rid, node)``, ``places (node, x, y)``: ``rid, nodes``.
    """
    known = roads.select("rid", F.posexplode("nodes").alias("k", "node")).join(places, "node")
    extra = missing.join(places, "node").select("rid", F.lit(-1).alias("k"), "node", "x", "y")
    item = F.struct("k", "node", "x", "y")
    lists = known.select("rid", "k", "node", "x", "y").unionByName(extra).groupBy("rid").agg(
        F.array_sort(F.collect_list(F.when(F.col("k") >= 0, item))).alias("road"), F.array_sort(F.collect_list(F.when(F.col("k") < 0, item))).alias("extra")
    )

    def foot(p: Column, a: Column, b: Column, i: Column) -> Column:
        """Squared distance of a place to a chord, the chord's number and where its foot lies along it."""
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        n = dx * dx + dy * dy
        t = F.when(n != 0, ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / n).otherwise(F.lit(1.0))
        u = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
        ex, ey = p["x"] - a["x"] - u * dx, p["y"] - a["y"] - u * dy
        return F.struct((ex * ex + ey * ey).alias("d"), i.alias("i"), t.alias("t"))

    def insert(road: Column, p: Column) -> Column:
        feet = F.transform(F.sequence(F.lit(0), F.size(road) - 2), lambda i: foot(p, F.get(road, i), F.get(road, i + 1), i))
        best = F.when(F.size(road) > 1, F.array_min(feet))

        def put(b: Column) -> Column:
            place = F.when(b.isNull(), 1).when((b["i"] == 0) & (b["t"] < 0), 0).when((b["i"] == F.size(road) - 2) & (b["t"] > 1), b["i"] + 2).otherwise(b["i"] + 1)
            return let(place, lambda k: F.concat(F.slice(road, F.lit(1), k), F.array(p), F.slice(road, k + 1, F.size(road))))

        return let(best, put)

    return lists.select("rid", F.transform(F.aggregate("extra", F.col("road"), insert), lambda x: x["node"]).alias("nodes"))


def resolve_cluster(cluster: Column, order: Column) -> Column:
    """Place of a simulator node in an ordered id list: the largest place among the members of a ``cluster_a_b`` id, the place of a plain id, else null."""
    members = F.filter(F.split(F.regexp_replace(cluster, "^cluster_", ""), "_"), lambda x: x.rlike(r"^\d+$"))
    places = F.transform(members, lambda m: F.array_position(order, m.cast("long")))
    return F.nullif(F.array_max(places), F.lit(0)) - 1
