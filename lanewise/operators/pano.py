"""Street-view observations: nested records, heading repair, topology and trajectories."""

from __future__ import annotations

from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lanewise.functions import geo

PANO = "struct<PID:string,Order:int,DIR:int,X:bigint,Y:bigint,Type:string>"
ROADS = f"array<struct<ID:string,IsCurrent:int,Panos:array<{PANO}>>>"
LINKS = "array<struct<PID:string,RID:string,X:bigint,Y:bigint,DIR:int>>"


def parse_nested(text: Column, schema: str) -> Column:
    """Python-style nested text to a nested value: None, True and False become JSON first; nothing is evaluated."""
    json = text
    for python, plain in (("None", "null"), ("True", "true"), ("False", "false")):
        json = F.regexp_replace(json, rf"(?<=[\[,:\s]){python}(?=[\],}}\s])", plain)
    return F.from_json(json, schema, {"allowSingleQuotes": "true"})


def current_road(roads: Column) -> Column:
    """The road the record stands on."""
    return F.get(F.filter(roads, lambda r: r["IsCurrent"] == 1), F.lit(0))


def by_order(panos: Column) -> Column:
    """Panos in their order."""
    return F.array_sort(panos, lambda a, b: F.when(a["Order"] < b["Order"], -1).when(a["Order"] > b["Order"], 1).otherwise(0))


def explode_panos(nodes: DataFrame) -> DataFrame:
    """Panos of every node's current road, once each: ``PID, RID, Order, DIR, X, Y, Type``."""
    road = nodes.select(current_road(F.col("Roads")).alias("road"))
    return road.select(F.col("road.ID").alias("RID"), F.inline("road.Panos")).select("PID", "RID", "Order", "DIR", "X", "Y", "Type").distinct()


def road_table(nodes: DataFrame) -> DataFrame:
    """One row per road: first and last pano, line of all in order; a single pano gives its point twice: ``ID, src, dst, n, line``."""
    panos = explode_panos(nodes)
    grouped = panos.groupBy("RID").agg(by_order(F.collect_list(F.struct("PID", "Order", "DIR", "X", "Y", "Type"))).alias("p"))
    points = F.transform("p", lambda x: F.struct(x["X"].cast("double").alias("x"), x["Y"].cast("double").alias("y")))
    return grouped.select(F.col("RID").alias("ID"), F.get("p", F.lit(0))["PID"].alias("src"), F.element_at("p", -1)["PID"].alias("dst"), F.size("p").alias("n"), F.when(F.size("p") == 1, F.concat(points, points)).otherwise(points).alias("line"))


def road_and_links(nodes: DataFrame) -> DataFrame:
    """Every record as edges: its road from first to last pano, and a link to each neighbour: ``rid, src, dst, link``."""
    r = current_road(F.col("Roads"))
    p = by_order(r["Panos"])
    road = F.struct(r["ID"].alias("rid"), F.get(p, F.lit(0))["PID"].alias("src"), F.element_at(p, -1)["PID"].alias("dst"), F.lit(False).alias("link"))
    links = F.transform(F.coalesce(F.col("Links"), F.array().cast(LINKS)), lambda x: F.struct(x["RID"].alias("rid"), F.col("ID").alias("src"), x["PID"].alias("dst"), F.lit(True).alias("link")))
    return nodes.select(F.inline(F.concat(F.array(road), links))).distinct()


def repair_headings(panos: DataFrame, keys: DataFrame, least: float = 0.15) -> DataFrame:
    """Heading of every pano, and roads driven against their order turned round.

    ``panos (PID, RID, Order, DIR)``, ``keys (PID, MoveDir)`` of key panos. A road's last pano takes its key heading, else -1; the one of order 0, if it is
    not the last, its key heading, else 0; the others have none yet. On roads of several panos ``dir_sim`` of the one of order 0 is cos of (its heading - DIR) + 1;
    below ``least`` the road's order is reversed, and its panos without a heading, or with -1, take the opposite of DIR. What has no heading then takes DIR.
    """
    w = Window.partitionBy("RID")
    p = panos.join(keys.select("PID", F.col("MoveDir").alias("__key")), "PID", "left")
    p = p.withColumns({"__n": F.count(F.lit(1)).over(w), "__l": F.row_number().over(w.orderBy(F.col("Order").desc())) == 1})
    first = F.col("Order") == 0
    sim = F.when(first & (F.col("__n") > 1), F.cos(geo.azimuth_gap(F.coalesce("__key", F.lit(0.0)), "DIR")) + 1)
    move = F.when(F.col("__l"), F.coalesce("__key", F.lit(-1.0))).when(first, F.coalesce("__key", F.lit(0.0)))
    p = p.withColumns({"dir_sim": sim, "__move": move}).withColumn("revert", F.coalesce(F.min("dir_sim").over(w) < least, F.lit(False)))
    order = F.when(F.col("revert"), F.max("Order").over(w) - F.col("Order")).otherwise(F.col("Order"))
    turned = F.when(F.col("revert") & ~F.coalesce(F.col("__move") >= 0, F.lit(False)), geo.opposite("DIR")).otherwise(F.col("__move"))
    return p.select("PID", "RID", order.cast("int").alias("Order"), "DIR", F.coalesce(turned, F.col("DIR")).cast("int").alias("MoveDir"), "dir_sim", "revert")


def topology(edges: DataFrame, panos: DataFrame, sigma: float = 20.0, forward: bool = True) -> DataFrame:
    """Roads and links between panos with their similarity: ``edges (rid, src, dst, link, dist)``, ``panos (pid, dir, x, y)``.

    ``dist_prob`` is the density of the edge's length; its square root, normalised by the largest of all edges that start together (end
    together without ``forward``), is ``dist_prob_std``; ``turn_sim`` compares the heading at the start (at the end) with the azimuth from start to end. The
    similarity is cos_sim^2 x dist_prob_std x turn_sim, with the cosine of the two headings; a road's is 1.
    """
    at = lambda end, k: panos.select(F.col("pid").alias(end), F.col("dir").alias(f"dir_{k}"), F.col("x").alias(f"__x{k}"), F.col("y").alias(f"__y{k}"))
    both = edges.join(at("src", 0), "src").join(at("dst", 1), "dst").withColumn("dist_prob", geo.observation_probability("dist", sigma))
    std = F.when(F.col("link"), F.sqrt(F.col("dist_prob") / F.max("dist_prob").over(Window.partitionBy("src" if forward else "dst")))).otherwise(F.lit(1.0))
    turn = geo.turn_similarity("dir_0" if forward else "dir_1", geo.azimuth("__x0", "__y0", "__x1", "__y1"))
    out = both.withColumns({"dist_prob_std": std, "turn_sim": turn, "cos_sim": geo.turn_similarity("dir_0", "dir_1")}).drop("__x0", "__y0", "__x1", "__y1")
    return out.withColumn("similarity", F.when(F.col("link"), geo.edge_similarity("cos_sim", "dist_prob_std", "turn_sim")).otherwise(F.lit(1.0)))


def _chains(threshold: float):
    """Chains of one component: seeds in table order, greedy best neighbour forwards and backwards, visited roads skipped."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rid", "src", "dst"])
        ahead: dict = {}
        behind: dict = {}
        pairs: dict = {}
        pair = lambda r: pairs.setdefault((r.src, r.dst) if r.src < r.dst else (r.dst, r.src), len(pairs))
        for r in pdf.sort_values(["link", "similarity", "rid"], ascending=[True, False, True]).itertuples():
            if not r.similarity < threshold:
                ahead.setdefault(r.src, []).append((r.dst, r.rid, r.link, pair(r)))
        for r in pdf.sort_values(["link", "similarity_back", "rid"], ascending=[True, False, True]).itertuples():
            if not r.similarity_back < threshold:
                behind.setdefault(r.dst, []).append((r.src, r.rid, r.link, pair(r)))
        seen: set = set()
        taken, walks = [0] * len(pairs), count(1)
        roads = [{rid for near in table.values() for _, rid, link, _ in near if not link} for table in (ahead, behind)]

        def see(rid) -> None:
            seen.add(rid)
            for left in roads:
                left.discard(rid)

        def walk(pid, table, left: set) -> list:
            # what a walk passes over at a node it never takes later: back there it goes on behind that, and does not meet the same neighbours again;
            # once all roads that it could take are seen, it only follows links, which leave no trace
            out, rest, number = [], {}, next(walks)
            while left:
                near = rest.get(pid)
                if near is None:
                    near = rest[pid] = iter(table.get(pid, ()))
                for other, rid, link, own in near:
                    if taken[own] == number or (not link and rid in seen):
                        continue
                    taken[own] = number
                    if not link:
                        see(rid)
                        out.append(rid)
                    pid = other
                    break
                else:
                    break
            return out

        rows = []
        for r in pdf[~pdf.link & (pdf.src != pdf.dst)].drop_duplicates("rid").itertuples():
            if r.rid in seen:
                continue
            see(r.rid)
            chain = [*reversed(walk(r.src, behind, roads[1])), r.rid, *walk(r.dst, ahead, roads[0])]
            rows += [(chain[0], k, rid) for k, rid in enumerate(chain)]
        return pd.DataFrame(rows, columns=["root", "seq", "rid"])

    return run


def trajectories(topo: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``root, seq, rid``: roads chained greedily, component by component, as what is visited in one cannot be met in another.

    ``topo (rid, src, dst, link, similarity)``, ``labels (node, component)`` of the panos' weak components. Chains go backwards by ``similarity_back``, if there
    is such a column, else by ``similarity``.
    """
    if "similarity_back" not in topo.columns:
        topo = topo.withColumn("similarity_back", F.col("similarity"))
    keyed = topo.join(labels.select(F.col("node").alias("src"), "component"), "src")
    kind = topo.schema["rid"].dataType.simpleString()
    return keyed.select("component", "rid", "src", "dst", "link", "similarity", "similarity_back").groupBy("component").applyInPandas(_chains(threshold), f"root {kind}, seq long, rid {kind}")


def trajectory_table(trajs: DataFrame, roads: DataFrame) -> DataFrame:
    """``root, rids, n_roads, n_panos, line`` of every trajectory; equal road lists once; longest first is the reader's sort.

    ``roads (ID, n, line)``.
    """
    rows = trajs.join(roads.select(F.col("ID").alias("rid"), "n", "line"), "rid")
    items = F.array_sort(F.collect_list(F.struct("seq", "rid", "n", "line")))
    grouped = rows.groupBy("root").agg(items.alias("i"))
    table = grouped.select(
        "root", F.array_join(F.transform("i", lambda x: x["rid"].cast("string")), ";").alias("rids"), F.size("i").alias("n_roads"),
        F.aggregate("i", F.lit(0).cast("long"), lambda acc, x: acc + x["n"]).alias("n_panos"), F.flatten(F.transform("i", lambda x: x["line"])).alias("line"),
    )
    return table.withColumn("__rn", F.row_number().over(Window.partitionBy("rids").orderBy("root"))).where("__rn = 1").drop("__rn")


def expand_roads(matched: DataFrame, panos: DataFrame, visited: DataFrame) -> DataFrame:
    """Panos of matched roads by link, group and index; a road and a pano count where they come first, visited panos not at all.

    ``matched (link, grp, idx, rid)``, ``panos (rid, pid, ord)``, ``visited (pid)``.
    """
    first = matched.withColumn("__rn", F.row_number().over(Window.partitionBy("rid").orderBy("link", "grp", "idx"))).where("__rn = 1").drop("__rn")
    rows = first.join(panos, "rid")
    once = rows.withColumn("__rn", F.row_number().over(Window.partitionBy("pid").orderBy("link", "grp", "idx", "ord"))).where("__rn = 1").drop("__rn")
    return once.join(visited.select("pid").distinct(), "pid", "left_anti").select("link", "grp", "idx", "rid", "pid", "ord")


def predictions_along(way: DataFrame, panos: DataFrame, memo: DataFrame, every: int = 3) -> DataFrame:
    """Predictions along a way: roads in order of appearance, panos thinned, memo joined on (pid, dir).

    ``way (seq, rid)``, ``panos (rid, pid, ord, dir)``, ``memo (pid, dir, lane_num)``.
    """
    roads = way.groupBy("rid").agg(F.min("seq").alias("road_seq"))
    n = F.count(F.lit(1)).over(Window.partitionBy("rid"))
    thinned = panos.withColumn("__n", n).where((F.col("__n") <= every) | (F.col("ord") % every == 1)).drop("__n")
    return roads.join(thinned, "rid").join(memo, ["pid", "dir"]).select("road_seq", "rid", "pid", "ord", "dir", "lane_num")


def look_up(wanted: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of the wanted panos from the landed table, and those still to be fetched: ``wanted (PID)``."""
    return wanted.select("PID").distinct().join(stored, F.col("PID") == F.col("ID")).drop("PID"), wanted.select("PID").distinct().join(stored.select(F.col("ID").alias("PID")), "PID", "left_anti")


def key_panos(nodes: DataFrame) -> DataFrame:
    """First and last pano of every record's current road: the panos a crawl goes on with."""
    p = by_order(current_road(F.col("Roads"))["Panos"])
    return nodes.select(F.explode(F.array_distinct(F.array(F.get(p, F.lit(0))["PID"], F.element_at(p, -1)["PID"]))).alias("PID")).where("PID is not null").distinct()


def trajectory_overlap(pids: DataFrame, first: str, second: str) -> DataFrame:
    """Panos and edges that two trajectories share: ``eid, shared, only_first, only_second``.

    ``pids (eid, root, pid)``.
    """
    side = pids.where(F.col("root").isin(first, second)).groupBy("eid", "pid").agg(F.max((F.col("root") == first).cast("int")).alias("a"), F.max((F.col("root") == second).cast("int")).alias("b"))
    return side.groupBy("eid").agg(F.sum(F.col("a") * F.col("b")).alias("shared"), F.sum(F.col("a") * (1 - F.col("b"))).alias("only_first"), F.sum(F.col("b") * (1 - F.col("a"))).alias("only_second"))
