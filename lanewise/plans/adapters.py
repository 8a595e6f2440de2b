"""The driver's tables seen as road data: the same views for Spark and, as common table expressions, for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions import line


class Registry(dict):
    """Queries by name: (callable, oracle SQL or None)."""

    def add(self, sql: str | None = None) -> Callable:
        def keep(f: Callable) -> Callable:
            self[f.__name__] = (f, sql)
            return f

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_map(spark: SparkSession, d: str) -> DataFrame:
    """Observations on edges: eid, rid, pid, ofs (tenths), lane_num (0: none), tie."""
    return table(spark, d, "lineitem").selectExpr("l_orderkey eid", "l_suppkey rid", "l_partkey pid", "l_linenumber ofs", "cast(l_quantity as int) % 6 lane_num", "l_extendedprice tie")


def v_edge(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_orderkey eid", "o_orderpriority road_type", "o_orderstatus name", "o_totalprice dist", "o_custkey rid")


def v_point(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").selectExpr("vec_id id", "113.9D + 0.1D * cast(embedding[0] as double) x", "22.5D + 0.1D * cast(embedding[1] as double) y", "vec_id * 37 % 360 heading")


def v_line(spark: SparkSession, d: str, points: int = 8, shift: int = 0) -> DataFrame:
    """Lines of the first points of each vector, or of those after ``shift`` numbers."""
    v = F.transform(F.slice("embedding", shift + 1, 2 * points), lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), line.from_flat(v, points).alias("coords"))


def v_graph(spark: SparkSession, d: str) -> DataFrame:
    """Directed edges from each user to the next by time: src, dst, length (the least), n."""
    from pyspark.sql import Window

    # days keep the window's partitions bounded; the first event of a day has no edge
    w = Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id")
    e = table(spark, d, "events").select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst"), "value")
    return e.where("dst is not null and src <> dst").groupBy("src", "dst").agg(F.min("value").alias("length"), F.count(F.lit(1)).alias("n"))


def v_track(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("user_id traj", "ts", "event_id", "value v", "event_type kind")


#: Oracle views of the same names.
VIEWS = {
    "v_map": "v_map AS (SELECT l_orderkey AS eid, l_suppkey AS rid, l_partkey AS pid, l_linenumber AS ofs, CAST(trunc(l_quantity) AS INTEGER) % 6 AS lane_num, l_extendedprice AS tie FROM lineitem)",
    "v_edge": "v_edge AS (SELECT o_orderkey AS eid, o_orderpriority AS road_type, o_orderstatus AS name, o_totalprice AS dist, o_custkey AS rid FROM orders)",
    "v_point": "v_point AS (SELECT vec_id AS id, CAST(113.9 AS DOUBLE) + CAST(0.1 AS DOUBLE) * CAST(embedding[1] AS DOUBLE) AS x, CAST(22.5 AS DOUBLE) + CAST(0.1 AS DOUBLE) * CAST(embedding[2] AS DOUBLE) AS y, vec_id * 37 % 360 AS heading FROM embeddings)",
    "v_seg": "v_seg AS (SELECT vec_id AS id, i, CAST(embedding[2 * i - 1] AS DOUBLE) AS x, CAST(embedding[2 * i] AS DOUBLE) AS y FROM embeddings, unnest(generate_series(1, 8)) AS u(i))",
    "v_graph": "v_graph AS (SELECT src, dst, min(value) AS length, count(*) AS n FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS dst, value FROM events) WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst)",
    "v_track": "v_track AS (SELECT user_id AS traj, ts, event_id, value AS v, event_type AS kind FROM events)",
}


def sql(views: str, body: str) -> str:
    """Oracle text: the named views, then the rest of a WITH clause or a SELECT."""
    ctes = ", ".join(VIEWS[v] for v in views.split())
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
