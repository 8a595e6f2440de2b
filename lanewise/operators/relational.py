"""Joins, set operations and table maintenance in the shapes road tables need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in ``order``, which must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def top_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str | None = None) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k)
    return out.withColumnRenamed("__rn", rank) if rank else out.drop("__rn")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows whose key is not new, and the new rows; columns missing on one side are null."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(stored: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return stored.join(keys, on, "left_anti")


def insert_absent(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows, and the new rows whose key is absent."""
    return stored.unionByName(new.join(stored.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def left_fill(left: DataFrame, right: DataFrame, on: list[str], fills: dict) -> DataFrame:
    """Left join whose missing values take defaults."""
    return left.join(right, on, "left").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


def full_fill(left: DataFrame, right: DataFrame, on: list[str], fills: dict) -> DataFrame:
    return left.join(right, on, "full").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


def both_ends(edges: DataFrame, nodes: DataFrame, node_key: str, start: str, end: str, values: list[str]) -> DataFrame:
    """Look the two ends of every edge up in one table; values get suffixes _0 and _1."""
    side = lambda k, end_col: nodes.select(F.col(node_key).alias(end_col), *[F.col(v).alias(f"{v}_{k}") for v in values])
    return edges.join(side(0, start), start).join(side(1, end), end)


def known_ends(edges: DataFrame, nodes: DataFrame, node_key: str, start: str, end: str) -> DataFrame:
    """Edges both ends of which exist."""
    for column in (start, end):
        edges = edges.join(nodes.select(F.col(node_key).alias(column)).distinct(), column, "left_semi")
    return edges


def touching(edges: DataFrame, nodes: DataFrame, node_key: str, start: str, end: str) -> DataFrame:
    """Edges one end of which at least is listed: two semi joins, no OR in a join condition."""
    listed = nodes.select(F.col(node_key).alias("__n")).distinct()
    by_start = edges.join(listed, F.col(start) == F.col("__n"), "left_semi")
    by_end = edges.join(listed, F.col(start) == F.col("__n"), "left_anti").join(listed, F.col(end) == F.col("__n"), "left_semi")
    return by_start.unionByName(by_end)


def either_direction(paths: DataFrame, roads: DataFrame, start: str = "src", end: str = "dst") -> DataFrame:
    """Rows of ``roads`` on pairs of ``paths`` in both directions, with ``reversed``."""
    forward = roads.join(paths, [start, end]).withColumn("reversed", F.lit(False))
    swapped = paths.select(F.col(end).alias(start), F.col(start).alias(end))
    return forward.unionByName(roads.join(swapped, [start, end]).withColumn("reversed", F.lit(True)))


def union_tables(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def pivot_counts(df: DataFrame, key: str, column: str, values: list, prefix: str) -> DataFrame:
    """Counts per key and value as columns, and their sum; 0 where there is none. One aggregation, no pivot job."""
    counts = [F.count(F.when(F.col(column) == v, 1)).alias(f"{prefix}{k}") for k, v in enumerate(values)]
    return df.groupBy(key).agg(*counts, F.count(F.lit(1)).alias(f"{prefix}sum"))


def expand_links(starts: DataFrame, connectors: DataFrame, singles: DataFrame) -> DataFrame:
    """Ends reached from ``starts (road, pid)``: by a connector, or by a connector, a road of one point and another connector.

    ``connectors (prev_pid, pid)``; ``singles (rid, pid)``: roads of one point.
    """
    one = starts.join(connectors.withColumnRenamed("pid", "next"), F.col("pid") == F.col("prev_pid")).select("road", "next", F.lit(None).cast("long").alias("via"))
    via = one.join(singles.select(F.col("rid").alias("s_rid"), F.col("pid").alias("s_pid")), F.col("next") == F.col("s_pid")).select("road", "s_pid", "s_rid")
    two = via.join(connectors, F.col("s_pid") == F.col("prev_pid")).select("road", F.col("pid").alias("next"), F.col("s_rid").alias("via"))
    return one.unionByName(two).distinct()


def matches(frame: DataFrame, predicate: str | Column | None) -> DataFrame:
    """Apply a caller's predicate, if any: SQL text or an expression."""
    return frame if predicate is None else frame.where(predicate)
