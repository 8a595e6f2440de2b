"""Interval operators: union, coverage, run insertion, overlap splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def union_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Disjoint intervals covering the same ground; touching ones merge. Gaps and islands by a running maximum."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.when(F.col(start) <= reach, 0).otherwise(1)).withColumn("__island", F.sum("__new").over(Window.partitionBy(*keys).orderBy(start, end, F.col("__new").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def coverage(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Total length of the union of a group's intervals."""
    return union_intervals(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("percentage"))


def step_interval(step: Column, breakpoint: Column) -> Column:
    """Covered part of an edge: all of it (step 1), from the breakpoint on (0), up to it (-1)."""
    return F.struct(F.when(step == 0, breakpoint).otherwise(F.lit(0.0)).alias("start"), F.when(step == -1, breakpoint).otherwise(F.lit(1.0)).alias("end"))


def path_coverage(path: DataFrame, edge: str = "eid", threshold: float = 0.6) -> DataFrame:
    """``eid, percentage, visited`` of match results ``eid, step, breakpoint``.

    A path that starts and ends on one edge, just a row of step 0 and one of step -1, covers what lies between its breakpoints.
    """
    w = Window.partitionBy(edge)
    alone = (F.count(F.lit(1)).over(w) == 2) & (F.sum(F.when(F.col("step") == 0, 1).otherwise(0)).over(w) == 1) & (F.sum(F.when(F.col("step") == -1, 1).otherwise(0)).over(w) == 1)
    ends = path.withColumns({"__two": alone, "__a": F.max(F.when(F.col("step") == 0, F.col("breakpoint"))).over(w), "__b": F.max(F.when(F.col("step") == -1, F.col("breakpoint"))).over(w)})
    part = step_interval(F.col("step"), F.col("breakpoint"))
    rows = ends.select(
        edge,
        F.when(F.col("__two"), F.least("__a", "__b")).otherwise(part["start"]).alias("start"),
        F.when(F.col("__two"), F.greatest("__a", "__b")).otherwise(part["end"]).alias("end"),
    )
    return coverage(rows, [edge], "start", "end").withColumn("visited", F.col("percentage") > threshold)


def insert_interval(items: Column, new: Column) -> Column:
    """Insert ``struct<start,end,value>`` into an ordered list: what it overlaps is absorbed, the span grows and may reach further items, and the value is
    that of the last absorbed one."""
    none = F.filter(items, lambda x: F.lit(False))
    zero = F.struct(none.alias("before"), new.alias("new"), none.alias("after"))

    def step(acc: Column, x: Column) -> Column:
        left, right = x["end"] < acc["new"]["start"], x["start"] > acc["new"]["end"]
        grown = F.struct(F.least(x["start"], acc["new"]["start"]).alias("start"), F.greatest(x["end"], acc["new"]["end"]).alias("end"), x["value"].alias("value"))
        return F.struct(
            F.when(left, F.concat(acc["before"], F.array(x))).otherwise(acc["before"]).alias("before"),
            F.when(left | right, acc["new"]).otherwise(grown).alias("new"),
            F.when(~left & right, F.concat(acc["after"], F.array(x))).otherwise(acc["after"]).alias("after"),
        )

    return F.aggregate(items, zero, step, lambda acc: F.concat(acc["before"], F.array(acc["new"]), acc["after"]))


def split_overlaps(changes: DataFrame, existing: DataFrame, key: str, bucket: float | None = None) -> DataFrame:
    """Parts of change intervals by existing intervals of the same key: ``key, start, end, value, base``.

    Both tables: ``key, start, end``; changes have ``value``, existing ones ``base``. With ``bucket`` the range join also equi-joins on
    buckets that the intervals cover, so that a key with many intervals is shared by many tasks.
    """
    a, b = changes.select(key, F.col("start").alias("a0"), F.col("end").alias("a1"), "value"), existing.select(key, F.col("start").alias("b0"), F.col("end").alias("b1"), "base")
    on = [key]
    if bucket:
        cover = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket)))
        a, b, on = a.withColumn("__c", cover("a0", "a1")), b.withColumn("__c", cover("b0", "b1")), [key, "__c"]
    joined = a.join(b, on).where((F.col("a0") < F.col("b1")) & (F.col("b0") < F.col("a1")))
    if bucket:  # a pair that shares several buckets counts in the first one
        joined = joined.where(F.col("__c") == F.floor(F.greatest("a0", "b0") / bucket))
    return joined.select(key, F.greatest("a0", "b0").alias("start"), F.least("a1", "b1").alias("end"), "value", "base")
