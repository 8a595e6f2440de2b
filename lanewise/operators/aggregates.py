"""Aggregations of lane observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def value_modes(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value of each group, the smallest on ties, and its frequency: ``keys, mode, freq``.

    Counts are combined before the shuffle; the pick is a maximum over (frequency, -value), not a window.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*keys).agg(F.max(F.struct(F.col("n").alias("n"), (-F.col(value)).alias("v"))).alias("b"))
    return best.select(*keys, (-F.col("b.v")).alias("mode"), F.col("b.n").alias("freq"))


def lane_mode(df: DataFrame, keys: list[str], value: str, offset: int = 1) -> DataFrame:
    """Lanes of a group from observed lane lines: mode - ``offset``; null if the mode occurs once or is 0."""
    m = value_modes(df, keys, value)
    return m.select(*keys, F.when((F.col("freq") > 1) & (F.col("mode") != 0), F.col("mode") - offset).alias("lane_num"))


def road_lanes(df: DataFrame, keys: list[str], value: str, offset: int = 1) -> DataFrame:
    """Smallest mode - ``offset``, whatever its frequency."""
    return value_modes(df, keys, value).select(*keys, (F.col("mode") - offset).alias("lane_num"))


def within_sigmas(df: DataFrame, keys: list[str], value: str, k: float) -> DataFrame:
    """Rows inside the open interval mean +- k sample deviations; a group without a deviation keeps its rows."""
    w = Window.partitionBy(*keys)
    mean, dev = F.avg(value).over(w), F.stddev_samp(value).over(w)
    out = df.withColumn("__m", mean).withColumn("__s", dev)
    inside = F.col("__s").isNull() | ((F.col(value) > F.col("__m") - k * F.col("__s")) & (F.col(value) < F.col("__m") + k * F.col("__s")))
    return out.where(inside).drop("__m", "__s")


def median_int(value: str) -> Column:
    return F.percentile(F.col(value), F.lit(0.5)).cast("int")


def group_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """Values as sorted text, sample deviation (-1 without one) and count."""
    return df.groupBy(key).agg(
        F.array_join(F.sort_array(F.collect_set(value)), ",").alias("vals"),
        F.coalesce(F.round(F.stddev_samp(value), 6), F.lit(-1.0)).alias("dev"),
        F.count(F.lit(1)).alias("n"),
    )


def ordered_list(df: DataFrame, keys: list[str], order: list[str], value: str, separator: str = ",") -> DataFrame:
    """Values of a group in order, as text."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(items, lambda x: x["__v"].cast("string")), separator).alias("items"))


def degrees(edges: DataFrame, start: str = "src", end: str = "dst") -> DataFrame:
    """In- and out-degree of every node, counted in one pass over the edges' ends."""
    ends = edges.select(F.inline(F.array(F.struct(F.col(start).alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col(end).alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    return ends.groupBy("node").agg(F.sum("i").alias("indegree"), F.sum("o").alias("outdegree"))


def majority_class(nodes_classes: DataFrame, node: str, label: str, ignore: tuple = ("connector",), default: str = "") -> DataFrame:
    """Most frequent class of each node, the alphabetically first on ties; ignored classes count for nothing."""
    counts = nodes_classes.groupBy(node, label).agg(F.sum(F.when(F.col(label).isin(*ignore), 0).otherwise(1)).alias("n"))
    best = counts.groupBy(node).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(label).alias("l"))).alias("b"))
    return best.select(node, F.when(F.col("b.n") == 0, F.lit(default)).otherwise(F.col("b.l")).alias("activity"))
