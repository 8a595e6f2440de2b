"""Window operators over ordered observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def continuous(df: DataFrame, keys: list[str], order: list, value: str, name: str = "continuous") -> DataFrame:
    """Whether a value equals the one before or after it in its group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    same = lambda c: F.coalesce(c == F.col(value), F.lit(False))
    return df.withColumn(name, same(F.lag(value).over(w)) | same(F.lead(value).over(w)))


def sigma_outlier(df: DataFrame, keys: list[str], value: str, k: float = 2.0, name: str = "outlier") -> DataFrame:
    """Outside the open interval mean +- k sample deviations of the group; groups with one distinct value have no outlier."""
    w = Window.partitionBy(*keys)
    stats = df.withColumns({"__m": F.avg(value).over(w), "__s": F.stddev_samp(value).over(w), "__lo": F.min(value).over(w), "__hi": F.max(value).over(w)})
    inside = (F.col(value) > F.col("__m") - k * F.col("__s")) & (F.col(value) < F.col("__m") + k * F.col("__s"))
    return stats.withColumn(name, F.coalesce((F.col("__lo") != F.col("__hi")) & ~inside, F.lit(False))).drop("__m", "__s", "__lo", "__hi")


def lane_filter(points: DataFrame, keys: list[str], order: list, value: str, k: float = 2.0) -> DataFrame:
    """Outlier flag of lane observations: lanes of 0 or less are outliers; of the others those outside k deviations, and those at a place, the
    first column of ``order``, where one equals neither neighbour. Both tests see all positive rows of the group. Rows without a lane number vanish."""
    bad = points.where(F.col(value) <= 0).withColumn("outlier", F.lit(True))
    good = continuous(sigma_outlier(points.where(F.col(value) > 0), keys, value, k, "__far"), keys, order, value, "__cont")
    broken = F.max(~F.col("__cont")).over(Window.partitionBy(*keys, order[0]))
    return bad.unionByName(good.withColumn("outlier", F.col("__far") | broken).drop("__far", "__cont"))


def running_distance(df: DataFrame, keys: list[str], order: list, distance: Column, name: str) -> DataFrame:
    """Running sum of the distance to the row before; rows that did not move are dropped first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    moved = df.withColumn("__d", F.coalesce(distance, F.lit(0.0))).withColumn("__first", F.row_number().over(w) == 1).where(F.col("__first") | (F.col("__d") != 0))
    return moved.withColumn(name, F.sum("__d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__d", "__first")


def max_normalised(df: DataFrame, keys: list[str], value: str, is_link: Column, name: str) -> DataFrame:
    """sqrt(value / largest of the group, of all its rows) for links, 1 for others."""
    w = Window.partitionBy(*keys)
    return df.withColumn(name, F.when(is_link, F.sqrt(F.col(value) / F.max(value).over(w))).otherwise(F.lit(1.0)))


def reverse_order(df: DataFrame, keys: list[str], order: str, flag: Column, name: str) -> DataFrame:
    """Order numbers counted from the group's end where flagged."""
    return df.withColumn(name, F.when(flag, F.max(order).over(Window.partitionBy(*keys)) - F.col(order)).otherwise(F.col(order)))


def run_lengths(df: DataFrame, keys: list[str], start: str, value: str) -> DataFrame:
    """Runs of adjacent places (p, p + 1, v) with one value: ``keys, start, stop, value``; null and 0 are skipped."""
    w = Window.partitionBy(*keys).orderBy(start)
    kept = df.where(F.coalesce(F.col(value), F.lit(0)) != 0).select(*keys, start, value)
    new = (F.lag(start).over(w) + 1 == F.col(start)) & (F.lag(value).over(w) == F.col(value))
    runs = kept.withColumn("__new", F.when(F.coalesce(new, F.lit(False)), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w))
    return runs.groupBy(*keys, "__run").agg(F.min(start).alias("start"), (F.max(start) + 1).alias("stop"), F.first(value).alias("value")).drop("__run")


def fill_zero(df: DataFrame, keys: list[str], order: list, value: str, name: str) -> DataFrame:
    """Zeros take the last value before them that is not zero; 0 if there is none."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.coalesce(F.last(F.nullif(F.col(value), F.lit(0)), ignorenulls=True).over(w), F.lit(0)))


def trim_ends(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """Without the rows of the first and last ``n`` distinct orders of each group."""
    up, down = Window.partitionBy(*keys).orderBy(F.col(order)), Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumns({"__u": F.dense_rank().over(up), "__d": F.dense_rank().over(down)}).where((F.col("__u") > n) & (F.col("__d") > n)).drop("__u", "__d")


def near_median(df: DataFrame, keys: list[str], value: str, within: float) -> DataFrame:
    """Rows closer than ``within`` to the group's median."""
    return df.withColumn("__m", F.percentile(F.col(value), F.lit(0.5)).over(Window.partitionBy(*keys))).where(F.abs(F.col(value) - F.col("__m")) < within).drop("__m")


def recent_mean(df: DataFrame, keys: list[str], order: list, value: str, n: int, name: str) -> DataFrame:
    """Mean of the last n rows, the newest weighing most (weights 1..n)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    seen = F.collect_list(value).over(w.rowsBetween(-n + 1, 0))
    weigh = lambda a: F.aggregate(F.transform(a, lambda x, i: x * (i + 1)), F.lit(0.0), lambda acc, x: acc + x) / (F.size(a) * (F.size(a) + 1) / 2)
    return df.withColumn(name, F.transform(F.array(seen), weigh)[0])


def iqr_outlier(df: DataFrame, keys: list[str], value: str, k: float = 1.5, name: str = "outlier") -> DataFrame:
    """Outside the fence of k interquartile ranges around the quartiles."""
    w = Window.partitionBy(*keys)
    q = df.withColumns({"__q1": F.percentile(F.col(value), F.lit(0.25)).over(w), "__q3": F.percentile(F.col(value), F.lit(0.75)).over(w)})
    spread = k * (F.col("__q3") - F.col("__q1"))
    return q.withColumn(name, (F.col(value) < F.col("__q1") - spread) | (F.col(value) > F.col("__q3") + spread)).drop("__q1", "__q3")
