"""New observations as a stream: a log of micro-batches over a compacted table, the last row per key counts.

A micro-batch writes its own rows only, to a folder of its own, so that its cost does not grow with the table and a repeated batch writes the
same folder again. ``compact`` folds the log into a new version of the base; a version counts once it is whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lanewise.operators.relational import keep_first
from lanewise.sources.sinks import _files

#: The column that tells from which batch a row is.
BATCH = "__batch"


def _versions(spark: SparkSession, folder: str) -> dict[int, str]:
    """Whole folders ``n=<number>`` by number."""
    fs, at = _files(spark, folder)
    if not fs.exists(at(folder)):
        return {}
    paths = [f.getPath() for f in fs.listStatus(at(folder)) if f.isDirectory()]
    return {int(p.getName().removeprefix("n=")): p.toString() for p in paths if not p.getName().endswith(".tmp") and fs.exists(at(f"{p.toString()}/_SUCCESS"))}


def append_batch(batch: DataFrame, path: str, number: int) -> None:
    """Write a batch to the log; written twice, it stands there once."""
    batch.withColumn(BATCH, F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/log/n={number:019d}")


def _stored(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """Base and log rows with their batch numbers, and the last number."""
    base, log = _versions(spark, f"{path}/base"), _versions(spark, f"{path}/log")
    last = max(base, default=-1)
    folders = [*([base[last]] if base else []), *[p for n, p in sorted(log.items()) if n > last]]
    return (spark.read.parquet(*folders) if folders else None), max([last, *log])


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The table as of now: of each key the row of the last batch that has it."""
    rows, _ = _stored(spark, path)
    if rows is None:
        raise FileNotFoundError(path)
    return keep_first(rows, keys, [F.col(BATCH).desc()]).drop(BATCH)


def compact(spark: SparkSession, path: str, keys: list[str]) -> None:
    """Fold the log into a new base version; older versions and the folded log go last."""
    rows, last = _stored(spark, path)
    if rows is None:
        return
    keep_first(rows, keys, [F.col(BATCH).desc()]).write.mode("overwrite").parquet(f"{path}/base/n={last:019d}.tmp")
    fs, at = _files(spark, path)
    new = f"{path}/base/n={last:019d}"
    if not fs.exists(at(new)):
        fs.rename(at(f"{new}.tmp"), at(new))
    fs.delete(at(f"{new}.tmp"), True)
    for kind, least in (("base", last), ("log", last + 1)):
        for n, folder in _versions(spark, f"{path}/{kind}").items():
            if n < least:
                fs.delete(at(folder), True)


def upsert_stream(stream: DataFrame, path: str, keys: list[str], time: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write ``stream`` to the table at ``path``: of each batch the newest row per key replaces the stored one.

    The checkpoint makes restarts resume where they were; a batch done twice gives the same table.
    """

    def write(batch: DataFrame, number: int) -> None:
        newest = keep_first(batch, keys, [F.col(time).desc(), *[F.col(c).asc_nulls_last() for c in batch.columns if c not in (*keys, time)]])
        append_batch(newest, path, number)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update")
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Observations per key and tumbling window, late rows up to ``late``."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))
