"""Sinks: tables, backups, upserts, GeoJSON, lane labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.operators.relational import upsert
from lanewise.session import cut

from .tables import MEMO_NULL, memo, memo_schema


def save(df: DataFrame, path: str, mode: str = "overwrite") -> bool:
    """Write a table; False, not an error, if Spark refuses."""
    try:
        df.write.mode(mode).parquet(path)
    except PySparkException:
        return False
    return True


def _files(spark: SparkSession, path: str):
    """The file system of ``path`` and a function that makes paths of it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path


def recover(spark: SparkSession, path: str) -> bool:
    """Finish or undo an upsert that was interrupted; whether there is a table. A new table that is whole (it has ``_SUCCESS``) wins over the old one."""
    fs, at = _files(spark, path)
    here, fresh, old = (path.rstrip("/") + end for end in ("", ".new", ".old"))
    if not fs.exists(at(here)):
        for other in (f"{fresh}/_SUCCESS", old):
            if fs.exists(at(other)):
                fs.rename(at(other.removesuffix("/_SUCCESS")), at(here))
                break
    if fs.exists(at(here)):
        for rest in (fresh, old):
            fs.delete(at(rest), True)
        return True
    return False


def save_upserted(spark: SparkSession, new: DataFrame, path: str, keys: list[str]) -> None:
    """New rows over stored ones by key. The result goes to a sibling folder, the old table steps aside and is deleted last: at every moment one of the
    two is whole, and ``recover`` finds it."""
    fs, at = _files(spark, path)
    here, fresh, old = (path.rstrip("/") + end for end in ("", ".new", ".old"))
    stored = recover(spark, path)
    out = upsert(spark.read.parquet(here), new, keys) if stored else new
    out.write.mode("overwrite").parquet(fresh)
    if stored:
        fs.rename(at(here), at(old))
    fs.rename(at(fresh), at(here))
    fs.delete(at(old), True)


def save_memo(df: DataFrame, path: str, mode: str = "append") -> None:
    """Rows of a memo as CSV with a header (or Parquet, by the name); nested columns become JSON text.

    The types of a CSV's columns are written beside it, at ``path.schema``, when it is begun; rows that are appended later take those types, and an error if their columns
    have other names.
    """
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
    flat = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
    if not path.rstrip("/").endswith(".csv"):
        flat.write.mode(mode).parquet(path)
        return
    spark = df.sparkSession
    known = memo_schema(spark, path) if mode == "append" else None
    if known is None:
        spark.createDataFrame([(flat.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}.schema")
    elif set(known.names) != set(flat.columns):
        raise ValueError(f"the memo at {path} has columns {known.names}, not {flat.columns}")
    else:
        flat = flat.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in known.fields])
    flat.write.mode(mode).options(header=True, escape='"', nullValue=MEMO_NULL, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def remembered(spark: SparkSession, wanted: DataFrame, path: str, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results of ``wanted`` by ``keys`` from the memo at ``path``, kept between sessions: only what the memo lacks is computed, and added to it.

    ``compute`` takes the missing rows and returns them with its results.
    """
    fs, at = _files(spark, path)
    known = memo(spark, path) if fs.exists(at(path)) else None
    missing = wanted if known is None else wanted.join(known.select(*keys).distinct(), keys, "left_anti")
    fresh = cut(compute(missing))
    if not fresh.isEmpty():
        save_memo(fresh, path)
    return memo(spark, path).join(wanted.select(*keys).distinct(), keys, "left_semi") if known is not None or not fresh.isEmpty() else fresh


def stored_form(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, equal rows once."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
    return df.withColumns({c: F.to_json(c) for c in nested}).dropDuplicates()


def backup(spark: SparkSession, name: str) -> None:
    """Copy a table to ``back_<name>``."""
    spark.table(name).write.mode("overwrite").saveAsTable(f"back_{name}")


def geojson_features(df: DataFrame, coords: str, kind: str = "LineString") -> DataFrame:
    """One GeoJSON feature per row, as text."""
    pairs = F.transform(coords, lambda p: F.array(p["x"], p["y"]))
    geometry = F.struct(F.lit(kind).alias("type"), (F.get(pairs, F.lit(0)) if kind == "Point" else F.array(pairs) if kind == "Polygon" else pairs).alias("coordinates"))
    properties = F.struct(*[F.col(c) for c in df.columns if c != coords])
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("value"))


def write_geojson(df: DataFrame, coords: str, path: str, kind: str = "LineString", mode: str = "overwrite") -> None:
    """Features as newline-delimited GeoJSON, a file per partition."""
    if coords not in df.columns:
        raise TypeError(f"no geometry column {coords!r}")
    geojson_features(df, coords, kind).write.mode(mode).text(path)


def lane_json(file: Column, lanes: Column, rows: Column) -> Column:
    """A label as a JSON line: lanes, rows and the file."""
    return F.to_json(F.struct(lanes.alias("lanes"), rows.alias("h_samples"), file.alias("raw_file")))


def lane_text(lane: Column, rows: Column, missing: int = -2) -> Column:
    """A lane as ``x y x y ...`` without its missing points."""
    pairs = F.filter(F.arrays_zip(lane.alias("x"), rows.alias("y")), lambda p: p["x"] != missing)
    return F.array_join(F.transform(pairs, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), " ")
