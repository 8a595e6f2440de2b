"""OSM files: XML through Spark's reader, PBF through a Python data source; both give node, way and relation tables."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TAG = "array<struct<_k:string,_v:string>>"
NODE_XML = f"_id long, _lon double, _lat double, tag {TAG}"
WAY_XML = f"_id long, nd array<struct<_ref:long>>, tag {TAG}"
RELATION_XML = f"_id long, member array<struct<_type:string,_ref:long,_role:string>>, tag {TAG}"
#: Bounds of a file that states none.
WORLD = (-180.0, -90.0, 180.0, 90.0)


def _tags():
    return F.map_from_entries(F.array_distinct(F.transform(F.coalesce(F.col("tag"), F.array().cast(TAG)), lambda t: F.struct(t["_k"], t["_v"]))))


def read_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``nodes (id, x, y, tags)``, ``ways (id, refs, tags)``, ``relations (id, members, tags)`` of an OSM XML file."""
    load = lambda row, schema: spark.read.format("xml").option("rowTag", row).schema(schema).load(path)
    nodes = load("node", NODE_XML).select(F.col("_id").alias("id"), F.col("_lon").alias("x"), F.col("_lat").alias("y"), _tags().alias("tags"))
    ways = load("way", WAY_XML).select(F.col("_id").alias("id"), F.transform(F.coalesce("nd", F.array().cast("array<struct<_ref:long>>")), lambda r: r["_ref"]).alias("refs"), _tags().alias("tags"))
    members = F.transform(F.coalesce("member", F.array().cast("array<struct<_type:string,_ref:long,_role:string>>")), lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role")))
    relations = load("relation", RELATION_XML).select(F.col("_id").alias("id"), members.alias("members"), _tags().alias("tags"))
    return nodes, ways, relations


def read_bounds(spark: SparkSession, path: str) -> tuple[float, float, float, float]:
    """Bounds (x0, y0, x1, y1) that the file states, else the world's."""
    row = spark.read.format("xml").option("rowTag", "bounds").schema("_minlon double, _minlat double, _maxlon double, _maxlat double").load(path).first()
    return WORLD if row is None else tuple(d if v is None else v for v, d in zip(row, WORLD, strict=True))


def way_edges(ways: DataFrame) -> DataFrame:
    """Ways as consecutive node pairs: ``rid, ord, s, e``."""
    pairs = F.arrays_zip(F.slice("refs", F.lit(1), F.greatest(F.size("refs") - 1, F.lit(0))).alias("s"), F.slice("refs", F.lit(2), F.greatest(F.size("refs") - 1, F.lit(0))).alias("e"))
    return ways.where(F.size("refs") > 1).select(F.col("id").alias("rid"), F.posexplode(pairs).alias("ord", "p")).select("rid", "ord", F.col("p.s").alias("s"), F.col("p.e").alias("e"))


# Wire format of the PBF files.


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of one message: integers of kind 0, bytes of kind 2."""
    at, end = 0, len(data)
    while at < end:
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            n, at = varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield key >> 3, value


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def numbers(data: bytes, signed: bool = False) -> list[int]:
    """A packed list of varints, zigzag coded if signed."""
    out, at = [], 0
    while at < len(data):
        v, at = varint(data, at)
        out.append((v >> 1) ^ -(v & 1) if signed else v)
    return out


def running(values: list[int]) -> list[int]:
    out, total = [], 0
    for v in values:
        total += v
        out.append(total)
    return out


def blob_offsets(path: str) -> list[tuple[int, int]]:
    """Place and size of every data blob of a file."""
    out = []
    with open(path, "rb") as f:
        while head := f.read(4):
            header = dict(fields(f.read(struct.unpack(">I", head)[0])))
            size, at = header[3], f.tell()
            if header[1] == b"OSMData":
                out.append((at, size))
            f.seek(size, 1)
    return out


def read_blob(path: str, at: int, size: int) -> bytes:
    with open(path, "rb") as f:
        f.seek(at)
        blob = dict(fields(f.read(size)))
    if 1 in blob:
        return blob[1]
    if 3 in blob:
        return zlib.decompress(blob[3])
    raise ValueError("only raw and zlib blobs are supported")


def block_rows(data: bytes) -> Iterator[tuple]:
    """Rows ``kind, id, x, y, refs, members, tags`` of a block."""
    strings: list[str] = []
    groups, scale, lat0, lon0 = [], 100, 0, 0
    for k, v in fields(data):
        if k == 1:
            strings = [s.decode("utf-8", "replace") for n, s in fields(v) if n == 1]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            scale = v
        elif k == 19:
            lat0 = v
        elif k == 20:
            lon0 = v
    degrees = lambda base, v: 1e-9 * (base + scale * v)
    for group in groups:
        for k, v in fields(group):
            if k == 2:  # dense nodes: deltas, tags as one list with a 0 after each node
                dense = dict(fields(v))
                ids, lats, lons = (running(numbers(dense.get(n, b""), True)) for n in (1, 8, 9))
                kv, at = numbers(dense.get(10, b"")), 0
                for i, lat, lon in zip(ids, lats, lons, strict=True):
                    tags = {}
                    while at < len(kv) and kv[at]:
                        tags[strings[kv[at]]] = strings[kv[at + 1]]
                        at += 2
                    at += 1
                    yield "node", i, degrees(lon0, lon), degrees(lat0, lat), None, None, tags
            elif k in (3, 4):
                own: dict[int, object] = {}
                for n, x in fields(v):
                    own[n] = x
                tags = {strings[a]: strings[b] for a, b in zip(numbers(own.get(2, b"")), numbers(own.get(3, b"")), strict=True)}
                if k == 3:
                    yield "way", own[1], None, None, running(numbers(own.get(8, b""), True)), None, tags
                else:
                    kinds = ("node", "way", "relation")
                    refs = running(numbers(own.get(9, b""), True))
                    members = [(kinds[t], r, strings[s]) for s, r, t in zip(numbers(own.get(8, b"")), refs, numbers(own.get(10, b"")), strict=True)]
                    yield "relation", own[1], None, None, None, members, tags


PBF_SCHEMA = "kind string, id long, x double, y double, refs array<long>, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>"


class PbfSource(DataSource):
    """``spark.read.format("osmpbf").load(path)``: one partition per blob. Files are opened by their local or mounted path."""

    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> str:
        return PBF_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PbfReader(self.options["path"])


class PbfReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(x) for x in blob_offsets(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from block_rows(read_blob(self.path, *partition.value))


def read_pbf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Node, way and relation tables of a PBF file, as ``read_xml`` returns them."""
    spark.dataSource.register(PbfSource)
    rows = spark.read.format("osmpbf").load(path)
    return (
        rows.where("kind = 'node'").select("id", "x", "y", "tags"),
        rows.where("kind = 'way'").select("id", "refs", "tags"),
        rows.where("kind = 'relation'").select("id", "members", "tags"),
    )
