"""Table scans: column lists, predicates, boxes and polygons; features by alias; memo tables; nested text columns."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lanewise.functions import geo, line
from lanewise.operators import pano

#: Feature aliases of the map service.
ALIASES = {"point": "panos", "line": "roads", "road": "roads", "edge": "edge", "node": "node"}


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | Column | None = None, box: tuple | None = None, ring: list[tuple[float, float]] | None = None, x: str = "x", y: str = "y", format: str = "parquet") -> DataFrame:
    """Rows of a table: a box (which wins over a ring) becomes range predicates that reach the scan; a ring adds an exact test to its own box."""
    df = spark.read.format(format).load(path)
    if where is not None:
        df = df.where(where)
    if box is None and ring:
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        points = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ring])
        df = df.where(geo.in_bbox(x, y, (min(xs), min(ys), max(xs), max(ys)))).where(geo.in_ring(x, y, points))
    elif box is not None:
        df = df.where(geo.in_bbox(x, y, box))
    return df.select(*columns) if columns else df


def features(spark: SparkSession, root: str, alias: str, box: tuple | None = None) -> DataFrame:
    """A feature table by alias; with a box the rows whose points (x, y) or lines (coords) touch it, uncut."""
    if alias not in ALIASES:
        raise ValueError(f"unknown feature {alias!r}")
    df = spark.read.parquet(f"{root}/{ALIASES[alias]}.parquet")
    if box is None:
        return df
    if "coords" in df.columns:
        return df.where(touches_box(F.col("coords"), box))
    return df.where(geo.in_bbox("x", "y", box))


def touches_box(coords: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a polyline has a point in the box or crosses its border."""
    x0, y0, x1, y1 = box

    def hits(s: Column) -> Column:
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        inv = lambda d: F.when(d != 0, 1 / d)
        tx0, tx1 = (x0 - s["a"]["x"]) * inv(dx), (x1 - s["a"]["x"]) * inv(dx)
        ty0, ty1 = (y0 - s["a"]["y"]) * inv(dy), (y1 - s["a"]["y"]) * inv(dy)
        flat_x = F.when(dx == 0, s["a"]["x"].between(x0, x1)).otherwise(True)
        flat_y = F.when(dy == 0, s["a"]["y"].between(y0, y1)).otherwise(True)
        low = F.greatest(F.lit(0.0), F.coalesce(F.least(tx0, tx1), F.lit(0.0)), F.coalesce(F.least(ty0, ty1), F.lit(0.0)))
        high = F.least(F.lit(1.0), F.coalesce(F.greatest(tx0, tx1), F.lit(1.0)), F.coalesce(F.greatest(ty0, ty1), F.lit(1.0)))
        return flat_x & flat_y & (low <= high)

    return F.exists(line.segments(coords), hits) | F.exists(coords, lambda p: p["x"].between(x0, x1) & p["y"].between(y0, y1))


def load_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Key panos with typed heading and parsed nested columns, once per id."""
    df = spark.read.parquet(path)
    typed = df.withColumn("MoveDir", F.col("MoveDir").cast("double"))
    for name, schema in (("Roads", pano.ROADS), ("Links", pano.LINKS)):
        if name in df.columns and df.schema[name].dataType.typeName() == "string":
            typed = typed.withColumn(name, pano.parse_nested(F.col(name), schema))
    return typed.dropDuplicates(["ID"])


#: How CSV memos are read: quotes are doubled, so that text with line ends and quotes comes back as it was.
MEMO_CSV = {"header": True, "escape": '"', "multiLine": True}
#: What stands for null in memos of our own, where an empty cell is an empty text.
MEMO_NULL = "\\N"


def memo_schema(spark: SparkSession, path: str) -> StructType | None:
    """The column types that ``sinks.save_memo`` has put beside a CSV memo; none if it was written elsewhere."""
    here = f"{path.rstrip('/')}.schema"
    at = spark._jvm.org.apache.hadoop.fs.Path(here)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return StructType.fromJson(json.loads(spark.read.text(here, wholetext=True).first()[0]))


def memo(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """A memo table, Parquet or CSV by its name. A CSV has the types stored beside it or given; without either its columns are text, so that no key loses its zeros."""
    if not path.rstrip("/").endswith(".csv"):
        return spark.read.parquet(path)
    own = memo_schema(spark, path)
    reader = spark.read.options(**MEMO_CSV, **({"nullValue": MEMO_NULL} if own else {}))
    return reader.csv(path, schema=schema or own) if schema or own else reader.csv(path)


def unpredicted(panos: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Rows the memo has no prediction for."""
    return panos.join(done, on, "left_anti")


#: Encodings that Spark's CSV reader takes itself.
NATIVE_ENCODINGS = ("iso-8859-1", "us-ascii", "utf-16", "utf-16be", "utf-16le", "utf-32", "utf-8")


def headerless_csv(spark: SparkSession, path: str, names: list[str], encoding: str = "gb2312", types: list[str] | None = None) -> DataFrame:
    """CSV without a header, columns named by position; strings unless ``types`` says otherwise.

    Encodings that Spark does not know are decoded file by file in Arrow batches, then parsed by Spark.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, types or ["string"] * len(names), strict=True))
    if encoding.lower() in NATIVE_ENCODINGS:
        return spark.read.csv(path, header=False, encoding=encoding, schema=schema)

    def lines(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(content.as_py().decode(encoding).splitlines(), pa.string())], names=["line"])

    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(lines, "line string")
    return raw.where("line <> ''").select(F.from_csv("line", schema).alias("r")).select("r.*")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files of a folder as ``path, pid, dir``, from names ``pid_dir.ext``. Contents are not read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return f.select("path", F.regexp_extract(name, r"^(.+)_[^_]+$", 1).alias("pid"), F.regexp_extract(name, r"_([^_]+)$", 1).alias("dir"))


def geometry_table(spark: SparkSession, shapes: list[tuple[float, float]] | list[list[tuple[float, float]]]) -> DataFrame:
    """One geometry or a list of them, each a list of points, as a table of one column ``geometry``."""
    one = bool(shapes) and not isinstance(shapes[0][0], (list, tuple))
    rows = [([(float(x), float(y)) for x, y in shape],) for shape in ([shapes] if one else shapes)]
    return spark.createDataFrame(rows, "geometry array<struct<x:double,y:double>>")


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of a GeoJSON file: ``properties`` as a map, ``kind`` and ``coords`` (points, lines and the outer ring of polygons)."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>").alias("j"))
    g = raw.select(F.explode("j.features").alias("f")).select("f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    pairs = F.regexp_extract_all("c", F.lit(r"\[\s*(-?[\d.eE+-]+)\s*,\s*(-?[\d.eE+-]+)"), F.lit(0))
    number = lambda t, k: F.regexp_extract(t, r"\[\s*(-?[\d.eE+-]+)\s*,\s*(-?[\d.eE+-]+)", k).cast("double")
    return g.select("properties", "kind", F.transform(pairs, lambda t: F.struct(number(t, 1).alias("x"), number(t, 2).alias("y"))).alias("coords"))


def lane_files(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of lane labels with ``num``, their number of lanes."""
    df = spark.read.schema("raw_file string, lanes array<array<int>>, h_samples array<int>").json(path)
    return df.withColumn("num", F.size("lanes"))


def annotations(spark: SparkSession, path: str, scale: float = 1280 / 1024) -> DataFrame:
    """Shapes of annotation files as point lists, scaled and cut to integers: ``file, lane, points``."""
    raw = spark.read.schema("imagePath string, shapes array<struct<label:string,points:array<array<double>>>>").json(path, multiLine=True)
    cut = lambda v: F.floor(v * scale).cast("double")
    return raw.select(F.col("imagePath").alias("file"), F.posexplode("shapes").alias("lane", "s")).select("file", "lane", F.transform("s.points", lambda p: F.struct(cut(p[0]).alias("x"), cut(p[1]).alias("y"))).alias("points"))


def road_shapes(text: Column) -> Column:
    """Provider geometry ``dirs|ports|x,y,x,y;...;`` as lines ``struct<start,end,line>``."""
    parts = F.filter(F.split(F.element_at(F.split(text, r"\|"), -1), ";"), lambda p: p != "")

    def build(p: Column) -> Column:
        v = F.transform(F.split(p, ","), lambda x: x.cast("double"))
        points = line.from_flat(v)
        return geo.let(points, lambda q: F.struct(F.get(q, F.lit(0)).alias("start"), F.element_at(q, -1).alias("end"), q.alias("line")))

    return F.transform(parts, build)


def tracks(df: DataFrame) -> DataFrame:
    """GPS rows with ``time`` (``yyyyMMdd HH:mm:ss``) as a timestamp."""
    return df.withColumn("time", F.to_timestamp("time", "yyyyMMdd HH:mm:ss"))
