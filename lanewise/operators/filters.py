"""Projection, filtering and tag rules of road tables as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lanewise import constants as C
from lanewise.session import cut


def literal_map(table: dict) -> Column:
    """A dictionary as a constant map; numbers become doubles, booleans stay."""
    values = [F.lit(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else F.lit(v) for v in table.values()]
    return F.create_map(*[x for k, v in zip(table, values, strict=True) for x in (F.lit(k), v)])


def lookup(key: Column, table: dict, default=None) -> Column:
    """The key's value in a dictionary, or ``default``."""
    return F.coalesce(F.element_at(literal_map(table), key), F.lit(default))


def road_level(road_type: Column, default: float | None = 50) -> Column:
    """Level of a road class, with fractional levels for links; callers differ in the default (50, 99 or null)."""
    return lookup(road_type, C.ROAD_LEVEL, default)


def oneway_strict(tag: Column) -> Column:
    """Map reader's rule: yes, 1, true, -1 and reversible are one-way; anything else, also a missing tag, is not."""
    return F.coalesce(F.lower(tag).isin("yes", "1", "true", "-1", "reversible"), F.lit(False))


def oneway_builder(tag: Column, highway_class: Column) -> Column:
    """Network builder's rule: reversible and alternating are two-way; a missing tag takes the class's default."""
    return (
        F.when(F.lower(tag).isin("yes", "true", "1", "-1", "reversed"), True)
        .when(F.lower(tag).isin("no", "false", "0", "reversible", "alternating"), False)
        .otherwise(F.coalesce(F.element_at(literal_map(C.DEFAULT_ONEWAY), highway_class), F.lit(False)))
    )


def oneway_reversed(tag: Column) -> Column:
    """Whether the way runs against its node order."""
    return F.coalesce(F.lower(tag).isin("-1", "reversed"), F.lit(False))


def oneway_simulator(tag: Column) -> Column:
    """Simulator's rule: only yes and 1 are one-way."""
    return F.coalesce(F.lower(tag).isin("yes", "1"), F.lit(False))


def first_number(text: Column) -> Column:
    """First number in a tag as text; null without one."""
    return F.nullif(F.regexp_extract(text, r"\d+\.?\d*", 0), F.lit(""))


def lanes_of(text: Column) -> Column:
    return F.floor(first_number(text).try_cast("double")).cast("int")


def agent_types(tags: dict[str, Column], highway: Column) -> Column:
    """Agent types a way admits, joined by ``;``: those none of whose excluded tag values it has, and ``track`` if its class says so."""
    allowed = [
        F.when(~F.coalesce(F.greatest(*[F.coalesce(tags[t].isin(*bad), F.lit(False)).cast("int") for t, bad in rule.items() if t in tags], F.lit(0), F.lit(0)) > 0, F.lit(False)), F.lit(agent))
        for agent, rule in C.AGENT_EXCLUDES.items()
    ]
    return F.concat_ws(";", *allowed, F.when(F.contains(highway, F.lit("track")), "track"))


def link_rule(road_type: Column, lanes: Column) -> Column:
    """A link class with no lane number or more than two lanes has one lane."""
    return F.when(F.contains(road_type, F.lit("link")) & (lanes.isNull() | (lanes > 2)), F.lit(1)).otherwise(lanes)


def name_part(name: Column, from_end: int, separator: str = "_") -> Column:
    """The n-th part of a name from its end, without a file extension; null if there are fewer."""
    return F.try_element_at(F.split(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), separator), F.lit(-from_end))


def edge_id_parts(edge: Column) -> Column:
    """``[-]rid[#order][-postfix]`` as ``struct<rid,order,postfix>``; an empty id gives rid -1."""
    return F.struct(
        F.when(edge == "", F.lit(-1)).otherwise(F.regexp_extract(edge, r"^(-?\d+)", 1).cast("long")).alias("rid"),
        F.coalesce(F.nullif(F.regexp_extract(edge, r"#(\d+)", 1), F.lit("")).cast("int"), F.lit(0)).alias("order"),
        F.nullif(F.regexp_extract(edge, r"^-?\d+(?:#\d+)?-(.+)$", 1), F.lit("")).alias("postfix"),
    )


def initials(name: Column, separator: str = "_") -> Column:
    """First letters of a name's parts."""
    return F.array_join(F.transform(F.split(name, separator), lambda x: F.left(x, F.lit(1))), "")


def thin(df: DataFrame, key: str, order: str, every: int = 3, at: int = 1, more_than: int = 3) -> DataFrame:
    """Of groups with more than ``more_than`` rows, only rows whose order leaves remainder ``at``."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return df.withColumn("__n", n).where((F.col("__n") <= more_than) | (F.col(order) % every == at)).drop("__n")


def varying_columns(df: DataFrame) -> list[str]:
    """Columns with at least two different values that are not null; one pass with minima and maxima."""
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct")]
    row = df.agg(*[(F.min(F.col(f"`{c}`")) != F.max(F.col(f"`{c}`"))).alias(c) for c in plain]).first()
    return [c for c in df.columns if c not in plain or row[c]]


def drop_constant_columns(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in varying_columns(df)])


def dense_ids(df: DataFrame, where: Column, order: list, name: str) -> DataFrame:
    """Rows that satisfy ``where`` with ids from 0 in the given order.

    Places come from counts per range of the order and a window within each range, so that no task sees all rows.
    """
    kept = df.where(where).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = kept.withColumn("__p", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    placed = cut(placed)
    counts = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.withColumn("__s", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).select("__p", "__s")
    return placed.join(F.broadcast(starts), "__p").withColumn(name, F.col("__s") + F.col("__k")).drop("__p", "__k", "__s")


def draw_number(keys: list[str], seed: int) -> Column:
    """A number in [0, 1) that depends on the keys and the seed only: 32 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    return F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double") / 2**32


def sample_rows(df: DataFrame, keys: list[str], n: int, seed: int = 1) -> DataFrame:
    """``n`` rows, the smallest by a seeded hash of their keys: the same on every run, however the table is partitioned."""
    return df.orderBy(draw_number(keys, seed), *keys).limit(n)


def split_fraction(df: DataFrame, keys: list[str], fraction: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """About ``fraction`` of the rows by a seeded hash of their keys, and the others."""
    drawn = draw_number(keys, seed) < fraction
    return df.where(drawn), df.where(~drawn)


def bernoulli(df: DataFrame, keys: list[str], wanted: int, size: int, seed: int = 42) -> DataFrame:
    """Every row with probability wanted / size."""
    return split_fraction(df, keys, min(1.0, wanted / max(size, 1)), seed)[0]


def draw_test_set(edges: DataFrame, per_city: int, levels: int = 5, seed: int = 1) -> DataFrame:
    """Edges for a labelled test set: classified, minor roads left out, links flagged, ``per_city`` drawn by hash in every city.

    ``edges (city, eid, road_type)``.
    """
    typed = edges.withColumn("level", road_level(F.col("road_type"))).withColumn("is_link", F.contains("road_type", F.lit("link"))).where(F.col("level") < levels + 1)
    w = Window.partitionBy("city").orderBy(draw_number(["eid"], seed), "eid")
    return typed.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= per_city).drop("__rn")
