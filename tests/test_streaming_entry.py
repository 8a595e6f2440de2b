"""The driver contract and the streaming sink."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lanewise.streaming import upserts
from lanewise.streaming.upserts import upsert_stream, windowed_counts

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return repr(round(float(v), 9) + 0.0) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["eid", "road_type", "lane_num"] and out.count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    other = duck.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(other.columns)
    mine = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    place = [other.columns.index(c) for c in columns]
    assert mine == sorted(tuple(cell(r[i]) for i in place) for r in other.fetchall())


def test_stream_is_upserted(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "table")
    schema = "id long, v string, t timestamp"
    rows = spark.createDataFrame([(1, "a", "2024-01-01"), (1, "b", "2024-01-02"), (2, "c", "2024-01-01")], "id long, v string, t string").withColumn("t", F.to_timestamp("t"))
    rows.coalesce(1).write.parquet(str(source))
    for extra in (None, (2, "d", "2024-01-05")):
        if extra:
            spark.createDataFrame([extra], "id long, v string, t string").withColumn("t", F.to_timestamp("t")).write.mode("append").parquet(str(source))
        upsert_stream(spark.readStream.schema(schema).parquet(str(source)), path, ["id"], "t", str(tmp_path / "cp"), once=True).awaitTermination()
    assert {(r.id, r.v) for r in upserts.current(spark, path, ["id"]).collect()} == {(1, "b"), (2, "d")}
    upserts.compact(spark, path, ["id"])
    assert sorted(p.name for p in (tmp_path / "table").glob("*/n=*")) == [f"n={1:019d}"]
    upserts.append_batch(spark.createDataFrame([(1, "e", None), (7, "f", None)], schema), path, 2)
    upserts.append_batch(spark.createDataFrame([(1, "e", None), (7, "f", None)], schema), path, 2)  # a batch repeated after a crash
    (tmp_path / "table" / "log" / f"n={3:019d}").mkdir()  # a batch that was not finished
    assert {(r.id, r.v) for r in upserts.current(spark, path, ["id"]).collect()} == {(1, "e"), (2, "d"), (7, "f")}
    upserts.compact(spark, path, ["id"])
    upserts.compact(spark, path, ["id"])
    assert {(r.id, r.v) for r in upserts.current(spark, path, ["id"]).collect()} == {(1, "e"), (2, "d"), (7, "f")}
    counts = windowed_counts(spark.readStream.schema(schema).parquet(str(source)), "t", "id")
    assert counts.isStreaming and counts.columns == ["window", "id", "n"]
