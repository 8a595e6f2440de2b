"""Shared pieces of the corpus operators: table reading, lineage cuts and connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.session import cut

#: A word is a run of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder all executors share, the session's ``spark.checkpoint.dir``, and continue from the copy.

    Shuffle files of lineages cut before are let go first: Spark removes them when the
    driver collects garbage, which a small driver heap may put off for long.
    """
    df.sparkSession.sparkContext._jvm.System.gc()
    return cut(df)


#: Rows of an Arrow batch between the JVM and Python: texts are long, and both sides hold a whole batch.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches to ``BATCH_ROWS`` rows, unless the user has set a bound."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def pieces_of(batch: pa.RecordBatch, column: int, rows: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of up to ``rows`` rows whose texts in ``column`` have ``most`` bytes together, or of one row."""
    at, n, size = 0, 0, 0
    for k, own in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if n and (n == rows or size + own > most):
            yield batch.slice(at, n)
            at, n, size = k, 0, 0
        n, size = n + 1, size + own
    if n:
        yield batch.slice(at, n)


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, and the next stage needs it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library than glibc
        pass


#: Keys of more copies than 1 / ``MOST_HOT`` of all rows (and than ``HOT_COPIES``) are at most ``MOST_HOT``: a proven bound for a broadcast.
MOST_HOT, HOT_COPIES = 100_000, 1_000


def join_copies(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined with ``side (key, copies, ...)``, whose ``copies`` are the key's rows at least; without ``copies``. Both are written tables.

    A key with very many rows would be one task of the join, so that those keys are joined by broadcast instead, and the others as usual.
    """
    bound = max(HOT_COPIES, rows.count() // MOST_HOT)
    rest = [c for c in side.columns if c not in (key, "copies")]
    few = side.where(F.col("copies") > bound)
    hot = F.broadcast(few.select(F.col(key).alias("__hot"), *[F.col(c).alias(f"__{c}") for c in rest]))
    tried = rows.join(hot, F.col(key) == F.col("__hot"), "left")
    cold = tried.where("__hot is null").select(*rows.columns).join(side.where(F.col("copies") <= bound).drop("copies"), key, "left")
    return cold.select(*rows.columns, *rest).unionByName(tried.where("__hot is not null").select(*rows.columns, *[F.col(f"__{c}").alias(c) for c in rest]))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the fold whose rows never teach a model: crc32 of the id as text, modulo ``folds``, is 0.

    A row without an id is held out, so that nothing is learned from it.
    """
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node with the smallest node it can reach.

    ``nodes``: one column ``node`` (long, distinct). ``edges``: columns ``a`` and ``b``; direction does not matter and
    repeats are fine. Returns ``node``, ``label``. Rounds of neighbour minima and pointer jumping, each
    written to the shared folder; the number of rounds follows the logarithm of the longest path. Only
    nodes that have an edge take part in the rounds.
    """
    both = edges.select("a", "b").where("a <> b")
    both = cut_lineage(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    for _ in range(max_rounds):
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        hooked = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        # the label's own label: the pointer jump; a label also learns what its followers have found
        up = hooked.groupBy(F.col("label").alias("node")).agg(F.min("low").alias("found"))
        low = cut_lineage(
            hooked.join(up, "node", "left").select("node", "label", F.least("low", F.coalesce("found", "low")).alias("low"))
        )
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("next"))
        new = cut_lineage(low.join(jump, "low", "left").select("node", F.col("label").alias("old"), F.least("low", F.coalesce("next", "low")).alias("label")))
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
