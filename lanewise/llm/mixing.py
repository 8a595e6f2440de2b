"""Mixing sources to target weights.

Every row gets a hash-random key. Within a source the rows stand in key order; word counts are summed
by key range first, so that a prefix sum needs only the ranges' sums and the rows of the one range in
which the budget runs out. A source smaller than its budget is repeated in whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import WORD, cut_lineage

#: Key ranges within a source: the first three hex digits of the key.
RANGE_DIGITS = 3
#: Sources up to this number are joined by broadcast (under 10 MB); beyond it the plan is salted.
BROADCAST_SOURCES = 50_000
SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_key(doc_id: Column, seed: str) -> Column:
    """A hash-random key, the same on every run."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most_epochs: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources in code point order, null last, take the weights in turn. ``share`` of all words is dealt out
    by weight; no target exceeds ``most_epochs`` times its source, and what is above is dealt out again
    by weight. With the caps in order of cap / weight, the fair level is the largest of
    (rest of the words) / (rest of the weights). One row per source passes through one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    weighted = ranked.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.col("total") * F.lit(share) - F.col("cap_before")) / F.col("w_from")
    levels = (
        weighted.withColumn("cap", F.col("source_size") * most_epochs)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("cap_before", F.sum("cap").over(by_cap) - F.col("cap"))
        .withColumn("w_from", F.sum("w").over(everything) - F.sum("w").over(by_cap) + F.col("w"))
        .withColumn("level", F.max(level).over(everything))
    )
    return levels.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * F.col("level")).alias("target"))


def plan_mix(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most_epochs: int = 3) -> DataFrame:
    """Where each source's budget runs out.

    ``rows``: ``source, doc_id, key, size``. Returns one row per source: ``source, source_size, target,
    epochs`` (whole passes), and the cut of the pass that follows: rows below (``cut_key``, ``cut_id``) are taken
    once more, rows at it give ``cut_words`` each, later ones nothing. Without a cut the three are null.
    Rows with equal key and id share what is left evenly, rounded down.
    """
    ranges = rows.groupBy("source", F.substring("key", 1, RANGE_DIGITS).alias("range")).agg(F.sum("size").alias("words"))
    ranges = cut_lineage(ranges)
    targets = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most_epochs)
    budget = (
        targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most_epochs))).otherwise(0).cast("long"))
        .withColumn("left", F.when(F.col("epochs") < most_epochs, F.round(F.col("target") - F.col("epochs") * F.col("source_size"))).otherwise(0).cast("long"))
    )
    budget = cut_lineage(budget)
    in_source = Window.partitionBy("source").orderBy("range")
    at = budget.select(F.col("source").alias("s"), "left")
    cut_range = (
        ranges.withColumn("before", F.sum("words").over(in_source) - F.col("words"))
        .join(at, F.col("source").eqNullSafe(F.col("s")))
        .where("left > 0 and before < left and before + words >= left")
        .select(F.col("s"), F.col("range").alias("r"), (F.col("left") - F.col("before")).alias("rest"))
    )
    inside = rows.withColumn("range", F.substring("key", 1, RANGE_DIGITS)).join(cut_range, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    runs = inside.groupBy("source", "rest", "key", "doc_id").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    in_range = Window.partitionBy("source").orderBy("key", "doc_id")
    cuts = (
        runs.withColumn("before", F.sum("words").over(in_range) - F.col("words"))
        .where("words > 0 and before < rest and before + words >= rest")
        .select(F.col("source").alias("s"), F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_id"), F.expr("(rest - before) div n").alias("cut_words"))
    )
    return cut_lineage(budget.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "left"))


def with_taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with ``source, doc_id, key, size``) and their source's ``source_size, target, epochs``, and ``taken``.

    The plan has one row per source: it is broadcast up to ``BROADCAST_SOURCES`` rows and otherwise joined
    with its rows dealt out to salts, so that a hot source is shared by many tasks.
    """
    on = F.col("source").eqNullSafe(F.col("p_source"))
    side = plan.withColumnRenamed("source", "p_source")
    if plan.count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(side), on)
    else:
        salted = side.withColumn("p_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, on & (F.col("salt") == F.col("p_salt"))).drop("salt", "p_salt")
    same_id = F.col("doc_id").eqNullSafe(F.col("cut_id"))
    earlier_id = F.coalesce(F.col("doc_id") < F.col("cut_id"), F.col("doc_id").isNull() & F.col("cut_id").isNotNull())
    extra = (
        F.when(F.col("cut_key").isNull(), F.lit(0))
        .when((F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & earlier_id), F.col("size"))
        .when((F.col("key") == F.col("cut_key")) & same_id, F.least("size", "cut_words"))
        .otherwise(F.lit(0))
    )
    return joined.withColumn("taken", (F.col("size") * F.col("epochs") + extra).cast("long")).drop("p_source", "cut_key", "cut_id", "cut_words")


def mix_sizes(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """Words the mix takes of every document: ``doc_id, source, size, source_size, target, epochs, taken``.

    A null or empty text has size 0 and gives nothing. A null source is a source of its own, the last one. Null ids
    share one key. Repeated rows count each for itself. An empty table gives an empty result; other columns
    are not read. The texts are read once: sizes are written to the shared folder.
    """
    rows = cut_lineage(docs.select("doc_id", "source", mix_key(F.col("doc_id"), seed).alias("key"), word_count(F.col("text")).alias("size")))
    return with_taken(rows, plan_mix(rows, weights, share, most_epochs)).drop("key")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it, same columns.

    The document at which a source's budget runs out appears a last time cut after its last taken word; its
    ``n_chars``, if there is one, is that of the cut text. Documents without words are not in the mix. Other cases as in
    ``mix_sizes``. Texts are not shuffled.
    """
    rows = cut_lineage(docs.select("doc_id", "source", mix_key(F.col("doc_id"), seed).alias("key"), word_count(F.col("text")).alias("size")))
    plan = plan_mix(rows, weights, share, most_epochs)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", mix_key(F.col("doc_id"), seed).alias("key"), word_count(F.col("text")).alias("size"))
    taken = with_taken(packed, plan).where("taken > 0")
    whole = F.expr("taken div size")
    part = F.col("taken") % F.col("size")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), whole.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    mixed = taken.select("row", F.explode(copies).alias("words"))
    pieces = F.split(F.col("row.text"), r"(?<=[\x20\x09-\x0D])(?![\x20\x09-\x0D])", -1)
    lead = F.when(F.col("row.text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    start = F.regexp_replace(F.array_join(F.slice(pieces, F.lit(1), (F.col("words") + lead).cast("int")), ""), r"[\x20\x09-\x0D]+$", "")
    text = F.when(F.col("words") == 0, F.col("row.text")).otherwise(start)
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(F.col("words") == 0, F.col("row.n_chars")).otherwise(F.length(text).cast(kind))
    return mixed.select(*[out[c].alias(c) for c in docs.columns])
