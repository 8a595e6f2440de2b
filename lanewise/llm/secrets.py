"""Secret scans with multipart credential linking.

Strong kinds are found by pattern alone, in one projection of built-in expressions. Weak candidates (identifiers, endpoints, unlabelled keys) are
reported only where complementary parts stand in the same scope: an interval join of the spans of texts that have any, widened by ``SCOPE``
code points. It is an equi-join on cells of a text, so that a text of very many spans is shared by many tasks; of the texts, spans only are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: Base patterns, fixed values: (kind, pattern, group whose length is checked, least length). Of ``access`` and ``hex`` a
#: run that is long enough starts where its maximal run starts, so the length stands in the pattern.
BASE = (
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
)
#: Weak patterns: reported only beside complementary parts.
WEAK = (
    ("identifier", r"""((?i)client_?id|key_?id|user_?name|login|account)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]+)""", 2, 3),
    ("endpoint", r"""(?:https?|ftp|ssh|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?@%=-]+""", 0, 8),
    ("blob", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{32,}", 0, 32),
)
KINDS = tuple(k for k, *_ in (*BASE, *WEAK))
#: Code points between two spans that still share a scope.
SCOPE = 200
#: What a credential's part is, by kind.
PART = {"assign": "secret", "hex": "secret", "blob": "secret", "access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}
#: Parts that must all stand in the scope of a weak candidate.
NEEDS = {"identifier": ("secret",), "endpoint": ("identifier", "secret"), "blob": ("identifier",)}

SPAN = "struct<start:bigint,rank:int,end:bigint>"
#: Matches whose places are summed up at once.
RUN = 64


def _let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``."""
    return F.transform(F.array(value), body)[0]


def find_spans(text: Column, pattern: str, group: int, least: int, rank: int) -> Column:
    """Leftmost non-overlapping matches as start and end in code points; matches whose group is too short are dropped.

    The text between the matches gives their places: no function of Spark returns them.
    """
    hits = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long")).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x).cast("long")).alias("len"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x).cast("long")).alias("part"),
    )
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, hit: Column) -> Column:
        start = acc["at"] + hit["gap"]
        end = start + hit["len"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(hit["part"] >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def placed(h: Column) -> Column:
        """Runs of matches: their lengths first, then the places within each, so that no long list is copied for every match."""
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(h) - 1) / RUN).cast("int")), lambda k: F.slice(h, k * RUN + 1, F.lit(RUN)))
        total = lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda acc, x: acc + x["gap"] + F.coalesce(x["len"], F.lit(0).cast("long")))
        starts = lambda r: F.aggregate(F.transform(r, total), F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        spans = lambda r, at: F.transform(r, lambda x, i: F.aggregate(x, F.struct(F.get(at, i).alias("at"), none.alias("out")), step, lambda acc: acc["out"]))
        return _let(runs, lambda r: _let(starts(r), lambda at: F.flatten(spans(r, at))))

    return F.when(text.rlike(pattern), _let(hits, placed)).otherwise(none)


def linked(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id, tid, weak``: the weak spans of every text that have all parts they need within ``scope`` code points.

    ``spans (doc_id, tid, start, rank, end)``. A span is no complement of one it overlaps. Weak spans stand in all cells that their scope touches, parts in
    those of their start and end.
    """
    parts = tuple(dict.fromkeys(PART.values()))
    bit = {k: 1 << parts.index(PART[k]) for k in KINDS}
    needs = {k: sum(1 << parts.index(p) for p in NEEDS[k]) for k in NEEDS}
    by_rank = lambda table: F.get(F.array(*[F.lit(table.get(k, 0)) for k in KINDS]), F.col("rank"))
    cell = lambda x: F.floor(x / F.lit(2 * scope))
    weak = spans.withColumn("need", by_rank(needs)).where("need > 0").withColumn("cell", F.explode(F.sequence(cell(F.col("start") - scope), cell(F.col("end") + scope))))
    other = spans.select(F.col("doc_id").alias("d2"), F.col("tid").alias("t2"), F.col("start").alias("s2"), F.col("end").alias("e2"), by_rank(bit).alias("bit"))
    other = other.withColumn("cell2", F.explode(F.array_distinct(F.array(cell(F.col("s2")), cell(F.col("e2"))))))
    near = F.expr(f"(s2 >= end and s2 - end <= {scope}) or (start >= e2 and start - e2 <= {scope})")
    met = weak.join(other, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("tid") == F.col("t2")) & (F.col("cell") == F.col("cell2"))).where(near & (F.col("need").bitwiseAND(F.col("bit")) != 0))
    full = met.groupBy("doc_id", "tid", "start", "rank", "end").agg(F.bit_or("bit").alias("has"), F.max("need").alias("need")).where(F.col("has").bitwiseAND(F.col("need")) == F.col("need"))
    return full.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("start", "rank", "end")).alias("weak"))


def _said(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Spans of every whole text: ``doc_id, n_assign, n_access, n_hex, base`` (``kind:start:end``, by start, then kind),
    ``spans`` (likewise, with the linked weak ones) and ``n_linked``.

    A null or empty text has no spans and empty strings. Repeated rows give repeated results; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    strong, weak = [k for k, *_ in BASE], [k for k, *_ in WEAK]
    found = docs.select("doc_id", text.alias("t")).select("doc_id", F.xxhash64("t").alias("tid"), *[find_spans(F.col("t"), p, g, n, KINDS.index(k)).alias(k) for k, p, g, n in (*BASE, *WEAK)])
    found = cut_lineage(found)
    some = found.where(reduce(Column.__or__, [F.size(k) > 0 for k in weak])).dropDuplicates(["doc_id", "tid"])
    links = linked(some.select("doc_id", "tid", F.inline(F.concat(*[F.col(k) for k in KINDS]))), scope).select(F.col("doc_id").alias("d"), F.col("tid").alias("i"), "weak")
    base = F.concat(*[F.col(k) for k in strong])
    more = F.coalesce("weak", F.array().cast(f"array<{SPAN}>"))
    kept = found.join(links, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tid") == F.col("i")), "left")
    return kept.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in strong],
        _said(base).alias("base"),
        _said(F.concat(base, more)).alias("spans"),
        F.size(more).cast("long").alias("n_linked"),
    )
