"""Line dedup with a log-template tree.

Every line walks a tree of fixed depth: its token count, then its leading tokens, then what is constant in the rest. Tokens with
digits are variable fields from the start. The tokens after the leading ones fall into ``PARTS`` stretches, and a line
stands in one leaf for each stretch left open: two lines that differ only within one stretch, a variable field, share a
leaf. A stretch is open only where what stays makes up three quarters of the line, and half of it without digits. A leaf that holds
lines of several documents is a recurring template; its lines are dropped everywhere but in its first document.
Lines too short or too variable for a template have one leaf of their exact text, so that their copies recur too.

Leaves are told apart by 96 bits of hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage


#: Leading tokens of the tree's fixed levels; stretches of the rest, of which one at a time may vary.
LEADING, PARTS = 2, 5
#: Lines with fewer tokens have no template, only their exact text.
LEAST_TOKENS = 3
#: Documents in which a template must stand to recur. With two, a line of four words goes where an earlier document has it but for one word;
#: a larger number spares such chance pairs, and keeps the passages that two documents only share.
DOCUMENTS = 2
#: Stands for a null id among whole numbers: after all others.
NO_ID = 2**63 - 1


def _masked(line: Column) -> Column:
    """A line whose tokens with digits are variable fields. Only lines with a digit see the pattern, which starts at token starts."""
    masked = F.regexp_replace(line, r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*", "<*>")
    return F.when(line.rlike("[0-9]"), masked).otherwise(line)


def _spaced(line: Column) -> Column:
    """A line with spaces for all white space; only lines with other white space are written anew."""
    other = line.contains("\t") | line.contains("\x0b") | line.contains("\x0c") | line.contains("\r")
    return F.when(other, F.translate(line, "\t\x0b\x0c\r", "    ")).otherwise(line)


def _tokens(line: Column) -> Column:
    """What spaces part; only some lines have empty tokens to remove."""
    tokens = F.split(line, " ", -1)
    gaps = (line == "") | line.startswith(" ") | line.endswith(" ") | line.contains("  ")
    return F.when(gaps, F.array_remove(tokens, "")).otherwise(tokens)


def _keys(docs: DataFrame) -> list[Column]:
    """``id``, by which documents are earlier or later, nulls last, and ``rid``, which tells rows with one id apart."""
    whole = isinstance(docs.schema["doc_id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) if whole else F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("value"))
    return [own.alias("id"), F.xxhash64("doc_id", "text").alias("rid")]


def _leaf(*parts: Column) -> Column:
    return F.struct(F.xxhash64(*parts).alias("leaf"), F.hash(*parts).alias("more"))


def line_leaves(docs: DataFrame, leading: int = LEADING, parts: int = PARTS, least: int = LEAST_TOKENS) -> DataFrame:
    """``id, rid, pos, leaf, more``: the leaves of every line that is not blank, one for each open stretch. ``rid`` tells rows with one
    id apart. Lines that are too short or of which less than half is constant have the leaf of their exact text.

    What a step reads more than once is a projection before it, so that generated code computes it once.
    """
    t, n, constant, width, form = (F.col(c) for c in ("t", "n", "constant", "width", "form"))
    names = ["id", "rid", "pos", "line"]
    lines = docs.where("text is not null").select(*_keys(docs), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select(*names, _masked(F.col("line")).alias("masked"))
    lines = lines.select(*names, _spaced(F.col("masked")).alias("plain"))
    lines = lines.select(*names, "plain", _tokens(F.col("plain")).alias("t"))
    fixed = F.when(F.col("plain").contains("<*>"), F.size(F.array_remove(t, "<*>"))).otherwise(F.size(t))
    lines = lines.select(*names, "t", F.size(t).alias("n"), fixed.alias("constant"))
    lines = lines.select(*names, "t", "n", "constant", F.ceil((n - leading) / F.lit(parts)).cast("int").alias("width"))
    solid = (n >= least) & (constant * 2 >= n)
    opens = (width * 4 <= n) & ((constant - width) * 2 >= n)
    # forms: blank, exact text alone, open stretches, whole template
    lines = lines.select(*names, "t", "n", "width", F.when(n == 0, 0).when(~solid, 1).when(opens, 2).otherwise(3).alias("form"))
    # the tokens are hashed once, by stretch; lines with one whole template share the leaf of each stretch, so that neither the
    # whole template nor an empty stretch needs a leaf of its own
    cut = lambda k: F.when((form == 2) & (F.lit(leading) + width * k < n), F.xxhash64(F.slice(t, F.lit(leading + 1) + width * k, width))).otherwise(F.lit(0).cast("long"))
    head = F.when(form == 2, F.xxhash64(n, F.slice(t, 1, leading)))
    lines = lines.select(*names, "t", "n", "width", "form", head.alias("head"), *[cut(k).alias(f"part{k}") for k in range(parts)])
    several = F.array(*[_leaf(F.col("head"), F.lit(k), *[F.col(f"part{j}") for j in range(parts) if j != k]) for k in range(parts)])
    filled = F.when(width > 0, F.ceil((n - leading) / width)).otherwise(1).cast("int")
    none = F.array().cast("array<struct<leaf:bigint,more:int>>")
    leaves = F.when(form == 2, F.slice(several, 1, filled)).when(form == 3, F.array(_leaf(n, F.lit(-1), t))).when(form == 1, F.array(_leaf(F.lit(-2), F.col("line")))).otherwise(none)
    return lines.select("id", "rid", "pos", F.inline(leaves))


def recurring_lines(docs: DataFrame, documents: int = DOCUMENTS, **tree) -> DataFrame:
    """``id, rid, drop``: of every text that has any, the places of its lines whose template an earlier document has, of templates
    of ``documents`` documents at least.

    Sums and minima are combined before the shuffle, so that a template that most documents have costs one row per task;
    only leaves of several documents are joined back.
    """
    leaves = line_leaves(docs, **tree)
    # written first: a join against a table, unlike one against an aggregation, can have its large partitions split
    if documents <= 2:
        found = leaves.groupBy("leaf", "more").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    else:
        found = leaves.select("leaf", "more", "id").distinct().groupBy("leaf", "more").agg(F.min("id").alias("first"), F.count("*").alias("n")).where(F.col("n") >= documents)
    shared = cut_lineage(found.select("leaf", "more", "first"))
    hits = leaves.join(shared, ["leaf", "more"]).where("id > first").select("id", "rid", "pos")
    return hits.groupBy("id", "rid").agg(F.collect_set("pos").alias("drop"))


def _with_kept(docs: DataFrame, packed: DataFrame, **tree) -> DataFrame:
    drops = recurring_lines(docs, **tree).select(F.col("id").alias("d_id"), F.col("rid").alias("d_rid"), "drop")
    joined = packed.join(drops, (F.col("id") == F.col("d_id")) & (F.col("rid") == F.col("d_rid")), "left")
    lines = F.split("text", "\n", -1)
    keep = lambda s: F.transform(F.array_except(F.sequence(F.lit(0), F.size(s) - 1), F.col("drop")), lambda i: F.get(s, i))
    kept = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.array(lines), keep)[0], "\n"))
    return joined.withColumn("kept_text", kept).withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long")).withColumn("n_dropped", F.coalesce(F.size("drop"), F.lit(0)).cast("long"))


def dedup_lines(docs: DataFrame, **tree) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text``: every text without the lines whose template an earlier document has.

    "Earlier" is by ``doc_id`` in its own type's order; null ids count as one last document. A line repeated within its own document only stays, as do
    blank lines. A null text stays null with no lines; an empty one has one line. Rows with equal id and text are one document, and each of
    them is returned; rows with equal id and other texts are one document too. Other columns are not read.
    """
    packed = docs.select("doc_id", "text", *_keys(docs))
    out = _with_kept(docs, packed, **tree)
    return out.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).alias("n_lines"), "n_dropped", F.col("kept_text").alias("text"))


def dedup_documents(docs: DataFrame, **tree) -> DataFrame:
    """The rows of ``docs``, same columns, with the text that ``dedup_lines`` leaves and its length in ``n_chars``."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text"), *_keys(docs))
    out = _with_kept(docs, packed, **tree)
    new = {c: F.col(f"row.`{c}`") for c in names} | {"text": F.col("kept_text")}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[new[c].alias(c) for c in names])
