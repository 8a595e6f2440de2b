"""N-gram Jaccard join: prefix trees over globally ordered shingle sets.

1. Every text becomes a set of hashed word n-grams in one global order, the hash's. Equal sets share a 128-bit digest and are one node from here on.
2. Filter: all but ``slack(n)`` of a set's n-grams lie in a partner's set. So of the first ``slack + need`` at least ``need`` do, and
   then they stand among the partner's first ones. Sets whose first n-grams are hardly shared by other sets drop out.
3. Rounds over the rest: sets that share an n-gram drawn for the round (a minimum under a round-specific hash) meet in bounded blocks and
   are joined by trie. Linked sets take one label; then a set stays only if enough of its n-grams are shared with sets of other labels.
4. What stays is joined exactly, in one global order, the n-grams' frequency. Two linked sets share one of their ``slack + 1`` rarest n-grams. Sets
   that share one are of one family; a family is joined by trie, in pairs of bounded blocks if it is large. A family of very many blocks
   is joined n-gram by n-gram instead, so that a set is copied as often as it has rare n-grams, and not as often as its family has blocks.

Groups are split into blocks, and of the pairs found only a spanning forest leaves a block, so that a group of copies costs rows in proportion
to its size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import components, cut_lineage, give_back, join_copies, pieces_of, small_batches

#: N-grams and sets that a trie is built over at once, about: a block's bound.
BLOCK_GRAMS, BLOCK = 250_000, 512
#: Blocks beyond which a family is joined by its rare n-grams.
FAMILY_BLOCKS = 16
#: Rows up to this number are broadcast (24 bytes each); beyond it they are joined.
BROADCAST_NODES = 1_000_000
ROUNDS = 2
SPACE = re.compile(rb"[ \t-\r]")
#: Fixed odd multipliers.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
#: Bytes whose words are hashed at once; a longer text is cut at white space.
PIECE_BYTES = 1 << 20


def _finish(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(MIX[3])
    x ^= x >> np.uint64(29)
    return x


def word_hashes(text: bytes) -> np.ndarray:
    """The hash of every word of a text; A-Z count as lower case. A long text is read in pieces that end at white space."""
    from xxhash import xxh3_64_intdigest

    parts, at = [], 0
    while at < len(text):
        end = SPACE.search(text, at + PIECE_BYTES) if len(text) - at > PIECE_BYTES else None
        stop = end.start() if end else len(text)
        words = text[at:stop].lower().split()
        parts.append(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)))
        at = stop
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def batch_shingles(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Distinct hashed word n-grams of each text, ascending; of fewer words the whole sequence."""
    return _grams([word_hashes(t) for t in texts], width)


def _grams(hashes: list[np.ndarray], width: int) -> list[np.ndarray]:
    lens = np.array([len(h) for h in hashes], dtype=np.int64)
    flat = np.concatenate(hashes)
    ends = np.cumsum(lens)
    x = np.full(len(flat), width, np.uint64)
    for j in range(width):  # runs over the ends of texts too; those are not read
        x[: len(flat) - j] = _finish((x[: len(flat) - j] ^ flat[j:]) * np.uint64(MIX[j % 3]))
    out = []
    for h, n, end in zip(hashes, lens.tolist(), ends.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(x[end - n : end - width + 1].view(np.int64)))
        elif n:
            y = np.full(1, n, np.uint64)
            for j in range(n):
                y = _finish((y ^ h[j : j + 1]) * np.uint64(MIX[j % 3]))
            out.append(y.view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def slack(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of n n-grams a partner may lack: the overlap is at least ``percent`` % of the larger set."""
    return n - (n * percent + 99) // 100


def need(n: np.ndarray, percent: int, share: int) -> np.ndarray:
    """How many of the first n-grams must be shared: ``share`` % of the slack and four. More is stricter and publishes more."""
    return np.minimum(slack(n, percent) * share // 100 + 4, n - slack(n, percent))


def first(n: np.ndarray, percent: int, share: int) -> np.ndarray:
    """N-grams that must be published so that those tested of any partner are among them."""
    most = n * 100 // percent + 1  # a partner's largest size
    return np.minimum(n, slack(most, percent) + need(most, percent, share) + slack(n, percent) + 1)


def _sets(docs: DataFrame, width: int, percent: int, share: int, what: str) -> DataFrame:
    """``place, n, node, digest`` and n-grams of every text: the ``first`` ones, ``all``, or none.

    ``digest`` is the set's, of 128 bits, null for an empty one; ``node`` is 63 bits of it, for tests that may pass too many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for piece in pieces_of(batch, 1, 512, 4 * PIECE_BYTES):
                n, node, digest, grams = [], [], [], []
                for s in batch_shingles([t or b"" for t in piece.column(1).cast(pa.binary()).to_pylist()], width):
                    d = xxh3_128_digest(s.tobytes())
                    n.append(len(s))
                    node.append(int.from_bytes(d[:8], "little") >> 1 if len(s) else None)
                    digest.append(d if len(s) else None)
                    grams.append(s[: int(first(np.int64(len(s)), percent, share))] if what == "first" else s if what == "all" else s[:0])
                offsets = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int32)
                flat = np.concatenate(grams) if grams else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["place", "n", "node", "digest", "grams"]
                )
        give_back()

    small_batches(docs.sparkSession)
    kind = docs.schema["place"].dataType.simpleString()
    return docs.select("place", "text").mapInArrow(run, f"place {kind}, n long, node long, digest binary, grams array<long>")


def _shared_enough(sets: DataFrame, percent: int, share: int) -> DataFrame:
    """Nodes of which at least ``need`` of the first ``slack + need`` n-grams occur in other texts. A necessary condition for a link."""
    n = F.col("n")
    loose = n - F.floor((n * percent + 99) / 100)
    enough = F.least(F.floor(loose * share / 100) + 4, n - loose)
    posts = sets.where("node is not null").select("node", "n", F.posexplode("grams").alias("pos", "gram"))
    # counting rows, not sets, lets copies of one set pass; they are one node later
    # written first: a join against a table, unlike one against an aggregation, can have its large partitions split
    common = cut_lineage(posts.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gram"))
    tested = posts.where(F.col("pos") < loose + enough).select("node", "gram", enough.cast("int").alias("enough"))
    hits = tested.join(common, "gram").groupBy("node", "gram").agg(F.min("enough").alias("enough"))  # copies of a set count once
    return hits.groupBy("node").agg(F.count(F.lit(1)).alias("hits"), F.min("enough").alias("enough")).where("hits >= enough").select("node")


def _gather(post: np.ndarray, start: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The posting lists of some n-grams, one after another."""
    at, n = start[grams], start[grams + 1] - start[grams]
    ends = np.cumsum(n)
    return post[np.repeat(at - ends + n, n) + np.arange(ends[-1])] if len(ends) and ends[-1] else post[:0]


def trie_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, frequency: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of left, j of right) with Jaccard of at least ``percent`` %; right None: i < j of left.

    The n-grams of the left sets, most frequent first, form a trie. Their global ``frequency`` (n-grams, ascending, and their
    counts) orders them, or else how often the right sets hold them; its paths are walked depth first. Overlaps with all right sets are kept at every
    branching, so that sets that share a path share its partial overlaps. A subtree is left when no right set can still reach its bound:
    overlap so far plus what remains of the path.
    """
    own = right is None
    others = left if own else right
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not left or not others:
        return none
    lens = np.array([len(s) for s in others])
    known, inverse = np.unique(np.concatenate(others), return_inverse=True)
    count = np.bincount(inverse, minlength=len(known)) if frequency is None else frequency[1][np.searchsorted(frequency[0], known)]
    rank = np.empty(len(known), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(known))
    place = rank[inverse]
    order = np.argsort(place, kind="stable")
    post, start = np.repeat(np.arange(len(others)), lens)[order], np.searchsorted(place[order], np.arange(len(known) + 1))
    if own:
        paths = np.split(place, np.cumsum(lens)[:-1])
    else:
        flat = np.concatenate(left)
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        mine = np.where(known[at] == flat, rank[at], -1)
        paths = [p[p >= 0] for p in np.split(mine, np.cumsum([len(s) for s in left])[:-1])]
    paths = [np.sort(p) for p in paths]
    walk = sorted(range(len(left)), key=lambda k: paths[k].astype(">u4").tobytes())

    def shared(a: np.ndarray, b: np.ndarray) -> int:
        m = min(len(a), len(b))
        differ = a[:m] != b[:m]
        return int(differ.argmax()) if differ.any() else m

    ahead = [shared(paths[a], paths[b]) for a, b in zip(walk, walk[1:], strict=False)] + [0]
    out_i, out_j = [], []
    stack: list[tuple[int, np.ndarray]] = [(0, np.zeros(len(others), np.int64))]
    for k, i in enumerate(walk):
        path, n = paths[i], len(left[i])
        while k and stack[-1][0] > ahead[k - 1]:  # back to the branching
            stack.pop()
        least = -(-percent * (n + lens) // (100 + percent))  # overlap that a pair needs
        fits = (np.minimum(n, lens) * 100 >= percent * np.maximum(n, lens)) & (least > 0)
        if own:
            fits[i] = False
        depth, overlap = stack[-1]
        stops = sorted({x for x in (ahead[k], depth + (len(path) - depth) // 4, depth + (len(path) - depth) // 2) if x > depth} | {len(path)})
        for stop in stops:
            if stop > depth:
                overlap = overlap + np.bincount(_gather(post, start, path[depth:stop]), minlength=len(others))
                depth = stop
                if stop == ahead[k]:
                    stack.append((depth, overlap))
            if stop >= ahead[k] and not (fits & (overlap + len(path) - depth >= least)).any():  # nothing below reaches its bound
                break
        else:
            found = np.flatnonzero(fits & (overlap * 100 >= percent * (n + lens - overlap)))
            if own:
                found = found[found > i]
            out_i.append(np.full(len(found), i, np.int64))
            out_j.append(found.astype(np.int64))
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else none


def forest(n: int, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs that join two trees so far: at most n - 1."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            root[rb] = ra
            kept.append((a, b))
    return kept


def _block_links(percent: int):
    """Links within a block (side 0 only) or between two (sides 0 and 1): a spanning forest of them."""
    empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    def run(table: pa.Table) -> pa.Table:
        nodes, sides, labels = (table.column(c).to_numpy() for c in ("node", "side", "label"))
        if len(nodes) < 2 or (labels == labels[0]).all():
            return empty
        lists = table.column("grams").combine_chunks()
        flat, cut = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().cumsum()
        sets = np.split(flat, cut[:-1])
        frequency = None
        if "dfs" in table.schema.names:
            known, at = np.unique(flat, return_index=True)
            frequency = known, table.column("dfs").combine_chunks().flatten().to_numpy()[at]
        a, b = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        i, j = trie_pairs([sets[k] for k in a], [sets[k] for k in b] if len(b) else None, percent, frequency)
        i, j = a[i], (b if len(b) else a)[j]
        differ = labels[i] != labels[j]
        kept = forest(len(nodes), zip(i[differ].tolist(), j[differ].tolist(), strict=True))
        return pa.table({"a": pa.array([int(nodes[x]) for x, _ in kept], pa.int64()), "b": pa.array([int(nodes[y]) for _, y in kept], pa.int64())})

    return run


def _blocks_of(sets: Column, grams: Column) -> Column:
    """Into how many blocks a group is cut: of one set at least."""
    return F.least(F.greatest(F.ceil(sets / BLOCK), F.ceil(grams / BLOCK_GRAMS)), sets).cast("int")


def _placed(dealt: DataFrame, group: str) -> DataFrame:
    """Every set in all pairs of blocks of its group that hold its own block; side 1 is that of the larger block."""
    pairs = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = pairs.select(group, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "label", "grams", "dfs", (F.col("block") > F.col("other")).cast("int").alias("side"))
    return placed.repartition(group, "i", "j")  # the pairs of one group go to many tasks, however the group came here


def _round_links(sets: DataFrame, seed: int, percent: int) -> DataFrame:
    """Links between sets that share the round's minimum n-gram; a large group is cut into blocks by a hash."""
    drawn = F.array_min(F.transform("grams", lambda g: F.xxhash64(g, F.lit(seed))))
    keyed = sets.select("node", drawn.alias("key"), "grams")
    size = cut_lineage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum(F.size("grams")).alias("total")).where("size > 1").select("key", _blocks_of(F.col("size"), F.col("total")).alias("blocks")))
    block = F.pmod(F.xxhash64("node", F.lit(seed)), F.col("blocks")).cast("int")
    few = size.count() <= BROADCAST_NODES
    dealt = keyed.join(F.broadcast(size) if few else size, "key").select("key", block.alias("block"), "node", F.col("node").alias("label"), "grams", F.lit(0).alias("side"))
    dealt = dealt if few else dealt.repartition("key", "block")  # a join by key leaves a key's blocks in one task
    return dealt.groupBy("key", "block").applyInArrow(_block_links(percent), "a long, b long")


def _unsettled(sets: DataFrame, percent: int) -> DataFrame:
    """Sets of which enough n-grams occur under another label too: only they can have a link that joins two labels."""
    posts = sets.select("node", "label", F.explode("grams").alias("gram"))
    mixed = cut_lineage(posts.groupBy("gram").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("gram"))
    hits = posts.select("node", "gram").join(mixed, "gram").groupBy("node").agg(F.count(F.lit(1)).alias("hits"))
    return sets.join(hits, "node").where(F.col("hits") * 100 >= F.col("n") * percent).drop("hits")


def _last_links(sets: DataFrame, percent: int) -> DataFrame:
    """Every link that joins two labels of ``sets``.

    Two linked sets share one of the first ``slack + 1`` n-grams in order of frequency. Sets that share one go to one family. A family of several blocks
    is dealt out to pairs of its blocks; one of more than ``FAMILY_BLOCKS``, and of more than its sets have rare n-grams, to those n-grams, and each
    of them to pairs of blocks.
    """
    slack_of = F.col("n") - F.floor((F.col("n") * percent + 99) / 100)
    posts = sets.select("node", "label", "n", F.explode("grams").alias("gram"))
    freq = cut_lineage(posts.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), (F.min("label") != F.max("label")).alias("mixed")))
    ranked = cut_lineage(posts.join(freq, "gram").withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("df", "gram"))))
    prefix = ranked.where((F.col("rank") <= slack_of + 1) & F.col("mixed"))
    ties = prefix.groupBy("gram").agg(F.min("node").alias("hub"))
    edges = cut_lineage(prefix.select("node", "gram").join(ties, "gram").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    touched = edges.where("a <> b")
    family = components(touched.select(F.col("a").alias("node")).unionByName(touched.select(F.col("b").alias("node"))).distinct(), touched).withColumnRenamed("label", "family")
    listed = ranked.groupBy("node").agg(F.any_value("label").alias("label"), F.any_value("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("x"))
    ordered = cut_lineage(listed.join(family, "node").select("node", "label", "n", "family", F.col("x.gram").alias("grams"), F.col("x.df").alias("dfs")))
    few = F.col("blocks") <= F.greatest(F.lit(FAMILY_BLOCKS), F.col("rare"))
    blocks = cut_lineage(ordered.groupBy("family").agg(_blocks_of(F.count(F.lit(1)), F.sum("n")).alias("blocks"), (F.avg(slack_of) + 1).alias("rare")))
    links = [_placed(ordered.join(blocks.where(few), "family"), "family").groupBy("family", "i", "j").applyInArrow(_block_links(percent), "a long, b long")]
    large = blocks.where(~few)
    if not large.isEmpty():
        mine = ordered.join(large.select("family"), "family", "left_semi")
        rare = prefix.join(mine.select("node"), "node", "left_semi").select("node", "n", "gram", "label")
        shared = rare.groupBy("gram").agg(_blocks_of(F.count(F.lit(1)), F.sum("n")).alias("blocks"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("gram", "blocks")
        dealt = rare.select("node", "gram").join(shared, "gram").join(mine, "node")
        links.append(_placed(dealt, "gram").groupBy("gram", "i", "j").applyInArrow(_block_links(percent), "a long, b long"))
    return reduce(DataFrame.unionByName, links)


def _linked(docs: DataFrame, width: int, percent: int, share: int, rounds: int) -> DataFrame:
    """``digest, label`` of the sets that have links; ``label`` is the same for all sets that are reachable."""
    kept = cut_lineage(_shared_enough(_sets(docs, width, percent, share, "first").select("node", "n", "grams"), percent, share))
    again = _sets(docs, width, percent, share, "all").where("node is not null").select("node", "digest", "n", "grams")
    if kept.count() <= BROADCAST_NODES:
        kept = F.broadcast(kept)
    sets = again.join(kept, "node", "left_semi").groupBy("digest").agg(F.max("n").alias("n"), F.any_value("grams").alias("grams"))
    sets = cut_lineage(sets.withColumn("node", F.monotonically_increasing_id()))  # the whole digest tells sets apart
    links = cut_lineage(reduce(DataFrame.unionByName, [_round_links(sets, seed, percent) for seed in range(rounds)]))
    labels = components(sets.select("node"), links)
    rest = cut_lineage(_unsettled(sets.select("node", "n", "grams").join(labels, "node"), percent))
    links = links.unionByName(cut_lineage(_last_links(rest, percent)))
    touched = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    return sets.select("node", "digest").join(components(touched, links), "node").select("digest", "label")


def join_sets(docs: DataFrame, width: int = 3, percent: int = 90, share: int = 100, rounds: int = ROUNDS) -> DataFrame:
    """``place, n, first, size`` of every row of ``docs (place, text)``: of the rows that are reachable by links, the smallest place and the number.

    Rows without a link or copy, and those without an n-gram, have no ``first`` and ``size``. Places are counted per set before they are joined. A text
    with very many copies is joined by broadcast.
    """
    members = cut_lineage(_sets(docs, width, percent, share, "none").select("place", "n", "digest"))
    own = members.where("digest is not null").groupBy("digest").agg(F.min("place").alias("low"), F.count(F.lit(1)).alias("copies"))
    own = cut_lineage(own.join(_linked(docs, width, percent, share, rounds), "digest", "left"))
    linked = own.where("label is not null")
    ends = cut_lineage(linked.groupBy("label").agg(F.min("low").alias("first"), F.sum("copies").alias("size")))
    alone = own.where("label is null and copies > 1").select("digest", "copies", F.col("low").alias("first"), F.col("copies").alias("size"))
    named = cut_lineage(linked.join(ends, "label").select("digest", "copies", "first", "size").unionByName(alone))
    return join_copies(members, named, "digest").drop("digest")


def classes(docs: DataFrame, width: int = 3, percent: int = 90, share: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document, linked where 100 x intersection >= ``percent`` x union.

    ``component_id`` is the smallest id reachable by links, the own one included. Empty and null texts have no n-gram and no link. Null ids count as
    smaller than none: a component of null ids only has the id null. Repeated rows give repeated results; other columns are not read.
    """
    found = join_sets(docs.select(F.col("doc_id").alias("place"), "text"), width, percent, share)
    return found.select(F.col("place").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("first", "place").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, share: int = 40) -> DataFrame:
    """The rows of ``docs``, same columns, of which one of each group of linked texts stays: that of the smallest id.

    A null id comes after all others. Rows are told apart by id and text: another text of the same id is no part of the group. Of texts of one id in one
    group the smallest by hash stays, of rows equal in id and text the smallest in all columns. Texts without an n-gram are in no group and stay.
    """
    rid = F.xxhash64("doc_id", "text")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", rid.alias("rid"))
    found = join_sets(docs.select(place.alias("place"), "text"), width, percent, share).where("size > 1")
    found = found.groupBy("place").agg(F.any_value("first").alias("first"), F.count(F.lit(1)).alias("copies"))
    found = cut_lineage(found.select(F.col("place.doc_id").alias("__id"), F.col("place.rid").alias("__rid"), F.expr("place <> first").alias("gone"), "copies"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (rid == F.col("__rid"))

    def few(ids: DataFrame) -> DataFrame:
        ids = ids.select("__id", "__rid")
        return F.broadcast(ids) if ids.count() <= BROADCAST_NODES else ids

    names = [F.col(f"`{c}`") for c in docs.columns]
    left = docs.join(few(found.where("gone")), same, "left_anti")
    copied = found.where("not gone and copies > 1")
    if copied.isEmpty():
        return left.select(*names)
    copied = few(copied)
    one = left.join(copied, same, "left_semi").groupBy("doc_id", rid.alias("__rid")).agg(F.min(F.struct(*names)).alias("row"))
    return left.join(copied, same, "left_anti").select(*names).unionByName(one.select("row.*"))
