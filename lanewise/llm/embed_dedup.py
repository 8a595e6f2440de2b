"""Embedding near-dedup with spherical-cap filters.

Filters are the directions of a random product code: the space is turned by a random rotation and cut into blocks, each block has a codebook of
unit vectors, and a filter is one codeword of each block. A vector is list-decoded to every filter whose inner product exceeds a
bound, and to a few nearest ones at least. Vectors meet at shared filters, where they are verified in double precision. The number of blocks and of
codewords follows from the number of vectors, so that a filter holds equally many at every size.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut_lineage, join_copies, small_batches
from .ngram_join import forest

#: Filters a vector falls into on average, and at least; vectors per filter that the code's size aims at.
LIST, LEAST, PER_FILTER = 24, 20, 400
#: Codewords of one block; a code that needs more has another block.
MOST_WORDS = 2048
#: Vectors verified at once; larger filters are split into pairs of blocks. Filters that are compared at once.
BLOCK, COLUMNS = 1024, 4096


def code_size(n: int) -> tuple[int, int]:
    """Blocks and codewords per block for ``n`` vectors: as many filters as give ``PER_FILTER`` vectors to each."""
    filters = n * LIST / PER_FILTER
    blocks = 2
    while MOST_WORDS**blocks < filters:
        blocks += 1
    return blocks, int(max(16, filters ** (1 / blocks)))


def codebooks(dim: int, words: int, blocks: int = 2, seed: int = 7) -> np.ndarray:
    """The blocks' codebooks as rows of full length, rotated: ``blocks x words x dim``. A block without coordinates is all zeros."""
    rng = np.random.default_rng([seed, dim, words])
    turn, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    out = np.zeros((blocks, words, dim))
    for k, part in enumerate(np.array_split(np.arange(dim), blocks)):
        if len(part):
            book = rng.standard_normal((words, len(part)))
            out[k][:, part] = book / np.linalg.norm(book, axis=1, keepdims=True)
    return out @ turn


def list_decode(unit: np.ndarray, books: np.ndarray, aim: int = LIST, least: int = LEAST) -> list[np.ndarray]:
    """Ascending filter ids of every row of ``unit``: all with an inner product above the bound that ``aim`` random filters exceed, or the ``least`` best.

    Block by block the codewords are put together; what cannot exceed the bound with the best codewords of the blocks to come is left, but for
    the best so far.
    """
    blocks, words, dim = books.shape
    bound = NormalDist().inv_cdf(1 - min(0.5, aim / words**blocks)) * np.sqrt(blocks / dim)
    scores = [unit @ book.T for book in books]
    top, out = min(words, 4 * least), []
    for rows in zip(*scores, strict=True):
        best = [float(r.max()) for r in rows]
        total, ids = np.zeros(1), np.zeros(1, np.int64)
        for k, r in enumerate(rows):
            own = np.argpartition(-r, top - 1)[:top] if top < words else np.arange(words)
            own = np.union1d(own, np.flatnonzero(r > bound - (sum(best) - best[k])))
            total, ids = (total[:, None] + r[own][None, :]).ravel(), (ids[:, None] * words + own[None, :]).ravel()
            if k < blocks - 1 and len(total) > top:
                able = total + sum(best[k + 1 :]) > bound
                able[np.argpartition(-total, top - 1)[:top]] = True
                total, ids = total[able], ids[able]
        hit = total > bound
        if hit.sum() < least:
            hit = np.argpartition(-total, min(least, len(total)) - 1)[:least]
        out.append(np.sort(ids[hit]))
    return out


def _units(raw: list[bytes], single: bool) -> np.ndarray:
    """Unit vectors in double precision of vectors of one length, stored as single or double floats."""
    x = np.frombuffer(b"".join(raw), np.float32 if single else np.float64).astype(np.float64).reshape(len(raw), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _vectors(table: DataFrame, single: bool) -> DataFrame:
    """``vec_id, dim, digest``, and the vector as bytes in ``raw``; digest (of the direction, 128 bits) and raw null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            digests, raws, dims = [], [], []
            for v in batch.column(1).to_pylist():
                raw = digest = None
                if v and None not in v:
                    x = np.array(v, np.float32 if single else np.float64)
                    if np.isfinite(x).all() and x.any():
                        raw = x.tobytes()
                        digest = xxh3_128_digest((_units([raw], single) + 0.0).tobytes())  # -0.0 is 0.0
                raws.append(raw)
                digests.append(digest)
                dims.append(len(v) if v else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(raws, pa.binary())], names=["vec_id", "dim", "digest", "raw"])

    kind = table.schema["vec_id"].dataType.simpleString()
    return table.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, dim int, digest binary, raw binary")


def _filters(blocks: int, words: int, single: bool):
    """The filters of every vector, in the last column."""
    small = words**blocks < 2**31

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                dims = piece.column("dim").to_numpy()
                lists: list[np.ndarray] = [np.zeros(0, np.int64)] * piece.num_rows
                raw = piece.column("raw").to_pylist()
                for dim in np.unique(dims).tolist():
                    if dim not in books:
                        books[dim] = codebooks(dim, words, blocks)
                    at_dim = np.flatnonzero(dims == dim)
                    for k, found in zip(at_dim, list_decode(_units([raw[i] for i in at_dim], single), books[dim]), strict=True):
                        lists[k] = found
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                flat = pa.array(np.concatenate(lists).astype(np.int32 if small else np.int64))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.ListArray.from_arrays(pa.array(offsets), flat)], names=[*piece.schema.names, "filters"])

    return run, f"filters array<{'int' if small else 'long'}>"


def _verify(threshold: float, single: bool):
    """Links of a pair of blocks at one filter, each pair at its smallest shared filter only: degrees and a spanning forest."""
    empty = pa.table({k: pa.array([], pa.int64()) for k in ("a", "b", "w")})

    def run(table: pa.Table) -> pa.Table:
        here, side = table.column("filter")[0].as_py(), table.column("side").to_numpy()
        diagonal = table.column("i")[0] == table.column("j")[0]
        left = np.flatnonzero(side == 0)
        right = left if diagonal else np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return empty
        units = _units(table.column("raw").to_pylist(), single)
        near = units[left] @ units[right].T >= threshold
        if diagonal:
            near = np.triu(near, 1)
        rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if not len(rows):
            return empty
        close, involved = near[np.ix_(rows, columns)], np.zeros(len(side), bool)
        involved[left[rows]] = involved[right[columns]] = True
        lists = table.column("filters").combine_chunks()
        flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(side)), lists.value_lengths().to_numpy())
        earlier = (flat < here) & involved[owner]
        flat, owner = flat[earlier], owner[earlier]
        _, place, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times[place] > 1  # filters that several of them are in
        owner, place = owner[shared], (np.cumsum(times > 1) - 1)[place[shared]]
        order = np.argsort(place, kind="stable")
        owner, place, most = owner[order], place[order], int((times > 1).sum())
        for at in range(0, most, COLUMNS):
            lo, hi = np.searchsorted(place, (at, at + COLUMNS))
            marks = np.zeros((len(side), min(COLUMNS, most - at)), np.float32)
            marks[owner[lo:hi], place[lo:hi] - at] = 1
            close &= ~(marks[left[rows]] @ marks[right[columns]].T > 0)
        if not close.any():
            return empty
        near[np.ix_(rows, columns)] = close
        nodes, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        weight = np.zeros(len(side), np.int64)
        weight[left] += near @ copies[right]
        weight[right] += copies[left] @ near
        i, j = np.nonzero(near)
        kept = forest(len(side), zip(left[i].tolist(), right[j].tolist(), strict=True))
        has = np.flatnonzero(weight)
        return pa.table(
            {
                "a": pa.array([*nodes[has].tolist(), *[int(nodes[x]) for x, _ in kept]], pa.int64()),
                "b": pa.array([*[None] * len(has), *[int(nodes[y]) for _, y in kept]], pa.int64()),
                "w": pa.array([*weight[has].tolist(), *[0] * len(kept)], pa.int64()),
            }
        )

    return run


def near_duplicates(table: DataFrame, threshold: float = 0.95, code: tuple[int, int] | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vec_id, embedding``.

    Two vectors of equal length link when they are found and their cosine is at least ``threshold``. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing. Vectors of one direction are one node with its number of copies, so that copies cost no
    pairs. ``component_id`` is the smallest id reachable, the own one included; ``kept`` where it is the own one. Rows with one id are
    different vectors. ``code``: blocks and codewords of a block; by default as many as give ``PER_FILTER`` vectors a filter. Vectors travel in the
    precision of the column, and are made unit vectors in double precision where they are compared.
    """
    small_batches(table.sparkSession)
    single = isinstance(table.schema["embedding"].dataType.elementType, T.FloatType)
    rows = cut_lineage(_vectors(table, single))
    own = rows.where("digest is not null").groupBy("digest", "dim").agg(F.any_value("raw").alias("raw"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low"))
    nodes = cut_lineage(own.withColumn("node", F.monotonically_increasing_id()))  # the whole digest tells directions apart
    blocks, words = code or code_size(nodes.count())
    run, filters = _filters(blocks, words, single)
    coded = cut_lineage(nodes.select("node", "dim", "copies", "raw").mapInArrow(run, f"node long, dim int, copies long, raw binary, {filters}"))
    posts = coded.select("node", "dim", F.explode("filters").alias("filter"))
    # one row per filter in use: bounded by the code's size times the vectors' lengths
    sizes = cut_lineage(posts.groupBy("dim", "filter").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("dim", "filter", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    dealt = posts.join(sizes, ["dim", "filter"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = other.select("node", "dim", "filter", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    full = placed.join(coded.select("node", "copies", "raw", "filters"), "node").select("dim", "filter", "i", "j", "side", "node", "copies", "raw", "filters")
    found = cut_lineage(full.groupBy("dim", "filter", "i", "j").applyInArrow(_verify(threshold, single), "a long, b long, w long"))
    degree = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("w"))
    labels = components(nodes.select("node"), found.where("b is not null").select("a", "b"))
    named = cut_lineage(nodes.select("node", "digest", "dim", "copies", "low").join(degree, "node", "left").join(labels, "node"))
    smallest = cut_lineage(named.groupBy("label").agg(F.min("low").alias("component_id")))
    n_links = (F.coalesce("w", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    ends = cut_lineage(named.join(smallest, "label").select("digest", "copies", n_links, "component_id"))
    out = join_copies(rows.select("vec_id", "digest"), ends, "digest")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
