"""Toxicity: a counterfactually regularised linear classifier.

Logistic regression on the words of a text and their beginnings. Wherever a sentence of a labelled text names groups of people, a copy
names other groups instead; the fit pays for every difference between the scores of the two, so that a neutral mention of
a group does not count as toxic. What the two share cancels, so that a pair is what the swap removes and what it adds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, held_out, small_batches

#: Bound of the training sample: rows of each class, chosen by hash of the id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 5_000, 10_000
#: Features that the fit considers, most telling first, and documents of the sample that one must occur in.
MOST_FEATURES, LEAST_DOCS = 4_000, 4
#: Different swaps that the penalty considers, most frequent first.
MOST_SWAPS = 50_000
#: Length of the word beginnings that are features besides the words.
PREFIX = 4
#: Weights of the counterfactual penalty and of the L1 and L2 penalties, and the steps of the fit.
CF_WEIGHT, L1, L2, STEPS = 4.0, 1e-4, 1e-4, 300

#: Terms for groups of people, a list for each set of terms that may stand for one another; fixed values.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("she", "he"), ("her", "his"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("africans", "europeans", "americans", "asians"), ("immigrants", "citizens", "refugees"), ("old", "young"), ("disabled", "deaf", "blind"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"), ("muslime", "christen", "juden"), ("musulmans", "chrétiens", "juifs"), ("musulmanes", "cristianos", "judíos"),
)

WORDS = re.compile(r"[^\W\d_]+")
#: Where a sentence ends.
SENTENCE = re.compile(r"[.!?。！？]+\s|\n")


def word_set(text: str) -> set[str]:
    return set(WORDS.findall(text.lower()))


def feature_names(words: set[str]) -> set[str]:
    """The words, and the beginnings of longer ones, marked by a hyphen."""
    return words | {w[:PREFIX] + "-" for w in words if len(w) >= PREFIX}


def hashed(names: set[str]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.sort(np.fromiter((xxh3_64_intdigest(n) for n in names), np.uint64, len(names))).astype(np.int64)


def swaps(text: str, terms=IDENTITY_TERMS) -> list[tuple[set[str], set[str]]]:
    """For every sentence that names groups: the features that it loses and gains if each group term gives way to the next of its list.

    All terms of a sentence change at once: "she saw him and her" says "he" where it said "she", and "his" where it said "her". A sentence
    whose words are the same afterwards, as where all terms of a list are named, is left out.
    """
    to = {term: group[(k + 1) % len(group)] for group in terms for k, term in enumerate(group)}
    low, out = text.lower(), []
    if not any(t in low for t in to):
        return out
    for sentence in SENTENCE.split(low):
        words = WORDS.findall(sentence)
        if any(w in to for w in words):
            mine, other = feature_names(set(words)), feature_names({to.get(w, w) for w in words})
            if mine != other:
                out.append((mine - other, other - mine))
    return out


@dataclass
class Model:
    """Weights by hashed feature and a bias; ``scores`` takes word sets."""

    bias: float
    weights: dict[int, float] = field(default_factory=dict)

    def margin(self, words: set[str]) -> float:
        from xxhash import xxh3_64_intdigest

        get = self.weights.get
        return self.bias + sum(get(xxh3_64_intdigest(n), 0.0) for n in feature_names(words))

    def score(self, text: str | None) -> float:
        m = self.margin(word_set(text)) if text else self.bias
        return float(1 / (1 + np.exp(-np.clip(m, -40, 40))))


def _solve(y: np.ndarray, own: tuple, gains: tuple, losses: tuple, times: np.ndarray, known: np.ndarray, cf_weight: float) -> Model:
    """Weights of the features ``known``, by accelerated proximal gradient steps. ``own``: row and column of every feature of a text; ``gains`` and
    ``losses``: of every swap, which occurs ``times``. With one class only, or none, the model is a constant."""
    n, d, pos = len(y), len(known), float(y.sum())
    if n == 0 or pos in (0.0, float(n)):
        return Model(float(np.log((pos + 0.5) / (n - pos + 0.5))))
    (row, col), (arow, acol), (brow, bcol), m = own, gains, losses, len(times)
    dear = 2 * cf_weight * times / max(times.sum(), 1)  # what a unit of each swap's gap costs
    share = np.where(y > 0, 0.5 / pos, 0.5 / (n - pos))  # both classes weigh the same

    def smooth(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        z = np.bincount(row, weights=w[col], minlength=n) + b
        r = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        g = np.bincount(col, weights=r[row], minlength=d) + L2 * w
        if m:
            gap = np.bincount(arow, weights=w[acol], minlength=m) - np.bincount(brow, weights=w[bcol], minlength=m)
            gap *= dear
            g += np.bincount(acol, weights=gap[arow], minlength=d) - np.bincount(bcol, weights=gap[brow], minlength=d)
        return g, float(r.sum())

    v, curvature = np.full(d + 1, 1.0), 1.0
    for _ in range(12):  # the largest curvature, by power iteration
        z = np.bincount(row, weights=v[col], minlength=n) + v[d]
        u = np.append(np.bincount(col, weights=(0.25 * share * z)[row], minlength=d), (0.25 * share * z).sum())
        if m:
            gap = dear * (np.bincount(arow, weights=v[acol], minlength=m) - np.bincount(brow, weights=v[bcol], minlength=m))
            u[:d] += np.bincount(acol, weights=gap[arow], minlength=d) - np.bincount(bcol, weights=gap[brow], minlength=d)
        curvature = float(np.linalg.norm(u)) or 1.0
        v = u / curvature
    step = 1 / (1.1 * curvature + L2)
    w, b, wy, by, t = np.zeros(d), 0.0, np.zeros(d), 0.0, 1.0
    for _ in range(STEPS):
        g, gb = smooth(wy, by)
        w1, b1 = wy - step * g, by - step * gb
        w1 = np.sign(w1) * np.maximum(np.abs(w1) - step * L1, 0)
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        wy, by = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)
        w, b, t = w1, b1, t1
    keep = np.flatnonzero(w)
    return Model(b, dict(zip(known[keep].view(np.uint64).tolist(), w[keep].tolist(), strict=True)))


def learn(docs: DataFrame, labels: DataFrame, n_toxic: int = SAMPLE_TOXIC, n_clean: int = SAMPLE_CLEAN, terms=IDENTITY_TERMS, cf_weight: float = CF_WEIGHT) -> Model:
    """Fit on a bounded sample of the labelled documents that are not held out.

    Ids that have a label and a row are drawn by hash, at most ``n_toxic + n_clean`` of them; their texts are found by a broadcast of those ids, one
    text of each: of several, the smallest by hash. Features and swaps are counted by the executors; the driver gets the hashes of the most
    telling features and the most frequent swaps only. Labels that are null, or whose id is null, teach nothing; of several labels of an id the highest counts.
    """
    small_batches(docs.sparkSession)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    one = cut_lineage(docs.select("doc_id").distinct().join(one, "doc_id"))  # an id of very many rows is one before it is joined
    drawn = [one.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(k) for v, k in ((1, n_toxic), (0, n_clean))]
    ids = F.broadcast(drawn[0].unionByName(drawn[1]))
    found = docs.where("text is not null").select("doc_id", "text").join(ids, "doc_id")
    sample = found.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    hashes = cut_lineage(sample.mapInArrow(_hasher(terms), f"doc_id {kind}, toxic int, own array<long>, gains array<array<long>>, losses array<array<long>>"))
    known = np.array(sorted(r["f"] for r in _telling(hashes).collect()), dtype=np.int64)
    got = sorted(hashes.select("doc_id", "toxic", "own").mapInArrow(_narrower(known, 2), f"doc_id {kind}, toxic int, own binary").collect())
    pairs = hashes.select(F.explode(F.arrays_zip("gains", "losses")).alias("p")).select("p.gains", "p.losses").mapInArrow(_narrower(known, 0), "gains binary, losses binary")
    often = pairs.where("gains <> losses").groupBy("gains", "losses").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "gains", "losses").limit(MOST_SWAPS).collect()
    places = (_places([r[k] for r in rows]) for rows, k in ((got, "own"), (often, "gains"), (often, "losses")))
    return _solve(np.array([r["toxic"] for r in got], dtype=np.float64), *places, np.array([r["n"] for r in often], dtype=np.float64), known, cf_weight)


def _places(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of every feature of lists of 32-bit column numbers."""
    return np.repeat(np.arange(len(lists), dtype=np.int32), np.array([len(x) // 4 for x in lists], dtype=np.int64)), np.frombuffer(b"".join(lists), np.int32)


def _hasher(terms):
    """Hashed features of a text, and what the swaps of its sentences gain and lose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, gains, losses = [], [], []
            for text in batch.column(2).to_pylist():
                own.append(hashed(feature_names(word_set(text))))
                pairs = swaps(text, terms)
                losses.append([hashed(a).tolist() for a, _ in pairs])
                gains.append([hashed(b).tolist() for _, b in pairs])
            kind = pa.list_(pa.int64())
            lists = [pa.array(own, kind), pa.array(gains, pa.list_(kind)), pa.array(losses, pa.list_(kind))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["doc_id", "toxic", "own", "gains", "losses"])

    return run


def _telling(hashes: DataFrame) -> DataFrame:
    """The sample's most telling features ``f``: a large gap and a large ratio between the classes' document shares."""
    n, pos = hashes.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    seen = hashes.select("toxic", F.explode("own").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("df"), F.sum("toxic").alias("hit")).where(F.col("df") >= LEAST_DOCS)
    p, q = (F.col("hit") + 0.5) / (pos + 1), (F.col("df") - F.col("hit") + 0.5) / (n - pos + 1)
    gain = F.abs(F.log(p / q)) * F.abs(p - q)
    return seen.select("f", gain.alias("gain")).where("gain > 0").orderBy(F.col("gain").desc(), "f").limit(MOST_FEATURES)


def _narrower(known: np.ndarray, keep: int):
    """Of the lists after the first ``keep`` columns, the known features as bytes of 32-bit column numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def narrow(v) -> bytes:
            return np.flatnonzero(np.isin(known, v.values.to_numpy(zero_copy_only=False), assume_unique=True)).astype(np.int32).tobytes()

        for batch in batches:
            lists = [pa.array([narrow(v) for v in c], pa.binary()) for c in batch.columns[keep:]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *lists], names=batch.schema.names)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, from its whole ``text`` alone.

    A null or empty text gets the bias's score. Repeated rows give repeated results; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_scorer(model), f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            scores = pa.array([model.score(t.as_py()) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=[*batch.schema.names[:-1], "score"])

    return run


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, same columns."""
    small_batches(docs.sparkSession)
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    schema = T.StructType([T.StructField("row", packed.schema["row"].dataType), T.StructField("score", T.DoubleType())])
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([model.score(t.as_py()) for t in batch.column(0).field(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["row", "score"])

    return packed.mapInArrow(run, schema).where("score < 0.5").select(*[F.col(f"row.`{c}`").alias(c) for c in names])
