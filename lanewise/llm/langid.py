"""Language identification by compression: the language whose dictionary makes a text smallest.

Each language's dictionary is raw content taken from its own documents, given to zstandard ahead of a block of text. The whole
text is compressed in blocks, as a dictionary helps only near a frame's start.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import held_out, small_batches

#: Bound of the training sample: rows per language, code points of each that go to the dictionary, bytes of a dictionary.
SAMPLE_ROWS, SAMPLE_CHARS, DICT_BYTES = 400, 1_000, 112_640
#: Languages that are learned at most: so many coders every worker holds.
LANGUAGES = 500
#: Bytes of all dictionaries together, which every executor holds: of more than 200 languages each has an equal share.
ALL_BYTES = 200 * DICT_BYTES
BLOCK_BYTES, LEVEL = 1_000, 5
#: Relative margin to the second language under which a prediction is marked as rejected.
MARGIN = 0.02


def sample_texts(docs: DataFrame, rows: int = SAMPLE_ROWS) -> dict[str, list[str]]:
    """Up to ``rows`` different texts of each language, the smallest by a hash of the id and text, from documents that are not held out and have a letter.

    Of more than ``LANGUAGES`` languages the most frequent are learned. Two reads of the corpus for any number of them. How many different hashes a language has comes first, so that they
    can be thinned before they are ranked: repeated rows are one, and no language is thinned to nothing. What reaches the driver is one count and up to ``rows`` x
    ``SAMPLE_CHARS`` for each. A long text gives a stretch that starts at a hash-random place, or its first letters if there are none.
    """
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    h = F.xxhash64("doc_id", "text")
    distinct = known.select("lang", h.alias("h")).distinct().groupBy("lang").count()
    counts = {r["lang"]: r["count"] for r in distinct.orderBy(F.col("count").desc(), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return {}
    rows = max(1, min(rows, ALL_BYTES // len(counts) // 250))
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, 4.0 * rows / n)) for k, n in counts.items()], "lang string, share double")
    start = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1)).cast("long")) + 1
    thin = known.join(F.broadcast(shares), "lang").where(F.pmod(h, F.lit(1_000_003)) < F.col("share") * 1_000_003)
    stretch = F.coalesce(_letters(F.substr("text", start.cast("int"), F.lit(SAMPLE_CHARS))), F.substring(F.trim(_letters(F.col("text"))), 1, SAMPLE_CHARS))
    parts = thin.select("lang", h.alias("h"), stretch.alias("part")).groupBy("lang", "h").agg(F.min("part").alias("part"))
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "part"))).where(F.col("rank") <= rows)
    out: dict[str, list[str]] = {k: [] for k in sorted(counts)}
    for r in sorted(ranked.collect(), key=lambda r: r["rank"]):
        out[r["lang"]].append(r["part"])
    return out


def dictionaries(samples: dict[str, list[str]], size: int = DICT_BYTES) -> dict[str, bytes]:
    """Raw content per language: up to ``size`` bytes of its own sample, however little the other languages have.

    A small dictionary is at no advantage: what it does not hold has to be spelt out. All together have up to ``ALL_BYTES``.
    """
    raw = {k: "\n".join(v).encode() for k, v in samples.items()}
    size = min(size, ALL_BYTES // max(len(raw), 1))
    return {k: v[-size:] for k, v in raw.items() if v}


def predict(docs: DataFrame, dicts: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every row; only ``text`` decides.

    ``score`` is 1 - e^(-20 m), m the saving over the second smallest language; ``rejected`` where m is under ``margin``: the prediction stands but
    should not be relied on. A null text or one without a letter is ``und`` with score 0, rejected; so is every text if no language was learned.
    Repeated rows give repeated results.
    """
    small_batches(docs.sparkSession)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), _letters(F.col("text")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return out.mapInArrow(_predictor(dicts, margin), f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def _letters(text: Column) -> Column:
    """The text as the coders see it: lower case, letters and single spaces; null without a letter."""
    return F.when(text.rlike(r"\p{L}"), F.lower(F.regexp_replace(text, r"[^\p{L}\p{M}]+", " ")))


def _predictor(dicts: dict[str, bytes], margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import math

        import zstandard as zstd

        langs = sorted(dicts)
        params = zstd.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
        coders = []
        for k in langs:
            d = zstd.ZstdCompressionDict(dicts[k], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            coders.append(zstd.ZstdCompressor(dict_data=d, compression_params=params).compress)
        for batch in batches:
            preds, scores, rejected = [], [], []
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                if text is None or not langs:
                    preds.append("und"), scores.append(0.0), rejected.append(True)
                    continue
                data = text.encode()
                blocks = [data[k : k + BLOCK_BYTES] for k in range(0, len(data), BLOCK_BYTES)]
                sizes = [sum(len(c(b)) for b in blocks) for c in coders]
                best = min(range(len(langs)), key=sizes.__getitem__)
                second = min((s for j, s in enumerate(sizes) if j != best), default=2 * sizes[best])
                saved = 1 - sizes[best] / second
                preds.append(langs[best]), scores.append(1 - math.exp(-20 * saved)), rejected.append(saved < margin)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame) -> DataFrame:
    """Learn the dictionaries from the documents that are not held out and predict all of them."""
    return predict(docs, dictionaries(sample_texts(docs)))
