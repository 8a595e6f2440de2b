"""A corpus pipeline: toxic documents go, repeated lines go, one of each near-duplicate group stays, sources are mixed, texts are encoded.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns a DataFrame; all but the last return
the columns of ``documents``. Stages are written as Parquet and read again by whoever runs them one by one; ``run`` chains them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lanewise.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from lanewise.llm.common import cut_lineage, read_table
from lanewise.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from ``labels``, predicts toxic are rejected."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, read_table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template an earlier document has are dropped; every document stays."""
    return line_dedup.dedup_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles have a Jaccard similarity of 0.8 or more, the one with the smallest id of each group stays."""
    return ngram_join.keep_one(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; small ones are repeated, up to three times."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids, decoded`` of every document of the mix."""
    return bpe.encode(docs, tokenizer_path(), keep=("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("mixing", mix),
    ("bpe", encode),
]

#: The first stage is a trained classifier, which SQL cannot express; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder before the next reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else cut_lineage(docs), sf_dir)
    return docs
