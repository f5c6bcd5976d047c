"""From raw documents to tokens: toxic documents go, repeated lines go, one of each group of near copies stays, sources are mixed to their targets, and what is left is encoded.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns the next stage's docs, with the columns of documents; the last returns a row for each text of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import bpe, lines, mixing, ngram_join, toxicity
from tesserae.llm.common import saved, table
from tesserae.llm.queries import vocabulary

#: Words of a shingle and least Jaccard similarity, in hundredths, of the near-duplicate stage.
SHINGLE, HUNDREDTHS = 5, 80


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that a model of the labelled ones rejects."""
    return toxicity.clean(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut runs of three lines that stand earlier too; a document of which nothing is left goes."""
    return lines.without_repeats(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity keep the one with the lowest doc_id."""
    return ngram_join.representatives(docs, SHINGLE, HUNDREDTHS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its source's target asks."""
    return mixing.copies_of(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode, and decode again: token ids and decoded text of each."""
    return bpe.encoded(docs, vocabulary(), with_ids=True, with_text=True)


STAGES = [("toxicity", toxic), ("line dedup", repeated_lines), ("n-gram Jaccard join", near_copies), ("mixing sources to target weights", mix), ("BPE encoding and decoding", tokens)]
#: A learnt model is beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one returns is written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage{k}")
    return docs
