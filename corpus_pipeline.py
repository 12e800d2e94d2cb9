"""A training corpus from raw documents: five stages, each written as Parquet and read again.

Each stage is (name, function); the function takes (spark, docs, sf_dir) and returns the next docs. All but
the last return the columns of documents. Every stage takes null ids and texts, empty texts, repeated ids
and rows, and empty tables; what it does with them is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakewright.llm import decontamination, paragraphs, quality, sentencepieces, simhash
from lakewright.llm.common import table, written
from lakewright.llm.queries import model_path
from lakewright.llm.training import remainder


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field accepts; it learns from the labels outside the held-out part.

    Each row is judged by its own text; a null or empty text is one empty line.
    """
    labels = table(spark, sf_dir, "labels")
    return quality.accepted(docs, quality.fit(docs, labels, remainder("doc_id", 5) != 0))


def one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints of five-word shingles that agree in 62 of
    64 bits (a similarity of 0.97), and what they connect.

    The smallest doc_id stays, rows without one come last; null and wordless texts are copies of each other.
    """
    return simhash.one_of_each(docs, size=5)


def without_repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each repeated line or passage stays in one document.

    Null and empty texts stay; a document of which nothing is left goes; rows without a doc_id are told
    apart by their texts.
    """
    return paragraphs.without_repeats(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; null and empty texts hold none."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with their digests; a null text counts as empty."""
    return sentencepieces.encode(docs, model_path(), keep_ids=True).drop("decoded")


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_near_copy),
    ("substring dedup", without_repeated_paragraphs),
    ("benchmark decontamination", uncontaminated),
    ("SentencePiece encoding", encoded),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, written(docs) if k else docs, sf_dir)
    return docs
