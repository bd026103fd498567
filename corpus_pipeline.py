"""From raw documents to packed training sequences, in five stages.

Each stage takes the session, the documents its predecessor kept and the folder
of the tables, and returns documents with the same columns; the last returns
packed pieces. Between stages everything is written to the shared folder and
read again, so a lost executor costs a part of one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import decontaminate, packing, pseudonyms, quality, simhash
from tidegauge.llm.common import table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this stage's input, takes for neither broken nor abusive."""
    return quality.kept(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (three-word SimHashes two bits apart at most) the document with the smallest id."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms of the same format."""
    return pseudonyms.replaced(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 2048 tokens."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), spaced=True, end_id=1)


STAGES = [
    ("quality classifier", good_quality),
    ("near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("PII pseudonyms", pseudonymous),
    ("packing", packed_sequences),
]

#: Trained scorers, keyed permutations and tokenizers are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
