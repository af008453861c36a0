"""The corpus pipeline: documents in, packed sequences out, each stage written and read again by the next.

A stage takes (spark, docs, sf_dir). All but the last return the columns of documents, extra columns included. An
empty table passes through every stage as one; texts are read whole, however long. What each stage does with nulls,
empty texts, repeated rows and ties is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orebed.llm import decontam, langid, line_dedup, minhash, packing
from orebed.llm.common import table
from orebed.storage import forget, materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; null, empty and letterless texts go, repeated rows and a null doc_id are judged by their text."""
    return langid.keep_known(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later ones of fuzzy duplicate lines, by doc_id and line number.

    Null, empty and blank texts stay; a document that loses all its lines goes; repeated rows of a doc_id lose the
    same lines; rows with a null doc_id stay whole.
    """
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, similarity 0.8): the smallest doc_id.

    Texts without a word and rows with a null doc_id stay; rows that repeat a kept doc_id all stay.
    """
    return minhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, a null or empty item is in none."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of what is left; a null text is empty, each row is a document of its own."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("packing", packed)]

#: SQL can express none of these methods; a test holds each stage, on its own input, against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; every stage but the last is written and read again, then forgotten."""
    docs, written = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(spark, *written)
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
