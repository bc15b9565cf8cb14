"""A training corpus from raw documents: quality rules, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what a stage returns is written as
Parquet and read again before the next. All but the last return the columns of documents.

Defined results, for every stage: rows with null ids take part and stay or go by their text; texts of any length are read
whole; further columns pass through all stages but the last, whatever their names; an empty table stays empty. Each stage
states what it does with null and empty texts, ties and repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from itemloom.llm import packing, pii, quality, simhash, suffix
from itemloom.llm.common import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the tokeniser's fertility bands reject go.

    Null and empty texts have no words, so they go; a measure that equals a bound is inside; repeated rows are judged alike.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are near copies (five-word shingles, Jaccard 0.8), the one with the least id stays.

    Null and empty texts are copies of each other; between equal ids the least hash of the text decides, a row without an id
    comes last; of repeated rows one stays.
    """
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier go; what else a document holds stays.

    Earlier is a smaller id, or an earlier place in the same text. Null texts stay null, no row goes; repeated rows are one
    document and lose the same passages.
    """
    return suffix.remove_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the names of their kinds.

    Null texts stay null; of spans that overlap all characters are masked; repeated rows are masked alike.
    """
    return pii.mask_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its place in a sequence.

    A null or empty text is a document of the one end id; pieces of one length are packed in the order of their rows, repeated
    rows like any others.
    """
    return packing.op9(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("pii", personal_data),
    ("best-fit packing", packed),
]

#: Fingerprints, components, tokens and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
