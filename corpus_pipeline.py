"""Corpus pipeline: language ID, near duplicates, decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; extra columns are carried along. An empty table gives an
empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontamination, jaccard_join, language_id, packing, pii
from textloom.llm.shared import materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is recognised go: null texts, texts without a letter, and texts whose best language
    scores below what labelled documents outside the training fold do. Repeated rows are judged alike."""
    return language_id.keep_identified(docs, language_id.fit(docs, noise=True))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingle sets of similarity 0.8 or more, one row stays, that of the smallest doc_id
    (a null is the largest). Repeated rows stay once; texts without words are linked with nothing."""
    return jaccard_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; null texts hold none. Repeated rows are judged alike."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text is replaced by its kind in brackets; null texts stay null; every row stays."""
    return pii.redact_texts(docs, pii.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, each with its place in a packed sequence; a null text is its closing id alone, and
    repeated rows are packed each."""
    return packing.pack(materialize(packing.pieces(docs), "pieces"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("PII", redact),
    ("packing", pack),
]

#: The trained network, the field and the tokenizer have no SQL form; a test holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each returns is written before the next reads it."""
    out = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, out, sf_dir)
        if name != STAGES[-1][0]:
            out = materialize(out, "stage")
    return out
