"""From raw documents to packed training sequences, in stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of documents. In every stage nulls may stand in any column, texts may be empty or very long and are read whole, repeated
rows and ties give the same result in a rerun, an empty table gives an empty one, and other columns pass through whatever
their names are; what a null or empty text means is said at each stage. Between stages the rows are written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import jaccard, mixing, packing, quality, secrets
from tidewater.llm.common import stage, table


def counted(docs: DataFrame) -> DataFrame:
    """n_chars again the length of the text, where a stage has changed texts."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the current policy rejects; a null or empty text has too few words and goes."""
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of exact and near copies, that of the least doc_id (null ids last); a null text is
    a copy of nothing but rows that repeat it with its doc_id."""
    return jaccard.one_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; keeps all documents, null texts as they are."""
    return counted(secrets.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (null sources are one source); one document of a source at most is taken
    in part, with its first words. A text without words is taken as often as its source is taken whole."""
    return counted(mixing.mixed(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents by sequence and offset; a null text packs its end id."""
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL can't express the join's components and the tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
