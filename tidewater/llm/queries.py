"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.pii(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    return secrets.secrets(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    return langid.identify(table(spark, sf_dir, "documents"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    return lm.perplexities(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_files

    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.judged(quality.ledger(table(spark, sf_dir, "documents")))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk

    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_secrets, op3_language, op4_lm, op5_token_files, op6_jaccard, op7_packing, op8_quality, op9_topk, op10_mixing)
}
