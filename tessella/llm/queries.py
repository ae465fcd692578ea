"""The queries of this subpackage, each over its whole intended table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import load
from . import mixing, voronoi_knn
from .bpe_codec import bpe_digest
from .hilbert_shards import shard_documents
from .html_tree import main_text
from .langid import language_digest
from .lbl_lm import lm_digest
from .quality_forest import quality_digest
from .simhash import simhash_digest
from .token_output import token_output


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as Simple-8b token ids and read back."""
    return token_output(load(spark, sf_dir, "documents"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded by per-prefix dynamic programming and decoded."""
    return bpe_digest(load(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by segmentation-marginalised unigrams."""
    return language_digest(load(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of every document and their components by pigeonring filtering."""
    return simhash_digest(load(spark, sf_dir, "documents"))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 runs of the Hilbert curve over size, script and word density."""
    return shard_documents(load(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics of every document and an isolation forest's verdict."""
    return quality_digest(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by message passing on its tree."""
    return main_text(load(spark, sf_dir, "pages"))


def op8_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest inner products of every 50th vector with all others."""
    return voronoi_knn.top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_lbl_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under the log-bilinear model and under smoothed counts."""
    return lm_digest(load(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of target weights takes of every document."""
    return mixing.mix(load(spark, sf_dir, "documents")).drop("source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_output": op1_token_output,
        "op2_bpe_codec": op2_bpe_codec,
        "op3_language_id": op3_language_id,
        "op4_simhash": op4_simhash,
        "op5_hilbert_shards": op5_hilbert_shards,
        "op6_quality_rules": op6_quality_rules,
        "op7_html_text": op7_html_text,
        "op8_voronoi_knn": op8_voronoi_knn,
        "op9_lbl_scores": op9_lbl_scores,
        "op10_mixing": op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_voronoi_knn": voronoi_knn.ORACLE, "op10_mixing": mixing.ORACLE}
