"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ._shared import documents, shared_dir
from .merkle import ORACLE_SQL as MERKLE_SQL


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir))


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hmm import language_model

    return language_model(documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import matches

    return matches(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .winnowing import compare_edited

    return compare_edited(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_files

    path = shared_dir(spark)
    token_files.write(documents(spark, sf_dir), path)
    return token_files.read(spark, path, with_ids=False)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find

    return find(documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_report

    return line_report(documents(spark, sf_dir))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest

    return manifest(documents(spark, sf_dir))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align

    return align(documents(spark, sf_dir))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wrappers import extract

    return extract(documents(spark, sf_dir, "pages"))


_ALL = (op1_packing, op2_hmm, op3_decontamination, op4_winnowing, op5_toxicity, op6_token_files, op7_pii, op8_line_dedup, op9_jaccard_join, op10_quality, op11_merkle_manifest, op12_token_alignment, op13_html_extraction)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {"op11_merkle_manifest": MERKLE_SQL}
