"""The corpus pipeline: five stages, each on what its predecessor kept.

Quality rejects documents below the threshold; line dedup cuts repeated lines out of texts; the n-gram Jaccard join keeps
the document of the smallest doc_id of each group of near copies; decontamination drops documents that hold benchmark
items; packing cuts what is left into training sequences.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as one, so that no column of docs meets one of an operator's of the same name."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest).alias("_rest")) if rest else docs.select("doc_id", "text")


def _unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents of which the score is at least the threshold.

    Learns from the labels of the training rows among docs (crc32(doc_id) mod 5 isn't 0), as the query of the operator.
    Null and empty texts are scored like others; repeated rows are kept or rejected together; without labels all stay.
    """
    from prospark.llm import quality
    from prospark.llm._shared import documents, held_out

    model = quality.fit(docs.select("doc_id", "text"), documents(spark, sf_dir, "labels"), ~held_out(5, 0))
    return _unpacked(quality.score(_packed(docs), model).where("predicted = 1"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no line is left go; a text that was null, empty or blank before stays."""
    from prospark.llm.line_dedup import dedup_lines

    return _unpacked(dedup_lines(_packed(docs)).where((F.size("dropped") == 0) | (F.trim("text") != "")), docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of a null doc_id stay; repeated rows of the doc_id that stays, too."""
    from prospark.llm.jaccard_join import jaccard_components

    copies = jaccard_components(docs).where("doc_id is not null and doc_id != component_id").select(F.col("doc_id").alias("_copy")).distinct()
    return _unpacked(_packed(docs).join(copies, F.col("doc_id").cast("long") == F.col("_copy"), "left_anti"), docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item; null and empty texts hold none, rows of a null doc_id stay."""
    from prospark.llm._shared import documents
    from prospark.llm.decontamination import decontaminate

    return _unpacked(decontaminate(_packed(docs), documents(spark, sf_dir, "benchmark")), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece; columns of docs other than doc_id and text are left behind."""
    from prospark.llm.packing import pack

    return pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again as the next one's input."""
    from prospark.llm._shared import documents, stored

    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
