"""The corpus pipeline: five stages over documents, each a table that the next one reads.

Cases, in every stage: a null text is judged like an empty one, which is accepted, shares nothing
and stays; rows that repeat are judged each and share their fate; a row without an id stays unless
its text is rejected; an empty table gives an empty table; columns other than COLUMNS are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stringloom.llm.common import table, written
from stringloom.llm.decontaminate import drop_contaminated
from stringloom.llm.line_dedup import dedup_lines
from stringloom.llm.mixing import mix
from stringloom.llm.near_dedup import drop_near_duplicates
from stringloom.llm.quality import ImportanceModel
from stringloom.shipping import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. Without labels of both kinds all are."""
    return ImportanceModel(docs, table(ship(spark), sf_dir, "labels")).accepted(docs.select(COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents or more hold; n_chars follows. A null text becomes an empty one."""
    kept = dedup_lines(docs.select(COLUMNS), min_docs=10, min_chars=1)
    return kept.selectExpr("doc_id", "kept_text as text", "lang", "source", "cast(length(kept_text) as bigint) as n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id: five-word shingles, similarity 0.8."""
    ship(spark)
    return drop_near_duplicates(docs.select(COLUMNS), shingle=5, threshold=(80, 100))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Items without words are held by none."""
    return drop_contaminated(docs.select(COLUMNS), table(ship(spark), sf_dir, "benchmark"), similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: a row for each use of a document, no source repeated more than twice.

    Uses carry doc_id, not the text: a document used twice isn't stored twice.
    """
    return mix(docs, max_repeats=2.0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Models and similarity joins: SQL can't express the stages (tests hold them to brute force).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
