"""The filter that drops noise rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringloom.functions.dialect import SPARK
from stringloom.functions.garbage import KEPT_KINDS, KEPT_METHODS, garbage_sql

from .text import trimmed


def is_garbage(value: str = "__t", kind: str = "kind") -> Column:
    return F.expr(garbage_sql(SPARK, value, kind))


def plausible(finds: DataFrame) -> DataFrame:
    """Finds (value, kind) of a key search that chance hardly makes: those with a kind, or with words and not noise."""
    words = F.col("__t").rlike(r"[a-z]{3,}[ /._-][a-z]{2,}")
    return finds.withColumn("__t", F.trim("value")).where(F.col("kind").isNotNull() | (~is_garbage() & words)).drop("__t")


def without_garbage(rows: DataFrame) -> DataFrame:
    """Rows that aren't noise; decoded rows and rows of structural kinds always stay."""
    label = F.regexp_replace(trimmed(F.col("value")), r"^[A-Za-z_][A-Za-z0-9_]*: +", "")
    kept = F.col("method").isin(*KEPT_METHODS) | F.coalesce(F.col("kind").isin(*KEPT_KINDS), F.lit(False))
    return rows.withColumn("__t", label).where(kept | ~is_garbage()).drop("__t")
