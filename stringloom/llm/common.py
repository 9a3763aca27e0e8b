"""Shared pieces of the corpus operators: scratch tables, safe column names, text keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.scratch import written

# ASCII white space, and the ASCII letters that are folded.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

__all__ = ["ASCII_SPACE", "fold_ascii", "hex128", "sha256_text", "table", "wide_hash", "written"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def wide_hash(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes: 128 bits."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)]


def hex128(high: Column, low: Column) -> Column:
    return F.concat(F.lpad(F.lower(F.hex(high)), 16, "0"), F.lpad(F.lower(F.hex(low)), 16, "0"))


def sha256_text(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)
