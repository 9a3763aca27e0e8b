"""Extractors over text blobs: lines, printable runs, tokens, spaced letters, packed patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "blob_id"
TRIM = r"^[ \t\n\x0b\f\r\x85  -     　]+|[ \t\n\x0b\f\r\x85  -     　]+$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, TRIM, "")


def line_rows(blobs: DataFrame, text: str = "text", min_length: int = 4) -> DataFrame:
    """(blob_id, value, data_offset, data_len, method) for each line; offsets count a byte a line end.

    One shuffle by blob orders a blob's lines for the running sum of their bytes.
    """
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, "\r$", ""))
    rows = blobs.select(KEY, F.posexplode(lines).alias("pos", "line"))
    before = Window.partitionBy(KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("data_offset", F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)).cast("long"))
    value = trimmed(F.col("line"))
    return rows.where(F.octet_length(value) >= min_length).select(KEY, value.alias("value"), "data_offset", F.octet_length(value).alias("data_len"), F.lit("RawScan").alias("method"))


def printable_runs(blobs: DataFrame, text: str = "text", min_length: int = 4) -> DataFrame:
    """Maximal runs of printable ASCII, blank or tab, first occurrence of each value in a blob."""
    pattern = rf"[ -~\t]{{{min_length},}}"
    found = blobs.select(KEY, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), 0)).alias("pos", "run"))
    found = found.withColumn("value", F.regexp_replace("run", r"^[ \t]+|[ \t]+$", "")).where(F.octet_length("value") >= min_length)
    return found.groupBy(KEY, "value").agg(F.min("pos").alias("pos"), F.min_by(F.octet_length("run"), "pos").alias("data_len")).withColumn("method", F.lit("RawScan"))


def tokens(blobs: DataFrame, text: str = "text", like: str | None = None) -> DataFrame:
    """White-space separated tokens without the signs at their edges; like: a cheap test of the raw word first."""
    words = blobs.select(KEY, F.posexplode(F.split(text, r"[ \t\n\r\f]+", -1)).alias("pos", "word"))
    words = words.where(F.col("word").like(like)) if like else words
    return words.select(KEY, "pos", F.regexp_replace("word", r"^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", "").alias("value")).where("value != ''")


def vocabulary(blobs: DataFrame, text: str = "text") -> DataFrame:
    """(value, n): each distinct token and how often it occurs.

    What is costly for a token (trimming, classifying) is then done once for each distinct one.
    """
    raw = blobs.select(F.explode(F.split(text, r"[ \t\n\r\f]+", -1)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    value = F.regexp_replace("word", r"^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", "")
    return raw.select(value.alias("value"), "n").where("value != ''").groupBy("value").agg(F.sum("n").alias("n"))


def spaced_ascii(rows: DataFrame, value: str = "value") -> DataFrame:
    """Values written as letter, blank, letter, blank: joined, four characters or more."""
    v = F.col(value)
    pairs = F.size(F.regexp_extract_all(v, F.lit(r"[!-~][ \x00]"), 0))
    ok = (F.octet_length(v) >= 6) & (pairs >= 4) & (pairs * 2 * 100 / F.octet_length(v) >= 70)
    joined = F.regexp_replace(v, r"([!-~])[ \x00]", "$1")
    return rows.where(ok).withColumn("decoded", joined).where(F.octet_length("decoded") >= 4)


# What the packed-segment miner looks for.
PACKED = (
    ("url", r"https?://[A-Za-z0-9./_?=&%:@#~+-]+"), ("path", r"/(?:[A-Za-z0-9._-]+/)+[A-Za-z0-9._-]+"), ("env", r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+"),
    ("snake", r"[a-z][a-z0-9]*(?:_[a-z0-9]+)+"), ("domain", r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*\.(?:com|net|org|io|dev|edu|gov)"),
)


def _named(name: str):
    return lambda x: F.struct(F.lit(name).alias("pattern"), x.alias("value"))


def packed_patterns(blobs: DataFrame, text: str = "text", min_length: int = 4) -> DataFrame:
    """(blob_id, pattern, value): distinct finds of each pattern that aren't mostly digits or short hex."""
    finds = F.concat(*(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(p), 0)), _named(n)) for n, p in PACKED))
    rows = blobs.select(KEY, F.explode(finds).alias("f")).select(KEY, "f.pattern", "f.value")
    digits = F.octet_length(F.regexp_replace("value", "[^0-9]", ""))
    short_hex = (F.octet_length("value") < 8) & F.col("value").rlike("^[0-9a-f]+$")
    return rows.where((F.octet_length("value") >= min_length) & (digits * 100 / F.octet_length("value") <= 70) & ~short_hex)


def wrapped(rows: DataFrame, width: int, value: str = "value") -> DataFrame:
    """Rows of at most width characters; offsets advance by bytes."""
    n = F.greatest(F.ceil(F.length(value) / width), F.lit(1)).cast("int")
    parts = rows.withColumn("part", F.explode(F.sequence(F.lit(0), n - 1)))
    piece = F.substring(value, F.col("part") * width + 1, F.lit(width))
    before = F.octet_length(F.substring(value, F.lit(1), F.col("part") * width))
    return parts.withColumns({"line": piece, "line_offset": F.col("data_offset") + before}).drop("part")
