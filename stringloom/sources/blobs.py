"""Blob sources and string sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.operators.kinds import severity
from stringloom.shipping import ship


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(blob_id, content, size, modified) of files under a path; unreadable ones are skipped."""
    reader = ship(spark).read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(F.col("path").alias("blob_id"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def spread(rows: DataFrame) -> DataFrame:
    """A file scan with fewer partitions than cores, dealt out: a file of one row group is else one task.

    A large table has more partitions than cores and isn't shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def text_blobs(rows: DataFrame, key: Column, text: Column) -> DataFrame:
    """Rows of a text table as blobs (blob_id, text)."""
    return rows.select(key.cast("string").alias("blob_id"), text.alias("text"))


def is_text(content: Column) -> Column:
    """No binary magic, at most two NULs and 85 of 100 bytes printable in the first 8 KiB."""
    sample = F.substring(content, 1, 8192)
    hexed = F.hex(sample)
    n = F.octet_length(sample)
    magic = F.substring(hexed, 1, 8).isin("7F454C46", "FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "CAFEBABE", "BEBAFECA") | hexed.startswith("4D5A")
    latin = F.decode(sample, "ISO-8859-1")
    nuls = n - F.length(F.translate(latin, "\x00", ""))
    good = F.length(F.regexp_replace(latin, "[^!-~ \t\n\r\f]", ""))
    return (n > 0) & ~magic & (nuls <= 2) & (good * 100 >= n * 85)


def bom_text(content: Column) -> Column:
    """The text of a UTF-16 file with a byte order mark, else null."""
    mark = F.hex(F.substring(content, 1, 2))
    body = F.substring(content, F.lit(3), F.octet_length(content))
    return F.when(mark == "FFFE", F.decode(body, "UTF-16LE")).when(mark == "FEFF", F.decode(body, "UTF-16BE"))


def platform_signed(content: Column) -> Column:
    """Any of six certificate names in the first or last 4 MiB."""
    # Signer names.
    names = ("Apple Code Signing Certification Authority", "Apple Root CA", "Software Signing", "Microsoft Windows Production PCA", "Microsoft Code Signing PCA", "Microsoft Root Certificate Authority")
    size = 4 << 20
    ends = (F.decode(F.substring(content, 1, size), "ISO-8859-1"), F.decode(F.substring(content, -size, size), "ISO-8859-1"))
    out = F.lit(False)
    for e in ends:
        for n in names:
            out = out | e.contains(n)
    return out


def searchable(content: Column) -> Column:
    """Blobs that an XOR search is for: neither text nor signed by a platform's vendor."""
    return ~is_text(content) & bom_text(content).isNull() & ~platform_signed(content)


def describe(blobs: DataFrame) -> DataFrame:
    """The header line of each blob: format, size and SHA-256."""
    mark = F.hex(F.substring("content", 1, 4))
    form = F.when(mark == "7F454C46", "ELF").when(mark.startswith("4D5A"), "PE").when(mark.isin("FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "CAFEBABE"), "Mach-O").otherwise("unknown")
    return blobs.select("blob_id", form.alias("format"), F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON document a row; zero lengths and absent fields are left out."""
    lean = F.struct("value", "data_offset", F.when(F.col("data_len") > 0, F.col("data_len")).alias("data_len"), "method", "kind")
    return rows.select("blob_id", F.to_json(lean).alias("json"))


def simple_lines(rows: DataFrame) -> DataFrame:
    """One value a line, trailing control characters off."""
    return rows.select(F.regexp_replace("value", r"\p{Cntrl}+$", "").alias("value"))


def table_lines(rows: DataFrame) -> DataFrame:
    """Offset, method, kind, severity and value as one line of a table."""
    return rows.select("blob_id", "data_offset", F.format_string("%8x  %-20s %-16s %-6s %s", "data_offset", "method", F.coalesce("kind", F.lit("-")), severity(F.col("kind")), "value").alias("line"))
