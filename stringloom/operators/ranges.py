"""Joins and windows over offsets: ranges, overlaps, gaps, symbols, retention."""

from __future__ import annotations


from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "blob_id"
#: Offsets are compared inside cells of this size, so that a range join is an equi-join.
CELL = 1 << 16


def in_ranges(points: DataFrame, ranges: DataFrame, how: str = "inner", at: str = "data_offset") -> DataFrame:
    """points joined with the ranges (blob_id, start, end) that hold their offset; end is exclusive."""
    cells = ranges.where("end > start").select("*", F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor((F.col("end") - 1) / CELL))).alias("__cell")).withColumnRenamed(KEY, "__blob")
    keyed = points.withColumn("__at", F.floor(F.col(at) / CELL))
    on = (keyed[KEY] == cells["__blob"]) & (keyed["__at"] == cells["__cell"]) & (keyed[at] >= cells["start"]) & (keyed[at] < cells["end"])
    return keyed.join(cells, on, how).drop("__blob", "__cell", "__at")


def merge_symbols(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols give rows of the same value their kind; symbols without a row are added."""
    named = symbols.groupBy(KEY, "value").agg(F.min("kind").alias("__kind"), F.min("data_offset").alias("__offset"))
    relabelled = rows.join(named, [KEY, "value"], "left").withColumn("kind", F.coalesce("__kind", "kind")).drop("__kind", "__offset")
    new = named.join(rows, [KEY, "value"], "left_anti").select(KEY, "value", F.col("__offset").alias("data_offset"), F.octet_length("value").alias("data_len"), F.lit("R2Symbol").alias("method"), F.col("__kind").alias("kind"))
    return relabelled.unionByName(new, allowMissingColumns=True)


def without_known(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose value the blob's known rows don't have."""
    return rows.join(known.select(KEY, "value").distinct(), [KEY, "value"], "left_anti")


def suppress_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows that touch no span (blob_id, start, end)."""
    length = F.when(F.col("data_len") > 0, F.col("data_len")).otherwise(F.octet_length("value"))
    wide = spans.select(KEY, F.col("start").alias("__s"), F.col("end").alias("__e"))
    on = (rows[KEY] == wide[KEY]) & (rows["data_offset"] < wide["__e"]) & (rows["data_offset"] + length > wide["__s"])
    return rows.join(wide, on, "left_anti")


def strip_length_byte(rows: DataFrame) -> DataFrame:
    """Of package paths and type names a first character goes whose code is the length of the rest; the offset moves by one."""
    rest = F.expr("substr(value, 2)")
    path = rest.rlike(r"^[A-Za-z_*\[(.][A-Za-z0-9/._*\[\]() -]*\z") & rest.rlike("[/.]")
    prefixed = F.coalesce((F.octet_length("value") >= 6) & (F.ascii(F.substring("value", 1, 1)) == F.octet_length("value") - 1) & F.expr("substr(value, 1, 1)").rlike(r"^[!-~]\z") & path, F.lit(False))
    return rows.withColumns({"data_offset": F.when(prefixed, F.col("data_offset") + 1).otherwise(F.col("data_offset")), "value": F.when(prefixed, rest).otherwise(F.col("value"))})


def islands(rows: DataFrame, gap: int, start: str = "start", end: str = "end") -> DataFrame:
    """Runs of intervals no more than gap apart, numbered within the blob."""
    order = Window.partitionBy(KEY).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) - before > gap), 1).otherwise(0)
    return rows.withColumn("__new", new).withColumn("island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def resolve_overlaps(rows: DataFrame, rank: str = "rank") -> DataFrame:
    """Greedy choice of rows that don't overlap: lower rank, then longer, then earlier, then fewer odd characters.

    Two keys can make printable text of the same bytes; letters, digits and blanks tell which is meant.
    Rows of an island of overlaps follow each other in the order of choice; a task holds the spans
    chosen so far in one island.
    """
    length = F.when(F.col("data_len") > 0, F.col("data_len")).otherwise(F.octet_length("value"))
    placed = rows.withColumns({"start": F.col("data_offset"), "end": F.col("data_offset") + length})
    placed = islands(placed, -1)

    placed = placed.withColumns({"__n": F.col("start") - F.col("end"), "__odd": F.length(F.regexp_replace("value", "[A-Za-z0-9 ]", ""))})
    placed = placed.repartition(KEY, "island").sortWithinPartitions(KEY, "island", rank, "__n", "start", "__odd", "value")

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pile, spans = None, []
        for batch in batches:
            keep = []
            for key, island, s, e in zip(batch[KEY], batch["island"], batch["start"], batch["end"], strict=True):
                if (key, island) != pile:
                    pile, spans = (key, island), []
                at = bisect_left(spans, (s, e))
                free = (at == 0 or spans[at - 1][1] <= s) and (at == len(spans) or e <= spans[at][0])
                if free:
                    spans.insert(at, (s, e))
                keep.append(free)
            yield batch[keep]

    return placed.mapInPandas(choose, placed.schema).drop("start", "end", "island", "__n", "__odd")


def retain(entries: DataFrame, now: str, days: int = 30, cap: int = 2 << 30, share: float = 0.9) -> DataFrame:
    """Cache entries (key, bytes, modified) that stay: young ones, newest first within the cap.

    The size pass runs only where the total is over the cap, then down to a share of it. Sizes are
    summed by hour (at most 24 * days + 1 rows, hence the broadcast); only inside an hour are
    entries ordered one by one, so that no task sees them all.
    """
    young = entries.where(F.col("modified") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))
    young = young.withColumn("__hour", F.least(F.floor((F.lit(now).cast("timestamp").cast("long") - F.col("modified").cast("long")) / 3600), F.lit(24 * days)))
    hours = young.groupBy("__hour").agg(F.sum("bytes").alias("__sum"))
    newest = Window.partitionBy(F.lit(0)).orderBy("__hour")
    whole = newest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hours = hours.select("__hour", (F.sum("__sum").over(newest.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__sum")).alias("__before"), F.sum("__sum").over(whole).alias("__total"))
    inside = Window.partitionBy("__hour").orderBy(F.col("modified").desc(), "key").rowsBetween(Window.unboundedPreceding, 0)
    marked = young.join(F.broadcast(hours), "__hour").withColumn("__running", F.col("__before") + F.sum("bytes").over(inside))
    return marked.where((F.col("__total") <= cap) | (F.col("__running") <= cap * share)).drop("__hour", "__before", "__total", "__running")


def few_or_none(rows: DataFrame, most: int = 4) -> DataFrame:
    """Rows of blobs with at most that many."""
    small = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most).select(KEY)
    return rows.join(small, KEY, "left_semi")


__all__ = ["few_or_none", "in_ranges", "islands", "merge_symbols", "resolve_overlaps", "retain", "strip_length_byte", "suppress_spans", "without_known"]


# What property lists and certificates are told by.
PLIST_STARTS = ("<?xml", "<!DOCTYPE plist", "<plist", "<dict", "</dict>", "</plist>", "<key>", "<array>", "</array>", "<data>", "</data>")
CERTIFICATE_WORDS = (
    "Certification Authority", "Certificate Authority", "Root CA", "Code Signing", "Software Signing", "crl.apple.com", "appleca", "certificate is to be used", "Reliance on this certificate", "terms and conditions",
)


def relabel_signatures(rows: DataFrame, signed: DataFrame) -> DataFrame:
    """Rows inside signature ranges (blob_id, start, end): hashes, property lists, certificates, bundle names."""
    inside = in_ranges(rows, signed.select(KEY, "start", "end"), "left").withColumn("__in", F.col("start").isNotNull()).drop("start", "end").dropDuplicates()
    v, kind, here = F.col("value"), F.col("kind"), F.col("__in")
    size = F.octet_length(F.expr("try_to_binary(value, 'base64')"))
    hashed = here & F.coalesce(kind == "Base64", F.lit(False)) & size.isin(20, 32)
    word = F.lit(False)
    for w in CERTIFICATE_WORDS:
        word = word | v.contains(w)
    word = word | (v.contains(".crl") & v.contains("http")) | v.rlike("^[0-9]{12}([0-9]{2})?Z$|[0-9]{12}Z") | ((v.contains("Apple Inc.") | v.contains("Apple Software")) & (F.octet_length(v) < 50))
    listed = F.lit(False)
    for w in PLIST_STARTS:
        listed = listed | v.startswith(w)
    signature = hashed | (here & kind.isNull() & listed) | (here & (kind.isNull() | (kind == "Base64")) & word)
    bundle = here & kind.isNull() & v.rlike(r"^(com|org|net|io|app|dev)(\.[\p{L}\p{N}_-]+){2,}$")
    return inside.withColumns({"method": F.when(signature, "CodeSignature").otherwise(F.col("method")), "kind": F.when(hashed, "CodeSignatureHash").when(bundle, "AppId").otherwise(kind)}).drop("__in")


def suppress_versions(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """Addresses that are a blob's version string (blob_id, value) lose their kind."""
    known = versions.select(KEY, "value").distinct().withColumn("__version", F.lit(True))
    marked = rows.join(known, [KEY, "value"], "left")
    off = F.col("__version").isNotNull() & F.col("kind").isin("IP", "IPPort")
    return marked.withColumn("kind", F.when(~F.coalesce(off, F.lit(False)), F.col("kind"))).drop("__version")
