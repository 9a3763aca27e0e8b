"""The whole dataflow: blobs to string rows to indicators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.functions import lexicon as L
from stringloom.operators import binary, decode, garbage, iocs, kinds, ranges, script, text, xor
from stringloom.scratch import written
from stringloom.shipping import ship
from stringloom.sources.blobs import bom_text, is_text, searchable

COLUMNS = ["blob_id", "value", "data_offset", "data_len", "method", "kind", "fragments"]
SPANS = "array<struct<offset:bigint,length:int>>"


@dataclass(frozen=True)
class Options:
    min_length: int = 4
    drop_garbage: bool = False
    xor: bool = False
    xor_key: bytes | None = None
    scripts: bool = True
    interesting: bool = False


def text_strings(blobs: DataFrame, o: Options) -> DataFrame:
    """Rows of text blobs (blob_id, text) by line."""
    rows = text.line_rows(blobs, min_length=o.min_length).withColumn("fragments", F.lit(None).cast(SPANS))
    return rows


def _whole(rows: DataFrame) -> DataFrame:
    """Rows of values that stand in one piece."""
    return rows.withColumn("fragments", F.lit(None).cast(SPANS)).select(*COLUMNS)


def extract(blobs: DataFrame, options: Options | None = None) -> DataFrame:
    """String rows of blobs (blob_id, content): extracted, classified, decoded, filtered, one an offset.

    Extraction, the only step that reads whole contents, is written once; the decoders, which all
    read the same rows, start from that table.
    """
    o = options or Options()
    ship(blobs.sparkSession)
    wide = blobs.withColumn("__bom", bom_text(F.col("content"))).withColumn("__text", is_text(F.col("content")) & F.col("__bom").isNull())
    lines = text_strings(wide.where(F.col("__text") | F.col("__bom").isNotNull()).select(F.col("blob_id").cast("string").alias("blob_id"), F.coalesce("__bom", F.decode(F.col("content"), "UTF-8")).alias("text")), o)
    found = binary.extract_blobs(wide.where(~F.col("__text") & F.col("__bom").isNull()), o.min_length)
    rows = kinds.with_kind(lines.withColumn("kind", F.lit(None).cast("string")).unionByName(found).withColumnRenamed("kind", "known"))
    overlay = F.col("known").isin("Overlay", "OverlayWide") & F.col("kind").isin(*L.OVERLAY_KEPT)  # telling kinds stay in overlays
    version, address = F.coalesce(F.col("known") == binary.VERSION, F.lit(False)), F.coalesce(F.col("kind").isin("IP", "IPPort"), F.lit(False))
    rows = rows.withColumn("kind", F.when(overlay | (version & ~address), F.col("kind")).when(~version, F.coalesce("known", "kind"))).drop("known").select(*COLUMNS)
    magic = F.hex(F.substring("content", 1, 4)).isin("CFFAEDFE", "CEFAEDFE", "FEEDFACE", "FEEDFACF", "CAFEBABE")
    signed = binary.catalogue(blobs.where(magic)).where("what = 'segment' AND name = '__LINKEDIT'")
    rows = written(ranges.relabel_signatures(rows, signed), "strings")
    if o.xor or o.xor_key:
        finds = _xor(blobs, o)
        if not o.xor_key:
            finds = finds.unionByName(xor.own_key_finds(blobs, rows, kinds.with_kind, o.min_length).select(*finds.columns))
        rows = written(rows.unionByName(_whole(finds)), "strings")
    spaced = text.spaced_ascii(rows).withColumns({"value": F.col("decoded"), "method": F.lit("SpacedAscii"), "kind": F.lit(None).cast("string")})
    fresh = decode.decoded_rows(rows).select(*COLUMNS).unionByName(_whole(spaced))
    fresh = kinds.with_kind(fresh.withColumnRenamed("kind", "known")).withColumn("kind", F.coalesce("known", "kind"))
    every = rows.select(*COLUMNS).unionByName(fresh.select(*COLUMNS))
    if o.scripts:
        texts = wide.where("__text").select(F.col("blob_id").cast("string").alias("blob_id"), F.decode(F.col("content"), "UTF-8").alias("text"))
        payload = kinds.with_kind(script.script_rows(script.deobfuscate(texts), texts))
        every = every.unionByName(_whole(payload))
    if o.drop_garbage:
        every = garbage.without_garbage(every)
    every = ranges.strip_length_byte(every)
    if o.interesting:
        every = every.where("method <> 'RawScan'")
    return kinds.top_per_offset(every)


def _xor(blobs: DataFrame, o: Options) -> DataFrame:
    """XOR finds: all of an explicit key's; of searched keys those with a kind, or that aren't noise.

    Where finds overlap, one of high severity wins, then one with a kind, then the longest.
    """
    if o.xor_key:
        finds = xor.with_key(blobs, o.xor_key, o.min_length)
    else:
        blobs = blobs.where(searchable(F.col("content")))
        first = written(xor.single_byte(blobs), "xor")
        windows = blobs.where(F.hex(F.substring("content", 1, 2)) == "4D5A")  # rolling keys are sought in PE blobs
        finds = first.unionByName(xor.with_own_keys(blobs, xor.repeated_keys(first))).unionByName(xor.rolling(windows)).unionByName(xor.incremental(blobs)).unionByName(xor.dotted(blobs))
    named = kinds.with_kind(finds.drop("key").dropDuplicates(["blob_id", "data_offset", "value"]))
    if not o.xor_key:
        named = named.withColumn("value", xor.clean_tail(F.col("value"), F.col("kind"))).withColumn("data_len", F.least("data_len", F.octet_length("value")))
        named = garbage.plausible(named)
    rank = F.when(kinds.severity(F.col("kind")) == "High", 0).when(F.col("kind").isNotNull(), 1).otherwise(2)
    return ranges.resolve_overlaps(named.withColumn("rank", rank)).drop("rank")


def indicators(blobs: DataFrame, options: Options | None = None) -> DataFrame:
    """Indicators of blobs, in order of kind and value."""
    return iocs.ordered(iocs.extract_iocs(extract(blobs, options)))
