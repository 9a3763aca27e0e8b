"""Incremental extraction: results are kept by content key, and only new blobs are read.

The key is SHA-256 over content, options and version. As a batch it is an anti-join with the
results table; as a stream each micro-batch does the same, so that a replayed batch adds nothing.
"""

from __future__ import annotations

from dataclasses import astuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stringloom.plans.pipeline import Options, extract

VERSION = 1
FILES = "path string, modificationTime timestamp, length long, content binary"


def content_key(content: Column, options: Options) -> Column:
    return F.sha2(F.concat(F.coalesce(content, F.lit(b"")), F.encode(F.lit(repr((VERSION, *astuple(options)))), "UTF-8")), 256)


def cacheable(options: Options) -> bool:
    """Results with an explicit key aren't kept."""
    return options.xor_key is None


def new_blobs(blobs: DataFrame, results: DataFrame, options: Options) -> DataFrame:
    keyed = blobs.withColumn("key", content_key(F.col("content"), options))
    return keyed.join(results.select("key").distinct(), "key", "left_anti").dropDuplicates(["key"])


def _results(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where) else None


def update(blobs: DataFrame, path: str, options: Options | None = None) -> int:
    """Extracts blobs that the results at path don't have yet, appends them, returns their number."""
    o = options or Options()
    spark, known = blobs.sparkSession, _results(blobs.sparkSession, path)
    fresh = blobs.withColumn("key", content_key(F.col("content"), o)).dropDuplicates(["key"]) if known is None else new_blobs(blobs, known, o)
    rows = extract(fresh.select(F.col("key").alias("blob_id"), "content"), o).withColumnRenamed("blob_id", "key")
    seen = fresh.select("key").withColumns({"value": F.lit(None).cast("string"), "method": F.lit("Seen")})
    n = fresh.count()
    if n:
        rows.unionByName(seen, allowMissingColumns=True).write.mode("append").parquet(path)
    return n


def lookup(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.parquet(path).where((F.col("key") == key) & (F.col("method") != "Seen"))


def follow(spark: SparkSession, source: str, path: str, checkpoint: str, options: Options | None = None) -> StreamingQuery:
    """A stream over a folder of files that keeps the results at path up to date."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(source)
    blobs = files.select(F.col("path").alias("blob_id"), "content")
    return blobs.writeStream.foreachBatch(lambda batch, _: update(batch, path, options) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
