"""Line dedup (7): explode normalised lines, hash, count documents, drop, reassemble by position.

Native throughout: DataFrame functions only.

Cases: a null or empty text is one empty line (key of length 0, never dropped). Rows that repeat
a document count as documents of their own. A null id is kept. Only the id and text columns are
read; other columns pass through untouched whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, fold_ascii, wide_hash, written

PREFIX = "__line_dedup_"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """Stripped of ASCII white space at both ends, A-Z in lower case."""
    return fold_ascii(F.btrim(line, F.lit(ASCII_SPACE)))


def frequent_keys(docs: DataFrame, text: str, min_docs: int, min_chars: int) -> DataFrame:
    """(h1, h2) of each key that at least min_docs documents hold.

    A document's keys are made distinct inside its row, so that one count with map-side
    combining is enough: what is shuffled is one row per key and map task.
    """
    keys = F.array_distinct(F.transform(lines_of(F.col(text)), line_key))
    one = docs.select(F.explode(keys).alias("key")).where(F.length("key") >= min_chars)
    h1, h2 = wide_hash(F.col("key"))
    return one.select(h1.alias("h1"), h2.alias("h2")).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("h1", "h2")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, out: str = "kept_text") -> DataFrame:
    """docs with the columns `out`, n_lines and n_dropped.

    The lines that go are found as positions per row (row key: id and hash of the text, so rows
    that repeat share them); the text is then put together again from the positions that stay.
    """
    one, two = PREFIX + "text", PREFIX + "id"
    hash1, hash2 = PREFIX + "h1", PREFIX + "h2"
    keyed = docs.withColumns({two: F.col(id_col), hash1: F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), hash2: F.length(F.coalesce(F.col(text_col), F.lit("")))})
    frequent = written(frequent_keys(docs, text_col, min_docs, min_chars), "frequent")  # as a table: Spark can then split a hot key's join
    rows = keyed.select(F.col(two).alias("id"), F.col(hash1).alias("t1"), F.col(hash2).alias("t2"), F.posexplode(F.transform(lines_of(F.col(text_col)), line_key)).alias("pos", "key"))
    h1, h2 = wide_hash(F.col("key"))
    rows = rows.where(F.length("key") >= min_chars).select("id", "t1", "t2", "pos", h1.alias("h1"), h2.alias("h2"))
    gone = rows.join(frequent, ["h1", "h2"], "left_semi").groupBy("id", "t1", "t2").agg(F.collect_set("pos").alias(PREFIX + "gone"))
    gone = gone.select(F.col("id").alias(PREFIX + "gid"), F.col("t1").alias(PREFIX + "g1"), F.col("t2").alias(PREFIX + "g2"), PREFIX + "gone")
    same = keyed[two].eqNullSafe(gone[PREFIX + "gid"]) & (keyed[hash1] == gone[PREFIX + "g1"]) & (keyed[hash2] == gone[PREFIX + "g2"])
    both = keyed.join(gone, same, "left").withColumn(one, lines_of(F.col(text_col)))
    none = F.array().cast("array<int>")
    drop = F.coalesce(F.col(PREFIX + "gone"), none)
    stay = F.array_except(F.sequence(F.lit(0), F.size(one) - 1), drop)
    kept = F.when(F.size(drop) == 0, F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(one), i)), "\n"))
    result = both.withColumns({out: kept, "n_lines": F.size(one).cast("long"), "n_dropped": F.size(drop).cast("long")})
    return result.drop(one, two, hash1, hash2, *(PREFIX + x for x in ("gid", "g1", "g2", "gone")))
