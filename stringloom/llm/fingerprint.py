"""Document fingerprints (5): canonical exact digest.

Native throughout. The canonical form is NFKC (the ICU library that ships with Spark, called by
SQL's reflect()), lower case, runs of white space as one space, trimmed. Two xxhash64 values over
it make 128 bits; inside buckets of equal hashes the canonical texts are compared as bytes, and
where they differ (a collision) the SHA-256 of the text is appended. An edited text is compared
as bytes with its own document; a document's collision marks it too.

Being exact, a fingerprint is like another (1.0) or not (0.0). Each text is canonicalised once
and written with its hashes; what follows joins narrow rows by id.

Cases: a null text is empty. Rows that repeat an id: each has its own fingerprint; as a "next
document" the smallest start and the smallest fingerprint of the rows with the next larger id
count. A row without an id has no next document. The last id is followed by the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hex128, wide_hash, written

#: Ids are grouped by this many of their lower bits on each level of next_ids.
LEVEL_BITS = 10
#: White space of Unicode other than the plain space, as characters of a class.
OTHER_SPACE = r"\t\n\x0b\f\r\x1c-\x1f\x85   -     　"


def canonical(text: Column) -> Column:
    """NFKC, lower case, white space folded. Plain ASCII texts need no normalisation; a single space needs no folding."""
    plain = F.octet_length(text) == F.length(text)
    composed = F.when(plain, text).otherwise(F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True)))
    return F.btrim(F.regexp_replace(F.lower(composed), f"[ {OTHER_SPACE}]{{2,}}|[{OTHER_SPACE}]", " "), F.lit(" "))


def next_ids(ids: DataFrame) -> DataFrame:
    """(id, next_id) for distinct ids, without a window over all rows.

    Ids are windowed in groups of 2**LEVEL_BITS values; where a group ends, the first id of the
    next group follows, which is found in the same way among the groups, and so on.
    """

    def follow(keys: DataFrame, bits: int) -> DataFrame:
        if bits <= LEVEL_BITS:
            every = Window.partitionBy(F.lit(0)).orderBy("key")  # 2**LEVEL_BITS keys at most
            whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            return keys.select("key", "first", F.coalesce(F.lead("first").over(every), F.min("first").over(whole)).alias("next"))
        up = keys.withColumn("up", F.shiftright("key", LEVEL_BITS))
        groups = follow(up.groupBy(F.col("up").alias("key")).agg(F.min("first").alias("first")), bits - LEVEL_BITS)
        inside = up.withColumn("inside", F.lead("first").over(Window.partitionBy("up").orderBy("key")))
        groups = groups.select(F.col("key").alias("up"), F.col("next").alias("after"))
        return inside.join(groups, "up").select("key", "first", F.coalesce("inside", "after").alias("next"))

    low, high = ids.agg(F.min("id"), F.max("id")).first()
    bits = (high - low).bit_length() if low is not None else 0
    key = F.col("id").cast("long")
    if bits > 62:  # the difference may not fit a long
        low, bits = 0, 64
    start = ids.select((key - F.lit(low or 0)).alias("key"), key.alias("first"))
    return follow(start, bits).select(F.col("first").alias("id"), F.col("next").alias("next_id"))


def hashed(df: DataFrame, text_col: str, prefix: str = "") -> DataFrame:
    """df with canon, h1, h2 and sha (prefixed) of the text column."""
    canon = F.col(prefix + "canon")
    h1, h2 = wide_hash(canon)
    return df.withColumn(prefix + "canon", canonical(F.col(text_col))).withColumns({prefix + "h1": h1, prefix + "h2": h2, prefix + "sha": F.unhex(F.sha2(F.encode(canon, "UTF-8"), 256))})


def collisions(rows: DataFrame) -> DataFrame:
    """(h1, h2) of the buckets of rows (h1, h2, canon, a written table) that hold different canonical texts.

    Only texts of buckets with more than one row are compared; each map task sends one pair of
    them a bucket at most.
    """
    shared = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    members = rows.select("h1", "h2", "canon").join(written(shared, "shared"), ["h1", "h2"], "left_semi")
    ends = members.groupBy("h1", "h2").agg(F.min("canon").alias("least"), F.max("canon").alias("most"))
    return written(ends.where("least != most").select("h1", "h2"), "clashes")


def with_fingerprint(df: DataFrame, clashes: DataFrame, out: str, prefix: str = "") -> DataFrame:
    """df with the fingerprint of the prefixed hashes. Of clashes a few rows at most exist: 10**10 texts have one with a probability below 10**-18."""
    h1, h2, sha, clash = (prefix + x for x in ("h1", "h2", "sha", "clash"))
    named = clashes.select(F.col("h1").alias(h1), F.col("h2").alias(h2), F.lit(True).alias(clash))
    code = hex128(F.col(h1), F.col(h2))
    return df.join(named, [h1, h2], "left").withColumn(out, F.when(F.col(clash), F.concat(code, F.lit("-"), F.lower(F.hex(sha)))).otherwise(code)).drop(h1, h2, sha, clash)


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of each row."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = written(hashed(base, "text").drop("text"), "canonical")
    return with_fingerprint(rows.drop("canon"), collisions(rows), "fingerprint").select(F.col("id").alias(id_col), "fingerprint")


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last quarter is the next one's start."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    placed = base.where("id is not null")  # one shuffle by id serves both joins of texts
    sizes = written(placed.groupBy("id").agg(F.max(F.length("text")).alias("n")), "sizes")
    follow = written(next_ids(sizes.select("id")), "next")
    wanted = follow.join(sizes, "id").select(F.col("id").alias("for_id"), F.col("next_id").alias("id"), F.floor(F.col("n") / 4).cast("int").alias("k"))
    starts = placed.join(wanted, "id").select("for_id", F.substring("text", F.lit(1), F.col("k")).alias("start"))
    starts = starts.groupBy(F.col("for_id").alias("id")).agg(F.min("start").alias("start"))

    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring(F.coalesce("start", F.lit("")), F.lit(1), quarter))
    rows = placed.join(starts, "id", "left").unionByName(base.where("id is null"), allowMissingColumns=True).withColumns({"n_chars": n.cast("long"), "edited": edited})
    rows = hashed(hashed(rows, "text"), "edited", "e")
    same = (F.col("h1") == F.col("eh1")) & (F.col("h2") == F.col("eh2")) & (F.col("canon") == F.col("ecanon"))
    rows = rows.select("id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), same.alias("same"), "canon", "h1", "h2", "sha", "eh1", "eh2", "esha")
    rows = written(rows, "canonical")
    clashes = collisions(rows)
    found = with_fingerprint(with_fingerprint(rows.drop("canon"), clashes, "fingerprint"), clashes, "edited_fingerprint", "e")
    after = found.where("id is not null").groupBy(F.col("id").alias("next_id")).agg(F.min("fingerprint").alias("next_fingerprint"))
    found = found.join(follow.join(after, "next_id").select("id", "next_fingerprint"), "id", "left")
    near = lambda c: F.when(c, 1.0).otherwise(0.0)
    return found.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        near(F.col("same")).alias("near_edited"), near(F.col("fingerprint") == F.col("next_fingerprint")).alias("near_next"),
    )
