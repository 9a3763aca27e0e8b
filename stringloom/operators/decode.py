"""Eight decoders: each turns string rows into decoded rows; decode_all appends those of all.

All see the same input rows, none another's output. Where a strict built-in exists (base64, hex)
the work stays in column expressions; the others run in Arrow batches over gated rows only.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stringloom.functions import codecs
from stringloom.functions.dialect import SPARK

from .text import trimmed

#: Decoded bytes become text if they are UTF-8 (or UTF-16LE that looks it), four characters trimmed.
LEAST = 4


@F.pandas_udf(StringType())
def _as_text(data: pd.Series) -> pd.Series:
    return pd.Series([codecs.bytes_to_text(None if x is None else bytes(x)) for x in data], dtype=object)


def _python(f):
    @F.pandas_udf(StringType())
    def run(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(x) for x in v], dtype=object)

    return run


def as_text(data: Column) -> Column:
    """Bytes as text: plain ASCII without control characters natively, else by the full rule."""
    latin = F.decode(data, "ISO-8859-1")
    plain = latin.rlike(r"^[ -~]*[!-~]{4}[ -~]*$") & ~latin.rlike("^ | $")
    return F.when(plain, latin).otherwise(_as_text(F.when(~plain, data)))


def quality(value: Column) -> Column:
    """0 to 100 from printable characters and vowels, counted over bytes."""
    bytes_ = F.greatest(F.octet_length(value), F.lit(1))
    n = lambda chars: F.octet_length(F.regexp_replace(value, f"[^{chars}]", ""))
    vowels = F.floor(n("AEIOUaeiou") * 100 / F.greatest(n("A-Za-z"), F.lit(1)))
    return F.floor((F.floor(n(" -~") * 100 / bytes_) * 7 + vowels * 3) / 10).cast("long")


def quality_sql(d, c: str) -> str:
    vowels = d.div(f"({d.count(c, 'AEIOUaeiou')} * 100)", f"greatest({d.count(c, 'A-Za-z')}, 1)")
    printable = d.div(f"({d.count(c, ' -~')} * 100)", f"greatest({d.size(c)}, 1)")
    return d.div(f"({printable} * 7 + {vowels} * 3)", "10")


def _done(rows: DataFrame, decoded: Column, method: str, data_len: Column, changed: bool = False) -> DataFrame:
    out = rows.withColumn("__new", decoded).where(F.col("__new").isNotNull() & (F.octet_length(trimmed(F.col("__new"))) >= LEAST))
    if changed:
        out = out.where(F.col("__new") != F.col("value"))
    if "fragments" in rows.columns:
        out = out.withColumn("fragments", F.lit(None).cast(out.schema["fragments"].dataType))
    return out.withColumns({"data_len": data_len.cast("int"), "value": F.col("__new"), "method": F.lit(method), "kind": F.lit(None).cast("string")}).drop("__new")


def _extent() -> Column:
    return F.when(F.col("data_len") > 0, F.col("data_len")).otherwise(F.octet_length("value"))


def base64_rows(rows: DataFrame) -> DataFrame:
    """Whole values in strict base64 whose decoding reads at least as well."""
    v = trimmed(F.col("value"))
    likely = F.expr(f"octet_length(value) >= 12 AND {SPARK.match('value', '[A-Z]')} AND {SPARK.match('value', '[a-z]')} AND {SPARK.match('value', '[0-9]')} AND NOT {SPARK.match('value', '^[a-z]{4}')}")
    gate = v.rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.length(v) % 4 == 0) & (F.coalesce(F.col("kind") == "Base64", F.lit(False)) | likely)
    data = F.when(gate, F.unbase64(v))
    exact = rows.where(gate).withColumn("__data", data).where(F.regexp_replace(F.base64("__data"), "[\r\n]", "") == v)
    text = exact.withColumn("__text", as_text(F.col("__data"))).where(F.col("__text").isNotNull())
    wide = F.octet_length("__text") * 2 <= F.octet_length("__data")
    return _done(text.where(wide | (quality(F.col("value")) <= quality(F.col("__text")))), F.col("__text"), "Base64Decode", _extent()).drop("__data", "__text")


def joined_literals(rows: DataFrame) -> DataFrame:
    """Base64 split over quoted literals that are concatenated."""
    v = F.col("value")
    gate = v.contains(" + ") | v.contains(" . ") | v.contains(" .. ")
    parts = F.regexp_extract_all(v, F.lit(r"['\"]([^'\"]+)['\"]"), 1)
    joined = F.array_join(parts, "")
    return base64_rows(rows.where(gate & (F.size(parts) >= 2) & (F.octet_length(joined) >= 12)).withColumns({"data_len": _extent().cast("int"), "value": joined}))


def embedded_base64_rows(rows: DataFrame) -> DataFrame:
    """Base64 tokens inside a value; offsets move by what stands before the token."""
    pattern = r"[A-Za-z0-9+/]{8,}={0,2}"
    found = rows.where(F.col("value").rlike(pattern)).withColumn("__m", F.regexp_extract_all("value", F.lit(pattern), 0)).select("*", F.posexplode("__m").alias("__n", "token"))
    asked = F.col("value").rlike(r"base64 +(-d|--decode|-D)\b")
    plain = F.octet_length(F.rtrim(F.col("token"), F.lit("=")))
    ok = (F.col("token") != F.col("value")) & (F.length("token") % 4 == 0) & ((plain >= 12) | F.col("token").endswith("=") | asked)
    decoded = found.where(ok).withColumn("__data", F.unbase64("token")).where(F.regexp_replace(F.base64("__data"), "[\r\n]", "") == F.col("token"))
    between = F.slice(F.split("value", pattern, -1), F.lit(1), F.col("__n") + 1)
    before = F.octet_length(F.concat(F.array_join(between, ""), F.array_join(F.slice("__m", F.lit(1), F.col("__n")), "")))
    decoded = decoded.withColumn("data_offset", (F.col("data_offset") + before).cast("long"))
    return _done(decoded, as_text(F.col("__data")), "Base64Decode", F.length("token")).drop("__m", "__n", "token", "__data")


def hex_rows(rows: DataFrame) -> DataFrame:
    gate = (F.octet_length("value") >= 16) & (F.octet_length("value") % 2 == 0) & F.col("value").rlike("^[0-9A-Fa-f]+$")
    return _done(rows.where(gate), as_text(F.when(gate, F.unhex("value"))), "HexDecode", F.lit(0))


def url_rows(rows: DataFrame) -> DataFrame:
    escapes = F.size(F.regexp_extract_all("value", F.lit("%[0-9A-Fa-f]{2}"), 0))
    letter = F.col("value").rlike("%(3[0-9]|4[1-9A-Fa-f]|5[0-9Aa]|6[1-9A-Fa-f]|7[0-9Aa])")
    gate = (F.coalesce(F.col("kind") == "UrlEncoded", F.lit(False)) | (escapes >= 3)) & (~F.col("value").contains("://") | letter)
    return _done(rows.where(gate), _python(codecs.url_text)(F.col("value")), "UrlDecode", _extent(), changed=True)


def unicode_rows(rows: DataFrame) -> DataFrame:
    return _done(rows.where(F.col("value").rlike(r"\\[xuU]")), _python(codecs.unicode_text)(F.col("value")), "UnicodeEscapeDecode", _extent(), changed=True)


def base32_rows(rows: DataFrame) -> DataFrame:
    gate = (F.octet_length("value") >= 16) & F.col("value").rlike("^[A-Z2-7]+=*$")
    return _done(rows.where(gate), _python(lambda s: codecs.bytes_to_text(codecs.base32_bytes(s)))(F.col("value")), "Base32Decode", _extent())


def base85_rows(rows: DataFrame) -> DataFrame:
    def decode(s: str) -> str | None:
        text = codecs.bytes_to_text(codecs.ascii85_bytes(s))
        return text if text is not None and codecs.quality(text.encode())[0] > codecs.quality(s.encode())[0] + 5 else None

    gate = (F.octet_length("value") >= 20) & F.col("value").rlike("^[!-uz~ \t\r\n]+$")
    return _done(rows.where(gate), _python(decode)(F.col("value")), "Base85Decode", _extent())


def fuzzy_base64(s: str) -> str | None:
    """Base64 hidden by substituted letters, surrounding code or missing padding, if it then reads."""
    import re

    trials = [s]
    for source, target in (("A", "+"), ("9", "/")):
        found = re.search(rf"replace\(\s*/?['\"/]?(.)['\"/]?[g/]*\s*,\s*['\"]{re.escape(target)}['\"]", s) or re.search(rf"replace\([^)]*['\"]{re.escape(target)}['\"]\)", s)
        if found:
            mark = found[1] if found.groups() else source
            trials.append(s.replace(mark, target))
    trials += sorted(re.findall(r"[A-Za-z0-9+/=]{24,}", s), key=len, reverse=True)[:3]
    trials += re.findall(r"=\s*['\"]([A-Za-z0-9+/=]{16,})['\"]", s)
    for t in trials:
        body = re.sub(r"[^A-Za-z0-9+/]", "", t)
        for cut in range(4):
            part = body[: len(body) - cut]
            data = codecs.strict_base64(part + "=" * (-len(part) % 4)) if len(part) % 4 != 1 else None
            text = None if data is None else codecs._text(data)
            if text and len(text) >= 10 and sum(32 <= ord(c) < 127 or c in "\t\n\r" for c in text) * 10 >= len(text) * 6 and re.search(r"[ /]|http|exec|eval|import|function|cmd|shell", text):
                return text
    return None


def fuzzy_base64_rows(rows: DataFrame) -> DataFrame:
    gate = (F.octet_length("value") >= 32) & (F.col("method") != "XorDecode") & F.col("value").rlike("[A-Za-z0-9+/]{16}")
    done = _done(rows.where(gate), _python(fuzzy_base64)(F.col("value")), "Base64ObfuscatedDecode", _extent())
    kind = F.when(F.col("value").rlike("https?://"), "Url").when(F.col("value").rlike(r"(/bin/|sh -c|curl |wget |powershell)"), "ShellCmd")
    return done.withColumn("kind", kind)


DECODERS = (base64_rows, joined_literals, embedded_base64_rows, fuzzy_base64_rows, base32_rows, base85_rows, hex_rows, url_rows, unicode_rows)


def decoded_rows(rows: DataFrame) -> DataFrame:
    """What every decoder makes of rows."""
    return reduce(DataFrame.unionByName, [f(rows) for f in DECODERS])


def decode_all(rows: DataFrame) -> DataFrame:
    """rows and what every decoder makes of them."""
    return rows.unionByName(decoded_rows(rows))
