"""Indicators: what a string row points at, canonical, rolled up by kind and value."""

from __future__ import annotations

import ipaddress
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stringloom.functions import lexicon as L
from stringloom.functions.dialect import DUCKDB, SPARK, Dialect, both, either

KEY = "blob_id"
KIND_ORDER = ("ip", "hostname", "key", "path")
EVIDENCE = 8


# --- IPv4 ---------------------------------------------------------------------------------


def external_ipv4(d: Dialect, c: str, bare: str) -> str:
    """Four strict octets that are routed on the internet; bare (SQL boolean) values must not look like a version."""
    a, b, e, f = (d.number(d.part(c, ".", i)) for i in range(1, 5))
    shape = d.match(c, r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$")
    inside = both(*(f"{x} BETWEEN 1 AND 255" for x in (a, b, e, f)))
    reserved = either(
        f"{a} = 10", f"{a} = 127", both(f"{a} = 100", f"{b} BETWEEN 64 AND 127"), both(f"{a} = 169", f"{b} = 254"), both(f"{a} = 172", f"{b} BETWEEN 16 AND 31"), both(f"{a} = 192", f"{b} = 168"),
        both(f"{a} = 198", f"{b} IN (18, 19)"), both(f"{a} = 198", f"{b} = 51", f"{e} = 100"), f"{a} >= 224",
    )
    version = both(bare, either(both(f"{a} < 10", f"{b} < 10", f"{e} < 10"), both(f"{e} = 1", f"{f} = 1")))
    return f"coalesce({both(shape, inside, f'NOT {reserved}', f'NOT {version}')}, false)"


def canonical_ipv6(s: str) -> str | None:
    """The compressed form of an address in global unicast space, or None."""
    try:
        ip = ipaddress.IPv6Address(s)
    except ValueError:
        return None
    if ip.ipv4_mapped is not None:
        return None
    top, second = int(ip) >> 112, int(ip) >> 96 & 0xFFFF
    if top >> 13 != 1 or (top == 0x2001 and second == 0x0DB8) or top & 0xFFF0 == 0x3FF0:
        return None
    return str(ip)


LABEL = "[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?"

# --- hostnames ----------------------------------------------------------------------------


def public_suffixes(spark: SparkSession) -> dict[str, str]:
    """suffix -> rule of the public suffix list that ships with Spark's own libraries.

    A rule is normal, wildcard (any one label in front) or exception. Some ten thousand entries,
    whatever the data.
    """
    names = ("mozilla/public-suffix-list.txt", "org/publicsuffix/list/effective_tld_names.dat")
    jvm = spark.sparkContext._jvm
    loader, text = jvm.Thread.currentThread().getContextClassLoader(), ""
    for name in names:
        stream = loader.getResourceAsStream(name)
        if stream is not None:
            scanner = jvm.java.util.Scanner(stream, "UTF-8").useDelimiter("\\A")
            text = scanner.next() if scanner.hasNext() else ""
            stream.close()
            break
    out = {}
    for line in text.split("\n") if text else ("com", "net", "org", "io", "dev", "edu", "gov"):
        word = line.strip().split(" ")[0]
        if not word or word.startswith("//"):
            continue
        rule = "wildcard" if word.startswith("*.") else "exception" if word.startswith("!") else "normal"
        word = word.removeprefix("*.").removeprefix("!").lower()
        try:
            out[word if word.isascii() else word.encode("idna").decode()] = rule
        except UnicodeError:
            continue
    return out


_suffixes: dict[str, object] = {}


def shared_suffixes(spark: SparkSession):
    app = spark.sparkContext.applicationId
    if app not in _suffixes:
        _suffixes[app] = spark.sparkContext.broadcast(public_suffixes(spark))
    return _suffixes[app]


def registrable(host: str, suffixes: dict[str, str]) -> bool:
    """Whether something stands in front of the host's longest public suffix; onion services are exempt."""
    labels = host.split(".")
    if labels[-1] == "onion":
        return len(labels[-2]) == 56 and not set(labels[-2]) - set("abcdefghijklmnopqrstuvwxyz234567")
    best = 0
    for k in range(1, len(labels) + 1):
        rule = suffixes.get(".".join(labels[-k:]))
        if rule == "exception":
            return True
        best = max(best, k + (rule == "wildcard")) if rule else best
    return 0 < best < len(labels)


def registered(host: str, suffixes: dict[str, str]) -> str | None:
    """A registrable host, in its ASCII form (IDNA), else null."""
    if not host.isascii():
        try:
            host = host.encode("idna").decode().lower()
        except UnicodeError:
            return None
        if not 0 < len(host) <= 253 or not re.fullmatch(rf"{LABEL}(\.{LABEL})+", host):
            return None
    return host if registrable(host, suffixes) else None


def _network(spark: SparkSession):
    """Canonical IPv6 address or registrable host name, else null; a null costs nothing."""
    shared = shared_suffixes(spark)

    @F.pandas_udf(StringType())
    def run(v: pd.Series) -> pd.Series:
        known, suffixes = {}, shared.value
        out = pd.Series([None] * len(v), dtype=object)
        for i in v.index[v.notna()]:
            x = v[i]
            if x not in known:
                known[x] = canonical_ipv6(x) if ":" in x else registered(x, suffixes)
            out[i] = known[x]
        return out

    return run.asNondeterministic()  # else the filter on its result makes Spark run it twice


def hostname_shape(d: Dialect, c: str) -> str:
    """Two labels or more of letters, digits and inner hyphens, 253 bytes at most."""
    return both(f"{d.size(c)} BETWEEN 1 AND 253", d.match(c, rf"^{LABEL}(\.{LABEL})+$"))


# --- paths --------------------------------------------------------------------------------


def ioc_path(d: Dialect, c: str) -> str:
    """An absolute path that points at something particular."""
    leaf = d.extract(c, r"[^/\\]*$", 0)
    posix = both(d.match(c, "^/[^/]"), f"{d.pieces(c, '/')} >= 2", d.match(c, r"^[/._+@ A-Za-z0-9\x{80}-\x{10FFFF}-]+$"))
    drive = both(d.match(c, r"^[A-Za-z]:[\\/]"), d.match(c, r'^..[^<>"|?*:]*$'))
    unc = both(d.match(c, r"^\\\\[\\/]*[^\\/]+[\\/]+[^\\/]+[\\/]+[^\\/]"), d.match(c, r'^[^<>"|?*:]*$'))
    ends = lambda names: d.match(leaf, "(?i)(" + "|".join("\\" + x for x in names) + ")$")
    tree = d.match(f"replace({c}, {d.lit(chr(92))}, '/')", "(?i)(" + "|".join(L.BUILD_TREES) + ")")
    windows = [p for p in L.SYSTEM_PATHS if ":" in p]
    common = either(
        d.among(c, [p for p in L.SYSTEM_PATHS if ":" not in p]), d.among(f"lower({c})", [*windows, "/drivers/etc/hosts"]), d.starts(c, *L.SYSTEM_PATH_STARTS), d.has(c, *L.SYSTEM_PATH_PARTS),
        both(d.starts(c, "/usr/lib/"), either(both(d.starts(leaf, "lib"), either(d.has(leaf, ".so"), d.ends(leaf, ".dylib"))), f"{leaf} = 'dyld'")),
    )
    return both(
        f"{d.size(c)} BETWEEN 1 AND 4096", f"NOT {d.match(c, r'^[ \t\n\x0b\f\r]|[ \t\n\x0b\f\r]$')}", f"NOT {d.match(c, r'[\x00-\x1f\x7f]')}", f"NOT {d.match(c, r'[${}]|%[sSdiuxXf@0-9]')}", f"NOT {d.has(c, '://')}",
        either(posix, drive, unc), f"{d.size(leaf)} >= 5", f"NOT {ends(L.SOURCE_ENDS)}", f"NOT ({tree} AND {ends(L.BUILD_ENDS)})", f"NOT {common}",
    )


# --- matching -----------------------------------------------------------------------------

AUTHORITY = r"[A-Za-z][A-Za-z0-9+.-]*://([^ \t\n\x0b\f\r/?#\"'<>]*)"
FOUND = "struct<k:string,a:string,bare:boolean,at:int>"


def matches(rows: DataFrame) -> DataFrame:
    """(...row, ioc_kind, ioc_value, port, value_at, value_len) for what each row points at, in one pass.

    Key rows give keys, path rows paths and nothing else; all other rows give the authorities of
    their URLs, and the value itself where it is an endpoint or typed as address or host. value_at
    and value_len are the bytes of the row's value that name the indicator.
    """
    kind, value = F.coalesce(F.col("kind"), F.lit("")), F.col("value")
    is_path = kind.isin("Path", "SuspiciousPath") & (F.col("method") != "PclntabSymbol")
    drive = F.when(value.rlike(r"^[A-Za-z]:"), F.concat(F.upper(F.substring("value", 1, 1)), F.expr("substr(value, 2)"))).otherwise(value)
    find = lambda k, a, bare, at: F.struct(F.lit(k).alias("k"), a.alias("a"), F.lit(bare).alias("bare"), at.cast("int").alias("at"))
    none = F.array().cast(f"array<{FOUND}>")
    whole = F.when(kind.isin("IP", "IPPort", "Hostname") | value.rlike(r"^[^ /]+:[0-9]{1,5}$"), F.array(find("net", value, True, F.lit(0)))).otherwise(none)
    between, urls = F.split(value, AUTHORITY, -1), F.regexp_extract_all(value, F.lit(AUTHORITY), 0)
    before = lambda i: F.octet_length(F.array_join(F.slice(between, F.lit(1), i + 1), "")) + F.octet_length(F.array_join(F.slice(urls, F.lit(1), i), ""))
    parts = F.transform(urls, lambda u, i: find("net", F.regexp_extract(u, AUTHORITY, 1), False, before(i) + F.locate("://", u) + 2))
    urls = F.when(value.contains("://"), parts).otherwise(none)
    finds = (
        F.when((kind == "XorKey") & (F.octet_length("value") <= 4096), F.array(find("key", key_text(value, F.col("method")), False, F.lit(0))))
        .when(is_path & F.expr(ioc_path(SPARK, "value")), F.array(find("path", drive, False, F.lit(0))))
        .when((kind != "XorKey") & ~is_path, F.concat(urls, whole))
        .otherwise(none)
    )
    found = rows.where(F.col("method") != "CodeSignature").select("*", F.explode(finds).alias("__x"))
    user = F.when(F.col("__x.k") == "net", F.regexp_extract("__x.a", "^(.*@)", 1)).otherwise(F.lit(""))
    found = found.select("*", F.col("__x.k").alias("__k"), F.col("__x.bare").alias("__bare"), (F.col("__x.at") + F.octet_length(user)).alias("__at"), F.expr("substr(__x.a, length({}) + 1)".format("CASE WHEN __x.k = 'net' THEN regexp_extract(__x.a, '^(.*@)', 1) ELSE '' END")).alias("__a")).drop("__x")
    v6, port6 = F.regexp_extract("__a", r"^\[([0-9A-Fa-f:.]+)\](?::([0-9]+))?$", 1), F.regexp_extract("__a", r"^\[[0-9A-Fa-f:.]+\](?::([0-9]+))?$", 1)
    bare6 = F.col("__a").rlike("^[0-9A-Fa-f.]*:[0-9A-Fa-f:.]*:[0-9A-Fa-f.]*$")
    host = F.when(v6 != "", v6).when(bare6, F.col("__a")).otherwise(F.regexp_extract("__a", r"^([^:]*)(?::([0-9]+))?$", 1))
    port = F.when(v6 != "", port6).when(bare6, F.lit("")).otherwise(F.regexp_extract("__a", r"^[^:]*:([0-9]+)$", 1))
    net = F.col("__k") == "net"
    found = found.withColumns({"value_at": F.col("__at") + F.when(net & (v6 != ""), 1).otherwise(0), "value_len": F.when(net, F.octet_length(host)).otherwise(F.octet_length("value"))})
    found = found.withColumns({"__host": F.when(net, F.regexp_replace(F.lower(host), r"\.$", "")), "__port": F.when(net, port)})
    found = found.withColumn("port", F.expr("try_cast(nullif(__port, '') AS INT)")).where(~net | ((F.col("__host") != "") & ((F.col("__port") == "") | F.col("port").between(1, 65535))))
    found = found.withColumn("__v4", net & F.expr(external_ipv4(SPARK, "__host", "(__bare AND port IS NULL)")))
    is_v6 = F.col("__host").contains(":")
    named = (F.expr(hostname_shape(SPARK, "__host")) | ~F.col("__host").rlike(r"^[\x00-\x7f]*$")) & ~F.col("__host").rlike(r"^[0-9.]+$") & ~(F.col("method").isin(*L.METADATA_METHODS) & metadata_host(F.col("__host")))
    ask = _network(rows.sparkSession)(F.when(net & ~F.col("__v4") & (is_v6 | named), F.col("__host")))
    found = found.withColumn("__net", ask)
    found = found.withColumns({
        "ioc_kind": F.when(~net, F.col("__k")).when(F.col("__v4") | F.col("__net").contains(":"), F.lit("ip")).otherwise(F.lit("hostname")),
        "ioc_value": F.when(~net, F.col("__a")).when(F.col("__v4"), F.col("__host")).otherwise(F.col("__net")),
    })
    return found.where(F.col("ioc_value").isNotNull()).select(*rows.columns, "ioc_kind", "ioc_value", "port", "value_at", "value_len")


def metadata_host(host: Column) -> Column:
    return host.isin(*L.METADATA_HOSTS) | F.substring_index(host, ".", -2).isin(*L.METADATA_DOMAINS)


def key_text(value: Column, method: Column) -> Column:
    """Key bytes as unpadded base64url; XorStackPair keys are given in hex."""
    hexed = (method == "XorStackPair") & value.rlike("^0x([0-9A-Fa-f]{2})+$")
    data = F.when(hexed, F.unhex(F.expr("substr(value, 3)"))).otherwise(F.encode(value, "UTF-8"))
    return F.concat(F.lit("base64url:"), F.translate(F.regexp_replace(F.base64(data), "[=\r\n]", ""), "+/", "-_"))


def key_bytes(value: Column) -> Column:
    """The bytes of a canonical key indicator; null for padding, another alphabet or stray trailing bits."""
    body = F.substring(value, 11, 1 << 20)
    padded = F.concat(F.translate(body, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(body), F.lit(4))))
    data = F.when(value.rlike("^base64url:[A-Za-z0-9_-]+$") & (F.pmod(F.length(body), F.lit(4)) != 1), F.unbase64(padded))
    return F.when(key_text(data, F.lit("")) == value, data)


def rollup(found: DataFrame) -> DataFrame:
    """(kind, value, ports, key, count, occurrences): all occurrences counted, the first EVIDENCE kept.

    An occurrence has the source's byte spans (a value built from several places has several), the
    span of the indicator in the value, port and method. key names a key's algorithms and size.
    First counts map-side; the evidence is cut by rank before it is gathered, so that a value that
    a third of all rows hold costs no task more than EVIDENCE rows a partition.
    """
    spans = "array<struct<offset:bigint,length:int>>"
    extent = F.when(F.col("data_len") > 0, F.col("data_len")).otherwise(F.octet_length("value"))
    own = F.array(F.struct(F.col("data_offset").alias("offset"), extent.cast("int").alias("length"))).cast(spans)
    pieces = F.coalesce(F.col("fragments").cast(spans), own) if "fragments" in found.columns else own
    ranked = found.withColumns({"part": F.pmod(F.xxhash64(KEY), F.lit(64)), "__spans": pieces})
    order = ["blob_id", "data_offset", "value"]
    local = Window.partitionBy("ioc_kind", "ioc_value", "part").orderBy(order)
    first = ranked.withColumn("r", F.row_number().over(local)).where(F.col("r") <= EVIDENCE)
    final = Window.partitionBy("ioc_kind", "ioc_value").orderBy(order)
    first = first.withColumn("r", F.row_number().over(final)).where(F.col("r") <= EVIDENCE)
    at = [F.col(c) if c in found.columns else F.lit(None).cast("int").alias(c) for c in ("value_at", "value_len")]
    seen = F.struct("r", KEY, F.col("__spans").alias("source_spans"), F.struct(at[0].alias("offset"), at[1].alias("length")).alias("value_span"), "port", "method")
    seen = first.groupBy("ioc_kind", "ioc_value").agg(F.sort_array(F.collect_list(seen)).alias("occurrences"))
    counts = found.groupBy("ioc_kind", "ioc_value").agg(F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_set("port")).alias("ports"))
    out = counts.join(seen, ["ioc_kind", "ioc_value"]).withColumnsRenamed({"ioc_kind": "kind", "ioc_value": "value"})
    key = F.when(F.col("kind") == "key", F.struct(F.array(F.lit("xor")).alias("algorithms"), F.octet_length(key_bytes(F.col("value"))).alias("bytes")))
    return out.select("kind", "value", "ports", key.alias("key"), "count", "occurrences")


def extract_iocs(rows: DataFrame) -> DataFrame:
    return rollup(matches(rows))


def ordered(iocs: DataFrame) -> DataFrame:
    at = F.array_position(F.array(*(F.lit(k) for k in KIND_ORDER)), F.col("kind"))
    return iocs.orderBy(at, "value")


__all__ = ["DUCKDB", "canonical_ipv6", "extract_iocs", "external_ipv4", "hostname_shape", "ioc_path", "matches", "ordered", "public_suffixes", "rollup"]
