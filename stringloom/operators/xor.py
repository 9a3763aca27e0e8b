"""XOR search: single-byte keys, explicit multi-byte keys, rolling and incremental keys, key ranking.

Byte scans run in mapInArrow, one blob at a time; ranking, key histograms and overlap resolution
are DataFrame operations.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stringloom.functions.dialect import SPARK
from stringloom.functions.keys import candidate_sql, score_sql

from .binary import outside_code

KEY = "blob_id"
FINDS = "blob_id string, value string, data_offset long, data_len int, method string, key binary"
# Plaintexts that the one-byte and the incremental search look for.
ANCHORS = (b"://", b"/bin", b"/proc", b"C:\\", b"Mozilla", b".exe", b".dll", b"passw", b"Library", b"Ethereum", b" %s ", b"ld.so", b"BCrypt", b"CreateProcess")
# Plaintexts that the search for short rolling keys looks for.
ROLLING_ANCHORS = (
    b"%USERPROFILE%", b"%APPDATA%", b"%LOCALAPPDATA%", b"%TEMP%", b"%PROGRAMDATA%", b"%SYSTEMROOT%", b"%HOMEDRIVE%", b"%HOMEPATH%",
    b"HKEY_LOCAL_MACHINE", b"HKEY_CURRENT_USER", b"HKEY_CLASSES_ROOT", b"SOFTWARE\\", b"\\Microsoft\\",
)
# The key that is a mere case flip, and limits; an incremental key's anchors have LONG bytes.
SKIP_KEY, MIN_LENGTH, SCAN_LIMIT, REACH, LONG = 0x20, 10, 5 << 20, 200, 4
#: Rows that a task gathers from many small blobs before it gives them on.
ROWS_A_BATCH = 1 << 13
PRINTABLE = np.zeros(256, bool)
PRINTABLE[list(range(0x20, 0x7F)) + [9]] = True


def _run_around(plain: bytes, at: int, size: int) -> tuple[int, int]:
    """The printable run around a find, within REACH on each side."""
    ok = PRINTABLE[np.frombuffer(plain, np.uint8)]
    low, high = max(0, at - REACH), min(len(plain), at + size + REACH)
    start = at
    while start > low and ok[start - 1]:
        start -= 1
    end = at + size
    while end < high and ok[end]:
        end += 1
    return start, end


@cache
def _automaton(growing: bool, wide: bool = False):
    """All anchors under all one-byte keys; growing: under keys that grow by one a byte, by their first value; wide: as UTF-16LE."""
    words: dict[str, list[tuple[int, int]]] = {}
    for key in range(256):
        for a in (x for x in ANCHORS if len(x) >= LONG or not growing):
            a = a.decode().encode("utf-16-le") if wide else a
            word = bytes(b ^ ((key + j * growing) & 255) for j, b in enumerate(a)).decode("latin-1")
            words.setdefault(word, []).append((key, len(a)))
    found = ahocorasick.Automaton()
    for word, keys in words.items():
        found.add_word(word, keys)
    found.make_automaton()
    return found


def _hits(data: bytes, growing: bool, wide: bool = False) -> list[tuple[int, int, int]]:
    """(key, place, size) of the anchors in one pass over the data."""
    return sorted((key, end + 1 - size, size) for end, keys in _automaton(growing, wide).iter(data.decode("latin-1")) for key, size in keys)


def single_byte_finds(data: bytes, wide: bool | None = None) -> Iterator[tuple[str, int, int, bytes]]:
    """Printable runs around an anchor, for each key but 0 and the case flip; in PE blobs also UTF-16LE runs."""
    if not data or len(data) > SCAN_LIMIT:
        return
    raw, seen = np.frombuffer(data, np.uint8), set()
    for key, at, size in _hits(data, False):
        if key in (0, SKIP_KEY):
            continue
        low, high = max(0, at - REACH), min(len(data), at + size + REACH)
        plain = (raw[low:high] ^ np.uint8(key)).tobytes()
        s, e = _run_around(plain, at - low, size)
        value = plain[s:e].decode("ascii").strip()
        if len(value) >= MIN_LENGTH and (key, low + s) not in seen and varied(value):
            seen.add((key, low + s))
            yield value, low + s, e - s, bytes([key])
    if data[:2] == b"MZ" if wide is None else wide:
        yield from _wide_finds(data)


def varied(value: str) -> bool:
    """Text rather than padding under a key: more than a quarter of the characters differ, or eight do."""
    distinct = len(set(value))
    return distinct >= 8 or distinct * 4 > len(value)


def _wide_finds(data: bytes) -> Iterator[tuple[str, int, int, bytes]]:
    """UTF-16LE runs of printable ASCII around a wide anchor, whole; lengths are in bytes of the blob."""
    ends: dict[tuple[int, int], int] = {}  # (key, parity) -> end of the last run
    for key, at, size in _hits(data, False, True):
        if key in (0, SKIP_KEY) or at < ends.get((key, at % 2), 0):
            continue
        good = lambda i: data[i + 1] == key and PRINTABLE[data[i] ^ key]  # noqa: B023, E731
        start, end = at, at + size
        while start >= 2 and good(start - 2):
            start -= 2
        while end + 1 < len(data) and good(end):
            end += 2
        ends[key, at % 2] = end
        value = bytes(b ^ key for b in data[start:end:2]).decode("ascii").strip()
        if len(value) >= MIN_LENGTH:
            yield value, start, end - start, bytes([key])


def _echo(value: str, key: bytes) -> bool:
    """Whether a value is the key itself shining through constant data, in any phase."""
    k = key.decode("latin-1").strip().lower()
    low = value.lower()
    if len(key) > 1 and len(k) == len(key):
        turns = {(k + k)[i : i + len(k)] for i in range(len(k))}
        return sum(low.count(t) for t in turns) * len(k) * 2 >= len(value)
    return len(set(low)) * 4 <= len(value)


def keyed_finds(data: bytes, key: bytes, min_length: int = MIN_LENGTH) -> Iterator[tuple[str, int, int, bytes]]:
    """Printable runs of the data under a repeated key, for each phase of the key; the longest first where they meet."""
    if not data or not key:
        return
    raw = np.frombuffer(data, np.uint8)
    zero = np.concatenate([[False], raw == 0, [False]])
    blank = zero[1:-1] & (zero[:-2] | zero[2:])  # two NULs or more end a run: only the key shows there
    found = []
    for phase in range(len(key)):
        mask = np.frombuffer((key[phase:] + key[:phase]) * (len(data) // len(key) + 1), np.uint8)[: len(data)]
        plain = raw ^ mask
        good = np.concatenate([[0], (PRINTABLE[plain] & ~blank).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(good))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - s >= min_length:
                value = plain[s:e].tobytes().decode("ascii")
                letters = sum(c.isalnum() or c in " /._-:" for c in value)
                if letters * 10 >= len(value) * 8 and not _echo(value, key):
                    found.append((e - s, s, value))
    starts, ends = [], []  # of the finds taken, in order; they don't overlap
    for n, s, value in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
        at = bisect_right(starts, s)
        if (at and ends[at - 1] > s) or (at < len(starts) and starts[at] < s + n):
            continue
        starts.insert(at, s)
        ends.insert(at, s + n)
        yield value, s, n, key


def rolling_finds(data: bytes, most: int = 4) -> Iterator[tuple[str, int, int, bytes]]:
    """Keys of one to four bytes that an anchor and a different one nearby agree on."""
    if not data or len(data) > SCAN_LIMIT:
        return
    raw, found = np.frombuffer(data, np.uint8), {}
    for anchor in ROLLING_ANCHORS:
        a = np.frombuffer(anchor, np.uint8)
        if len(data) < len(a):
            continue
        stream = np.lib.stride_tricks.sliding_window_view(raw, len(a)) ^ a
        for n in range(1, most + 1):
            periodic = (stream[:, n:] == stream[:, :-n]).all(axis=1)
            periodic &= (stream[:, :n] != stream[:, :1]).any(axis=1) if n > 1 else stream[:, 0] != 0
            for at in np.flatnonzero(periodic).tolist():
                if len(set(data[at : at + len(a)])) < 4:
                    continue  # constant data under a key made of the anchor itself
                key = np.roll(stream[at, :n], at % n).tobytes()
                found.setdefault(key, []).append((at, anchor))
    for key, places in sorted(found.items()):
        places.sort()
        if any(y[0] - x[0] <= 2048 and x[1] != y[1] for x, y in zip(places, places[1:], strict=False)):
            low, high = max(0, places[0][0] - 4096), min(len(data), places[-1][0] + 4096)
            low -= low % len(key)
            for value, s, n, _ in keyed_finds(data[low:high], key):
                yield value, low + s, n, key


def incremental_finds(data: bytes) -> Iterator[tuple[str, int, int, bytes]]:
    """Runs under a key that grows by one a byte, from any seed."""
    if not data or len(data) > SCAN_LIMIT:
        return
    raw, seen = np.frombuffer(data, np.uint8), set()
    for first, at, size in _hits(data, True):
        seed = (first - at) & 255
        low, high = max(0, at - REACH), min(len(data), at + size + REACH)
        plain = (raw[low:high] ^ ((np.arange(low, high) + seed) & 255).astype(np.uint8)).tobytes()
        s, e = _run_around(plain, at - low, size)
        value = plain[s:e].decode("ascii").strip()
        if seed and len(value) >= MIN_LENGTH and (seed, low + s) not in seen:
            seen.add((seed, low + s))
            yield value, low + s, e - s, bytes([seed])


_DOTTED = re.compile(rb"(?<![0-9.])(?:[1-9][0-9]{0,2}\.){3}[1-9][0-9]{0,2}(?::[1-9][0-9]{0,4})?(?![0-9.])|(?<![a-z0-9.-])[a-z](?:[a-z-]{3,60})\.com(?![a-z0-9.-])")

_LETTERS, _DIGITS = b"abcdefghijklmnopqrstuvwxyz-", b"0123456789"


def dotted_finds(data: bytes) -> Iterator[tuple[str, int, int, bytes]]:
    """Addresses, endpoints and plain .com names under one-byte keys; tables of small numbers don't count."""
    if not data or len(data) > SCAN_LIMIT:
        return
    raw = np.frombuffer(data, np.uint8)
    n, small = len(raw), np.concatenate([[0], np.cumsum(raw < 0x20)])
    keys, after = raw ^ np.uint8(0x2E), np.concatenate([raw, np.zeros(4, np.uint8)])  # each byte is a dot under one key
    plain = lambda d: after[d : d + n] ^ keys
    digit = lambda x: (x >= 0x30) & (x <= 0x39)
    address = digit(np.concatenate([raw[:1], raw[:-1]]) ^ keys) & digit(plain(1)) & ((after[2 : n + 2] == raw) | (after[3 : n + 3] == raw) | (after[4 : n + 4] == raw))
    name = (plain(1) == ord("c")) & (plain(2) == ord("o")) & (plain(3) == ord("m"))
    for dot in np.flatnonzero((address | name) & (keys != 0) & (keys != SKIP_KEY)).tolist():
        first = max(0, dot - 80)  # longer than any name that counts
        text = (raw[first : dot + 40] ^ keys[dot]).tobytes()
        own, start = _LETTERS if name[dot] else _DIGITS, dot - first
        while start and text[start - 1] in own:
            start -= 1
        m = _DOTTED.match(text, start)
        if m:
            at, end = first + m.start(), first + m.end()
            low, high = max(0, at - 32), min(n, end + 32)
            value = m[0].decode("ascii")
            host, _, port = value.partition(":")
            if (small[high] - small[low]) * 100 >= (high - low) * 85 or len(set(data[at:end])) < 4:
                continue
            if host[0].isdigit():
                octets = [int(x) for x in host.split(".")]
                if max(octets) > 255 or octets[0] in (10, 127) or octets[0] >= 224 or len(set(octets)) < 2 or (port and int(port) > 65535):
                    continue
            elif max(host.count(c) for c in host[:-4]) * 2 > len(host) - 4:
                continue
            yield value, at, end - at, bytes([keys[dot]])


def scan(blobs: DataFrame, finder, content: str = "content") -> DataFrame:
    """Finds of a scanner over (blob_id, content) rows."""
    fields = pa.schema([("blob_id", pa.string()), ("value", pa.string()), ("data_offset", pa.int64()), ("data_len", pa.int32()), ("method", pa.string()), ("key", pa.binary())])

    def given(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)] if rows else [pa.array([], f.type) for f in fields], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for blob, data in zip(batch.column(0), batch.column(1), strict=True):
                for v, at, n, key in finder(data.as_py() or b""):
                    rows.append((blob.as_py(), v, at, n, "XorDecode", key))
                    if len(rows) >= ROWS_A_BATCH:
                        yield given(rows)
                        rows = []
            yield given(rows)

    return blobs.select(F.col(KEY).cast("string"), F.col(content)).mapInArrow(run, FINDS)


def without_code(finder):
    """The finder over what a blob has outside of executable sections."""

    def run(data: bytes) -> Iterator[tuple[str, int, int, bytes]]:
        for start, piece in outside_code(data) if 0 < len(data) <= SCAN_LIMIT else ():
            for value, at, n, key in finder(piece):
                yield value, start + at, n, key

    return run


def single_byte(blobs: DataFrame) -> DataFrame:
    return scan(blobs, single_byte_in)


def single_byte_in(data: bytes) -> Iterator[tuple[str, int, int, bytes]]:
    return without_code(lambda piece: single_byte_finds(piece, data[:2] == b"MZ"))(data)


def rolling(blobs: DataFrame) -> DataFrame:
    return scan(blobs, without_code(rolling_finds))


def incremental(blobs: DataFrame) -> DataFrame:
    return scan(blobs, without_code(incremental_finds))


def dotted(blobs: DataFrame) -> DataFrame:
    return scan(blobs, without_code(dotted_finds))


def repeated_keys(finds: DataFrame, least: int = 2) -> DataFrame:
    """(blob_id, key) of the keys with several finds: these are worth a full pass."""
    return finds.groupBy(KEY, "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def with_key(blobs: DataFrame, key: bytes, min_length: int = MIN_LENGTH) -> DataFrame:
    return scan(blobs, lambda data: keyed_finds(data, key, min_length))


def with_own_keys(blobs: DataFrame, keys: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Each blob under each of its keys (blob_id, key)."""
    pairs = blobs.join(keys.select(KEY, F.col("key").alias("__key")), KEY).select(KEY, F.struct("content", "__key").alias("content"))

    def finder(x):
        return keyed_finds(x["content"], x["__key"], min_length) if x else ()

    return scan(pairs, finder)


def key_candidates(rows: DataFrame, most: int = 5) -> DataFrame:
    """The best-scored key candidates among a blob's strings."""
    good = rows.where(F.expr(candidate_sql(SPARK, "value"))).withColumn("score", F.expr(score_sql(SPARK, "value")))
    order = Window.partitionBy(KEY).orderBy(F.col("score").desc(), F.col("data_offset").desc(), "value")
    return good.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


# What speaks for a key when its finds hold it, and the total that accepts one.
KEY_SIGNS = (
    (100, ("osascript", "screencapture", "/bin/sh", "/bin/bash", "2>&1", "<<eod", "<<eof")),
    (80, ("ethereum", "bitcoin", "electrum", "wallet", "keystore", "monero", "litecoin", "dogecoin", "cryptocurrency", "mnemonic", "seed phrase")),
    (40, ("safari", "chrome", "firefox", "mozilla", "webkit", "chromium", "opera", "edge")),
)
KEY_KINDS = (("SuspiciousPath", 75), ("Url", 50), ("IP", 50), ("IPPort", 50), ("ShellCmd", 30), ("Path", 10), ("Base64", 5))
LOCALE_SCORE, ACCEPT = 25, 375


def find_weight() -> Column:
    """What one classified find (value, kind) says for its key."""
    low, out = F.lower("value"), F.lit(0)
    for weight, words in KEY_SIGNS:
        out = out + F.when(reduce(Column.__or__, [low.contains(w) for w in words]), weight).otherwise(0)
    for kind, weight in KEY_KINDS:
        out = out + F.when(F.col("kind") == kind, weight).otherwise(0)
    return out + F.when(F.col("value").rlike("^[a-z]{2,3}[_-][A-Z]{2,3}$"), LOCALE_SCORE).otherwise(0)


def best_keys(finds: DataFrame) -> DataFrame:
    """(blob_id, key, score): each blob's best key, if its distinct classified finds weigh ACCEPT or more."""
    once = finds.dropDuplicates([KEY, "key", "value"]).withColumn("weight", find_weight())
    scored = once.groupBy(KEY, "key").agg(F.sum("weight").alias("score")).where(F.col("score") >= ACCEPT)
    return scored.groupBy(KEY).agg(F.max(F.struct("score", "key")).alias("best")).select(KEY, "best.key", "best.score")


def own_key_finds(blobs: DataFrame, rows: DataFrame, with_kind, min_length: int = MIN_LENGTH) -> DataFrame:
    """Finds of each blob under the best of the keys that its own strings suggest, and a row for the key."""
    keys = key_candidates(rows).select(KEY, F.encode("value", "UTF-8").alias("key"), "data_offset")
    named = with_kind(with_own_keys(blobs, keys, min_length))
    best = best_keys(named)
    kept = named.join(best.select(KEY, "key"), [KEY, "key"], "left_semi").select(KEY, "value", "data_offset", "data_len", "method", "kind")
    at = best.join(keys, [KEY, "key"]).select(KEY, F.decode("key", "UTF-8").alias("value"), "data_offset", F.octet_length("key").alias("data_len"), F.lit("XorDecode").alias("method"), F.lit("XorKey").alias("kind"))
    return kept.unionByName(at)


def clean_tail(value: Column, kind: Column) -> Column:
    """A find without what the key makes of the bytes behind it: the tail of URLs, lists of locales and words.

    A URL ends after its numeric host and port, or after its last character that URLs use; a list of
    locales after its last separator; other text before its first four consonants in a row, if ten
    characters or more stand before them.
    """
    numeric = F.regexp_extract(value, r"^(.*?://[0-9]+(?:\.[0-9]+){3}(?::[0-9]+)?)", 1)
    named = F.regexp_extract(value, r"^(.*?://.*[A-Za-z0-9/._?=&%#+-])", 1)
    url = F.when(value.rlike(r"://[0-9]") & (numeric != ""), numeric).when(~value.rlike(r"://[0-9]") & (named != ""), named).otherwise(value)
    locales = F.when(value.rlike("[;,]"), F.regexp_extract(value, r"^(.*[;,])", 1)).otherwise(value)
    words = F.regexp_extract(value, r"^(.{10,}?)(?=[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]{4})", 1)
    listed = value.rlike(r"[a-z]{2,3}[_-][A-Z]{2,3}[;,][a-z]{2,3}[_-][A-Z]{2,3}[;,]")
    return F.when(value.contains("://"), url).when(listed, locales).when(kind.isNull() & (F.length(words) >= 10) & (F.length(value) >= 8) & ~value.rlike("(?i)^.{0,9}[b-df-hj-np-tv-z]{4}"), words).otherwise(value)


def parse_key(text: str) -> bytes:
    """0x… or bare hex of even length as bytes, anything else literally."""
    body = text[2:] if text[:2] in ("0x", "0X") else text
    if body and len(body) % 2 == 0 and re.fullmatch("[0-9A-Fa-f]+", body):
        return bytes.fromhex(body)
    return text.encode()
