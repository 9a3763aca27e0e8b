"""Script payloads: language detection by column scores, matchers and a decode algebra."""

from __future__ import annotations

import base64 as b64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringloom.functions import codecs

KEY = "blob_id"
PAYLOADS = "blob_id string, decoded string, data_offset long, chain string, language string, depth int"
DEPTH, LEAST = 3, 20

# Signs of each language, and how many make it.
PYTHON_SIGNS = ("import ", "exec(", "eval(", "def ", "print(", "base64.b64decode", "zlib.decompress", "bytes.fromhex", "codecs.decode", "lambda ", "__import__", "chr(")
JS_SIGNS = ("eval(", "atob(", "function", "var ", "let ", "const ", "String.fromCharCode", "Buffer.from", "document.", "window.", ".split(", "=>")
POWERSHELL_STRONG = ("-encodedcommand", "frombase64string", "invoke-expression", "-executionpolicy", "[char[]]")
POWERSHELL_MODERATE = ("iex ", "iex(", "$env:", "new-object", "write-host", "[system.", "-join", "param(", "powershell")


def scores(text: Column) -> dict[str, Column]:
    head = F.substring(text, 1, 8192)
    low = F.lower(head)
    count = lambda c, signs: sum((F.when(c.contains(s), 1).otherwise(0) for s in signs), F.lit(0))
    return {"python": count(head, PYTHON_SIGNS), "javascript": count(head, JS_SIGNS), "strong": count(low, POWERSHELL_STRONG), "moderate": count(low, POWERSHELL_MODERATE)}


def language(text: Column) -> Column:
    """php, powershell, python, javascript or null."""
    s = scores(text)
    return (
        F.when(F.substring(text, 1, 8192).rlike(r"<\?(php|=)"), "php").when((s["strong"] >= 1) | (s["moderate"] >= 2), "powershell")
        .when((s["python"] >= 2) & (s["python"] > s["javascript"]), "python").when((s["javascript"] >= 2) & (s["javascript"] >= s["python"]), "javascript")
    )


def language_sql() -> str:
    """The same over a column t, for checking."""
    n = lambda c, signs: "(" + " + ".join(f"CASE WHEN contains({c}, '{s}') THEN 1 ELSE 0 END" for s in signs) + ")"
    head, low = "substr(t, 1, 8192)", "lower(substr(t, 1, 8192))"
    p, j = n(head, PYTHON_SIGNS), n(head, JS_SIGNS)
    return f"CASE WHEN regexp_matches({head}, '<\\?(php|=)') THEN 'php' WHEN {n(low, POWERSHELL_STRONG)} >= 1 OR {n(low, POWERSHELL_MODERATE)} >= 2 THEN 'powershell' WHEN {p} >= 2 AND {p} > {j} THEN 'python' WHEN {j} >= 2 AND {j} >= {p} THEN 'javascript' END"


def _b64(data: bytes) -> bytes | None:
    text = re.sub(rb"\s", b"", data)
    try:
        return b64.b64decode(text + b"=" * (-len(text) % 4), validate=True)
    except ValueError:
        return None


def _numbers(data: bytes) -> bytes | None:
    found = re.findall(rb"0x[0-9A-Fa-f]+|\d+", data)
    codes = [int(x, 16) if x[:2] == b"0x" else int(x) for x in found]
    return "".join(map(chr, codes)).encode() if codes and max(codes) < 0x110000 and not any(0xD800 <= c < 0xE000 for c in codes) else None


def _wide(data: bytes) -> bytes | None:
    try:
        return data.decode("utf-16-le").encode()
    except UnicodeDecodeError:
        return None


STEPS = {
    "base64": _b64, "zlib": codecs.inflate, "gzip": codecs.inflate, "deflate": lambda d: codecs.inflate(d, raw=True), "utf16le": _wide, "reverse": lambda d: d.decode(errors="replace")[::-1].encode(),
    "charcodes": _numbers, "rot13": lambda d: codecs.rot13(d.decode(errors="replace")).encode(), "hex": lambda d: bytes.fromhex(d.decode()) if len(d) % 2 == 0 and re.fullmatch(rb"[0-9A-Fa-f]+", d) else None,
}


def decode_chain(data: bytes, steps: tuple[str, ...]) -> str | None:
    for step in steps:
        key = re.fullmatch(r"xor\((\d+)\)", step)
        data = bytes(b ^ int(key[1]) for b in data) if key else STEPS[step](data)
        if data is None or len(data) > codecs.MAX_TEXT:
            return None
    try:
        return data.decode() or None
    except UnicodeDecodeError:
        return None


Q = r"""['"]"""
B = r"([A-Za-z0-9+/=\s]{12,}?)"
# The shapes payloads come in, with the steps that undo them.
MATCHERS: dict[str, tuple[tuple[str, tuple[str, ...]], ...]] = {
    "python": (
        (rf"zlib\.decompress\(\s*base64\.b64decode\(\s*b?{Q}{B}{Q}", ("base64", "zlib")), (rf"(?<!decompress\()base64\.b64decode\(\s*b?{Q}{B}{Q}", ("base64",)), (rf"bytes\.fromhex\(\s*{Q}([0-9A-Fa-f]+){Q}", ("hex",)),
        (r"(?:chr\(\w+\) for \w+ in|map\(chr,)\s*\[([0-9,\sxA-Fa-f]+)\]", ("charcodes",)), (rf"codecs\.decode\(\s*{Q}([^'\"]+){Q},\s*{Q}rot_?13{Q}", ("rot13",)),
    ),
    "javascript": (
        (rf"atob\(\s*{Q}{B}{Q}", ("base64",)), (rf"Buffer\.from\(\s*{Q}{B}{Q}\s*,\s*{Q}base64{Q}", ("base64",)), (r"String\.fromCharCode\(([0-9,\sxA-Fa-f]+)\)", ("charcodes",)),
        (rf"{Q}([^'\"]+){Q}\.split\(\s*{Q}{Q}\s*\)\.reverse\(\)\.join\(", ("reverse",)),
    ),
    "php": (
        (rf"gzinflate\(\s*base64_decode\(\s*{Q}{B}{Q}", ("base64", "deflate")), (rf"gzuncompress\(\s*base64_decode\(\s*{Q}{B}{Q}", ("base64", "zlib")),
        (rf"(?<!gzinflate\()(?<!gzuncompress\()base64_decode\(\s*{Q}{B}{Q}", ("base64",)), (rf"str_rot13\(\s*{Q}([^'\"]+){Q}", ("rot13",)),
    ),
    "powershell": (
        (r"(?i)-e(?:nc(?:odedcommand)?|c)?\s+([A-Za-z0-9+/=]{16,})", ("base64", "utf16le")), (rf"(?i)Unicode\.GetString\(.{{0,40}}FromBase64String\(\s*{Q}{B}{Q}", ("base64", "utf16le")),
        (rf"(?i)UTF8\.GetString\(.{{0,40}}FromBase64String\(\s*{Q}{B}{Q}", ("base64",)), (r"(?i)\[char\[\]\]\s*\(?\s*\(([0-9,\sxA-Fa-f]+)\)", ("charcodes",)),
        (rf"(?i){Q}([^'\"]{{8,}}){Q}\[-1\.\.-\(?", ("reverse",)), (rf"(?i)FromBase64String\(\s*{Q}{B}{Q}", ("base64",)),
    ),
}


# The parts of Python's chain over aliased imports, and of PowerShell's replaced strings.
ALIAS = re.compile(rf"(\w+)\s*=\s*__import__\s*\(\s*{Q}(base64|zlib|codecs|marshal){Q}\s*\)")
B64_VARIABLE = re.compile(r"\.b64decode\s*\(\s*(\w+)\s*\)")
STRING_VALUE = re.compile(rf"(\w+)\s*=\s*b?{Q}([A-Za-z0-9+/=\s]{{20,}}){Q}")
INT_VALUE = re.compile(r"(?m)\b(\w+)\s*=\s*(0x[0-9A-Fa-f]+|\d+)\b")
XOR_LAMBDA = re.compile(r"\w+\s*=\s*lambda\s+\w+(?:\s*,\s*\w+)*\s*:\s*bytes\s*\(\s*\[\s*\w+\s*\^\s*(\w+)\s+for")
REPLACED = re.compile(rf"(?i)(?:iex|invoke-expression)\s*\(\s*{Q}([^'\"]+){Q}((?:\s*\.replace\s*\(\s*{Q}[^'\"]*{Q}\s*,\s*{Q}[^'\"]*{Q}\s*\))+)")
REPLACE_PAIR = re.compile(rf"(?i)\.replace\s*\(\s*{Q}([^'\"]*){Q}\s*,\s*{Q}([^'\"]*){Q}\s*\)")


def aliased_chain(text: str) -> Iterator[tuple[str, int, str]]:
    """(decoded, 0, chain) of a variable's base64 under aliased imports: then zlib, if imported, and a lambda's XOR key."""
    modules = {m[2] for m in ALIAS.finditer(text)}
    blob = B64_VARIABLE.search(text)
    value = next((m[2] for m in STRING_VALUE.finditer(text) if blob and m[1] == blob[1]), None)
    if "base64" not in modules or value is None:
        return
    steps = ("base64", "zlib") if "zlib" in modules else ("base64",)
    mask = XOR_LAMBDA.search(text)
    key = next((n for m in INT_VALUE.finditer(text) if mask and m[1] == mask[1] and (n := int(m[2], 16 if m[2][:2] == "0x" else 10)) < 256), None)
    if key is not None:
        steps += (f"xor({key})",)
    decoded = decode_chain(value.encode(), steps)
    if decoded:
        yield decoded, 0, "+".join(steps)


def replaced(text: str) -> Iterator[tuple[str, int, str]]:
    """(decoded, place, chain) of strings that iex() runs after replacements, done in order."""
    for m in REPLACED.finditer(text):
        value = m[1]
        for old, new in REPLACE_PAIR.findall(m[2]):
            value = value.replace(old, new)
            if len(value) > codecs.MAX_TEXT:
                break
        if 0 < len(value) <= codecs.MAX_TEXT:
            yield value, m.start(), "replace"


FINDERS = {"python": aliased_chain, "powershell": replaced}


def payloads(text: str, lang: str | None) -> list[tuple[str, int, str, str]]:
    """(decoded, offset, chain, language) of the matches; every language is tried where none is known."""
    out, taken = [], []
    for name in [lang] if lang in MATCHERS else sorted(MATCHERS):
        for pattern, steps in MATCHERS[name]:
            for m in re.finditer(pattern, text):
                if name == "powershell" and any(abs(m.start() - at) < 200 for at in taken):
                    continue
                decoded = decode_chain(m[1].encode(), steps)
                if decoded:
                    taken.append(m.start())
                    out.append((decoded, len(text[: m.start()].encode()), "+".join(steps), name))
        if name in FINDERS:
            out += [(decoded, len(text[:at].encode()), chain, name) for decoded, at, chain in FINDERS[name](text)]
    return out


def guess(text: str) -> str | None:
    head, low = text[:8192], text[:8192].lower()
    n = lambda t, signs: sum(s in t for s in signs)
    if re.search(r"<\?(php|=)", head):
        return "php"
    if n(low, POWERSHELL_STRONG) or n(low, POWERSHELL_MODERATE) >= 2:
        return "powershell"
    p, j = n(head, PYTHON_SIGNS), n(head, JS_SIGNS)
    return "python" if p >= 2 and p > j else "javascript" if j >= 2 else None


def peel(blob: str, text: str) -> list[tuple]:
    """Payloads of a text and of the largest payload in it, up to DEPTH deep."""
    out = []
    for depth in range(DEPTH):
        found = payloads(text, guess(text))
        out += [(blob, d, at, chain, lang, depth) for d, at, chain, lang in found]
        longest = max((d for d, *_ in found), key=len, default="")
        if len(longest) <= LEAST:
            break
        text = longest
    return out


def deobfuscate(blobs: DataFrame, text: str = "text") -> DataFrame:
    """Decoded payloads of script texts: one row each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in PAYLOADS.split(", ")]
        for batch in batches:
            rows = [r for blob, t in batch.itertuples(index=False) if t for r in peel(blob, t)]
            yield pd.DataFrame(rows, columns=names)

    likely = F.col(text).rlike(r"(?i)base64|atob|fromhex|fromcharcode|chr\(|rot_?13|\[char|-e(nc|c)? |\.reverse\(\)|\[-1\.\.|gzinflate|gzuncompress|map\(chr|\.replace\s*\(")
    return blobs.where(likely).select(F.col(KEY).cast("string"), F.col(text)).mapInPandas(run, PAYLOADS)


def script_rows(found: DataFrame, blobs: DataFrame, text: str = "text") -> DataFrame:
    """Payloads as string rows; their offsets lie behind the blob, by design."""
    sized = blobs.select(F.col(KEY).cast("string").alias("blob_id"), F.octet_length(text).alias("n"))
    rows = found.join(sized, "blob_id")
    return rows.select("blob_id", F.col("decoded").alias("value"), (F.col("n") + 1 + F.col("data_offset")).cast("long").alias("data_offset"), F.octet_length("decoded").alias("data_len"), F.lit("ScriptDecode").alias("method"))
