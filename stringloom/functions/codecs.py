"""Byte-level codecs in Python, used in Arrow batches where built-in functions have no strict form."""

from __future__ import annotations

import base64
import binascii
import re
import zlib
from collections import Counter

GRAPHIC = frozenset(range(0x21, 0x7F))
BLANK = frozenset(b" \t\n\r\x0c")
VOWELS = frozenset(b"aeiouAEIOU")
LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def quality(data: bytes) -> tuple[int, int]:
    """(score, vowels in a hundred letters): seven parts printable to three parts vowels."""
    if not data:
        return 0, 0
    letters = sum(b in LETTERS for b in data)
    vowels = sum(b in VOWELS for b in data)
    printable = sum(b in GRAPHIC or b == 0x20 for b in data)
    share = vowels * 100 // letters if letters else 0
    return (printable * 100 // len(data) * 7 + share * 3) // 10, share


def _text(data: bytes) -> str | None:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return None


MAX_TEXT = 10 << 20


def bytes_to_text(data: bytes | None) -> str | None:
    """Clean ASCII, or UTF-16LE that looks it, or strict UTF-8."""
    if data is None or len(data) > MAX_TEXT:
        return None
    clean = lambda b: all(0x20 <= x < 0x7F or x in (9, 10, 13) for x in b)
    if clean(data):
        return data.decode("ascii")
    if looks_wide(data):
        return data.decode("utf-16-le")
    return _text(data)


def looks_wide(data: bytes) -> bool:
    """Even, at least four bytes, half of the high bytes zero, valid and without control characters."""
    if len(data) < 4 or len(data) % 2 or data[1::2].count(0) * 2 < len(data) // 2:
        return False
    try:
        text = data.decode("utf-16-le")
    except UnicodeDecodeError:
        return False
    return not any(ord(c) < 32 and c not in "\t\n\r" or 0x7F <= ord(c) < 0xA0 for c in text)


def strict_base64(s: str) -> bytes | None:
    """Padded, canonical base64 of standard alphabet, as a whole."""
    if len(s) % 4 or not re.fullmatch(r"[A-Za-z0-9+/]*={0,2}", s):
        return None
    data = base64.b64decode(s)
    return data if base64.b64encode(data).decode() == s else None


def base32_bytes(s: str) -> bytes | None:
    body = s.rstrip("=")
    if not re.fullmatch("[A-Z2-7]+", body) or len(body) % 8 in (1, 3, 6):
        return None
    try:
        return base64.b32decode(body + "=" * (-len(body) % 8))
    except binascii.Error:
        return None


def ascii85_bytes(s: str) -> bytes | None:
    """Groups of five characters ! to u; z for four zeros; white space and the frame ignored."""
    s = re.sub(r"[ \t\n\r\x0b\x0c]", "", s.removeprefix("<~").removesuffix("~>"))
    out, group = bytearray(), []
    for c in s:
        if c == "z":
            if group:
                return None
            out += bytes(4)
            continue
        if not "!" <= c <= "u":
            return None
        group.append(ord(c) - 33)
        if len(group) == 5:
            value = 0
            for x in group:
                value = value * 85 + x
            if value >> 32:
                return None
            out += value.to_bytes(4, "big")
            group = []
    if len(group) == 1:
        return None
    if group:
        value = 0
        for x in group + [84] * (5 - len(group)):
            value = value * 85 + x
        if value >> 32:
            return None
        out += value.to_bytes(4, "big")[: len(group) - 1]
    return bytes(out)


def url_text(s: str) -> str | None:
    """Percent escapes of bytes; "+" stays, broken escapes stay, broken UTF-8 gives none."""
    raw = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), s.encode())
    return _text(raw)


_ESCAPE = re.compile(r"\\(?:x(.{0,2})|u(.{0,4})|U(.{0,8}))", re.S)


def unicode_text(s: str) -> str:
    r"""\xHH, \uHHHH and \UHHHHHHHH as characters. Of a broken one the letter stays, its digits go."""

    def one(m: re.Match) -> str:
        letter, digits, n = (("x", m[1], 2), ("u", m[2], 4), ("U", m[3], 8))[0 if m[1] is not None else 1 if m[2] is not None else 2]
        if len(digits) == n and re.fullmatch("[0-9A-Fa-f]+", digits):
            code = int(digits, 16)
            if code < 0x110000 and not 0xD800 <= code < 0xE000:
                return chr(code)
        return "\\" + letter

    return _ESCAPE.sub(one, s)


def escaped_bytes(s: str) -> bytes:
    r"""As the classifier reads escapes: \xHH is a byte, broken escapes stay."""

    def one(m: re.Match) -> bytes:
        if m[1] and len(m[1]) == 2 and re.fullmatch(b"[0-9A-Fa-f]{2}", m[1]):
            return bytes([int(m[1], 16)])
        if m[2] and re.fullmatch(b"[0-9A-Fa-f]{4}", m[2]) and not 0xD800 <= int(m[2], 16) < 0xE000:
            return chr(int(m[2], 16)).encode()
        return m[0]

    return re.sub(rb"\\(?:x(.{0,2})|u(.{0,4}))", one, s.encode(), flags=re.S)


def _mostly_printable(data: bytes) -> bool:
    return bool(data) and sum(b in GRAPHIC or b in BLANK for b in data) * 10 > len(data) * 6


def _base85(s: str) -> bool:
    data = ascii85_bytes(s)
    text = None if data is None else _text(data)
    if text is None or quality(text.encode())[0] <= quality(s.encode())[0] + 5:
        return False
    if s.startswith("<~") and s.endswith("~>"):
        return True
    b = s.encode()
    punctuation = sum(33 <= x <= 47 or 58 <= x <= 64 or 91 <= x <= 96 or 123 <= x <= 126 for x in b)
    valid = [x for x in b if 33 <= x <= 117 or x == 122]
    kinds = len(set(valid))
    if punctuation * 2 > len(b) or kinds < 8 or quality(b)[1] >= 28 or s.count(":") >= 6 and re.search("/usr/bin/|/bin/|/var/", s):
        return False
    if len(b) >= 50 and (len(valid) * 100 < len(b) * 98 or kinds < 15):
        return False
    return bool(re.search("[a-z]", s)) or punctuation > 0


def _base64(s: str) -> bool:
    most = max(Counter(s).values()) * 100 // len(s)
    if most > 30 and len(s) >= 24:
        return True
    data = strict_base64(s)
    if data is None:
        return True
    score, vowels = quality(s.encode())
    if most > 30 and vowels < 10 and sum(b in GRAPHIC or b == 0x20 for b in data) * 2 < len(data):
        return False
    return not (vowels >= 28 and score > quality(data)[0])


def classify_rest(s: str, base85: bool, base64_ok: bool, url: bool) -> str | None:
    """The kind of a value that the column expression left open; the flags say which gates it passed."""
    if s.count("\\x") + s.count("\\u") >= 5 and len(s.encode()) >= 20 and _mostly_printable(escaped_bytes(s)):
        return "UnicodeEscaped"
    if url:
        return "UrlEncoded"
    if base85 and _base85(s):
        return "Base85"
    if base64_ok and _base64(s):
        return "Base64"
    return None


def inflate(data: bytes, raw: bool | None = None, limit: int = MAX_TEXT) -> bytes | None:
    """zlib, gzip or (raw) bare deflate, up to a limit of bytes."""
    try:
        packer = zlib.decompressobj(-15 if raw else 47)
        out = packer.decompress(data, limit)
    except zlib.error:
        return None
    return out


def rot13(s: str) -> str:
    return s.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"))
