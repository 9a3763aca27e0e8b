"""Small made-up blobs for queries and tests: texts hidden in the ways that the extractors undo."""

from __future__ import annotations

import base64
import codecs
import hashlib
import struct
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

XOR_KEY = b"K3y!9z"


def elf(sections: list[tuple[str, int, bytes, int]], tail: bytes = b"", machine: int = 62) -> bytes:
    """A minimal 64-bit ELF of (name, address, data, flags) sections."""
    names, body, rows = b"\0", b"", [(0, 0, 0, 0, 0, 0)]
    placed = []
    for name, addr, data, flags in [*sections, (".shstrtab", 0, b"", 0)]:
        placed.append((len(names), addr, data, flags))
        names += name.encode() + b"\0"
    for i, (at, addr, data, flags) in enumerate(placed):
        data = names if i == len(placed) - 1 else data
        rows.append((at, 1, flags, addr, 64 + len(body), len(data)))
        body += data
    head = b"\x7fELF\x02\x01\x01" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 2, machine, 1, 0, 0, 64 + len(body), 0, 64, 56, 0, 64, len(rows), len(rows) - 1)
    return head + body + b"".join(struct.pack("<IIQQQQIIQQ", *r, 0, 0, 1, 0) for r in rows) + tail


def elf32(sections: list[tuple[str, int, bytes, int]], order: str = ">", machine: int = 8) -> bytes:
    """A minimal 32-bit ELF of (name, address, data, flags) sections in either byte order."""
    names, body, rows = b"\0", b"", [(0, 0, 0, 0, 0, 0)]
    for name, addr, data, flags in [*sections, (".shstrtab", 0, None, 0)]:
        at = len(names)
        names += name.encode() + b"\0"
        data = names if data is None else data
        rows.append((at, 1, flags, addr, 52 + len(body), len(data)))
        body += data
    body += bytes(-len(body) % 4)
    head = b"\x7fELF\x01" + (b"\x02" if order == ">" else b"\x01") + b"\x01" + bytes(9) + struct.pack(order + "HHIIIIIHHHHHH", 2, machine, 1, 0, 0, 52 + len(body), 0, 52, 32, 0, 40, len(rows), len(rows) - 1)
    return head + body + b"".join(struct.pack(order + "IIIIIIIIII", *r, 0, 0, 1, 0) for r in rows)


def pe(sections: list[tuple[str, int, bytes, int]], directories: dict[int, tuple[int, int]] | None = None) -> bytes:
    """A minimal 64-bit PE of (name, address, data, flags) sections; directories are (address, size) by number."""
    table = b"".join(struct.pack("<II", *(directories or {}).get(i, (0, 0))) for i in range(16))
    optional = struct.pack("<H22xQ", 0x20B, 0x140000000).ljust(108, b"\0") + struct.pack("<I", 16) + table
    start = 64 + 24 + len(optional) + 40 * len(sections)
    body, heads = b"", b""
    for name, addr, data, flags in sections:
        heads += struct.pack("<8sIIII12xI", name.encode(), len(data), addr, len(data), start + len(body), flags)
        body += data
    return b"MZ" + bytes(58) + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HH12xHH", 0x8664, len(sections), len(optional), 0x22) + optional + heads + body


def pe_tables(imported: bytes, exported: bytes) -> bytes:
    """A PE that imports one function and exports another."""
    at = 0x1000
    data = bytearray(bytes(256))
    struct.pack_into("<IIIII", data, 0, at + 64, 0, 0, at + 96, at + 64)
    struct.pack_into("<Q", data, 64, at + 112)
    data[96:104] = b"lib.dll\0"
    data[114 : 114 + len(imported)] = imported
    struct.pack_into("<II", data, 160 + 24, 1, 0)
    struct.pack_into("<I", data, 160 + 32, at + 204)
    struct.pack_into("<I", data, 204, at + 208)
    data[208 : 208 + len(exported)] = exported
    return pe([(".idata", at, bytes(data), 0x40000040)], {0: (at + 160, 40), 1: (at, 40)})


def versioned(text: bytes) -> bytes:
    """A PE with a version resource whose file version looks like an address, which stands in it again, and a real address."""
    version = f"18.44.{len(text) % 200}.23"
    info = b"".join(x.encode("utf-16-le") + b"\0\0" for x in ("VS_VERSION_INFO", "FileVersion", version))
    return pe([(".rsrc", 0x1000, b"\xff\xff" + info + b"\xff\xff" + version.encode() + b"\x0045.33.32.156\0", 0x40000040)])


def dotnet(text: bytes) -> bytes:
    """A PE whose CLR metadata holds a text in the #US heap."""
    wide = text.decode().encode("utf-16-le") + b"\0"
    size = len(wide)
    heap = b"\0" + (bytes([size]) if size < 0x80 else bytes([0x80 | size >> 8, size & 255])) + wide
    meta = b"BSJB" + struct.pack("<HHII", 1, 1, 0, 4) + b"v4\0\0" + struct.pack("<HH", 0, 1) + struct.pack("<II", 36, len(heap)) + b"#US\0"
    meta = meta.ljust(36, b"\0") + heap
    clr = struct.pack("<IHHII", 72, 2, 5, 0x2000 + 72, len(meta)).ljust(72, b"\0")
    return pe([(".text", 0x2000, clr + meta, 0x40000040)], {14: (0x2000, 72)})


def macho(sections: list[tuple[str, int, bytes, int]], symbols: list[tuple[bytes, int]] = (), order: str = "<", bits: int = 64, base: int = 0) -> bytes:
    """A minimal Mach-O of (name, address, data, flags) sections and (name, type) symbols."""
    wide = bits == 64
    head, one, per = (32, 72, 80) if wide else (28, 56, 68)
    start = head + one + per * len(sections) + 24
    body, rows = b"", b""
    for name, addr, data, flags in sections:
        words = struct.pack(order + ("QQ" if wide else "II"), addr, len(data))
        rows += struct.pack("16s16s", name.encode(), b"__TEXT") + words + struct.pack(order + "IIIIIII", start + len(body), 0, 0, 0, flags, 0, 0) + (bytes(4) if wide else b"")
        body += data
    names, entries = b"\0", b""
    for name, kind in symbols:
        entries += struct.pack(order + "IBBH", len(names), kind, 0, 0) + bytes(8 if wide else 4)
        names += name + b"\0"
    segment = struct.pack(order + "II16s", 0x19 if wide else 1, one + per * len(sections), b"__TEXT") + struct.pack(order + ("QQQQ" if wide else "IIII"), 0, 1 << 20, 0, start + len(body)) + struct.pack(order + "IIII", 5, 5, len(sections), 0)
    table = struct.pack(order + "IIIIII", 2, 24, start + len(body), len(symbols), start + len(body) + len(entries), len(names))
    magic = 0xFEEDFACF if wide else 0xFEEDFACE
    cpu = 0x01000007 if wide else 18
    return struct.pack(order + "IIIIIII", magic, cpu, 3, 2, 2, len(segment) + len(rows) + 24, 0) + (bytes(4) if wide else b"") + segment + rows + table + body + entries + names


def fat(slices: list[bytes]) -> bytes:
    head, body, at = struct.pack(">II", 0xCAFEBABE, len(slices)), b"", 4096
    for s in slices:
        head += struct.pack(">IIIII", 7, 3, at + len(body), len(s), 12)
        body += s + bytes(-len(s) % 4096)
    return head.ljust(4096, b"\0") + body


def masked(data: bytes, key: bytes) -> bytes:
    return bytes(b ^ key[i % len(key)] for i, b in enumerate(data))


def with_pointer(text: bytes) -> bytes:
    return elf([(".rodata", 0x400000, text + b"\0", 2), (".data", 0x600000, struct.pack("<QQ", 0x400000, len(text)), 3)])


def on_stack(text: bytes) -> bytes:
    moves = b"".join(b"\xc6\x45" + bytes([0x80 + i]) + bytes([b]) for i, b in enumerate(text[:100]))
    return elf([(".text", 0x500000, moves + b"\xc3", 6)])


def inline(text: bytes) -> bytes:
    lea = b"\x48\x8d\x05" + struct.pack("<i", 0x400000 - (0x500000 + 7))
    return elf([(".rodata", 0x400000, text + b"more of the pool", 2), (".text", 0x500000, lea + b"\xbe" + struct.pack("<I", len(text)) + b"\xe8" + bytes(4), 6)])


def name_table(text: bytes) -> bytes:
    words = [w for w in text.replace(b"#", b".").replace(b":", b"").split() if len(w) >= 4]
    return elf([(".gopclntab", 0x400000, b"\xff\xfe" + b"".join(bytes([len(w)]) + w for w in words) + b"\xff", 2)])


def socket(text: bytes) -> bytes:
    address = bytes([45, 133, 200 + len(text) % 50, 3 + text[0] % 20])
    return elf([(".data", 0x600000, bytes(16) + b"\x02\x00" + struct.pack(">H", 443) + address + bytes(8), 3)])


def python_script(text: bytes) -> bytes:
    return b"import base64, zlib\nexec(zlib.decompress(base64.b64decode('" + base64.b64encode(zlib.compress(text)) + b"')))\n"


# Plaintexts of the one-byte XOR search, as they stand in a line of text each.
ANCHORED = ("tcp://relay", "run /bin/tool", "read /proc/self", "C:\\\\work area", "agent Mozilla five", "start cmd.exe now", "load user32.dll now", "the passwd entry", "in Library folder", "an Ethereum account", "print %s twice", "set ld.so.preload", "use BCrypt here", "call CreateProcess now")


def anchored(text: bytes) -> bytes:
    """A line with an anchor under a one-byte key, both chosen by the number before the bar; odd numbers give plain noise."""
    n = int(text.split(b"|")[0])
    if n % 2:
        return hashlib.sha512(text).digest() * 3
    line = f"{ANCHORED[n // 2 % len(ANCHORED)]} of part {n}".encode()
    return masked(bytes(24) + line + bytes(24), bytes([(n * 7 % 200 + 40) | 1]))


def rolled(text: bytes) -> bytes:
    return b"MZ" + bytes(62) + masked(b"\0\0copy %APPDATA%\\tool to HKEY_CURRENT_USER\\SOFTWARE\\" + text.replace(b" ", b"_") + b"\0\0", b"k9!") + bytes(30)


def grown(text: bytes) -> bytes:
    return bytes(b ^ ((i + 7) & 255) for i, b in enumerate(bytes(30) + b"start /bin/tool for " + text + bytes(30)))


def dotted(text: bytes) -> bytes:
    n = len(text)
    return bytes(40) + masked(b"\x01\x02 45.33." + str(100 + n).encode() + b".156:8443 and evil-host.com\x01", b"\xa7") + bytes(40)


def big_endian_pointer(text: bytes) -> bytes:
    return elf32([(".rodata", 0x400000, text + b"\0", 2), (".data", 0x600000, struct.pack(">II", 0x400000, len(text)), 3)])


def macho_pointer(text: bytes) -> bytes:
    return macho([("__const", 0x4000, text + b"\0", 0), ("__data", 0x8000, struct.pack("<QQ", 0x4000, len(text)), 0)])


def fat_image(text: bytes) -> bytes:
    return fat([macho_pointer(b"first " + text), macho([("__const", 0x4000, b"second " + text + b"\0", 0), ("__data", 0x8000, struct.pack(">II", 0x4000, len(text) + 7), 0)], order=">", bits=32)])


def macho_symbols(text: bytes) -> bytes:
    name = text.split()[0].lower()
    return macho([("__data", 0x8000, bytes(16), 0)], [(b"_import_" + name, 0x01), (b"_export_" + name, 0x0F), (b"_local_" + name, 0x0E)])


MAKERS = {
    "anchored": anchored, "rolled": rolled, "grown": grown, "dotted": dotted, "pointer32be": big_endian_pointer, "machopointer": macho_pointer, "fat": fat_image, "machosymbols": macho_symbols, "peversion": versioned, "dotnet": dotnet,
    "petables": lambda t: pe_tables(b"Import" + t.split()[0], b"Export" + t.split()[0]), "pepointer": lambda t: pe([(".rdata", 0x1000, t + b"\0", 0x40000040), (".data", 0x3000, struct.pack("<QQ", 0x140001000, len(t)), 0xC0000040)]),
    "pewide": lambda t: pe([(".rsrc", 0x1000, b"\xff\xff" + t.decode().encode("utf-16-le") + b"\0\0\xff\xff", 0x40000040)]), "rot13script": lambda t: b"import os, codecs\nexec(codecs.decode('" + codecs.encode(t.decode(), "rot13").encode() + b"', 'rot13'))\n",
    "hexscript": lambda t: b"import os, binascii\nexec(bytes.fromhex('" + t.hex().encode() + b"'))\n",
    "xor": lambda t: masked(t, XOR_KEY), "wide": lambda t: b"\xff\xff" + t.decode().encode("utf-16-le") + b"\0\0\xff\xff", "base32": base64.b32encode, "base85": lambda t: base64.a85encode(t), "pointer": with_pointer, "stack": on_stack,
    "inline": inline, "names": name_table, "socket": socket, "script": python_script, "overlay": lambda t: elf([(".data", 0, b"\1\2\3\4", 3)], t + bytes(16)),
    "single": lambda t: bytes(24) + masked(b"\0\0see http://h" + str(len(t)).encode() + b".example.com/" + t.replace(b" ", b"_").replace(b"#", b"") + b"\0\0", b"\x5a") + bytes(8),
}


def make(how: str, text: Column) -> Column:
    """The blob that hides a text in one of the ways of MAKERS."""
    f = MAKERS[how]

    @F.pandas_udf(BinaryType())
    def run(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(x.encode()) for x in v], dtype=object)

    return run(text)
