"""ELF, PE and Mach-O headers as plain tables: sections, segments, symbols and what follows the file."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field


@dataclass
class Section:
    name: str
    address: int
    offset: int
    size: int
    executable: bool = False
    writable: bool = False


@dataclass
class Container:
    format: str = "unknown"
    arch: str = "other"
    bits: int = 64
    little: bool = True
    base: int = 0
    sections: list[Section] = field(default_factory=list)
    segments: list[Section] = field(default_factory=list)
    symbols: list[tuple[str, str]] = field(default_factory=list)
    end: int | None = None
    clr: tuple[int, int] | None = None
    signature: tuple[int, int] | None = None

    def section(self, *names: str) -> Section | None:
        return next((s for n in names for s in self.sections if s.name == n), None)

    def to_offset(self, address: int) -> int | None:
        for s in [*self.sections, *self.segments]:
            if s.size and s.address <= address < s.address + s.size:
                return address - s.address + s.offset
        return None


# Machine numbers.
ELF_ARCH = {3: "x86", 62: "x86_64", 40: "arm", 183: "aarch64", 8: "mips", 20: "ppc", 21: "ppc64", 243: "riscv64", 2: "sparc", 4: "m68k"}
PE_ARCH = {0x14C: "x86", 0x8664: "x86_64", 0x1C0: "arm", 0x1C4: "arm", 0xAA64: "aarch64"}
MACH_ARCH = {7: "x86", 0x01000007: "x86_64", 12: "arm", 0x0100000C: "aarch64", 18: "ppc", 0x01000012: "ppc64"}


def text_at(data: bytes, at: int, most: int = 1024) -> str:
    if not 0 <= at < len(data):
        return ""
    end = data.find(b"\0", at, at + most)
    return data[at : end if end >= 0 else at + most].decode("utf-8", "replace")


def parse_elf(d: bytes) -> Container:
    c = Container("elf", bits=64 if d[4] == 2 else 32, little=d[5] == 1)
    e = "<" if c.little else ">"
    wide = c.bits == 64
    c.arch = ELF_ARCH.get(struct.unpack_from(e + "H", d, 18)[0], "other")
    phoff, shoff = struct.unpack_from(e + ("QQ" if wide else "II"), d, 32 if wide else 28)
    hsize, phsize, phnum, shsize, shnum, names = struct.unpack_from(e + "HHHHHH", d, 52 if wide else 40)
    c.end = max(hsize, phoff + phsize * phnum, shoff + shsize * shnum if shoff else 0)
    for i in range(phnum):
        at = phoff + i * phsize
        if wide:
            kind, flags, off, addr, _, size = struct.unpack_from(e + "IIQQQQ", d, at)
        else:
            kind, off, addr, _, size, _, flags = struct.unpack_from(e + "IIIIIII", d, at)
        c.end = max(c.end, off + size)
        if kind == 1:
            c.segments.append(Section(f"load{i}", addr, off, size, bool(flags & 1), bool(flags & 2)))
    rows = []
    for i in range(shnum):
        at = shoff + i * shsize
        name, kind = struct.unpack_from(e + "II", d, at)
        flags, addr, off, size = struct.unpack_from(e + ("QQQQ" if wide else "IIII"), d, at + 8)
        link = struct.unpack_from(e + "I", d, at + (40 if wide else 24))[0]
        rows.append((name, kind, flags, addr, off, size, link))
    strings = rows[names][4] if names < len(rows) else 0
    for name, kind, flags, addr, off, size, _ in rows:
        if kind != 8:
            c.end = max(c.end, off + size)
            c.sections.append(Section(text_at(d, strings + name) if strings else "", addr, off, size, bool(flags & 4), bool(flags & 1)))
    for _, kind, _, _, off, size, link in rows:
        if kind == 11 and link < len(rows):
            for at in range(off, min(off + size, len(d) - (23 if wide else 15)), 24 if wide else 16):
                name, info, shndx = struct.unpack_from(e + "IBxH", d, at) if wide else (*struct.unpack_from(e + "I", d, at), *struct.unpack_from(e + "BxH", d, at + 12))
                value = text_at(d, rows[link][4] + name)
                if value:
                    if shndx == 0:
                        c.symbols.append((value, "Import"))
                    elif info >> 4 in (1, 2):
                        c.symbols.append((value, "Export"))
    return c


def parse_pe(d: bytes) -> Container:
    c = Container("pe")
    head = struct.unpack_from("<I", d, 60)[0]
    if d[head : head + 4] != b"PE\0\0":
        return Container()
    machine, count = struct.unpack_from("<HH", d, head + 4)
    osize = struct.unpack_from("<H", d, head + 20)[0]
    opt = head + 24
    c.arch, c.bits = PE_ARCH.get(machine, "other"), 64 if struct.unpack_from("<H", d, opt)[0] == 0x20B else 32
    c.base = struct.unpack_from("<Q" if c.bits == 64 else "<I", d, opt + (24 if c.bits == 64 else 28))[0]
    for i in range(count):
        name, vsize, addr, size, off, flags = struct.unpack_from("<8sIIII12xI", d, opt + osize + 40 * i)
        c.sections.append(Section(name.rstrip(b"\0").decode("latin-1"), addr, off, min(size, max(vsize, 1)) or size, bool(flags & 0x20000000), bool(flags & 0x80000000)))
    directories = opt + (112 if c.bits == 64 else 96)
    count = struct.unpack_from("<I", d, directories - 4)[0]
    entry = lambda n: struct.unpack_from("<II", d, directories + 8 * n) if n < count else (0, 0)
    export, imports = entry(0)[0], entry(1)[0]
    if entry(14)[0]:
        c.clr = entry(14)
    at = c.to_offset(imports) if imports else None
    while at is not None and at + 20 <= len(d):
        first, _, _, name, thunk = struct.unpack_from("<IIIII", d, at)
        if not name and not thunk:
            break
        slot = c.to_offset(first or thunk)
        size = 8 if c.bits == 64 else 4
        while slot is not None and slot + size <= len(d):
            value = int.from_bytes(d[slot : slot + size], "little")
            if not value:
                break
            if not value >> (size * 8 - 1) and (where := c.to_offset(value)) is not None:
                c.symbols.append((text_at(d, where + 2), "Import"))
            slot += size
        at += 20
    at = c.to_offset(export) if export else None
    if at is not None and at + 40 <= len(d):
        n, names = struct.unpack_from("<I", d, at + 24)[0], c.to_offset(struct.unpack_from("<I", d, at + 32)[0])
        for i in range(min(n, 65536)):
            if names is None or names + 4 * i + 4 > len(d):
                break
            where = c.to_offset(struct.unpack_from("<I", d, names + 4 * i)[0])
            if where is not None:
                c.symbols.append((text_at(d, where), "Export"))
    return c


def parse_macho(d: bytes, base: int = 0) -> Container:
    magic = d[base : base + 4]
    c = Container("macho", bits=64 if magic in (b"\xcf\xfa\xed\xfe", b"\xfe\xed\xfa\xcf") else 32, little=magic[:1] in (b"\xce", b"\xcf"))
    e = "<" if c.little else ">"
    cpu, _, _, count, _ = struct.unpack_from(e + "IIIII", d, base + 4)
    c.arch = MACH_ARCH.get(cpu, "other")
    at = base + (32 if c.bits == 64 else 28)
    for _ in range(count):
        kind, size = struct.unpack_from(e + "II", d, at)
        if kind in (0x19, 1):
            wide = kind == 0x19
            seg = d[at + 8 : at + 24].rstrip(b"\0").decode("latin-1")
            addr, _, off, length = struct.unpack_from(e + ("QQQQ" if wide else "IIII"), d, at + 24)
            protection = struct.unpack_from(e + "I", d, at + (60 if wide else 44))[0]
            c.segments.append(Section(seg, addr, base + off, length, bool(protection & 4), bool(protection & 2)))
            number = struct.unpack_from(e + "I", d, at + (64 if wide else 48))[0]
            for i in range(number):
                s = at + (72 if wide else 56) + i * (80 if wide else 68)
                name = d[s : s + 16].rstrip(b"\0").decode("latin-1")
                saddr, ssize = struct.unpack_from(e + ("QQ" if wide else "II"), d, s + 32)
                soff, = struct.unpack_from(e + "I", d, s + (48 if wide else 40))
                flags, = struct.unpack_from(e + "I", d, s + (64 if wide else 56))
                c.sections.append(Section(name, saddr, base + soff, ssize, bool(flags & 0x80000400), bool(protection & 2)))
        elif kind == 2:
            symoff, n, stroff, _ = struct.unpack_from(e + "IIII", d, at + 8)
            for i in range(min(n, 1 << 20)):
                s = base + symoff + i * (16 if c.bits == 64 else 12)
                if s + 12 > len(d):
                    break
                name, flags = struct.unpack_from(e + "IB", d, s)
                if flags & 0xE0 == 0 and flags & 1 and (value := text_at(d, base + stroff + name)):
                    c.symbols.append((value, "Import" if flags & 0x0E == 0 else "Export"))
        elif kind == 0x1D:
            c.signature = struct.unpack_from(e + "II", d, at + 8)
        at += size
        if size == 0:
            break
    return c


def parse(d: bytes) -> list[Container]:
    """The containers of a blob: one, or each slice of a fat file; broken headers give an unknown one."""
    try:
        if d[:4] == b"\x7fELF":
            return [parse_elf(d)]
        if d[:2] == b"MZ":
            return [parse_pe(d)]
        if d[:4] in (b"\xcf\xfa\xed\xfe", b"\xce\xfa\xed\xfe", b"\xfe\xed\xfa\xcf", b"\xfe\xed\xfa\xce"):
            return [parse_macho(d)]
        if d[:4] == b"\xca\xfe\xba\xbe" and 0 < (n := struct.unpack_from(">I", d, 4)[0]) < 32:
            return [parse_macho(d, struct.unpack_from(">I", d, 8 + 20 * i + 8)[0]) for i in range(n)]
    except (struct.error, IndexError, OverflowError):
        pass
    return [Container()]
