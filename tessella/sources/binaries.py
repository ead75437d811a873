"""Names in compiled files, and what cameras write into pictures.

Symbols come from the tables of ELF, Mach-O (one or several architectures), PE and COFF files, exports from WebAssembly, classes from
a Java archive. Only names are read. A file that is cut short or lies about its offsets gives what could be read before, or nothing.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from itertools import islice

#: Symbols of a file that are listed, in the order of its tables.
SYMBOLS = 4000

_COFF = (0x14C, 0x8664, 0x1C0, 0x1C4, 0xAA64)


def _until_zero(data: bytes, at: int) -> str:
    end = data.find(b"\0", at)
    return data[at : end if end >= 0 else len(data)].decode("utf-8", "replace")


def _elf(data: bytes) -> Iterator[str]:
    order, wide = "<" if data[5] == 1 else ">", data[4] == 2
    (start,) = struct.unpack_from(order + ("Q" if wide else "I"), data, 0x28 if wide else 0x20)
    size, count = struct.unpack_from(order + "HH", data, 0x3A if wide else 0x2E)
    head = struct.Struct(order + ("IIQQQQII" if wide else "IIIIIIII"))
    if not count and start:
        # More sections than the field holds: the first one's size tells.
        count = head.unpack_from(data, start)[5]
    sections = [head.unpack_from(data, start + k * size) for k in range(min(count, (len(data) - start) // max(size, 1)))]
    step = 24 if wide else 16
    for kind in (2, 11):  # all symbols, then those for the loader
        for s in sections:
            if s[1] == kind and s[6] < len(sections):
                names = sections[s[6]]
                for at in range(s[4], min(s[4] + s[5], len(data) - step + 1), step):
                    (name,) = struct.unpack_from(order + "I", data, at)
                    if 0 < name < names[5]:
                        yield _until_zero(data, names[4] + name)


def _macho(data: bytes) -> Iterator[str]:
    magic = data[:4]
    if magic == b"\xca\xfe\xba\xbe":
        (n,) = struct.unpack_from(">I", data, 4)
        for k in range(min(n, 64)):
            at, size = struct.unpack_from(">II", data, 16 + 20 * k)
            yield from _macho(data[at : at + size])
        return
    if magic[::-1] not in (b"\xfe\xed\xfa\xce", b"\xfe\xed\xfa\xcf") and magic not in (b"\xfe\xed\xfa\xce", b"\xfe\xed\xfa\xcf"):
        return
    order = ">" if magic[0] == 0xFE else "<"
    wide = 0xCF in (magic[0], magic[3])
    n, at, step = *struct.unpack_from(order + "I", data, 16), 32 if wide else 28, 16 if wide else 12
    for _ in range(n):
        command, size = struct.unpack_from(order + "II", data, at)
        if command == 2:
            first, count, names, length = struct.unpack_from(order + "IIII", data, at + 8)
            for k in range(min(count, len(data) // step)):
                name, kind = struct.unpack_from(order + "IB", data, first + k * step)
                if 0 < name < length and not kind & 0xE0:  # the others are notes for debuggers
                    yield _until_zero(data, names + name)
        at += max(size, 8)


def _coff(data: bytes, at: int) -> Iterator[str]:
    first, count = struct.unpack_from("<II", data, at + 8)
    strings, k = first + 18 * count, 0
    while first and k < count:
        name, kind, more = *struct.unpack_from("<8s", data, first + 18 * k), *struct.unpack_from("<BB", data, first + 18 * k + 16)
        if kind == 103:  # a source file, its name in the records that follow
            yield data[first + 18 * (k + 1) : first + 18 * (k + 1 + more)].split(b"\0")[0].decode("utf-8", "replace")
        elif name[:4] == bytes(4):
            yield _until_zero(data, strings + struct.unpack("<I", name[4:])[0])
        else:
            yield name.rstrip(b"\0").decode("utf-8", "replace")
        k += 1 + more


def _pe(data: bytes) -> Iterator[str]:
    (at,) = struct.unpack_from("<I", data, 0x3C)
    if data[at : at + 4] == b"PE\0\0":
        yield from _coff(data, at + 4)


def _number(data: bytes, at: int) -> tuple[int, int]:
    """An unsigned LEB128 number and where it ends."""
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128 or shift > 63:
            return value, at


def _exports(data: bytes) -> Iterator[str]:
    at = 8
    while at < len(data):
        kind = data[at]
        size, at = _number(data, at + 1)
        end = at + size
        if kind == 7:
            n, at = _number(data, at)
            for _ in range(n):
                length, at = _number(data, at)
                yield data[at : at + length].decode("utf-8", "replace")
                _, at = _number(data, at + length + 1)
        at = end


def _classes(data: bytes) -> Iterator[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in islice(z.namelist(), SYMBOLS):
            if name.endswith(".class"):
                yield re.sub(r"(\.class)+$", "", name).replace("/", ".")


def _reader(name: str, data: bytes):
    if name.lower().endswith(".jar"):
        return _classes
    if data[:4] == b"\0asm":
        return _exports
    if data[:4] == b"\x7fELF":
        return _elf
    if data[:2] == b"MZ":
        return _pe
    if len(data) >= 20 and struct.unpack_from("<H", data)[0] in _COFF:
        return lambda d: _coff(d, 0)
    return _macho


def symbols(name: str, data: bytes) -> list[str]:
    """The distinct names of a compiled file's first SYMBOLS symbols, sorted."""
    found: list[str] = []
    try:
        # One by one, so that what was read before an error stays.
        for symbol in islice((s for s in _reader(name, data)(data) if s), SYMBOLS):
            found.append(symbol)
    except (struct.error, IndexError, ValueError, zipfile.BadZipFile):
        pass
    return sorted(set(found))


#: Tags of the directory (0 the picture's, 1 the camera's, 2 the place's) and what they are called, in order of showing.
TAGS = (
    (0, 0x132, "Date"), (1, 0x9003, "Date taken"), (0, 0x10F, "Camera make"), (0, 0x110, "Camera model"), (0, 0x100, "Width"), (0, 0x101, "Height"), (2, 2, "GPS lat"), (2, 4, "GPS lon"),
    (0, 0x10E, "Description"), (0, 0x13B, "Artist"), (0, 0x8298, "Copyright"),
)
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 9: "i", 10: "ii"}


def _directory(data: bytes, order: str, at: int) -> dict[int, tuple[int, list]]:
    out = {}
    (n,) = struct.unpack_from(order + "H", data, at)
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        form = _TYPES.get(kind)
        if form is None or count > len(data):
            continue
        size = struct.calcsize("=" + form) * count
        where = at + 10 + 12 * k
        if size > 4:
            (where,) = struct.unpack_from(order + "I", data, where)
        if where + size <= len(data):
            values = [data[where : where + size]] if kind == 2 else [*struct.unpack_from(f"{order}{len(form) * count}{form[0]}", data, where)]
            out.setdefault(tag, (kind, values))
    return out


def _shown(label: str, kind: int, values: list) -> str:
    if kind == 2:
        parts = [p.decode("latin-1") for p in values[0].rstrip(b"\0").split(b"\0")]
        if label.startswith("Date") and (m := re.fullmatch(r"(\d{4}):(\d\d):(\d\d) (\d\d:\d\d:\d\d)", parts[0])):
            return f"{m[1]}-{m[2]}-{m[3]} {m[4]}"
        return ", ".join('"' + p.replace("\\", "\\\\").replace('"', '\\"') + '"' for p in parts)
    if kind in (5, 10):
        ratios = [f"{a / b:.12g}" if b else "NaN" for a, b in zip(values[::2], values[1::2], strict=True)]
        return "{} deg {} min {} sec".format(*ratios) if label.startswith("GPS") and len(ratios) >= 3 else ", ".join(ratios)
    return ", ".join(map(str, values))


def _block(data: bytes) -> bytes:
    """The block that tags stand in: the file itself (TIFF and raw pictures), or a part of a JPEG, PNG or WebP file."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
            (size,) = struct.unpack_from(">H", data, at + 2)
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            at += 2 + max(size, 2)
    if data[:8] == b"\x89PNG\r\n\x1a\n" or data[:4] + data[8:12] == b"RIFFWEBP":
        png, at = data[0] == 0x89, 8 if data[0] == 0x89 else 12
        while at + 8 <= len(data):
            size, kind = struct.unpack_from(">I4s", data, at) if png else struct.unpack_from("<4sI", data, at)[::-1]
            if kind in (b"eXIf", b"EXIF"):
                part = data[at + 8 : at + 8 + size]
                return part.removeprefix(b"Exif\0\0")
            at += size + 12 if png else size + 8 + size % 2
    return b""


def tags(data: bytes) -> list[str]:
    """'label: value' of a picture's tags. HEIF files keep theirs in items that aren't read."""
    out: list[str] = []
    try:
        block = _block(data)
        order = {b"II*\0": "<", b"MM\0*": ">"}.get(block[:4])
        if order is None:
            return out
        main = _directory(block, order, struct.unpack_from(order + "I", block, 4)[0])
        found = [main, {}, {}]
        for k, tag in ((1, 0x8769), (2, 0x8825)):
            if tag in main:
                try:
                    found[k] = _directory(block, order, main[tag][1][0])
                except (struct.error, TypeError):
                    # A broken part leaves the others.
                    pass
        for k, tag, label in TAGS:
            if tag in found[k] and (value := _shown(label, *found[k][tag])) not in ("", '""'):
                out.append(f"{label}: {value}")
    except struct.error:
        pass
    return out
