"""Names of compiled files and tags of pictures, from files made here byte by byte."""

import io
import struct
import zipfile

import pytest

from tessella.sources import binaries, ingest, parsers


def elf(names, wide=True, order="<", table=2):
    strings, at = b"\0", []
    for n in names:
        at.append(len(strings))
        strings += n.encode() + b"\0"
    symbol = (lambda k: struct.pack(order + "IBBHQQ", k, 0, 0, 1, 0, 0)) if wide else (lambda k: struct.pack(order + "IIIBBH", k, 0, 0, 0, 0, 1))
    rows = symbol(0) + b"".join(map(symbol, at))
    head, form = (64, "IIQQQQIIQQ") if wide else (52, "IIIIIIIIII")
    section = lambda kind, where, size, link: struct.pack(order + form, 0, kind, 0, 0, where, size, link, 0, 0, 0)
    sections = section(0, 0, 0, 0) + section(table, head, len(rows), 2) + section(3, head + len(rows), len(strings), 0)
    ident = b"\x7fELF" + bytes([2 if wide else 1, 1 if order == "<" else 2, 1]) + bytes(9)
    rest = struct.pack(order + ("HHIQQQIHHHHHH" if wide else "HHIIIIIHHHHHH"), 1, 62, 1, 0, 0, head + len(rows) + len(strings), 0, head, 0, 0, len(sections) // 3, 3, 2)
    return ident + rest + rows + strings + sections


def macho(names, order="<"):
    strings, rows = b"\0", b""
    for n in names:
        rows += struct.pack(order + "IBBHQ", len(strings), 0x64 if n == "stab" else 0x0F, 1, 0, 0)
        strings += n.encode() + b"\0"
    head = struct.pack(order + "IIIIIIII", 0xFEEDFACF, 0x01000007, 3, 1, 2, 32, 0, 0)
    commands = struct.pack(order + "II", 0x1B, 8) + struct.pack(order + "IIIIII", 2, 24, 64, len(names), 64 + len(rows), len(strings))
    return head + commands + rows + strings


def coff(at=0):
    strings = b"a_name_of_more_than_eight\0"
    row = lambda name, kind=2, more=0: name.ljust(8, b"\0") + struct.pack("<IhHBB", 0, 1, 0, kind, more)
    rows = row(b".file", 103, 1) + b"main.c".ljust(18, b"\0") + row(b"short") + row(b"eightlet") + row(bytes(4) + struct.pack("<I", 4))
    return struct.pack("<HHIIIHH", 0x8664, 0, 0, at + 20, 5, 0, 0) + rows + struct.pack("<I", 4 + len(strings)) + strings


def pe():
    return b"MZ".ljust(0x3C, b"\0") + struct.pack("<I", 64) + b"PE\0\0" + coff(68)


def number(n):
    return bytes([n & 127 | 128, n >> 7]) if n > 127 else bytes([n])


def wasm(names):
    body = number(len(names)) + b"".join(number(len(n)) + n.encode() + b"\0" + number(k) for k, n in enumerate(names))
    return b"\0asm\x01\0\0\0" + b"\x01\x04\x01\x60\0\0" + b"\x07" + number(len(body)) + body + b"\x0a\x01\0"


def jar():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in ("a/b/C.class", "a/b/C$D.class", "META-INF/MANIFEST.MF"):
            z.writestr(n, b"")
    return out.getvalue()


LONG = [f"name_{k:03d}" for k in range(200)]


@pytest.mark.parametrize("name, data, want", [
    ("l.so", elf(["mint", "burn", "mint"]), ["burn", "mint"]), ("l.so", elf(["x"], False), ["x"]), ("l.o", elf(["y", "é"], True, ">"), ["y", "é"]), ("l.so", elf(["z"], False, ">", 11), ["z"]),
    ("l.dylib", macho(["_a", "stab", "_b"]), ["_a", "_b"]), ("l.dylib", macho(["_c"], ">"), ["_c"]), ("l.dylib", struct.pack(">7I", 0xCAFEBABE, 1, 7, 3, 28, len(macho(["_f"])), 0) + macho(["_f"]), ["_f"]),
    ("a.o", coff(), ["a_name_of_more_than_eight", "eightlet", "main.c", "short"]), ("a.exe", pe(), ["a_name_of_more_than_eight", "eightlet", "main.c", "short"]),
    ("m.wasm", wasm(["run", "memory"]), ["memory", "run"]), ("m.wasm", wasm(LONG), LONG), ("l.jar", jar(), ["a.b.C", "a.b.C$D"]),
])
def test_symbols(name, data, want):
    assert binaries.symbols(name, data) == want
    chunks = parsers.Registry().parse("/d/" + name, data).chunks
    assert chunks[0][0] == "symbols" and chunks[0][1].startswith(f"Binary {name} — {len(want)} symbols: {want[0]}")
    # Cut short anywhere it names nothing that isn't there, or only part of the last name.
    for end in range(0, len(data), max(1, len(data) // 97)):
        for found in binaries.symbols(name, data[:end]):
            assert any(w.startswith(found) for w in want)


def test_symbols_at_most(monkeypatch):
    monkeypatch.setattr(binaries, "SYMBOLS", 3)
    assert binaries.symbols("m.wasm", wasm(["d", "c", "b", "a"])) == ["b", "c", "d"]


@pytest.mark.parametrize("data", [b"", b"not one", b"\x7fELF", b"MZ", b"\0asm", b"\xca\xfe\xba\xbe" + b"\xff" * 40, b"\xcf\xfa\xed\xfe" + b"\xff" * 60])
def test_nothing_readable(data):
    for name in ("junk.so", "junk.jar"):
        assert parsers.Registry().parse(name, data).chunks == [("symbols", f"Binary: {name} (no readable symbols — may be stripped)")]


def tiff(order="<"):
    """Directories of the picture, the camera and the place, then what doesn't fit into an entry."""
    text = lambda s: (2, len(s) + 1, s.encode() + b"\0")
    place = {1: (2, 2, b"N\0"), 2: (5, 3, struct.pack(order + "6I", 52, 1, 30, 1, 123, 10))}
    camera = {0x9003: text("2024:05:06 07:08:09")}
    main = {0x100: (4, 1, struct.pack(order + "I", 640)), 0x101: (3, 1, struct.pack(order + "H", 480)), 0x10E: text(""), 0x10F: text('Ca"m'), 0x110: text("M"), 0x132: text("at noon"), 0x13B: text("A. Person"), 0x8769: None, 0x8825: None}
    sizes = [2 + 12 * len(d) + 4 for d in (main, camera, place)]
    starts = [8, 8 + sizes[0], 8 + sizes[0] + sizes[1]]
    main[0x8769], main[0x8825] = ((4, 1, struct.pack(order + "I", s)) for s in starts[1:])
    out, tail, free = b"", b"", 8 + sum(sizes)
    for d in (main, camera, place):
        out += struct.pack(order + "H", len(d))
        for tag, (kind, n, value) in d.items():
            if len(value) > 4:
                value, tail = struct.pack(order + "I", free + len(tail)), tail + value
            out += struct.pack(order + "HHI", tag, kind, n) + value.ljust(4, b"\0")
        out += bytes(4)
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + out + tail


SHOWN = 'Date: "at noon", Date taken: 2024-05-06 07:08:09, Camera make: "Ca\\"m", Camera model: "M", Width: 640, Height: 480, GPS lat: 52 deg 30 min 12.3 sec, Artist: "A. Person"'


def boxed(kind, block):
    if kind == "jpg":
        part = b"Exif\0\0" + block
        return b"\xff\xd8\xff\xe0\0\x04ab\xff\xe1" + struct.pack(">H", len(part) + 2) + part + b"\xff\xda\0\x02"
    if kind == "png":
        part = lambda name, body: struct.pack(">I", len(body)) + name + body + bytes(4)
        return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", bytes(13)) + part(b"eXIf", block) + part(b"IEND", b"")
    if kind == "webp":
        part = lambda name, body: name + struct.pack("<I", len(body)) + body + bytes(len(body) % 2)
        return b"RIFF" + bytes(4) + b"WEBP" + part(b"VP8 ", b"abc") + part(b"EXIF", block)
    return block


@pytest.mark.parametrize("kind", ["jpg", "png", "webp", "tif", "nef"])
@pytest.mark.parametrize("order", "<>")
def test_tags(kind, order):
    data = boxed(kind, tiff(order))
    assert parsers.Registry().parse(f"/p/x.{kind}", data).chunks == [("", f"File: x.{kind}\n{SHOWN}")]
    for end in range(0, len(data), 7):
        assert set(", ".join(binaries.tags(data[:end])).split(", ")) <= set(SHOWN.split(", ")) | {""}


def test_picture_without_tags():
    for data in (b"", b"GIF89a", b"\xff\xd8\xff", b"II*\0\xff\xff\xff\xff", b"\x89PNG\r\n\x1a\n"):
        assert parsers.Registry().parse("/p/y.gif", data).chunks == [("", "File: y.gif")]


def test_in_a_tree(spark):
    found = spark.createDataFrame([("/a/l.so", bytearray(elf(["mint"]))), ("/a/p.jpg", bytearray(boxed("jpg", tiff())))], "path string, content binary")
    assert {(r.entry_path, r.text) for r in ingest.chunks(ingest.parsed(found)).collect()} == {("/a/l.so", "Binary l.so — 1 symbols: mint"), ("/a/p.jpg", f"File: p.jpg\n{SHOWN}")}
