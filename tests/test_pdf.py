"""PDF files made here: with a table of references and with streams of objects, with maps to Unicode, and broken ones."""

import zlib

from tessella.sources import parsers, pdf


def classic(objects, trailer="", broken=False):
    out, places = bytearray(b"%PDF-1.4\n%\xe2\xe3\n"), []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n".encode() + o + b"\nendobj\n"
    at = len(out) + (777 if broken else 0)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010} 00000 n \n".encode() for p in places)
    return bytes(out + f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R {trailer} >>\nstartxref\n{at}\n%%EOF\n".encode())


def stream(data, head="", pack=False):
    data = zlib.compress(data) if pack else data
    return f"<< /Length {len(data)} {'/Filter /FlateDecode' if pack else ''} {head} >>\nstream\n".encode() + data + b"\nendstream"


FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /fi /eacute /uni00DF 65 /A] >> >>"
PAGE_ONE = rb"BT /F1 12 Tf 72 700 Td (Introduction) Tj 0 -20 Td (This is the \(first\) p\141ge, with) Tj 0 -14 Td [(two l) 20 (ines) -300 (of it.)] TJ 14 TL T* (x) Tj ET"
PAGE_TWO = b"BT /F1 10 Tf 1 0 0 1 72 600 Tm (Second Part) Tj 1 0 0 1 72 580 Tm (of\001ce caf\002 stra\003e,) Tj 1 0 0 1 200 580 Tm (next) Tj ET q 1 0 0 1 0 -100 cm /X1 Do Q"
FORM = b"BT /F1 8 Tf 0 0 Td (inside a form.) Tj ET"
BODY = [
    b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /Resources << /Font << /F1 5 0 R >> /XObject << /X1 8 0 R >> >> >>",
    b"<< /Type /Page /Parent 2 0 R /Contents 6 0 R >>", b"<< /Type /Page /Parent 2 0 R /Contents [7 0 R] >>", FONT, stream(PAGE_ONE), stream(PAGE_TWO, pack=True), stream(FORM, "/Type /XObject /Subtype /Form"),
]
WANT = [("Introduction", "This is the (first) page, with two lines of it. x"), ("Second Part", "office café straße, next inside a form.")]


def test_pages_and_headings():
    for broken in (False, True):
        got = parsers.Registry().parse("/d/a.pdf", classic(BODY, broken=broken)).chunks
        assert got == WANT, broken


def test_streams_of_objects():
    held = [(i, o) for i, o in enumerate(BODY[:5], 1)]
    heads, text = "", b""
    for i, o in held:
        heads += f"{i} {len(text)} "
        text += o + b" "
    out, places = bytearray(b"%PDF-1.5\n"), {}
    for number, body in ((6, BODY[5]), (7, BODY[6]), (8, BODY[7]), (9, stream(heads.encode() + text, f"/Type /ObjStm /N 5 /First {len(heads)}", True))):
        places[number] = len(out)
        out += f"{number} 0 obj\n".encode() + body + b"\nendobj\n"
    at = len(out)
    rows = [b"\0\0\0\0"] + [b"\2" + (9).to_bytes(2, "big") + bytes([i]) for i in range(5)] + [b"\1" + places[n].to_bytes(2, "big") + b"\0" for n in (6, 7, 8, 9)] + [b"\1" + at.to_bytes(2, "big") + b"\0"]
    # Each row less the one above it.
    up, last = b"", bytes(4)
    for r in rows:
        up += b"\2" + bytes((a - b) & 255 for a, b in zip(r, last, strict=True))
        last = r
    out += b"10 0 obj\n" + stream(up, "/Type /XRef /W [1 2 1] /Size 11 /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 4 >>", True) + b"\nendobj\n" + f"startxref\n{at}\n%%EOF".encode()
    whole = pdf.text(classic(BODY))
    assert pdf.text(bytes(out)) == whole and "café" in whole
    # Without the references all is found by looking for it.
    assert pdf.text(bytes(out).replace(b"startxref", b"startnone")) == whole


def test_maps_to_unicode():
    cmap = b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0003> <0020> <0005> <D83DDE00> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<00660069> <4E2D>] endbfrange endcmap"
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Resources << /Font << /F 4 0 R >> >> /Contents 5 0 R >>",
        b"<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>", stream(b"BT /F 9 Tf <001000110012000300200021> Tj <0005> Tj ET"), stream(cmap, pack=True),
    ]
    assert pdf.text(classic(objects)) == "abc fi中😀"
    assert parsers.Registry().parse("m.pdf", classic(objects)).chunks == [("", "File: m.pdf abc fi中😀")]


def test_files_without_text():
    said = [("", "PDF: s.pdf (no extractable text — may be scanned)")]
    picture = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 2 0 R] /Count 1 >>", b"<< /Type /Page /Contents 4 0 R >>", stream(b"q BI /W 1 /H 1 ID (((( EI Q Tj 1 Tf [", pack=True)]
    for data in (b"%PDF-1.4\n", b"%PDF-1.4 garbage << [ ( <", classic(picture), classic(BODY, "/Encrypt << /Filter /Standard >>"), b"", classic(BODY)[:40]):
        assert parsers.Registry().parse("s.pdf", data).chunks == said


def test_filters():
    doc = pdf.Document(b"")
    for name, data in {"ASCIIHexDecode": b"68 65 6C6c 6f>", "ASCII85Decode": b"BOu!rDZ~>", "RunLengthDecode": b"\x01he\xffl\x00o\x80", "LZWDecode": b"\x80\x1a\x0c\xa6\xc3a\xbe\x02"}.items():
        assert doc.decoded(pdf.Stream({"Filter": pdf.Name(name)}, data)) == b"hello", name
    twice = pdf.Stream({"Filter": [pdf.Name("ASCIIHexDecode"), pdf.Name("FlateDecode")]}, zlib.compress(b"hello").hex().encode() + b">")
    assert doc.decoded(twice) == b"hello"


def test_sections():
    assert pdf.sections("Title\nAbout\nfirst line,\nsecond.\nNext Part\nmore of it.\nEnd.\n") == [("About", "first line, second."), ("Next Part", "more of it. End.")]
    assert not pdf.is_heading("A, b") and not pdf.is_heading("lower") and not pdf.is_heading("One two three four five six seven eight nine") and not pdf.is_heading("End.")
