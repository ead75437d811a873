"""Slides with notes, open spreadsheets, parts of documents and packed text, by literal cases."""

import io
import zipfile

import pytest

from tessella.sources import parsers


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def page(text):
    return f'<s xmlns:a="a"><a:p><a:t>{text}</a:t></a:p></s>'


def test_notes_follow_references():
    deck = {"ppt/slides/slide1.xml": page("one"), "ppt/slides/slide2.xml": page("two"), "ppt/slides/slide10.xml": page("ten"), "ppt/notesSlides/notesSlide1.xml": page("say ten"), "ppt/notesSlides/notesSlide2.xml": page("two")}
    deck["ppt/slides/_rels/slide10.xml.rels"] = '<Relationships><Relationship Target="../notesSlides/notesSlide1.xml"/></Relationships>'
    deck["ppt/slides/_rels/slide2.xml.rels"] = '<Relationships><Relationship Target="../notesSlides/notesSlide2.xml"/></Relationships>'
    deck["ppt/slides/_rels/slide1.xml.rels"] = '<Relationships><Relationship Target="../notesSlides/notesSlide99.xml"/></Relationships>'
    got = parsers.Registry().parse("a.pptx", zipped(deck)).chunks
    assert got == [("Slide 1", "one"), ("Slide 2", "two"), ("Slide 3", "ten Speaker notes: say ten")]


def test_notes_by_place():
    deck = {"ppt/slides/slide1.xml": page("one"), "ppt/slides/slide3.xml": page("three"), "ppt/notesSlides/notesSlide1.xml": page("a"), "ppt/notesSlides/notesSlide2.xml": page("b")}
    assert parsers.Registry().parse("a.ppsx", zipped(deck)).chunks == [("Slide 1", "one Speaker notes: a"), ("Slide 2", "three Speaker notes: b")]
    del deck["ppt/notesSlides/notesSlide2.xml"]
    assert parsers.Registry().parse("a.pptx", zipped(deck)).chunks == [("Slide 1", "one"), ("Slide 2", "three")]


def test_open_spreadsheet():
    cell = lambda *texts: "<t:table-cell>" + "".join(f"<x:p>{t}</x:p>" for t in texts) + "</t:table-cell>"
    rows = [cell("a") + cell("b", "<x:s>c</x:s>") + '<t:table-cell t:number-columns-repeated="1000"/>', '<t:table-cell/>' + cell("d"), ""]
    tables = '<t:table t:name="Sums">' + "".join(f"<t:table-row>{r}</t:table-row>" for r in rows) + "</t:table>" + f"<t:table><t:table-row>{cell('e')}</t:table-row></t:table>"
    data = zipped({"content.xml": f'<d xmlns:t="t" xmlns:x="x">{tables}</d>'})
    assert parsers.Registry().parse("a.ods", data).chunks == [("Sums", "a | b c | d"), ("Sheet 2", "e")]


def test_parts_of_documents():
    w = lambda t: f'<w:d xmlns:w="w"><w:p><w:t>{t}</w:t></w:p></w:d>'
    data = zipped({"word/document.xml": w("body"), "word/header1.xml": w("head"), "word/footnotes.xml": w("note"), "word/styles.xml": w("style")})
    assert [c for _, c in parsers.Registry().parse("a.docx", data).chunks] == ["body", "note", "head"]


def test_zstandard(monkeypatch):
    zstandard = pytest.importorskip("zstandard")
    pack = zstandard.ZstdCompressor().compress
    r = parsers.Registry()
    assert r.parse("a.txt.zst", pack(b"first ") + pack(b"second")).chunks == [("", "first second")]
    assert r.parse("a.txt.zst", b"\x28\xb5\x2f\xfd\0\0") is None
    monkeypatch.setattr(parsers, "UNPACKED", 1000)
    assert "not read" in r.parse("b.txt.zst", pack(b"x" * 5000)).chunks[0][1]
