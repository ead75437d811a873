"""Files into chunks, edges and symbols: a registry of parsers by name, and what they make of each format.

A parser takes (name, bytes) and gives Parsed. Python is read with its own grammar, languages with braces by their tokens.
"""

from __future__ import annotations

import ast
import bz2
import csv
import email
import email.policy
import gzip
import html.parser
import io
import json
import lzma
import re
import tarfile
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field
from xml.etree import ElementTree

try:
    import zstandard
except ImportError:
    zstandard = None

from tessella.operators.chunking import markdown_sections, word_windows
from tessella.sources import binaries, lexers, pdf

#: Bytes that a file may unpack to, against archives made to fill memory: a larger one is not read, and says so. Names of an
#: archive that are listed.
UNPACKED, LISTED = 256 << 20, 5000
CODE_LEAST, CODE_MOST = 20, 2000


@dataclass
class Parsed:
    chunks: list[tuple[str, str]] = field(default_factory=list)
    edges: list[tuple[str, str]] = field(default_factory=list)
    symbols: list[tuple[str, str, int, int]] = field(default_factory=list)
    language: str = ""


Parser = Callable[[str, bytes], Parsed]


def decoded(data: bytes) -> str:
    """By a byte order mark, else UTF-8 with U+FFFD for what isn't."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    return data.decode("utf-8", "replace")


def is_binary(data: bytes) -> bool:
    """A zero byte among the first 8192, unless they begin with a UTF-16 mark."""
    head = data[:8192]
    return head[:2] not in (b"\xff\xfe", b"\xfe\xff") and b"\0" in head


def plain(name: str, data: bytes) -> Parsed:
    return Parsed([("", c) for c in word_windows(decoded(data)) if c.strip()])


def markdown(name: str, data: bytes) -> Parsed:
    return Parsed([(h, c) for h, t in markdown_sections(decoded(data)) for c in word_windows(t)])


class _Html(html.parser.HTMLParser):
    _BLOCKS = frozenset("p div br tr table ul ol section article header footer blockquote pre".split())

    def __init__(self):
        super().__init__()
        self.out: list[str] = []

    def handle_starttag(self, tag, attrs):
        if re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in self._BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in self._BLOCKS or re.fullmatch("h[1-6]", tag):
            self.out.append("\n")

    def handle_data(self, data):
        self.out.append(re.sub(r"\s+", " ", data))


def html_to_markdown(text: str) -> str:
    """Headings, items and paragraphs of a page; scripts and styles go, to the end where they aren't closed."""
    text = re.sub(r"(?is)<(script|style)\b.*?(</\1\s*>|\Z)", " ", text)
    p = _Html()
    p.feed(text)
    p.close()
    return re.sub(r"\n{3,}", "\n\n", "".join(p.out)).strip()


def web_page(name: str, data: bytes) -> Parsed:
    return markdown(name, html_to_markdown(decoded(data)).encode())


def pdf_pages(name: str, data: bytes) -> Parsed:
    """By headings where there are two parts or more, else as one text with the file's name; a file without text says so."""
    shown, base = pdf.text(data), name.rsplit("/", 1)[-1]
    if not shown.strip():
        return Parsed([("", f"PDF: {base} (no extractable text — may be scanned)")])
    parts = pdf.sections(shown)
    return Parsed([(h, c) for h, t in (parts if len(parts) >= 2 else [("", f"File: {base}\n{shown}")]) for c in word_windows(t) if c.strip()])


def _code_chunks(name: str, parts: list[tuple[str, str]]) -> list[tuple[str, str]]:
    out = []
    for head, text in parts:
        size = len(text.encode())
        if size > CODE_MOST:
            out += [(head, c) for c in word_windows(text, 400, 100)]
        elif size >= CODE_LEAST:
            out.append((head, text))
    return out


def python_code(name: str, data: bytes) -> Parsed:
    """By Python's grammar; text that it doesn't take is plain."""
    text = decoded(data)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return Parsed(plain(name, data).chunks, language="python")
    lines, out, parts = text.splitlines(), Parsed(language="python"), []
    for node in tree.body:
        first = min([node.lineno, *[d.lineno for d in getattr(node, "decorator_list", [])]])
        parts.append((getattr(node, "name", ""), "\n".join(lines[first - 1 : node.end_lineno])))
    out.chunks = _code_chunks(name, parts)
    edges: set[tuple[str, str]] = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            kind = "class" if isinstance(node, ast.ClassDef) else "fn"
            out.symbols.append((node.name, kind, node.lineno, node.end_lineno))
            edges.add(("defines", node.name))
            for base in getattr(node, "bases", []):
                if named := _last_name(base):
                    edges.add(("extends", named))
        elif isinstance(node, ast.Import):
            edges |= {("imports", a.name) for a in node.names}
        elif isinstance(node, ast.ImportFrom):
            edges.add(("imports", "." * node.level + (node.module or "")))
        elif isinstance(node, ast.Call) and (named := _last_name(node.func)):
            edges.add(("calls", named))
    out.edges = sorted(edges)
    return out


def _last_name(node: ast.AST) -> str:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else ""


def other_code(language: str) -> Parser:
    """Of languages with braces, by their tokens: see ``lexers``."""

    def parse(name: str, data: bytes) -> Parsed:
        text = decoded(data)
        code = lexers.read(text, language)
        parts = [(head, text[a:b]) for head, a, b in code.parts]
        return Parsed(_code_chunks(name, parts or [("", text)]), sorted(code.edges), code.symbols, language)

    return parse


class TooLarge(Exception):
    """A file unpacks to more than UNPACKED bytes."""


def _read(f: io.IOBase, most: int) -> bytes:
    data = f.read(most + 1)
    if len(data) > most:
        raise TooLarge
    return data


def _zip_text(z: zipfile.ZipFile, entry: str, left: list[int]) -> str:
    with z.open(entry) as f:
        data = _read(f, left[0])
    left[0] -= len(data)
    return data.decode("utf-8", "replace")


def _xml_text(xml: str, paragraph: str, run: str) -> str:
    root = ElementTree.fromstring(xml)
    return "\n".join("".join(t.text or "" for t in p.iter() if t.tag.endswith(run)) for p in root.iter() if p.tag.endswith(paragraph))


def zipped_xml(pattern: str, paragraph: str, run: str, head: str = "") -> Parser:
    """Documents and slides that are archives of XML: the text of their parts, one section each, in order of number."""

    def parse(name: str, data: bytes) -> Parsed:
        out, left = Parsed(), [UNPACKED]
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            parts = [(int("".join(re.findall(r"\d+", n)) or 0), n) for n in z.namelist() if re.fullmatch(pattern, n)]
            for k, (_, entry) in enumerate(sorted(parts), 1):
                text = _xml_text(_zip_text(z, entry, left), paragraph, run)
                out.chunks += [(f"{head} {k}".strip() if head else "", c) for c in word_windows(text)]
        return out

    return parse


def slides(name: str, data: bytes) -> Parsed:
    """Slides in order of number, each with its speaker's notes: those that it refers to, or where no slide refers to any and there are as
    many notes as slides, those of its place."""
    out, left = Parsed(), [UNPACKED]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        numbers = lambda stem: sorted(int(m[1]) for n in names if (m := re.fullmatch(rf"ppt/{stem}(\d+)\.xml", n)))
        shown, notes, refers = numbers("slides/slide"), numbers("notesSlides/notesSlide"), {}
        for n in shown:
            if (entry := f"ppt/slides/_rels/slide{n}.xml.rels") in names and (m := re.search(r"notesSlide(\d+)\.xml", _zip_text(z, entry, left))):
                refers[n] = int(m[1])
        if not refers and len(notes) == len(shown):
            refers = dict(zip(shown, notes, strict=True))
        for k, n in enumerate(shown, 1):
            text = _xml_text(_zip_text(z, f"ppt/slides/slide{n}.xml", left), "}p", "}t")
            if refers.get(n) in notes and (said := _xml_text(_zip_text(z, f"ppt/notesSlides/notesSlide{refers[n]}.xml", left), "}p", "}t").strip()) and said != text.strip():
                text += f"\n\nSpeaker notes: {said}"
            out.chunks += [(f"Slide {k}", c) for c in word_windows(text)]
    return out


def open_spreadsheet(name: str, data: bytes) -> Parsed:
    """The tables of an OpenDocument spreadsheet, row by row; rows and cells at a table's end that are empty, however often, are left out."""
    out, left = Parsed(), [UNPACKED]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(_zip_text(z, "content.xml", left))
    for k, table in enumerate((t for t in root.iter() if t.tag.endswith("}table")), 1):
        lines = []
        for row in (r for r in table.iter() if r.tag.endswith("}table-row")):
            cells = [" ".join("".join(p.itertext()) for p in c if p.tag.endswith("}p")) for c in row if c.tag.endswith("}table-cell")]
            while cells and not cells[-1]:
                cells.pop()
            lines.append(" | ".join(cells))
        title = next((v for a, v in table.attrib.items() if a.endswith("}name")), f"Sheet {k}")
        out.chunks += [(title, c) for c in word_windows("\n".join(lines))]
    return out


def table_text(name: str, data: bytes) -> Parsed:
    rows = csv.reader(io.StringIO(decoded(data)), delimiter="\t" if name.lower().endswith(".tsv") else ",")
    return Parsed([("", c) for c in word_windows("\n".join(" | ".join(r) for r in rows))])


def spreadsheet(name: str, data: bytes) -> Parsed:
    out, left = Parsed(), [UNPACKED]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            root = ElementTree.fromstring(_zip_text(z, "xl/sharedStrings.xml", left))
            shared = ["".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")) for si in root if si.tag.endswith("}si")]
        for k, entry in enumerate(sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), 1):
            lines = []
            for row in (r for r in ElementTree.fromstring(_zip_text(z, entry, left)).iter() if r.tag.endswith("}row")):
                cells = []
                for c in row:
                    v = "".join(t.text or "" for t in c.iter() if t.tag.endswith(("}v", "}t")))
                    cells.append(shared[int(v)] if c.get("t") == "s" and v.isdigit() and int(v) < len(shared) else v)
                lines.append(" | ".join(cells))
            out.chunks += [(f"Sheet {k}", c) for c in word_windows("\n".join(lines))]
    return out


def book(name: str, data: bytes) -> Parsed:
    """An EPUB in the order of its spine."""
    out, left = Parsed(), [UNPACKED]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(_zip_text(z, "META-INF/container.xml", left))
        opf = next(e.get("full-path") for e in root.iter() if e.tag.endswith("rootfile"))
        package = ElementTree.fromstring(_zip_text(z, opf, left))
        items = {e.get("id"): e.get("href") for e in package.iter() if e.tag.endswith("}item")}
        base = opf.rsplit("/", 1)[0] + "/" if "/" in opf else ""
        for ref in (e.get("idref") for e in package.iter() if e.tag.endswith("}itemref")):
            if ref in items and base + items[ref] in z.namelist():
                out.chunks += web_page(name, _zip_text(z, base + items[ref], left).encode()).chunks
    return out


def notebook(name: str, data: bytes) -> Parsed:
    cells = json.loads(decoded(data)).get("cells", [])
    text = [(c.get("cell_type", ""), "".join(c["source"]) if isinstance(c.get("source"), list) else c.get("source") or "") for c in cells]
    return Parsed([(kind, c) for kind, t in text if t.strip() for c in word_windows(t)])


def message(name: str, data: bytes) -> Parsed:
    m = email.message_from_bytes(data, policy=email.policy.default)
    body = m.get_body(("plain", "html"))
    text = body.get_content() if body else ""
    if body and body.get_content_type() == "text/html":
        text = html_to_markdown(text)
    head = "\n".join(f"{k}: {m[k]}" for k in ("Subject", "From", "To", "Date") if m[k])
    return Parsed([(str(m["Subject"] or ""), c) for c in word_windows(f"{head}\n\n{text}")])


def outline(name: str, data: bytes) -> Parsed:
    """Org files: headings are stars."""
    return markdown(name, re.sub(r"(?m)^(\*+) ", lambda m: "#" * len(m[1]) + " ", decoded(data)).encode())


def drawing(name: str, data: bytes) -> Parsed:
    root = ElementTree.fromstring(decoded(data))
    text = " ".join("".join(e.itertext()).strip() for e in root.iter() if e.tag.rsplit("}", 1)[-1] in ("title", "desc", "text"))
    return Parsed([("", c) for c in word_windows(text)])


def rich_text(name: str, data: bytes) -> Parsed:
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), data.decode("latin-1"))
    text = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info|\*)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", text)
    text = re.sub(r"\\(par|line)\b ?", "\n", text)
    return Parsed([("", c) for c in word_windows(re.sub(r"\\[a-z]+-?\d* ?|[{}]", "", text))])


def archive(name: str, data: bytes) -> Parsed:
    """The names in an archive; nothing in it is unpacked."""
    if name.lower().endswith(".zip") or data[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()[:LISTED]
    else:
        names = []
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                names.append(m.name)
                if len(names) >= LISTED:
                    break
    return Parsed([("", c) for c in word_windows(f"Archive: {name}\n" + "\n".join(names))])


def compiled(name: str, data: bytes) -> Parsed:
    """The names that a compiled file declares."""
    shown, found = name.rsplit("/", 1)[-1], binaries.symbols(name, data)
    text = f"Binary {shown} — {len(found)} symbols:\n" + "\n".join(found) if found else f"Binary: {shown} (no readable symbols — may be stripped)"
    return Parsed([("symbols", c) for c in word_windows(text)])


def picture(name: str, data: bytes) -> Parsed:
    """A picture's name and the tags that its camera wrote."""
    lines = [f"File: {name.rsplit('/', 1)[-1]}", ", ".join(binaries.tags(data))]
    return Parsed([("", "\n".join(x for x in lines if x))])


def _frames(f: io.BytesIO) -> io.IOBase:
    """All frames of Zstandard data. The reader bounds what they unpack to but takes a cut frame for its end, so their ends are
    looked for too."""
    if zstandard is None:
        raise ValueError("zstandard isn't installed")
    rest = f.getvalue()
    whole = _read(zstandard.ZstdDecompressor().stream_reader(rest, read_across_frames=True), UNPACKED)
    while rest:
        frame = zstandard.ZstdDecompressor().decompressobj()
        frame.decompress(rest)
        if not frame.eof:
            raise ValueError("a frame is cut")
        rest = frame.unused_data
    return io.BytesIO(whole)


_OPENERS = {".gz": gzip.open, ".xz": lzma.open, ".bz2": bz2.open, ".zst": _frames, ".zstd": _frames}


def unpacked(name: str, data: bytes) -> tuple[str, bytes]:
    """The name and content of a compressed file, whole."""
    for ending, opener in _OPENERS.items():
        if name.lower().endswith(ending) and not name.lower().endswith(".tar" + ending):
            with opener(io.BytesIO(data)) as f:
                return name[: -len(ending)], _read(f, UNPACKED)
    return name, data


#: How well each ending is read: its parser, or the names alone of what is in it.
BUILT_IN: dict[str, Parser] = {
    **dict.fromkeys("txt log conf ini cfg yaml yml json toml xml css rst".split(), plain), **dict.fromkeys(("md", "markdown"), markdown), **dict.fromkeys(("html", "htm", "xhtml"), web_page), "py": python_code,
    **{e: other_code(lang) for lang, es in lexers.ENDINGS.items() for e in es.split()}, "csv": table_text, "tsv": table_text, "xlsx": spreadsheet, "docx": zipped_xml(r"word/(document|header\d*|footer\d*|footnotes|endnotes)\.xml", "}p", "}t"), "ods": open_spreadsheet, "odt": zipped_xml(r"content\.xml", "}p", "}p"),
    **dict.fromkeys(("pptx", "ppsx"), slides), "epub": book, "pdf": pdf_pages, "ipynb": notebook, "eml": message, "org": outline, "svg": drawing, "rtf": rich_text, **dict.fromkeys(("zip", "tar", "tgz"), archive),
    **dict.fromkeys("so dylib exe wasm jar o".split(), compiled), **dict.fromkeys("jpg jpeg png gif webp heic heif tiff tif bmp cr2 nef arw dng".split(), picture),
}


class Registry:
    """Parsers by what they accept: own ones first, the last registered before the others, then those by ending."""

    def __init__(self):
        self.own: list[tuple[Callable[[str], bool], Parser]] = []

    def register(self, accepts: Callable[[str], bool], parser: Parser) -> None:
        self.own.insert(0, (accepts, parser))

    def parse(self, name: str, data: bytes) -> Parsed | None:
        """What the first parser that accepts a name makes of the content; nothing for unknown binary files. A parser that
        fails leaves the text as it is, if it is text; of what unpacks to too much there is a line that says so."""
        try:
            name, data = unpacked(name, data)
            ending = name.rsplit("/", 1)[-1].rpartition(".")[2].lower()
            parser = next((p for accepts, p in self.own if accepts(name)), BUILT_IN.get(ending))
            if parser is not None:
                return parser(name, data)
        except TooLarge:
            return Parsed([("", f"File: {name.rsplit('/', 1)[-1]} (unpacks to more than {UNPACKED} bytes, not read)")])
        except Exception:
            # Its text, below.
            pass
        return None if is_binary(data) or data[:4] == b"PK\x03\x04" else plain(name, data)


def formats() -> list[tuple[str, str]]:
    """(ending, how well it is read)."""
    return sorted((e, "names" if p in (archive, compiled, picture) else "full") for e, p in BUILT_IN.items())
