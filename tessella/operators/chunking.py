"""Texts into chunks: windows of words, markdown sections, windows over code."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP, MOST_CHARS = 800, 100, 4000
CHUNK = "entry_path string, seq bigint, heading string, text string"


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def windows(rows: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """rows without their text, and for each window of words (seq, chunk). Windows start ``size - overlap`` words
    apart, and the one that reaches the end is the last. A text without words has none."""
    stride = max(1, size - overlap)
    rest = [c for c in rows.columns if c != text]
    n = F.size("__w")
    last = F.greatest(F.ceil((n - size) / stride), F.lit(0)).cast("int")
    split = rows.select(*rest, words(F.col(text)).alias("__w")).where(n > 0)
    return split.select(*rest, "__w", F.explode(F.sequence(F.lit(0), last)).alias("seq")).select(
        *rest, F.col("seq").cast("long").alias("seq"), F.array_join(F.slice("__w", F.col("seq") * stride + 1, F.lit(size)), " ").alias("chunk")
    )


def pieces(text: str, most: int = MOST_CHARS) -> list[str]:
    """text in pieces of at most so many characters, cut after the last space in a piece's second half, if any."""
    out = []
    while len(text) > most:
        space = text.rfind(" ", 0, most)
        cut = space + 1 if space >= most // 2 else most
        out.append(text[:cut])
        text = text[cut:]
    return [*out, text] if text else out


def word_windows(text: str, size: int = SIZE, overlap: int = OVERLAP, most: int = MOST_CHARS) -> list[str]:
    """The same windows for one text, each in pieces of at most ``most`` characters."""
    w, out, start, stride = text.split(), [], 0, max(1, size - overlap)
    while start < len(w):
        out += pieces(" ".join(w[start : start + size]), most)
        if start + size >= len(w):
            break
        start += stride
    return out


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """The title, tags, author, date and description of a YAML head, and the text after it."""
    lines = text.split("\n")
    if not lines or lines[0].strip() != "---":
        return {}, text
    for end, line in enumerate(lines[1:], 1):
        if line.strip() in ("---", "..."):
            pairs = (x.split(":", 1) for x in lines[1:end] if ":" in x and not x[:1].isspace())
            wanted = {k.strip().lower(): v.strip().strip("\"'") for k, v in pairs}
            return {k: wanted[k] for k in ("title", "tags", "date", "description", "author") if wanted.get(k)}, "\n".join(lines[end + 1 :])
    return {}, text


def markdown_sections(text: str) -> list[tuple[str, str]]:
    """(breadcrumb, text) of each section. Headings below the third level count as third; code fences hold none."""
    head, body = front_matter(text)
    trail: list[str] = []
    out: list[tuple[str, list[str]]] = [("", [f"{k}: {v}" for k, v in head.items()])]
    fence = ""
    for line in body.split("\n"):
        mark = line.lstrip()[:3]
        if mark in ("```", "~~~"):
            fence = "" if fence == mark else fence or mark
        level = len(line) - len(line.lstrip("#"))
        if not fence and 1 <= level <= 6 and line[level : level + 1] in (" ", ""):
            level = min(level, 3)
            trail = [*trail[: level - 1], line.strip("# ").strip()]
            out.append((" > ".join(x for x in trail if x), []))
        else:
            out[-1][1].append(line)
    return [(h, t) for h, lines in out if (t := "\n".join(lines).strip())]


def markdown_chunks(rows: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(entry_path, text) as chunks with their section's breadcrumb."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, text in zip(b["entry_path"], b["text"], strict=True):
                found = [(h, c) for h, t in markdown_sections(text or "") for c in word_windows(t, size, overlap)]
                out += [(path, i, h, c) for i, (h, c) in enumerate(found)]
            yield pd.DataFrame(out, columns=["entry_path", "seq", "heading", "text"])

    return rows.select("entry_path", "text").mapInPandas(of, CHUNK)


def context_prefix(path: Column, heading: Column, document: Column, chars: int = 500) -> Column:
    """What a chunk is embedded with: its file, its section and the start of its document."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("File: "), path),
        F.when(heading != "", F.concat(F.lit("Section: "), heading)),
        F.when(document != "", F.concat(F.lit("Document context: "), F.substring(document, 1, chars))),
    )
