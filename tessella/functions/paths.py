"""Column expressions over slash-separated paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(path: Column | str) -> Column:
    return F.col(path) if isinstance(path, str) else path


def normalised(path: Column | str) -> Column:
    """Backslashes as slashes, and no slash at the end but that of the root."""
    p = F.replace(_c(path), F.lit("\\"), F.lit("/"))
    return F.when(F.length(p) > 1, F.regexp_replace(p, "/+$", "")).otherwise(p)


def parent(path: Column | str) -> Column:
    """The directory of a path; '/' for what lies in the root, null for the root and for names without a slash."""
    p = _c(path)
    cut = F.regexp_extract(p, "^(.*)/[^/]*$", 1)
    return F.when((p == "/") | ~F.contains(p, F.lit("/")), None).when(cut == "", F.lit("/")).otherwise(cut)


def basename(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def extension(path: Column | str) -> Column:
    """The lower-cased extension of the file name, '' where it has none; a leading dot alone makes none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1))


def depth(path: Column | str) -> Column:
    """The number of separators."""
    p = normalised(path)
    return F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))


def ancestors(path: Column | str, self_too: bool = False) -> Column:
    """All directories above an absolute path, nearest last; '/' is left out."""
    parts = F.split(_c(path), "/")
    last = F.size(parts) if self_too else F.size(parts) - 1
    # Position 1 is what stands before the first slash.
    return F.when(last >= 2, F.transform(F.sequence(F.lit(2), last), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def under(path: Column | str, prefix: str) -> Column:
    """Whether a path is the prefix or lies below it: /proj doesn't hold /projector. An empty prefix holds all."""
    p = _c(path)
    if prefix in ("", "/", "\\"):
        return F.lit(True)
    separator = "\\" if "\\" in prefix and "/" not in prefix else "/"
    root = prefix.rstrip("/\\")
    return (p == root) | p.startswith(root + separator)


def historical(path: Column | str, segments: tuple[str, ...] = ("archive", "archived", "historical", "deprecated", "old")) -> Column:
    return F.arrays_overlap(F.split(F.lower(_c(path)), "/"), F.array(*map(F.lit, segments)))


def lexically_joined(base: str, relative: str) -> str:
    """relative from the directory base, with '.' and '..' resolved by name alone."""
    out: list[str] = []
    for part in f"{base}/{relative}".split("/"):
        if part == ".." and out and out[-1] not in ("", ".."):
            out.pop()
        elif part == ".." and out == [""]:
            continue
        elif part not in (".", "") or (part == "" and not out):
            out.append(part)
    return "/".join(out)


def joined(base: Column, relative: Column) -> Column:
    """lexically_joined as a column."""

    def step(out: Column, part: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        back = (part == "..") & (F.size(out) > 0)
        return (
            F.when(back & ~last.isin("", ".."), F.slice(out, F.lit(1), F.size(out) - 1)).when(back & (last == "") & (F.size(out) == 1), out)
            .when(~part.isin(".", "") | ((part == "") & (F.size(out) == 0)), F.concat(out, F.array(part))).otherwise(out)
        )

    parts = F.split(F.concat(base, F.lit("/"), relative), "/")
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
