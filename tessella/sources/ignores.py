"""Ignore files: ordered rules with negation, inherited along directories, as joins of paths with the directories above them.

A path is ignored where the rule that counts says so, or where a directory above it is ignored: what lies in it can't come
back. Of rules that match, the own ignore file's count before ``.ignore``'s and those before ``.gitignore``'s; of one kind of
file the deeper directory's count, and within a file the last line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import paths

#: Names of ignore files, the least first. Rules that a caller gives stand between the second and the last.
OWN = ".tessellaignore"
KINDS = {".gitignore": 0, ".ignore": 1, OWN: 3}
GIVEN = 2

_RULE = "dir string, kind int, line int, regex string, negated boolean, directory boolean"


def _class(glob: str, at: int) -> tuple[str, int] | None:
    """A character class from its bracket on, as a regular expression, and where it ends; None where it doesn't."""
    k = at + 1
    negated = k < len(glob) and glob[k] in "!^"
    k += negated
    first, inside = k, ""
    while k < len(glob) and (glob[k] != "]" or k == first):
        c = glob[k]
        if c == "\\" and k + 1 < len(glob):
            k += 1
            c = glob[k]
        inside += c if c == "-" and k != first and k + 1 < len(glob) and glob[k + 1] != "]" else "\\" + c if not c.isalnum() else c
        k += 1
    if k >= len(glob):
        return None
    return f"(?!/)[{'^' if negated else ''}{inside}]", k + 1


def _regex(glob: str) -> str | None:
    """A glob whose stars don't pass slashes; ``**`` between slashes does. None where it is broken."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        if c == "*":
            end = k
            while end < len(glob) and glob[end] == "*":
                end += 1
            whole = end - k > 1 and (k == 0 or glob[k - 1] == "/") and (end == len(glob) or glob[end] == "/")
            if whole and end == len(glob):
                # At the end: all that lies inside, but not the directory itself.
                out, k = out + (".+" if k else ".*"), end
            elif whole:
                out, k = out + "(?:.*/)?", end + 1
            else:
                out, k = out + "[^/]*", end
        elif c == "?":
            out, k = out + "[^/]", k + 1
        elif c == "[":
            found = _class(glob, k)
            if found is None:
                return None
            out, k = out + found[0], found[1]
        elif c == "\\":
            if k + 1 == len(glob):
                return None
            out, k = out + re.escape(glob[k + 1]), k + 2
        else:
            out, k = out + re.escape(c), k + 1
    return out


def rule(line: str) -> tuple[str, bool, bool] | None:
    """(regular expression over paths below the file's directory, negated, for directories alone) of a line; None of blank lines,
    comments and broken patterns."""
    line = line.rstrip("\r\n")
    if line.startswith("#"):
        return None
    line = re.sub(r"(?<!\\)((?:\\\\)*)[ \t]+$", r"\1", line)
    negated = line.startswith("!")
    line = line[1:] if negated else line
    directory = line.endswith("/")
    line = line.rstrip("/") if directory else line
    anchored = "/" in line
    glob = line[1:] if line.startswith("/") else line
    regex = _regex(glob) if glob else None
    if regex is None:
        return None
    return f"(?s)^{'' if anchored else '(?:.*/)?'}{regex}$", negated, directory


def rules(ignore_files: DataFrame, given: tuple[str, ...] = (), root: str = "") -> DataFrame:
    """(dir, kind, line, regex, negated, directory) of ignore files (path, content), and of lines given for the root. Bytes that aren't UTF-8 are replaced."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                up, _, name = path.rpartition("/")
                if name in KINDS and content is not None:
                    text = bytes(content).decode("utf-8-sig", "replace")
                    rows += [(up, KINDS[name], i, *r) for i, x in enumerate(text.split("\n")) if (r := rule(x))]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in _RULE.split(", ")])

    out = ignore_files.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(read, _RULE)
    own = [(root.rstrip("/"), GIVEN, i, *r) for i, x in enumerate(given) if (r := rule(x))]
    return out.unionByName(out.sparkSession.createDataFrame(own, _RULE)) if own else out


def _decided(rows: DataFrame, by_dir: DataFrame, is_directory: bool) -> DataFrame:
    """(path) of those rows (path) that a rule ignores by itself: each meets the directories above it that have rules."""
    up = rows.select("path", F.explode(paths.ancestors("path")).alias("dir")).join(by_dir, "dir")
    below = F.expr("substring(path, length(dir) + 2)")

    def hits(r: Column) -> Column:
        found = F.regexp_like(below, r["regex"])
        return found if is_directory else found & ~r["directory"]

    # The last line that matches.
    last = F.element_at(F.filter("rules", hits), -1)
    met = up.select("path", "kind", F.length("dir").alias("depth"), F.when(F.size(F.filter("rules", hits)) > 0, last["negated"]).alias("negated")).where("negated IS NOT NULL")
    return met.groupBy("path").agg(F.max_by("negated", F.struct("kind", "depth")).alias("negated")).where("NOT negated").select("path")


def kept(files: DataFrame, found_rules: DataFrame) -> DataFrame:
    """files' rows (path and more columns) that no rule ignores. A directory is judged once, however many files lie below it.

    Null paths are never ignored; repeated rows stay or go together. Without rules all stay. What is held for a directory is
    its own ignore files' lines.
    """
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line", "regex", "negated", "directory"))), lambda r: r)
    by_dir = found_rules.groupBy("dir", "kind").agg(lines.alias("rules"))
    own = files.select("path").where("path IS NOT NULL").distinct()
    # Rules speak of what lies below their directory, so only such directories are asked for.
    above = own.select("path", F.explode(paths.ancestors("path")).alias("dir"))
    gone_dirs = _decided(above.select(F.col("dir").alias("path")).distinct(), by_dir, True)
    inside = above.join(gone_dirs.select(F.col("path").alias("dir")), "dir", "left_semi").select("path")
    return files.join(_decided(own, by_dir, False).unionByName(inside).distinct(), "path", "left_anti").select(*files.columns)
