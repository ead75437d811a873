"""Ignore rules: single lines, their order, and trees."""

import re

import pytest

from tessella.sources import ingest, ignores

LINES = [
    ("*.log", "a.log b/a.log b/.log", "a.logs a.log/x b/alog"),
    ("/a", "a", "b/a a/b"),
    ("a/b", "a/b", "c/a/b a/b/c"),
    ("a/**", "a/b a/b/c", "a b/a/c"),
    ("**/a", "a b/a b/c/a", "ab a/b"),
    ("a/**/b", "a/b a/c/b a/c/d/b", "ab a/b/c"),
    ("a**b", "ab axb d/axxb", "a/b"),
    ("doc?.txt", "doc1.txt x/docé.txt", "doc.txt doc12.txt doc/.txt"),
    ("[a-c]x", "ax bx", "dx -x"),
    ("[!a-c]x", "dx -x", "ax /x"),
    ("[]-]x", "]x -x", "ax"),
    ("\\#a", "#a", "a"),
    ("\\!a", "!a", "a"),
    ("a\\*", "a*", "ab"),
    ("a\\ ", "a ", "a"),
    ("a.b+(c)", "a.b+(c)", "axb+(c) a.bb(c)"),
]


@pytest.mark.parametrize(("line", "yes", "no"), LINES, ids=[x[0] for x in LINES])
def test_lines(line, yes, no):
    regex, negated, directory = ignores.rule(line)
    split = (lambda t: [t]) if " " in yes and line.startswith("a") and line != "a/**" and line != "a/**/b" and line != "a**b" else str.split
    assert not negated and not directory
    assert [p for p in split(yes) if not re.search(regex, p)] == [] and [p for p in (split(no) if split is str.split else [no]) if re.search(regex, p)] == []


def test_kinds_of_lines():
    assert ignores.rule("a  ") == ignores.rule("a") and ignores.rule("a\\  ") != ignores.rule("a")
    assert [ignores.rule(x) for x in ("", "  ", "# c", "!", "/", "a[", "a\\", "\r")] == [None] * 8
    assert ignores.rule("!a/")[1:] == (True, True) and ignores.rule("a\r")[0] == ignores.rule("a")[0]


TREE = {
    ".gitignore": "*.tmp\n/out/\nlogs\n!keep.tmp\nsub/deep/*.md\n", "a.txt": "", "a.tmp": "", "keep.tmp": "", "out/keep.tmp": "", "sub/out/x.txt": "", "logs/x.txt": "", "sub/logs": "",
    "sub/.gitignore": "!b.tmp\n*.csv\n", "sub/b.tmp": "", "sub/c.tmp": "", "sub/d.csv": "", "sub/deep/e.md": "", "sub/deep/f/e.md": "", "sub/deep/g.csv": "",
    "sub/deep/.ignore": "!g.csv\nz*\n!zz\n", "sub/deep/za": "", "sub/deep/zz": "", "sub/deep/h.tmp": "", "own/.tessellaignore": "!*.tmp\nb/\n", "own/i.tmp": "", "own/b/x": "", "own/c/b": "", "given/x.dat": "", "given/y.dat": "", "own/z.dat": "",
}
KEPT = "a.txt keep.tmp sub/out/x.txt sub/b.tmp sub/deep/f/e.md sub/deep/g.csv sub/deep/zz own/i.tmp own/c/b given/y.dat"


def test_tree(spark, tmp_path):
    for name, text in TREE.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text or "x")
    names = lambda df: {r.path.removeprefix(f"{tmp_path}/") for r in df.select("path").collect()}
    rules = ("*.dat", "!given/y.dat")
    got = names(ingest.files(spark, str(tmp_path), rules=rules))
    assert got - {n for n in TREE if n.endswith("ignore")} == set(KEPT.split())
    assert names(ingest.files(spark, str(tmp_path), respect=False)) == {n for n in TREE if "/." not in f"/{n}"}
    assert "own/z.dat" not in names(ingest.files(spark, str(tmp_path), rules=rules, respect=False))


def test_no_rules_and_odd_rows(spark):
    files = spark.createDataFrame([("/a/b", 1), (None, 2), ("/a/b", 3), ("/c", 4)], "path string, n int")
    none = ignores.rules(spark.createDataFrame([], "path string, content binary"))
    assert ignores.kept(files, none).count() == 4
    some = ignores.rules(spark.createDataFrame([("/a/.gitignore", bytearray(b"b")), ("/a/x/.gitignore", None), ("/other", bytearray(b"c"))], "path string, content binary"))
    assert sorted(r.n for r in ignores.kept(files, some).collect()) == [2, 4]
