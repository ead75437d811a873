"""Overviews against literal cases."""

from pyspark.sql import functions as F

from tessella.operators import overview


def test_common_ancestors(spark):
    hits = {"one": ["/a/b/c.py"], "two": ["/a/b/c.py", "/a/b/d.py"], "prefix": ["/a/bc/x", "/a/b/x"], "none": ["/a/x", "/b/x"], "six": [*["/a/b/x"] * 5, "/z"], "same": ["/a/b", "/a/b/"]}
    rows = [(q, p, i) for q, ps in hits.items() for i, p in enumerate(ps)]
    got = {r.question: r.path for r in overview.common_ancestors(spark.createDataFrame(rows, "question string, entry_path string, place int")).collect()}
    assert got == {"one": "/a/b/c.py", "two": "/a/b", "prefix": "/a", "six": "/a/b/x", "same": "/a/b"}


def test_overviews(spark):
    summaries = [
        ("/a", "dir", "/", " Root. ", "r"), ("/a/b", "dir", "/a", "", None), ("/a/c", "dir", "/a", "Of c", " c0 "), ("/a/d", "dir", "/a", "Of d", None), ("/a/e", "dir", "/a", "Of e", " "), ("/a/f.py", "file", "/a", "file", "f"),
        *[(f"/a/g{i}", "dir", "/a", f"Of g{i}", f"g{i} ü") for i in range(5)], ("/a/d/x", "dir", "/a/d", "é" * 400, None),
    ]
    s = spark.createDataFrame(summaries, "path string, kind string, parent_path string, summary string, summary_l0 string")
    apps = spark.createDataFrame([("/a", "Django", True), ("/a/c", "Old", False), ("/a/c", "Node", True)], "path string, app_name string, is_primary boolean")
    roots = spark.createDataFrame([(1, "/a/f.py"), (2, "/a/b/deep/x"), (3, "/zz"), (4, "/a/d/x/"), (5, "/a/c"), (6, None)], "question int, path string")
    got = {r.question: (r.root, r.overview.removeprefix(overview.HEAD)) for r in overview.overviews(roots, s, apps).collect()}
    # Of the first six directories one has an empty line and one an empty summary of its own.
    assert got[1] == ("/a", "a [Django]: Root.\n  - c [Node]: c0\n  - d: Of d\n  - g0: g0 ü\n  - g1: g1 ü\n")
    assert got.keys() == {1, 4, 5} and got[5] == ("/a/c", "c [Node]: Of c\n")
    for budget in (len(overview.HEAD.encode()) + n for n in (0, 5, 6, 7, 8, 30, 44, 45, 46)):
        cut = {r.question: r.overview for r in overview.overviews(roots, s, apps, budget).collect()}
        assert all(len(x.encode()) <= budget for x in cut.values()) and len(cut[4].encode()) >= budget - 1
        assert (overview.HEAD + got[4][1]).startswith(cut[4]) and (overview.HEAD + got[1][1]).startswith(cut[1])


def test_floor_bytes(spark):
    rows = spark.createDataFrame([("aé中😀",), ("",), (None,)], "t string")
    for n in range(12):
        want = [b"a\xc3\xa9\xe4\xb8\xad\xf0\x9f\x98\x80"[:n].decode("utf-8", "ignore"), "", None]
        assert [r[0] for r in rows.select(overview.floor_bytes(F.col("t"), n)).collect()] == want
