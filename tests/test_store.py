"""A store of versions: streams against batches, replays, cascades, and claims by several at once."""

import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.schema import SCHEMAS
from tessella.sources import store
from tessella.streaming import watch

PY = "import os\n\n\ndef main():\n    return os.getcwd()\n\n\nclass {0}(Base):\n    pass\n"
EVENTS = [
    [("/p/a.py", "upsert", 1, PY.format("A")), ("/p/d/b.md", "upsert", 1, "# T\ntext of b"), ("/p/d/e/c.md", "upsert", 1, "# C\ntext of c"), ("/p/node_modules/x.js", "upsert", 1, "f()"), ("/p/.env", "upsert", 1, "K=1")],
    [("/p/a.py", "upsert", 2, PY.format("B")), ("/p/a.py", "upsert", 3, PY.format("C")), ("/p/dd.md", "upsert", 3, "# D\nnot below d")],
    [("/p/d", "remove", 5, None), ("/p/n.md", "upsert", 5, "# N\nnew"), ("/p/none", "remove", 5, None)],
]
SCHEMA = "path string, change string, at long, content string"
#: What other parts of a system have written for these paths.
OTHERS = {
    "summaries": [("/p/d/b.md", "file"), ("/p/d", "dir"), ("/p", "dir"), ("/p/dd.md", "file")], "classifications": [("/p/d/e/c.md", "file"), ("/p/a.py", "file")], "directory_apps": [("/p/d/e", "git"), ("/p", "git")],
    "note_anchors": [("/p/d/note.md", "/p/x"), ("/q", "/p/d")],
}


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("content", F.col("content").cast("binary"))


def seeded(spark, path):
    s = store.Store(spark, path)
    plan = {t: (lambda rows, t=t, new=new: (rows.limit(0), spark.createDataFrame([r + (None,) * (len(SCHEMAS[t]) - 2) for r in new], SCHEMAS[t]))) for t, new in OTHERS.items()}
    pairs = [("/p/a.py", "/p/d/b.md", 3, 0), ("/p/d/b.md", "/q", 1, 0), ("/p/a.py", "/p/dd.md", 2, 0)]
    plan["co_change"] = lambda rows: (rows.limit(0), spark.createDataFrame(pairs, SCHEMAS["co_change"]))
    s.change(plan)
    return s


def contents(s):
    at = s.version()
    return {t: Counter(str(r.asDict()) for r in s.table(t, at).drop("indexed_at", "updated_at", "enqueued_at").collect()) for t in store.KEYS}


@pytest.fixture(scope="module")
def batched(spark, tmp_path_factory):
    s = seeded(spark, f"file://{tmp_path_factory.mktemp('store')}/s")
    for i, rows in enumerate(EVENTS):
        watch.apply(s, frame(spark, rows), 100 + i)
    return s


def test_tables_after_changes(batched):
    t = lambda name: batched.table(name)
    files = {r.path: (r.indexed_at, r.first_indexed_at) for r in t("entries").where("kind = 'file'").collect()}
    assert files == {"/p/a.py": (101, 100), "/p/dd.md": (101, 101), "/p/n.md": (102, 102)}
    assert {r.path for r in t("entries").where("kind = 'dir'").collect()} == {"/p"}
    assert {r.entry_path for r in t("chunks").collect()} == {"/p/a.py", "/p/dd.md", "/p/n.md"}
    assert {(r.kind, r.to_ref) for r in t("edges").collect()} >= {("defines", "C"), ("imports", "os")} and not t("edges").where("to_ref IN ('A', 'B')").count()
    assert {r.name for r in t("symbols").collect()} == {"main", "C"}
    assert {r.path for r in t("summaries").collect()} == {"/p", "/p/dd.md"} and {r.path for r in t("classifications").collect()} == {"/p/a.py"}
    assert {r.path for r in t("directory_apps").collect()} == {"/p"} and {r.note_path for r in t("note_anchors").collect()} == {"/q"}
    assert {(r.path_a, r.path_b) for r in t("co_change").collect()} == {("/p/a.py", "/p/dd.md")}
    assert {(r.path, r.kind, r.state) for r in t("summary_queue").collect()} == {("/p/a.py", "file", "pending"), ("/p/dd.md", "file", "pending"), ("/p/n.md", "file", "pending"), ("/p", "dir", "pending")}


def test_stream_equals_batches_after_a_failure(spark, tmp_path, batched):
    src, s = tmp_path / "events", seeded(spark, f"file://{tmp_path}/s")
    src.mkdir()
    for i, rows in enumerate(EVENTS):
        frame(spark, rows).coalesce(1).write.parquet(f"file://{src}/{i}")
    events = spark.readStream.schema("path string, change string, at long, content binary").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{src}")
    started, broken = [], [True]

    def now():
        started.append(1)
        return 99 + len(started)

    def embed(chunks):
        # The second batch fails once, after others of its tables may have been written.
        if len(started) == 2 and broken.pop() if broken else False:
            raise RuntimeError("lost")
        return chunks

    with pytest.raises(Exception, match="lost"):
        watch.follow(s, events, f"file://{tmp_path}/c", "w", now, embed=embed).awaitTermination()
    assert s.version().batches == {"w": 0}
    watch.follow(s, events, f"file://{tmp_path}/c", "w", now, embed=embed).awaitTermination()
    assert s.version().batches == {"w": 2} and s.version().number == batched.version().number
    got, want = contents(s), contents(batched)
    # Times of the entries follow the batches' own; all else is equal.
    for t in want:
        assert t == "entries" or got[t] == want[t], t
    assert {r.path for r in s.table("entries").collect()} == {r.path for r in batched.table("entries").collect()}
    # A batch whose progress was never written down comes again.
    before = s.version()
    watch.apply(s, frame(spark, EVENTS[0]), 500, "w", 2)
    assert s.version() == before and contents(s) == got


def test_of_two_writers_one_wins(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    add = lambda n: {"edges": lambda rows: (rows.limit(0), spark.createDataFrame([("/a", "calls", n)], SCHEMAS["edges"]))}
    at = s.version()
    s.change(add("x"), at=at)
    with pytest.raises(store.Conflict):
        s.change(add("y"), at=at)
    assert [r.to_ref for r in s.table("edges").collect()] == ["x"] and s.version().number == 1
    s.change({"edges": lambda rows: (rows, rows.limit(0))})
    assert s.table("edges").count() == 0 and s.table("edges", s.version()).columns == SCHEMAS["edges"].names


def test_claims(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    paths = ["/r/a/x", "/r/a/y", "/r/b/z", "/rr"]
    s.change({"summary_queue": store.pending(spark.createDataFrame([(p,) for p in paths], "path string"), 1)})
    got, errors = [], []

    def work():
        try:
            got.append(store.claim(s, 2))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=work) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    taken = [p for x in got for p, _ in x]
    assert not errors and sorted(taken) == ["/r/a/x", "/r/a/y", "/r/b/z"]
    # No directory while something below it isn't done; /r isn't above /rr.
    assert store.claim(s, 3, most=5) == [("/rr", "file")]
    assert store.claim(s, 3) == []
    for p in ("/r/a/x", "/r/a/y"):
        store.finish(s, p, "done", 4)
    store.finish(s, "/r/b/z", "deferred", 4)
    assert store.claim(s, 5, most=9) == [("/r/b/z", "file"), ("/r/a", "dir")]
    rows = {r.path: (r.state, r.attempts) for r in s.table("summary_queue").collect()}
    assert rows["/r/a/x"] == ("done", 1) and rows["/r/b/z"] == ("in_flight", 1) and rows["/r/a"] == ("in_flight", 1) and rows["/r"] == ("pending", 0)
