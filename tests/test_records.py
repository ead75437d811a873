"""Records that users keep, by literal cases."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import records, state
from tessella.schema import SCHEMAS, empty

NOW = 1_735_689_600


def make(spark, table, *given):
    names = [f.name for f in SCHEMAS[table].fields]
    return spark.createDataFrame([tuple(g.get(n) for n in names) for g in given], SCHEMAS[table])


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


COMMANDS = "seq long, op string, pack_id string, name string, description string, paths array<string>, detail string"


def commands(spark, *given):
    names = [c.split(" ")[0] for c in COMMANDS.split(", ")]
    return spark.createDataFrame([tuple(g.get(n) for n in names) for g in given], COMMANDS)


def test_packs(spark):
    packs = make(spark, "packs", {"id": "p", "name": "old", "created_at": 1}, {"id": "gone", "name": "g", "created_at": 1})
    members = spark.createDataFrame([("p", "/a"), ("p", "/b"), ("gone", "/a")], "pack_id string, path string")
    events = make(spark, "pack_events", {"id": 4, "pack_id": "p", "event": "created", "detail": "old", "at": 1}, {"id": 5, "pack_id": "gone", "event": "created", "at": 1})
    given = commands(
        spark,
        {"seq": 1, "op": "rename", "pack_id": "p", "name": "first"}, {"seq": 2, "op": "rename", "pack_id": "p", "name": "new"},
        {"seq": 3, "op": "add", "pack_id": "p", "paths": ["/c", "/a"]}, {"seq": 4, "op": "remove", "pack_id": "p", "paths": ["/b", "/c", "/none"]}, {"seq": 5, "op": "add", "pack_id": "p", "paths": ["/b", "/d"]}, {"seq": 6, "op": "add", "pack_id": "p", "paths": []},
        {"seq": 7, "op": "add", "pack_id": "q", "paths": ["/early"]}, {"seq": 8, "op": "create", "pack_id": "q", "name": "Q", "description": "d"}, {"seq": 9, "op": "create", "pack_id": "q", "name": "again"}, {"seq": 10, "op": "export", "pack_id": "q", "detail": "out"},
        {"seq": 11, "op": "delete", "pack_id": "gone"}, {"seq": 12, "op": "add", "pack_id": "gone", "paths": ["/late"]},
        {"seq": 13, "op": "create", "pack_id": "r", "name": "R"}, {"seq": 14, "op": "delete", "pack_id": "r"}, {"seq": 15, "op": "rename", "pack_id": "nowhere", "name": "x"}, {"seq": 16, "op": "dance", "pack_id": "p"}, {"seq": 17, "op": "add", "pack_id": None, "paths": ["/x"]},
    )
    p, m, e = records.packs_after(packs, members, events, given, NOW)
    assert rows(p, "id", "name", "description", "created_at") == [("p", "new", None, 1), ("q", "Q", "d", NOW)]
    assert rows(m, "pack_id", "path") == [("p", "/a"), ("p", "/b"), ("p", "/d")]
    assert sorted(map(tuple, e.select("id", "pack_id", "event", "detail").collect())) == [
        (4, "p", "created", "old"), (6, "p", "renamed", "first"), (7, "p", "renamed", "new"), (8, "p", "path_added", "/c, /a"), (9, "p", "path_removed", "/b, /c, /none"), (10, "p", "path_added", "/b, /d"), (13, "q", "created", "Q"), (15, "q", "exported", "out"),
    ]
    same = records.packs_after(packs, members, events, commands(spark).where("false"), NOW)
    assert [d.count() for d in same] == [2, 3, 2]
    assert records.packs_after(empty(spark, "packs"), empty(spark, "pack_paths"), empty(spark, "pack_events"), given, NOW)[0].count() == 1


def test_stale_files(spark):
    members = spark.createDataFrame([("p", "/d"), ("p", "/e.txt"), ("q", "/d/sub"), ("q", "/none")], "pack_id string, path string")
    v = [1.0]
    given = [("/d/ok", 10, v), ("/d/ok", 11, v), ("/d/changed", 3, v), ("/d/gone", 10, v), ("/d/sub/novector", 10, None), ("/d/sub/novector", 10, v), ("/dd/x", 1, v), ("/e.txt", 10, v)]
    chunks = spark.createDataFrame(given, "entry_path string, indexed_at long, embedding array<float>")
    entries = spark.createDataFrame([(p, 5) for p in ("/d/ok", "/d/changed", "/d/sub/novector", "/dd/x", "/e.txt")], "path string, modified_s long")
    assert rows(records.stale_files(members, chunks, entries), "pack_id", "path") == [("p", "/d/changed"), ("p", "/d/gone"), ("p", "/d/sub/novector"), ("q", "/d/sub/novector")]


def test_import_plan(spark):
    items = spark.createDataFrame([("/r/a", "h1", True), ("/r/b", "h2", True), ("/r/none", "h", True), ("/rr/c", "h3", True), ("/r/child", "h", False), ("/r/new", "", True), ("/r/d", None, True)], "path string, hash string, is_root boolean")
    entries = spark.createDataFrame([(p,) for p in ("/r/a", "/r/b", "/rr/c", "/r/child", "/r/new", "/r/d")], "path string")
    summaries = spark.createDataFrame([("/r/a", "h1"), ("/r/b", "other"), ("/rr/c", "h3"), ("/r/d", "h")], "path string, source_hash string")
    roots = spark.createDataFrame([("/r/",)], "path string")
    want = [("/r/a", "valid", "h1", True), ("/r/b", "changed", "other", False), ("/r/d", "changed", "h", False), ("/r/new", "valid", "", True), ("/r/none", "missing", "", False), ("/rr/c", "outside", "h3", False)]
    assert rows(records.import_plan(items, entries, roots, summaries), "path", "verdict", "current", "taken") == want
    assert rows(records.import_plan(items, entries, roots, summaries, force=True).where("taken"), "path") == [("/r/a",), ("/r/b",), ("/r/d",), ("/r/new",)]
    assert records.import_plan(items, entries, spark.createDataFrame([("/",)], "path string"), summaries).where("verdict = 'outside'").count() == 0


def test_classifications(spark):
    base = make(spark, "classifications", {"path": "/a", "kind": "file", "category": "code", "confidence": 0.5, "source": "auto", "created_at": 1}, {"path": "/b", "kind": "dir", "category": "work", "confidence": 0.75, "source": "auto", "created_at": 1})
    said = spark.createDataFrame([("/a", "media", 1), ("/a", "work", 2), ("/new", "system", 3), (None, "work", 4)], "path string, category string, seq long")
    c = records.confirmed(base, said, NOW)
    columns = ("path", "kind", "category", "confidence", "source", "confirmed_at", "created_at")
    assert rows(c, *columns) == [("/a", "file", "work", 1.0, "user", NOW, 1), ("/b", "dir", "work", 0.75, "auto", None, 1), ("/new", "dir", "system", 1.0, "user", NOW, NOW)]
    i = records.ignored(c, spark.createDataFrame([("/b",), ("/x",), ("/x",), (None,)], "path string"), NOW + 1)
    assert rows(i.where("source = 'ignored'"), *columns) == [("/b", "dir", "work", 0.75, "ignored", NOW + 1, 1), ("/x", "dir", "", 0.0, "ignored", None, NOW + 1)]
    again = state.upsert_classifications(i, spark.createDataFrame([("/x", "code", "auto"), ("/b", "code", "auto")], "path string, category string, source string"))
    assert rows(again.where("category = 'code'"), "path") == []
    assert [r.path for r in records.classifications_listed(i).collect()] == ["/a", "/new", "/b", "/x"]
    assert [r.path for r in records.classifications_listed(i, source="user", limit=1).collect()] == ["/a"]
    assert [r.path for r in records.classifications_listed(i, category="work").collect()] == ["/a", "/b"]


def test_weights(spark):
    base = make(spark, "importance_weights", {"target_kind": "file", "target": "/a", "weight": 1.5, "source": "auto", "updated_at": 1}, {"target_kind": "dir", "target": "/a", "weight": 0.5, "updated_at": 1})
    given = spark.createDataFrame([("file", "/a", 2.0, "user", "best", 1), ("file", "/a", 3.0, "user", None, 2), ("category", "code", 1.5, "user", None, 3)], "target_kind string, target string, weight double, source string, reason string, seq long")
    w = records.weights_set(base, given, NOW)
    assert rows(w, "target_kind", "target", "weight", "source", "reason", "updated_at") == [("category", "code", 1.5, "user", None, NOW), ("dir", "/a", 0.5, None, None, 1), ("file", "/a", 3.0, "user", None, NOW)]
    assert rows(records.without(w, w.where("target_kind = 'file'").select("target_kind", "target")), "target_kind") == [("category",), ("dir",)]
    day = state.DAY
    entries = spark.createDataFrame([("/n", NOW + 5), ("/w", NOW - 7 * day), ("/m", NOW - 8 * day), ("/q", NOW - 31 * day), ("/o", NOW - 91 * day), ("/edge", NOW - 100 * day), ("/null", None)], "path string, modified_s long")
    assert [tuple(r) for r in records.recent_weights(entries, NOW, 100).collect()] == [("/n", 2.0), ("/w", 2.0), ("/m", 1.5), ("/q", 1.2), ("/o", 1.0)]


def test_saved_sessions_notes(spark):
    base = make(spark, "saved_queries", {"name": "a", "question": "old?", "mode": "rag", "scope": "/s", "created_at": 1}, {"name": "b", "question": "b?", "created_at": 1})
    given = spark.createDataFrame([("a", "new?", "graph", None, 1), ("c", "c?", "rag", None, 1), (None, "no?", "rag", None, 1)], "name string, question string, mode string, scope string, seq long")
    assert rows(records.saved(base, given, NOW), "name", "question", "mode", "scope", "created_at") == [("a", "new?", "graph", None, NOW), ("b", "b?", None, None, 1), ("c", "c?", "rag", None, NOW)]
    sessions = spark.createDataFrame([("s1", "/x", 1, 1), ("s2", None, 1, 1)], "id string, scope string, created_at long, updated_at long")
    asked = spark.createDataFrame([("s1", "/other", 1), ("s3", None, 2), ("s3", "/late", 3)], "id string, scope string, seq long")
    turns = spark.createDataFrame([("s2",), ("s2",), ("s3",)], "session_id string")
    assert rows(records.sessions_after(sessions, asked, turns, NOW), "id", "scope", "created_at", "updated_at") == [("s1", "/x", 1, 1), ("s2", None, 1, NOW), ("s3", None, NOW, NOW)]
    notes = make(spark, "note_anchors", {"note_path": "/n1", "anchor": "sym", "title": "t"}, {"note_path": "/n2", "anchor": "sym", "title": "u"})
    moved = spark.createDataFrame([("/n1", "other", "path", "T", "p", 1), ("/n3", "sym", "symbol", "N", "p", 2)], "note_path string, anchor string, anchor_kind string, title string, pack string, seq long")
    after = records.notes_after(notes, moved)
    assert [r.note_path for r in records.notes_of(after, spark.createDataFrame([("sym",), ("sym",)], "anchor string")).collect()] == ["/n3", "/n2"]


def test_summaries(spark):
    base = make(spark, "summaries", {"path": "/a", "kind": "file", "parent_path": "/", "summary": "Old.", "summary_l0": "Old.", "embedding": [1.0], "model": "m1", "provider": "x", "passes": 2, "generated_at": 1}, {"path": "/b", "kind": "dir", "parent_path": "/", "summary": "B.", "embedding": [2.0], "model": "m1"})
    given = make(spark, "summaries", {"path": "/a", "kind": "file", "parent_path": "/", "summary": "New one. And more.", "model": "m2", "provider": "y"}).withColumn("seq", F.lit(1))
    w = records.summaries_written(base, given)
    assert rows(w.where("path = '/a'"), "summary", "summary_l0", "model", "provider", "passes") == [("New one. And more.", "New one.", "m2", None, None)]
    texts = spark.createDataFrame([("/a", "Back. Again.", None, None, 1), ("/none", "x", None, None, 1)], "path string, summary string, summary_l0 string, model string, seq long")
    r = records.summaries_restored(base, texts)
    assert rows(r, "path", "summary", "summary_l0", "model", "embedding", "passes") == [("/a", "Back. Again.", "Back.", "m1", None, 2), ("/b", "B.", None, "m1", [2.0], None)]
    s = records.summaries_sourced(base, spark.createDataFrame([("/b", "local", 3, True, 1)], "path string, provider string, passes long, fallback boolean, seq long"))
    assert rows(s, "path", "provider", "passes", "fallback") == [("/a", "x", 2, None), ("/b", "local", 3, True)]
    assert [x.path for x in records.children(base, spark.createDataFrame([("/",)], "path string")).collect()] == ["/a", "/b"]
    assert rows(records.without(base, base.where("path = '/a'").select("path")), "path") == [("/b",)]


def test_chunks(spark):
    schema = "id long, entry_path string, seq long, text string, language string, embedding array<float>"
    chunks = spark.createDataFrame([(3, "/a/x", 1, "second", None, None), (1, "/a/x", 0, None, "py", [1.0, 2.0]), (2, "/ab/y", 0, "y", "rs", [3.0]), (4, "/a/z", 5, "z", "py", [])], schema)
    assert rows(records.first_texts(chunks), "entry_path", "text") == [("/a/x", None), ("/a/z", "z"), ("/ab/y", "y")]
    assert [r.id for r in records.code_chunks(chunks, "/a").collect()] == [1, 4] and records.code_chunks(chunks, limit=1).count() == 1
    assert records.first_dimension(chunks) == 2 and records.first_dimension(chunks.where("id = 3")) is None and records.vectors_of(chunks).count() == 3
    said = spark.createDataFrame([("/a/x", "kotlin", 1), ("/none", "go", 2)], "entry_path string, language string, seq long")
    assert rows(records.languages_set(chunks, said), "id", "language") == [(1, "kotlin"), (2, "rs"), (3, "kotlin"), (4, "py")]
    assert rows(records.chunks_for_mode(chunks, "/a", "compress"), "id") == [(2,)] and records.chunks_for_mode(chunks, "/a", "augment").count() == 4
    with pytest.raises(ValueError):
        records.chunks_for_mode(chunks, "/a", "some")


def test_queue_and_lookups(spark):
    queue = make(spark, "summary_queue", {"path": "/a", "state": "pending", "updated_at": 1}, {"path": "/b", "state": "in_flight", "updated_at": 1}, {"path": "/c", "state": "failed", "error": "old", "updated_at": 9})
    q = records.queue_marked(queue, spark.createDataFrame([("/a", "done", None, 1), ("/a", "failed", "late", 2), ("/x", "done", None, 1)], "path string, state string, error string, seq long"), NOW)
    assert [tuple(r) for r in records.failed(q).collect()] == [("/a", "late"), ("/c", "old")]
    keys = spark.createDataFrame([("/a",), ("/zz",), (None,), ("/a",)], "path string")
    assert rows(records.lookup(q, keys), "path", "found", "state") == [("/a", True, "failed"), ("/zz", False, None), (None, False, None)]
    order = spark.createDataFrame([("/c", 1), ("/none", 2), ("/a", 3)], "path string, rank int")
    assert [r.path for r in records.ranked(order, q, "path").collect()] == ["/c", "/a"]
    apps = make(spark, "directory_apps", {"path": "/d", "app_name": "b", "family": "f", "specificity": 1, "is_primary": False}, {"path": "/d", "app_name": "a", "family": "f", "specificity": 5, "is_primary": False}, {"path": "/d", "app_name": "c", "family": "e", "specificity": 9, "is_primary": True})
    dirs = spark.createDataFrame([("/d",)], "path string")
    assert [r.app_name for r in records.apps_of(apps, dirs).collect()] == ["c", "a", "b"] and [r.app_name for r in records.apps_of(apps).collect()] == ["c", "a", "b"]
    assert [r.app_name for r in records.apps_of(apps, dirs, primary=True).collect()] == ["c"]
    ledger = make(spark, "decisions", {"id": 2, "decision_type": "archive", "subject": "/a"}, {"id": 1, "decision_type": "archive", "subject": "/a"}, {"id": 3, "decision_type": "archive", "subject": "/b"})
    assert [r.id for r in records.history(ledger, ledger.where("subject = '/a'").select("decision_type", "subject")).collect()] == [1, 2]
