"""Detectors, the caps on questions, and what answers change, by literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.operators import review, state
from tessella.schema import SCHEMAS, empty

NOW, DAY = 1_735_689_600, 86400
CLUSTERS = "cluster long, path string, exact boolean, similarity double"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def ledger(spark, *given):
    names = [f.name for f in SCHEMAS["decisions"].fields]
    return spark.createDataFrame([tuple(g.get(n) for n in names) for g in given], SCHEMAS["decisions"])


def touched(spark, *given):
    return spark.createDataFrame(list(given), "decision_id long, path string")


@pytest.fixture
def clusters(spark):
    given = [
        (1, "/b/a.py", True, 1.0), (1, "/a/b.py", True, 1.0), (1, "/a/b.py", True, 1.0), (1, None, True, 1.0),  # exact, a row twice, a null
        (2, "/a/x.png", True, 1.0), (2, "/b/x.png", True, 1.0),  # assets
        (3, "/a/q.py", False, 0.97), (3, "/b/q.py", False, 0.97),  # near, one name
        (4, "/a/r.py", False, 0.97), (4, "/b/s.py", False, 0.97),  # near, two names
        (5, "/a/Cargo.toml", True, 1.0), (5, "/b/Cargo.toml", True, 1.0),  # manifests apart
        (6, "/a/b.py", False, 0.96), (6, "/c/b.py", False, 0.96),  # near, with a path of 1
        (7, "/dist/a.py", True, 1.0), (7, "/z/a.py", True, 1.0),  # generated
        (8, "/only/one.py", True, 1.0),
    ]
    return spark.createDataFrame(given, CLUSTERS)


def test_duplicates(spark, clusters):
    found, members = review.duplicates(clusters)
    assert rows(found, "subject", "turn", "weight") == [("/a/b.py", 0, 2.0), ("/a/b.py", 1, 2.0), ("/a/q.py", 1, 2.0)]
    assert rows(members.where("subject = '/a/q.py'"), "path") == [("/a/q.py",), ("/b/q.py",)]
    again = {r[0] for r in review.duplicates(clusters.orderBy(F.desc("path")))[0].select("evidence_hash").collect()}
    assert again == {r[0] for r in found.select("evidence_hash").collect()}
    more = clusters.unionByName(spark.createDataFrame([(3, "/c/q.py", False, 0.97)], CLUSTERS))
    assert len({r[0] for r in review.duplicates(more)[0].select("evidence_hash").collect()} - again) == 1
    assert review.duplicates(clusters.where("false"))[0].count() == 0


def test_archives(spark):
    old, young = NOW - 500 * DAY, NOW - 10 * DAY
    given = [("/old", "dir", old), ("/old/sub", "dir", old), ("/old/sub/f.txt", "file", old), ("/older", "dir", old), ("/young", "dir", young), ("/unknown", "dir", None), ("/x/node_modules", "dir", old), ("/x/node_modules/y", "dir", old), ("/done", "dir", old), (None, "dir", old)]
    entries = spark.createDataFrame(given, "path string, kind string, modified_s long")
    known = spark.createDataFrame([("/done", "archive")], "path string, category string")
    found = review.archives(entries, known, NOW)
    assert {(r.subject, json.loads(r.params)["days"], json.loads(r.params)["files"]) for r in found.collect()} == {("/old", 500, 1), ("/older", 500, 0)}
    # A day later nothing is new; in the next step of 90 days it is.
    e = lambda now: rows(review.archives(entries, known, now), "subject", "evidence_hash")
    assert e(NOW) == e(NOW + DAY) and e(NOW) != e(NOW + 60 * DAY)


def test_languages(spark):
    given = [("/a/M.KT", None)] * 3 + [("/b.pl", None)] * 2 + [("/c.txt", None)] * 9 + [("/d.py", "python")] * 5 + [(None, None)] * 4 + [("/e.zig", None)] * 4
    found = review.languages(spark.createDataFrame(given, "entry_path string, language string"))
    assert rows(found, "subject", "auto_value", "weight") == [("/a/M.KT", "kotlin", 3.0), ("/e.zig", "zig", 4.0)]


def test_symbols(spark):
    defines = [("mint", 2), ("new", 2), ("wide", 7), ("one", 1), ("cold", 3)]
    given = [(f"/d{k}.rs", "defines", s) for s, n in defines for k in range(n)] + [(f"/c{k}.rs", "calls", s) for s, n in (("mint", 3), ("new", 9), ("wide", 5), ("one", 8), ("cold", 1)) for k in range(n)]
    edges = spark.createDataFrame(given + given[:2], "from_path string, kind string, to_ref string")
    found, members = review.symbols(edges)
    assert rows(found, "subject", "weight") == [("cold", 1.0), ("mint", 3.0)]
    assert rows(members.where("subject = 'mint'"), "path") == [("/d0.rs",), ("/d1.rs",)]
    assert rows(review.symbols(edges, hottest=3)[0], "subject") == [("mint",)]


def test_drifts(spark):
    schema = "path string, source_hash string, summary string, summary_l0 string, embedding array<float>, model string"
    old = spark.createDataFrame([("/a", "h", "Old. More.", None, [1.0, 0.0], "m1"), ("/b", "h", "Same.", None, [1.0, 0.0], "m1"), ("/c", "h1", "Old.", None, [1.0, 0.0], "m1"), ("/d", "h", "Old.", None, None, "m1")], schema)
    new = spark.createDataFrame([("/a", "h", "New. Text.", None, [0.0, 1.0], "m2"), ("/b", "h", "Same", None, [1.0, 0.1], "m1"), ("/c", "h2", "New.", None, [0.0, 1.0], "m1"), ("/d", "h", "New.", None, [0.0, 1.0], "m1")], schema)
    (r,) = review.drifts(old, new).collect()
    assert r.subject == "/a" and json.loads(r.params) == {"old_summary": "Old. More.", "old_l0": "Old.", "new_l0": "New.", "cosine": 0.0, "old_model": "m1", "new_model": "m2"}


def test_askable(spark, clusters):
    found, members = review.duplicates(clusters)
    none = touched(spark)
    # The near group with a path of an exact one isn't asked about beside it.
    assert rows(review.askable(empty(spark, "decisions"), none, found, members), "subject", "turn") == [("/a/b.py", 0), ("/a/q.py", 1)]
    # A decision about one of its paths covers a group, until another supersedes it or it is dismissed on other evidence.
    for given, left in (({"status": "decided"}, False), ({"status": "open"}, False), ({"status": "decided", "superseded_by": 9}, True), ({"status": "dismissed", "evidence_hash": "other"}, True)):
        led = ledger(spark, {"id": 1, "decision_type": "duplicate", "subject": "/elsewhere", "evidence_hash": "e", **given})
        asked = rows(review.askable(led, touched(spark, (1, "/b/q.py")), found, members), "subject")
        assert (("/a/q.py",) in asked) == left, given


def test_askable_again(spark):
    def finding(kind, subject, evidence):
        return (kind, subject, "{}", None, None, evidence, 30, 2, 0.0)

    schema = "decision_type string, subject string, params string, auto_value string, confidence double, evidence_hash string, priority long, turn int, weight double"
    led = ledger(
        spark, {"id": 1, "decision_type": "archive", "subject": "/k", "status": "decided", "chosen": "keep_active", "evidence_hash": "e"}, {"id": 2, "decision_type": "archive", "subject": "/a", "status": "decided", "chosen": "archive", "evidence_hash": "e"},
        {"id": 3, "decision_type": "symbol_ambiguity", "subject": "mint", "status": "decided", "chosen": "/x", "evidence_hash": "e"}, {"id": 4, "decision_type": "language", "subject": "/l.kt", "status": "decided", "chosen": "ignore", "evidence_hash": "e"},
        {"id": 5, "decision_type": "archive", "subject": "/d", "status": "dismissed", "evidence_hash": "e"},
    )
    at = touched(spark, (1, "/k"), (2, "/a"), (5, "/d"))
    for evidence, want in (("e", []), ("f", [("/d", None), ("/k", 1), ("mint", 3)])):
        found = spark.createDataFrame([finding(k, s, evidence) for k, s in (("archive", "/k"), ("archive", "/a"), ("archive", "/d"), ("symbol_ambiguity", "mint"), ("language", "/l.kt"))], schema)
        assert rows(review.askable(led, at, found), "subject", "parent_id") == want


def test_opened_under_caps(spark, clusters):
    found, members = review.duplicates(clusters)
    chunks = spark.createDataFrame([("/e.zig", None)] * 4, "entry_path string, language string")
    found = found.unionByName(review.languages(chunks))
    led = ledger(spark, *[{"id": k, "decision_type": "archive", "subject": f"/s{k}", "status": "open", "evidence_hash": "e"} for k in range(1, 4)])
    new, at = review.opened(led, touched(spark), found, NOW, members)
    assert rows(new, "id", "subject", "status") == [(4, "/a/b.py", "open"), (5, "/a/q.py", "open"), (6, "/e.zig", "open")]
    assert rows(at, "decision_id", "path") == [(4, "/a/b.py"), (4, "/b/a.py"), (5, "/a/q.py"), (5, "/b/q.py"), (6, "/e.zig")]
    assert new.schema == SCHEMAS["decisions"] or [f.name for f in new.schema.fields] == [f.name for f in SCHEMAS["decisions"].fields]
    assert rows(review.opened(led, touched(spark), found, NOW, members, most_new=1)[0], "subject") == [("/a/b.py",)]
    assert rows(review.opened(led, touched(spark), found, NOW, members, most_open=5)[0], "subject") == [("/a/b.py",), ("/a/q.py",)]
    assert review.opened(led, touched(spark), found, NOW, members, most_open=3)[0].count() == 0
    # What is open isn't asked twice.
    assert review.opened(led.unionByName(new), at, found, NOW, members)[0].count() == 0


def test_vanished_and_swept(spark):
    led = ledger(
        spark, {"id": 1, "decision_type": "duplicate", "subject": "/a", "status": "open", "params": '{"exact":true}'}, {"id": 2, "decision_type": "duplicate", "subject": "/p/a.png", "status": "open", "params": '{"exact":true}'},
        {"id": 3, "decision_type": "archive", "subject": "/gone", "status": "open"}, {"id": 4, "decision_type": "symbol_ambiguity", "subject": "get_x", "status": "open"}, {"id": 5, "decision_type": "duplicate", "subject": "/n/a.py", "status": "open", "params": '{"exact":false}'},
        {"id": 6, "decision_type": "archive", "subject": "/gone2", "status": "decided"},
    )
    at = touched(spark, (1, "/a"), (1, "/b"), (2, "/p/a.png"), (2, "/q/a.png"), (4, "/a"), (5, "/n/a.py"), (5, "/n/b.py"))
    entries = spark.createDataFrame([("/a",), ("/p/a.png",), ("/q/a.png",), ("/n/a.py",)], "path string")
    assert rows(review.vanished(led, at, entries, spark.createDataFrame([("/n/b.py",)], "path string")), "id") == [(1,), (3,)]
    assert rows(review.swept(led, at), "id") == [(2,), (4,), (5,)]


def test_weights_after(spark):
    schema = SCHEMAS["importance_weights"]
    weights = spark.createDataFrame(
        [("file", "/mine", 3.0, "user", None, 1), ("file", "/old", 0.0, "user", "decision:7 duplicate of /c", 1), ("dir", "/kept", 0.5, "user", "decision:8 archived", 1), ("dir", "/hand", 2.0, "user", "important", 1),
         ("file", "/same", 0.0, "user", "decision:1 duplicate of /c", 1)], schema)
    decided = ledger(
        spark, {"id": 1, "decision_type": "duplicate", "subject": "/c", "status": "decided", "chosen": "/c"}, {"id": 7, "decision_type": "duplicate", "subject": "/old", "status": "decided", "chosen": "keep_all"},
        {"id": 3, "decision_type": "archive", "subject": "/arch", "status": "decided", "chosen": "archive"}, {"id": 8, "decision_type": "archive", "subject": "/kept", "status": "decided", "chosen": "keep_active"},
        {"id": 9, "decision_type": "archive", "subject": "/hand", "status": "decided", "chosen": "archive"},
    )
    at = touched(spark, (1, "/c"), (1, "/mine"), (1, "/copy"), (1, "/same"), (7, "/old"), (7, "/other"), (3, "/arch"))
    after = review.weights_after(weights, decided, at, NOW)
    want = [("/arch", 0.5, NOW), ("/copy", 0.0, NOW), ("/hand", 2.0, 1), ("/mine", 3.0, 1), ("/same", 0.0, 1)]
    assert rows(after, "target", "weight", "updated_at") == want
    # Once more changes nothing, whenever it is.
    assert rows(review.weights_after(after, decided, at, NOW + 5), "target", "weight", "updated_at") == want


def test_other_effects(spark):
    base = spark.createDataFrame([("/a", "dir", "code", 0.7, "auto", None, 1), ("/b", "file", "docs", 0.6, "auto", None, 1), ("/z", "dir", "media", 0.9, "auto", None, 1)], SCHEMAS["classifications"])
    decided = ledger(
        spark, {"id": 1, "decision_type": "classification", "subject": "/a", "status": "decided", "chosen": "docs"}, {"id": 2, "decision_type": "classification", "subject": "/b", "status": "decided", "chosen": "ignore"},
        {"id": 3, "decision_type": "archive", "subject": "/n", "status": "decided", "chosen": "archive"}, {"id": 4, "decision_type": "language", "subject": "/f.kt", "status": "decided", "chosen": "kotlin"},
        {"id": 5, "decision_type": "language", "subject": "/g.pl", "status": "decided", "chosen": "ignore"}, {"id": 6, "decision_type": "summary_drift", "subject": "/s", "status": "decided", "chosen": "restore_old", "params": '{"old_summary":"Old. More.","old_model":"m1"}'},
        {"id": 7, "decision_type": "summary_drift", "subject": "/t", "status": "decided", "chosen": "keep_new", "params": '{"old_summary":"Old."}'}, {"id": 8, "decision_type": "symbol_ambiguity", "subject": "mint", "status": "decided", "chosen": "all"},
    )
    after = review.classifications_after(base, decided, NOW)
    assert rows(after, "path", "kind", "category", "confidence", "source") == [("/a", "dir", "docs", 1.0, "user"), ("/b", "file", "docs", 0.6, "ignored"), ("/n", "dir", "archive", 1.0, "user"), ("/z", "dir", "media", 0.9, "auto")]
    chunks = spark.createDataFrame([("/f.kt", None), ("/g.pl", None), ("/h.py", "python")], "entry_path string, language string")
    assert rows(review.languages_after(chunks, decided).fillna("-"), "entry_path", "language") == [("/f.kt", "kotlin"), ("/g.pl", "-"), ("/h.py", "python")]
    s = spark.createDataFrame([("/s", "New.", "New.", [1.0], "m2"), ("/t", "New.", "New.", [1.0], "m2")], "path string, summary string, summary_l0 string, embedding array<float>, model string")
    assert rows(review.summaries_after(s, decided), "path", "summary", "summary_l0", "model", F.col("embedding").isNull().alias("none")) == [("/s", "Old. More.", "Old.", "m1", True), ("/t", "New.", "New.", "m2", False)]
    done = review.applied(decided, state.unapplied(decided).where("id <> 1"), NOW)
    assert rows(done.where("effects IS NOT NULL"), "id", "effects", "effects_applied_at") == [
        (2, '{"classification":"ignore"}', NOW), (3, '{"classification":"archive"}', NOW), (4, '{"language":"kotlin"}', NOW), (5, '{"language":null}', NOW), (6, '{"summary":"restored"}', NOW), (7, '{"summary":"kept_new"}', NOW),
        (8, '{"authoritative":null}', NOW)]


def test_pinned(spark):
    edges = spark.createDataFrame([("/a", "defines", "f"), ("/b", "defines", "f"), ("/a", "defines", "g"), ("/b", "defines", "g"), ("/a", "defines", "h"), ("/b", "defines", "h"), ("/c", "calls", "f")], "from_path string, kind string, to_ref string")
    led = ledger(
        spark, {"id": 1, "decision_type": "symbol_ambiguity", "subject": "f", "status": "decided", "chosen": "/b"}, {"id": 2, "decision_type": "symbol_ambiguity", "subject": "g", "status": "decided", "chosen": "all"},
        {"id": 3, "decision_type": "symbol_ambiguity", "subject": "h", "status": "decided", "chosen": "/elsewhere"}, {"id": 4, "decision_type": "symbol_ambiguity", "subject": "g", "status": "open"},
    )
    assert rows(review.pinned(edges, led), "from_path", "kind", "to_ref") == [("/a", "defines", "g"), ("/a", "defines", "h"), ("/b", "defines", "f"), ("/b", "defines", "g"), ("/b", "defines", "h"), ("/c", "calls", "f")]
