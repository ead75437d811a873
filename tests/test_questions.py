"""Questions as texts, refusals, and what is said beforehand, by literal cases."""

import json

from pyspark.sql import functions as F

from tessella.operators import questions
from tessella.schema import SCHEMAS, empty

NOW = 1_735_689_600
CLUSTERS = "cluster long, path string, exact boolean, similarity double"


def ledger(spark, *given):
    names = [f.name for f in SCHEMAS["decisions"].fields]
    return spark.createDataFrame([tuple(g.get(n) for n in names) for g in given], SCHEMAS["decisions"])


def question(n, kind, params, options, **more):
    return {"id": n, "decision_type": kind, "subject": "/r/proj", "params": json.dumps(params), "options": options if isinstance(options, str) else json.dumps(options), "status": "open", "priority": 5, "created_at": 1, **more}


def test_rendered(spark):
    led = ledger(
        spark, question(1, "classification", {"category": "code"}, ["work", "code", "ignore"], auto_value="code", confidence=0.7), question(2, "classification", {"prior": {"chosen": "work", "decided_at": 1_700_000_000}}, [], auto_value="code", confidence=0.5),
        question(3, "duplicate", {"exact": True, "paths": ["/a", "/b", "/c"]}, ["/a", "/b", "/c", "keep_all"], subject="/x/a.py", auto_value="/a"), question(4, "duplicate", {"similarity": 0.974}, ["/a", "/b", "keep_all"]),
        question(5, "archive", {"days": 400, "files": 3}, ["archive", "keep_active"]), question(6, "summary_drift", {"old_model": "m1", "old_l0": "O.", "new_model": "m2", "new_l0": "N.", "cosine": 0.42}, ["keep_new", "restore_old"]),
        question(7, "language", {"chunks": 4}, ["kotlin", "ignore"], auto_value="kotlin"), question(8, "symbol_ambiguity", {"callers": 9}, ["/a", "/b", "all"], subject="mint"),
        question(9, "later", {}, []), {"id": 10, "decision_type": "archive", "subject": None, "params": "{broken", "options": "{broken", "status": "open"}, {"id": 11, "decision_type": None, "subject": "s", "status": "open"},
    )
    r = {x.id: x for x in questions.rendered(led).collect()}
    assert r[1].title == "/r/proj looks like code (70%)" and r[1].detail.startswith("Confirm to keep code") and r[1].labels == ["work", "code (suggested)", "Ignore (stop suggesting)"]
    assert r[2].detail == "You said work on 2023-11-14; it now looks like code — keep work or switch?" and r[2].labels == []
    assert r[3].title == "3 copies of a.py — which is canonical?" and r[3].detail.startswith("Their content fingerprints are identical.") and r[3].labels == ["/a (suggested)", "/b", "/c", "Keep all (no canonical)"]
    assert r[4].title.startswith("2 copies of proj") and "~97% similar" in r[4].detail
    assert r[5].title == "/r/proj hasn't changed in 400 days — archive it?" and "3 file(s)" in r[5].detail and r[5].labels[0].startswith("Archive (kept indexed")
    assert "only ~42% agrees" in r[6].detail and "Old (m1): “O.” — New (m2): “N.”" in r[6].detail
    assert r[7].title == "/r/proj looks like kotlin — confirm its language?" and "4 chunk(s)" in r[7].detail and r[7].labels[1] == "Ignore (stop suggesting)"
    assert r[8].title == "'mint' is defined in 2 files — which definition is authoritative?" and "9 calling file(s)" in r[8].detail and r[8].labels[2] == "All (keep every definition)"
    assert r[9].title == "later: /r/proj" and r[10].title == " hasn't changed in 0 days — archive it?" and r[10].labels == [] and r[11].title == ": s"
    assert questions.rendered(empty(spark, "decisions")).count() == 0


def test_batch_refusal(spark):
    given = [("classification", "work"), ("classification", "ignore"), ("classification", "play"), ("duplicate", "keep_all"), ("duplicate", "/a"), ("archive", "archive"), ("archive", "all"), ("language", "ignore"), ("language", "go"), ("symbol_ambiguity", "all"), ("summary_drift", "restore_old"), ("new", "all"), (None, "all"), ("archive", None)]
    rows = spark.createDataFrame(given, "k string, c string").select("k", "c", questions.batch_refusal(F.col("k"), F.col("c")).alias("r")).collect()
    assert [(x.k, x.c) for x in rows if x.r is None] == [("classification", "work"), ("classification", "ignore"), ("duplicate", "keep_all"), ("archive", "archive"), ("language", "ignore"), ("symbol_ambiguity", "all"), ("summary_drift", "restore_old")]
    assert next(x.r for x in rows if x.c == "go") == "language questions accept at once: ignore"


def test_checked(spark):
    led = ledger(spark, question(1, "archive", {}, ["archive", "keep_active"]), question(2, "archive", {}, ["archive"], status="decided"), question(3, "later", {}, ["x"]), question(4, "archive", {}, []), question(5, "archive", {}, "{broken"))
    answers = spark.createDataFrame([(1, "archive"), (1, "other"), (2, "archive"), (3, "x"), (4, "archive"), (5, "archive"), (9, "archive"), (1, None), (None, "archive")], "id long, chosen string")
    r = [(x.id, x.refusal) for x in questions.checked(led, answers).collect()]
    assert sorted(r, key=str) == sorted([
        (1, None), (1, "not an option of: archive, keep_active"), (2, "decision is decided, not open"), (3, "unknown type later"), (4, "no readable options"), (5, "no readable options"), (9, "no decision 9"), (1, "not an option of: archive, keep_active"), (None, "no decision ?"),
    ], key=str)


def test_predismissed(spark):
    led = ledger(spark, question(3, "duplicate", {}, [], subject="/a/b.py", evidence_hash="old"), question(4, "archive", {}, [], subject="/a/b.py", evidence_hash="x"))
    clusters = spark.createDataFrame([(1, "/b/a.py", True, 1.0), (1, "/a/b.py", True, 1.0), (2, "/c/one.py", True, 1.0), (2, "/d/two.py", True, 1.0)], CLUSTERS)
    found = questions.duplicates_of(clusters, spark.createDataFrame([("/b/a.py",), ("/a/b.py",), ("/c/one.py",)], "path string"))
    assert [r.subject for r in found.collect()] == ["/a/b.py"]
    after = questions.predismissed(led, found, NOW)
    got = sorted((r.id, r.decision_type, r.status, r.decided_at) for r in after.collect())
    assert got == [(3, "duplicate", "dismissed", NOW), (4, "archive", "open", None), (5, "duplicate", "dismissed", NOW)]
    assert questions.predismissed(after, found, NOW).count() == 3 and questions.predismissed(led, found.where("false"), NOW).where("status = 'open'").count() == 2


def test_backfilled(spark):
    names = [f.name for f in SCHEMAS["classifications"].fields]
    given = [("/a", "dir", "work", 1.0, "user", 7, 1), ("/b", "dir", "code", 0.0, "ignored", None, 2), ("/c", "dir", "code", 0.5, "auto", None, 3)]
    known, led, none = spark.createDataFrame(given, SCHEMAS["classifications"]).select(*names), ledger(spark, question(9, "archive", {}, [])), empty(spark, "decision_paths")
    after, paths = questions.backfilled(led, none, known, NOW)
    rows = {r.subject: r for r in after.where("decision_type = 'classification'").collect()}
    assert {(s, r.chosen, r.status, r.decided_at, r.effects_applied_at, r.effects) for s, r in rows.items()} == {("/a", "work", "decided", 7, NOW, '{"classification":"work"}'), ("/b", "ignore", "decided", 2, NOW, '{"classification":"ignore"}')}
    assert sorted(r.id for r in rows.values()) == [10, 11] and {(r.decision_id, r.path) for r in paths.collect()} == {(r.id, s) for s, r in rows.items()}
    assert questions.backfilled(after, paths, known, NOW)[0].count() == 3
