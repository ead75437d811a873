"""What imports mean, who calls a symbol and what is known about it, by literal cases."""

import numpy as np
import pytest

import __spark_entry__ as entry
from tessella.functions import paths
from tessella.operators import graph, state
from tessella.sources import views

JS = graph.JS_ENDINGS
EDGE = "from_path string, kind string, to_ref string"


@pytest.mark.parametrize("caller, ref, want", [
    ("/r/a/x.ts", "./y", [("path", "/r/a/y" + e) for e in ("", *JS)] + [("path", "/r/a/y/index" + e) for e in JS]),
    ("/r/a/x.ts", "../b/./y", [("path", "/r/b/y" + e) for e in ("", *JS)] + [("path", "/r/b/y/index" + e) for e in JS]),
    ("/r/a/x.py", ".y", [("path", "/r/a/y.py"), ("path", "/r/a/y/__init__.py")]), ("/r/a/x.py", "..b.y", [("path", "/r/b/y.py"), ("path", "/r/b/y/__init__.py")]), ("/r/a/x.py", ".", [("path", "/r/a.py"), ("path", "/r/a/__init__.py")]),
    ("/r/a/x.py", "b.y", [("suffix", "/b/y/__init__.py"), ("suffix", "/b/y.py")]), ("/r/a/x.py", "b", [("suffix", "/b/__init__.py")]), ("/r/a/x.py", "naïve_1", [("suffix", "/naïve_1/__init__.py")]),
    ("/r/a/x.rs", "crate::b::y", [("suffix", "/b/y.rs"), ("suffix", "/b/y/mod.rs"), ("suffix", "/b.rs"), ("suffix", "/b/mod.rs")]), ("/r/a/x.rs", "b::{y", [("suffix", "/b/y.rs"), ("suffix", "/b/y/mod.rs"), ("suffix", "/b.rs"), ("suffix", "/b/mod.rs")]),
    ("/r/a/x.rs", "super::y", [("path", "/r/a/y.rs"), ("path", "/r/a/y/mod.rs")]), ("/r/a/mod.rs", "super::y", [("path", "/r/y.rs"), ("path", "/r/y/mod.rs")]), ("/r/a/b/x.rs", "super::super::y", [("path", "/r/a/y.rs"), ("path", "/r/a/y/mod.rs")]),
    ("/r/a/x.rs", "crate::", []), ("/r/a/x.c", "<stdio.h>", [("suffix", "/<stdio/h>/__init__.py"), ("suffix", "/<stdio/h>.py")]), ("/r/a/x.js", "left-pad", []), ("/r/a/x.js", "", []),
])
def test_import_candidates(spark, caller, ref, want):
    row = spark.createDataFrame([(caller, ref)], "a string, b string")
    assert [tuple(c) for c in row.select(graph.import_candidates(row.a, row.b).alias("c")).first().c] == want


def test_joined(spark):
    given = [("/a/b", "../c/./d"), ("/a", "../../../x"), ("a/b", "../../../x"), ("/", "x"), ("/a//b", "c//d/"), ("", "x"), ("/a", "..")]
    rows = spark.createDataFrame(given, "a string, b string")
    assert [r.j for r in rows.select(paths.joined(rows.a, rows.b).alias("j")).collect()] == [paths.lexically_joined(a, b) for a, b in given]


EDGES = [
    ("/r/a/def.py", "defines", "mint"), ("/r/b/def2.py", "defines", "mint"), ("/r/a/def.py", "defines", "new"), ("/r/a/def.py", "imports", "os"), ("/r/a/def.py", "calls", "burn"), ("/r/z.py", "imports", "sys"),
    ("/r/a/def.py", "calls", "mint"), ("/r/a/near.py", "calls", "mint"), ("/r/a/near.py", "calls", "mint"), ("/r/c/far.py", "calls", "mint"), ("/r/c/knows.py", "calls", "mint"), ("/r/c/knows.py", "imports", "b.def2"),
    ("/r/c/x.py", "extends", "mint"), ("/r/c/y.py", "implements", "mint"),
]


def test_symbol_context(spark):
    edges = spark.createDataFrame(EDGES, EDGE)
    files = edges.select(edges.from_path.alias("path")).distinct()
    known = graph.imported(edges, files)
    assert [tuple(r) for r in known.collect()] == [("/r/c/knows.py", "/r/b/def2.py")]
    symbols = spark.createDataFrame([("/r/a/def.py", "mint", "function", 9, 12), ("/r/a/def.py", "mint", "method", 3, 5), ("/r/a/def.py", "other", "function", 1, 2)], "path string, name string, kind string, start_line long, end_line long")
    notes = spark.createDataFrame([("/n/1.md", "mint", "symbol", "On minting", None), ("/n/2.md", "burn", "symbol", "No", None)], "note_path string, anchor string, anchor_kind string, title string, pack string")
    got = {tuple(r) for r in graph.symbol_context(edges, symbols, notes, "mint", known).collect()}
    assert got == {
        ("defined", "/r/a/def.py", "method", 3, 5), ("defined", "/r/b/def2.py", None, None, None), ("called", "/r/a/def.py", "same_file", None, None), ("called", "/r/a/near.py", "same_dir", None, None), ("called", "/r/c/far.py", "bare", None, None),
        ("called", "/r/c/knows.py", "import", None, None), ("extended", "/r/c/x.py", None, None, None), ("implemented", "/r/c/y.py", None, None, None), ("imports", "os", None, None, None), ("calls", "burn", None, None, None), ("calls", "mint", None, None, None),
        ("note", "/n/1.md", "On minting", None, None),
    }
    assert {r["item"] for r in graph.symbol_context(edges, symbols, notes, "mint", known, limit=2).where("section = 'called'").collect()} == {"/r/a/def.py", "/r/a/near.py"}
    # burn is called and noted, but nothing defines it.
    assert graph.symbol_context(edges, symbols, notes, "burn").count() == 0


def test_api_surface(spark):
    edges = spark.createDataFrame([("/a", "defines", f"n{k:02d}") for k in range(15)] * 2 + [("/a", "defines", "get_x"), ("/b", "defines", "new"), ("/b", "calls", "n01"), ("/c", "defines", "z"), ("/c", "defines", None)], EDGE)
    assert {tuple(r) for r in graph.api_surface(edges).collect()} == {("/a", ", ".join(f"n{k:02d}" for k in range(12))), ("/c", "z")}


def test_modules_in(spark):
    m = spark.createDataFrame([(1, "/a/x"), (1, "/b/y"), (2, "/ab/z"), (3, "/a")], "module_id long, member_path string")
    assert {tuple(r) for r in graph.modules_in(m, "/a").select("module_id", "member_path", "members").collect()} == {(1, "/a/x", 2), (1, "/b/y", 2), (3, "/a", 1)}
    assert graph.modules_in(m).count() == 4


def test_suggested_members(spark):
    hits = spark.createDataFrame([("/a", 3), ("/b", 1), ("/a", 2), ("/c", 4), (None, 0), ("/d", 5)], "entry_path string, rank long")
    has = spark.createDataFrame([("/b",)], "path string")
    assert [tuple(r) for r in state.suggested_members(hits, has, 2).collect()] == [("/a", 2), ("/c", 4)]


def _by_hand(edges, imports, cap, drop_own):
    """resolved by loops."""
    definers, calls = {}, {(a, r) for a, kind, r in edges if kind == "calls"}
    for a, kind, r in edges:
        if kind == "defines":
            definers.setdefault(r, set()).add(a)
    out = set()
    for caller, symbol in calls:
        targets = definers.get(symbol, set())
        if not targets or len(targets) > cap or (drop_own and caller in targets):
            continue
        targets = targets - {caller}
        known = {t for t in targets if (caller, t) in imports}
        near = {t for t in targets if "/" in t and t.rsplit("/", 1)[0] == caller.rsplit("/", 1)[0]}
        out |= {(caller, symbol, t, "import" if known else "same_dir" if near else "bare") for t in known or near or targets}
    return out


@pytest.mark.parametrize("drop_own", [True, False])
@pytest.mark.parametrize("cap", [2, 25])
def test_resolved_without_pairs(spark, cap, drop_own):
    # Files of one symbol and of more than the cap, callers that define, that lie beside and that import.
    edges = [(f"/r/d{i % 3}/f{i % 7}", "defines", f"s{i % 11 if i % 7 else i}") for i in range(77)]
    edges += [(f"/r/d{i % 4}/{'c' if i % 5 else 'f'}{i % 6}", "calls", f"s{i % 13}") for i in range(120)]
    imports = {(a, f"/r/d{(i * 5) % 3}/f{i % 7}") for i, (a, kind, _) in enumerate(edges) if kind == "calls" and i % 3 == 0}
    got = graph.resolved(spark.createDataFrame(edges, EDGE), spark.createDataFrame(sorted(imports), "from_path string, target string"), cap, drop_own)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == _by_hand(edges, imports, cap, drop_own)
    # What a call could mean is told before it becomes rows, so nothing sorts or ranks those rows again.
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_imports_asked_once_for_a_directory(spark):
    edges = spark.createDataFrame([(f"/r/a/x{i}.ts", "imports", "./y") for i in range(50)] + [("/r/mod.rs", "imports", "super::y"), ("/r/z.rs", "imports", "super::y"), ("x.py", "imports", "b.y"), (None, "imports", "b.y")], EDGE)
    files = spark.createDataFrame([("/r/a/y.ts",), ("/y.rs",), ("/r/y.rs",), ("/q/b/y.py",)], "path string")
    got = graph.imported(edges, files)
    assert {tuple(r) for r in got.collect()} == {(f"/r/a/x{i}.ts", "/r/a/y.ts") for i in range(50)} | {("/r/mod.rs", "/y.rs"), ("/r/z.rs", "/r/y.rs"), ("x.py", "/q/b/y.py"), (None, "/q/b/y.py")}
    # Candidates are made of directories, of which there are few, not of callers.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [here" in plan


def test_symbol_context_tells_its_callers_imports_alone(spark, monkeypatch):
    rows = [("/r/a/def.py", "defines", "mint"), ("/r/b/def.py", "defines", "mint"), ("/r/c/one.py", "calls", "mint"), ("/r/c/one.py", "imports", "a.def"), ("/r/c/two.py", "calls", "mint"), ("/r/b/three.py", "calls", "mint")]
    rows += [(f"/r/z/f{i}.py", k, ref) for i in range(50) for k, ref in (("imports", "a.def"), ("calls", "burn"))]
    edges = spark.createDataFrame(rows + rows[:6], "from_path string, kind string, to_ref string")
    files = spark.createDataFrame([("/r/a/def.py",), ("/r/b/def.py",)], "path string")
    symbols = spark.createDataFrame([("/r/a/def.py", "mint", "fn", 1, 2)], "path string, name string, kind string, start_line long, end_line long")
    notes = spark.createDataFrame([], "note_path string, anchor string, title string")
    want = graph.symbol_context(edges.distinct(), symbols, notes, "mint", graph.imported(edges.distinct(), files)).collect()
    asked, whole = [], graph.imported
    monkeypatch.setattr(graph, "imported", lambda e, f: asked.extend(e.collect()) or whole(e, f))
    got = graph.symbol_context(edges, symbols, notes, "mint", files=files).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {(r["item"], r["detail"]) for r in got if r["section"] == "called"} == {("/r/c/one.py", "import"), ("/r/c/two.py", "bare"), ("/r/b/three.py", "same_dir")}
    assert {r["from_path"] for r in asked} == {"/r/c/one.py"}


def modularity(edges, of):
    """Of calls and of links of one within directories, where ``of`` tells a file's community."""
    links = [(a, b, max(w, 1)) for a, b, w in edges]
    links += [(a, b, 1) for a in of for b in of if a < b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]]
    degree = {}
    for a, b, w in links:
        degree[of[a]] = degree.get(of[a], 0) + w
        degree[of[b]] = degree.get(of[b], 0) + w
    whole = sum(degree.values())
    return sum(2 * w for a, b, w in links if of[a] == of[b]) / whole - sum((d / whole) ** 2 for d in degree.values())


def test_modules_of_many_files(spark):
    rng = np.random.default_rng(3)
    names = [f"/d{i // 3:04d}/f{i:05d}" for i in range(1600)]
    rows = [(names[i], names[j], 3) for i in range(1600) for j in range(i // 8 * 8, i) if rng.random() < 0.7]
    rows += [(names[i], names[j], 1) for i, j in rng.integers(0, 1600, (500, 2)).tolist() if i != j]
    g = spark.createDataFrame(rows, "source string, target string, weight long")
    got = graph.modules(g).collect()
    of = {r.path: r.module_id for r in got}
    files = sorted({p for a, b, _ in rows for p in (a, b)})
    assert sorted(r.path for r in got) == files and len(files) > 1500
    at = {p: i for i, p in enumerate(files)}
    beside = [(at[a], at[b], 1) for a in files for b in files if a < b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]]
    order = graph.louvain(len(files), [(at[a], at[b], w) for a, b, w in rows] + beside)
    assert modularity(rows, of) > modularity(rows, dict(zip(files, order, strict=True))) - 0.01
    members, inside = {}, {}
    for p in files:
        members.setdefault(of[p], []).append(p)
    for a, b in {(min(a, b), max(a, b)) for a, b, _ in rows}:
        inside[of[a]] = inside.get(of[a], 0) + (of[a] == of[b])
    assert sorted(members, key=lambda m: (-len(members[m]), members[m][0])) == list(range(len(members)))
    for r in got:
        k = len(members[r.module_id])
        assert r.size == k and abs(r.cohesion - (2 * inside.get(r.module_id, 0) / (k * (k - 1)) if k > 1 else 1.0)) < 1e-9


@pytest.mark.parametrize("most", [1500, 0])
def test_modules_of_two_triangles(spark, most):
    """One after the other or all at once; a link of a file with itself makes it a file and nothing more."""
    rows = [("/a/x", "/b/y", 1), ("/b/y", "/c/z", 1), ("/c/z", "/a/x", 1), ("/d/u", "/e/v", 1), ("/e/v", "/f/w", 2), ("/d/u", "/f/w", 0), ("/c/z", "/d/u", 1), ("/g/t", "/g/t", 1)]
    g = spark.createDataFrame(rows, "source string, target string, weight long")
    got = {(r.path, r.module_id, r.cohesion, r.size) for r in graph.modules(g, most).collect()}
    assert got == {*((p, 0, 1.0, 3) for p in ("/a/x", "/b/y", "/c/z")), *((p, 1, 1.0, 3) for p in ("/d/u", "/e/v", "/f/w")), ("/g/t", 2, 1.0, 1)}
    assert graph.modules(g.where("false"), most).count() == 0


def test_modules_query_reads_the_whole_graph(spark, sf):
    links = {(r.source, r.target) for r in graph.code_graph(graph.resolved(views.calls(spark, sf))).collect()}
    got = entry.queries()["grf11_modules"](spark, sf).collect()
    of = {r.path: r.module_id for r in got}
    assert len(got) == len(of) and of.keys() == {p for link in links for p in link}
    inside = len({frozenset(link) for link in links if of[link[0]] == of[link[1]]})
    modules = {r.module_id: r.cohesion * r.size * (r.size - 1) / 2 for r in got if r.size > 1}
    assert len(links) > 400 and inside > 0 and abs(sum(modules.values()) - inside) < 1e-6
