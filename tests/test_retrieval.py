"""Graphs of vectors, the inverted index and questions in batches, against brute force and against one question at a time."""

import math
import random
import re
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import ann, batch, evaluation, retrieve, search
from tessella.operators import index as inverted
from tessella.sources.shared import stored


def vectors(n, d, seed, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32)
    if copies:
        x[n // 2 : n // 2 + copies] = x[0]
        # Many that are nearly the same, and far from the rest.
        x[-copies:] = x[1] + rng.standard_normal((copies, d)).astype(np.float32) * 0.01
    return x


@pytest.mark.parametrize(("n", "d", "copies"), [(12000, 64, 0), (6000, 24, 700)])
def test_graph_recall(spark, n, d, copies):
    x = vectors(n, d, n, copies)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<float>").repartition(4)
    graph = stored(ann.build(df))
    assert graph.select("shard").distinct().count() == -(-n // ann.SHARD) and graph.agg(F.sum(F.size("ids"))).first()[0] == n
    got = ann.nearest(graph, df.where("chunk_id % 150 = 0").select(F.col("chunk_id").alias("query"), F.col("embedding").alias("q")), 20).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    recalls = []
    for q in range(0, n, 150):
        own = sorted((r.rank, r.id, r.score) for r in got if r["query"] == q)
        score = np.round(unit @ unit[q], 9)
        want = np.lexsort((np.arange(n), -score))[:20]
        assert [r for r, _, _ in own] == list(range(20))
        assert np.allclose([s for _, _, s in own], score[[i for _, i, _ in own]])
        recalls.append(len({i for _, i, _ in own} & set(want.tolist())) / 20)
    assert np.mean(recalls) >= 0.97, np.mean(recalls)


def test_graph_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 2.0, 3.0]), (5, [float("nan"), 1.0]), (6, [0.5, 0.5]), (None, [1.0, 1.0]), (7, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    graph = stored(ann.build(df))
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0])], "query long, q array<double>")
    assert [(r["query"], r.id, r["rank"]) for r in ann.nearest(graph, asked, 5).orderBy("query", "rank").collect()] == [(1, 1, 0), (1, 7, 1), (1, 6, 2)]
    none = ann.build(df.limit(0))
    assert none.count() == 0 and ann.nearest(none, asked, 5).count() == 0


def test_dense_falls_back(spark):
    rows = [(i, f"/a/{'x' if i % 2 else 'y'}/{i}", [math.cos(i), math.sin(i)]) for i in range(30)]
    chunks = spark.createDataFrame(rows, "chunk_id long, entry_path string, embedding array<double>")
    graph = stored(ann.build(chunks))
    ids = lambda df: [r.id for r in df.orderBy(F.desc("score"), "id").collect()]
    exact = ids(ann.dense(chunks, [1.0, 0.1], 5))
    assert ids(ann.dense(chunks, [1.0, 0.1], 5, None, graph)) == exact
    # A scope is compared one by one; ids that are gone are left out; an index of other vectors finds nothing, so all are compared.
    assert ids(ann.dense(chunks, [1.0, 0.1], 5, "/a/x", graph)) == ids(ann.dense(chunks.where("chunk_id % 2 = 1"), [1.0, 0.1], 5))
    left = chunks.where(F.col("chunk_id") != exact[0])
    assert ids(ann.dense(left, [1.0, 0.1], 5, None, graph)) == exact[1:]
    other = stored(ann.build(spark.createDataFrame([(99, [1.0, 2.0, 3.0])], "chunk_id long, embedding array<double>")))
    assert ids(ann.dense(chunks, [1.0, 0.1], 5, None, other)) == exact
    assert not ann.worth(chunks) and ann.worth(chunks, 30)


WORDS = "alpha beta gamma delta the of where code function parser config".split()
QUESTIONS = [
    (1, "alpha beta"), (2, "beta alpha beta"), (3, "the of"), (4, "where is the parser function"), (5, "overview of everything gamma"), (6, ""), (7, "nothingness"), (8, "alpha"), (9, "give me an overview: delta code"),
]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    rows, files = [], []
    for i in range(160):
        path = f"/c/{rng.choice(['src', 'old', 'doc'])}/{rng.choice('pqr')}{rng.randint(0, 12)}.{rng.choice(['py', 'md'])}"
        text = " ".join(rng.choices(WORDS, k=rng.randint(0, 12))) if i % 17 else "File: x.png"
        rows.append((i, path, rng.choice([None, "alpha head", "Beta"]), text if i % 23 else None, [rng.gauss(0, 1) for _ in range(8)] if i % 5 else None))
        files.append((path, 1_000_000 - rng.randint(0, 200) * 86400))
    chunks = spark.createDataFrame(rows, "chunk_id long, entry_path string, heading string, text string, embedding array<double>")
    dirs = [(p, p.count("/"), [rng.gauss(0, 1) for _ in range(8)]) for p in {"/c", "/c/src", "/c/old", "/c/doc", *[r[1] for r in rows[:30]]}]
    summaries = spark.createDataFrame(dirs, "path string, depth long, embedding array<double>")
    weights = spark.createDataFrame([("dir", "/c/src", 1.5), ("file", rows[3][1], 0.5), ("category", "docs", 2.0)], "target_kind string, target string, weight double")
    known = spark.createDataFrame([(r[1], "docs", "auto") for r in rows if r[1].endswith("md")], "path string, category string, source string").distinct()
    made = inverted.build(chunks)
    t = retrieve.Tables(chunks, summaries, weights, known, spark.createDataFrame(dict(files).items(), "path string, modified_s long"))
    return replace(t, index=inverted.Index(stored(made.postings), stored(made.rows)))


def asked(spark):
    rng = random.Random(9)
    rows = [(n, t, [rng.gauss(0, 1) for _ in range(8)] if n != 4 else None) for n, t in QUESTIONS]
    return rows, spark.createDataFrame(rows, "question long, text string, vector array<double>")


def test_index_counts_as_one_pass_does(spark, tables):
    where = F.col("entry_path").startswith("/c/src/")
    got = inverted.sparse(tables.index, asked(spark)[1], where).collect()
    for n, text in QUESTIONS:
        want = {r.id: r.score for r in retrieve.match(tables.chunks, text, admitted=where).collect()}
        own = {r.id: r.score for r in got if r.question == n}
        assert own.keys() == want.keys() and all(math.isclose(own[i], want[i], abs_tol=1e-9) for i in own), text


def test_phrases_are_counted_within_fields(spark):
    chunks = spark.createDataFrame([(1, "/x", "b", "a b a b a"), (2, "/x", "a", "x b"), (3, "/x", "b c", "a"), (4, "/x", None, None)], "chunk_id long, entry_path string, heading string, text string")
    made = inverted.build(chunks, ("text", "heading"))
    met = inverted.asked(spark.createDataFrame([(1, "a b a"), (2, None)], "question long, text string"))
    assert {(r.slot, r.term, r.n) for r in met.where("phrase").collect()} == {(0, "a", 3), (1, "b", 3), (2, "a", 3)}
    places = {(r.term, r.id): list(r.places) for r in made.postings.collect()}
    assert places["a", 1] == [0, 2, 4] and places["b", 1] == [1, 3, 6] and places["b", 3] == [2]
    assert {r.id: r.length for r in made.rows.collect()} == {1: 6, 2: 3, 3: 3, 4: 0}


SETTINGS = retrieve.Settings(top_k=14, now=1_000_000, mmr=0.5, broad_cap=2)


@pytest.mark.parametrize(("settings", "compared"), [(SETTINGS, (1, 3)), (replace(SETTINGS, mode="dense"), (9,)), (replace(SETTINGS, mode="sparse", scope="/c/src"), (5,))], ids=["mmr", "dense", "sparse-scoped"])
def test_batch_equals_one_at_a_time(spark, tables, settings, compared):
    rows, questions = asked(spark)
    got = batch.retrieve(tables, questions, settings).collect()
    for n, text, vector in rows:
        if n in compared:
            want = [(r.place, r.chunk_id, round(r.rrf_score, 9)) for r in retrieve.retrieve(replace(tables, index=None), text, vector, settings).collect()]
            assert sorted((r.place, r.chunk_id, round(r.rrf_score, 9)) for r in got if r.question == n) == sorted(want), text


def test_whole_chain_equals_brute_force(spark, tables):
    """All stages in plain Python, for a question with diversity, summaries and the cap of broad ones."""
    s, (_, text, vector) = SETTINGS, asked(spark)[0][4]
    assert evaluation and "overview" in text
    chunks = {r.chunk_id: r for r in tables.chunks.collect()}
    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    fields = {i: [words(c.text), words(c.heading), words(c.entry_path), [str(i)]] for i, c in chunks.items()}
    terms, phrase = ["overview", "everything", "gamma"], ["overview", "of", "everything", "gamma"]
    count = lambda i, t: sum(f.count(t) for f in fields[i])
    tf = {i: [count(i, t) for t in terms] + [sum(f[k : k + 4] == phrase for f in fields[i] for k in range(len(f)))] for i in chunks}
    size = {i: sum(map(len, f)) for i, f in fields.items()}
    mean, n = sum(size.values()) / len(size), len(size)
    score = {}
    for i in chunks:
        if any(tf[i]) and chunks[i].text is not None and not chunks[i].text.startswith("File: "):
            score[i] = 0
            for k in range(4):
                df = sum(t[k] > 0 for t in tf.values())
                idf = math.log((n - df + 0.5) / (df + 0.5))
                score[i] += (idf if idf > 0 else 1e-6) * tf[i][k] * 2.2 / (tf[i][k] + 1.2 * (0.25 + 0.75 * size[i] / mean))
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) if a is not None else 0
    near = {i: cos(c.embedding, vector) for i, c in chunks.items() if c.embedding is not None and c.text is not None and not c.text.startswith("File: ")}
    fused = {}
    for arm in (score, near):
        for rank, i in enumerate(sorted(arm, key=lambda i: (-round(arm[i], 9), i))[:100]):
            fused[i] = fused.get(i, 0) + 1 / (rank + 61)
    pool = sorted(fused, key=lambda i: (-round(fused[i], 12), i))[: s.top_k]
    tree = tables.summaries.collect()
    deepest = max(r.depth for r in tree)
    best = dict(sorted(((r.path, cos(r.embedding, vector) * (1 + 0.15 * (deepest - r.depth))) for r in tree), key=lambda x: (-round(x[1], 9), x[0]))[:50])
    ages = {r.path: r.modified_s for r in tables.files.collect()}
    own = {(r.target_kind, r.target): r.weight for r in tables.weights.collect()}
    final = {}
    for i in pool:
        p = chunks[i].entry_path
        up = [best[x] for x in ["/".join(p.split("/")[:k]) for k in range(2, 5)] if x in best]
        value = fused[i] + 0.3 * max(up, default=0)
        value *= own.get(("file", p)) or own.get(("dir", p.rsplit("/", 1)[0])) or (2.0 if p.endswith("md") else 1.0)
        age = (1_000_000 - ages[p]) // 86400
        final[i] = value * (0.15 if "/old/" in p else 1) * (2 if age <= 7 else 1.5 if age <= 30 else 1.2 if age <= 90 else 1)
    order = sorted(pool, key=lambda i: (-final[i], i))
    low, high = min(final.values()), max(final.values())
    rel, left, turned = {i: (final[i] - low) / (high - low) for i in pool}, list(order), []
    while left:
        gain = {i: 0.5 * rel[i] - 0.5 * max((cos(chunks[i].embedding, chunks[j].embedding) for j in turned if chunks[i].embedding is not None and chunks[j].embedding is not None), default=0) for i in left}
        pick = max(left, key=lambda i: ((gain[i] if turned else rel[i]), order.index(i)))
        left.remove(pick)
        turned.append(pick)
    files = {}
    for i in turned:
        files.setdefault(chunks[i].entry_path, []).append(i)
    spread = [i for f in files.values() for i in f[:2]] + [i for f in files.values() for i in f[2:]]
    got = sorted((r.place, r.chunk_id, r.rrf_score) for r in retrieve.retrieve(tables, text, vector, s).collect())
    assert [i for _, i, _ in got] == spread and all(math.isclose(v, final[i], abs_tol=1e-9) for _, i, v in got)


def test_golden_questions(spark, tables):
    found = [(1, "/a/x.py", 0), (1, "/a/y.py", 1), (1, "/a/x.py", 2), (1, "/b/z.md", 3), (2, "/q", 0)]
    expected = [(1, "x.py"), (1, "/b/z.md"), (1, "a/none.py"), (2, "/other"), (3, "/r")]
    q = spark.createDataFrame([(1, 3), (2, 5), (3, 1), (4, 2)], "question long, k long")
    got = {r.question: r for r in evaluation.golden(spark.createDataFrame(found, "question long, item string, place long"), spark.createDataFrame(expected, "question long, expect string"), q).collect()}
    r = got[1]
    assert (r.retrieved, r.hit, r.first_rank, r.rr) == (3, True, 1, 1.0) and math.isclose(r.precision, 2 / 3) and math.isclose(r.recall, 1 / 3)
    assert math.isclose(r.ndcg, (1 + 1 / math.log2(4)) / (1 + 1 / math.log2(3)))
    assert all((got[n].hit, got[n].rr, got[n].recall, got[n].ndcg) == (False, 0, 0, 0) for n in (2, 3, 4)) and got[4].retrieved == 0


def test_reranked(spark, tables):
    questions = asked(spark)[1].where("question IN (1, 8)")
    hits = batch.retrieve(tables, questions, replace(SETTINGS, mmr=1.0))
    shorter = batch.reranked(hits, questions, lambda q, texts: [-len(t) for t in texts]).collect()
    for n in (1, 8):
        own = sorted((r.place, len(r.text), r.chunk_id) for r in shorter if r.question == n)
        assert [p for p, *_ in own] == list(range(len(own))) and [s for _, s, _ in own] == sorted(s for _, s, _ in own)


def test_postings_without_a_shuffle(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "/a", "b a b", "a"), (2, "/b", None, None), (3, "/c", "é e, E", "x"), (4, "/d", " ".join(f"w{i % 300}" for i in range(5000)), "")], "chunk_id long, entry_path string, text string, heading string")
    made = inverted.build(chunks, ("text", "heading"))
    assert "Exchange" not in made.postings._jdf.queryExecution().executedPlan().toString()
    rows = {(r.id, r.term): (r.tf, list(r.places)) for r in made.postings.collect()}
    assert {k: v for k, v in rows.items() if k[0] < 4} == {(1, "a"): (2, [1, 4]), (1, "b"): (2, [0, 2]), (3, "e"): (3, [0, 1, 2]), (3, "x"): (1, [4])}
    assert {k[1]: v for k, v in rows.items() if k[0] == 4} == {f"w{j}": (len(range(j, 5000, 300)), list(range(j, 5000, 300))) for j in range(300)}
    assert len(rows) == made.postings.count()
    # A few questions' words go to the postings; all postings aren't shuffled to meet them.
    index = made.write(str(tmp_path))
    found = inverted.sparse(index, spark.createDataFrame([(1, "b a"), (2, "w7 w8"), (3, "x"), (4, None)], "question long, text string"))
    assert {(r.question, r.id) for r in found.collect()} == {(1, 1), (2, 4), (3, 3)}
    plan = inverted.sparse(index, spark.createDataFrame([(1, "b a")], "question long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [term#" not in plan and "BroadcastHashJoin [term#" in plan


def test_postings_split_each_text_once(spark):
    rows = [(1, "Été, été x1"), (2, None), (3, ""), (4, " - "), (1, "x1"), (None, "a")]
    index, lengths = search.postings(spark.createDataFrame(rows, "id long, text string"))
    assert sorted(map(str, map(tuple, index.collect()))) == ["('a', None, 1)", "('ete', 1, 2)", "('x1', 1, 2)"]
    assert sorted((r["id"] or 0, r["length"]) for r in lengths.where("id IS NULL OR id > 2 OR id = 1").collect()) == [(0, 1), (1, 1), (1, 3), (3, 0), (4, 0)]
    assert index._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
