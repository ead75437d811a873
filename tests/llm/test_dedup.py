"""Substring dedup, the n-gram join and components against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import ngram_join, secrets, substring_dedup, toxicity
from tessella.llm.common import written
from tessella.llm.components import components


def brute_substrings(rows, window):
    words = [(d, (t or "").split()) for d, t in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - window + 1) if d is not None else ():
            g = tuple(w[i : i + window])
            least[g] = min(least.get(g, d), d)
    out = []
    for d, w in words:
        gone = {k for i in range(len(w) - window + 1) if d is not None and least[tuple(w[i : i + window])] < d for k in range(i, i + window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def substring_rows():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(50)]
    passages = [rng.choices(vocabulary, k=n) for n in (49, 50, 51, 70, 120)]
    rows = []
    for i in range(60):
        w = rng.choices(vocabulary, k=rng.randint(0, 90))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        rows.append((i, "  ".join(w)))
    return [*rows, (60, None), (61, ""), (62, "same " * 200), (63, "same " * 49), (64, "same " * 51), rows[5], (None, rows[5][1]), (70, rows[5][1]), (62, "other " * 3 + rows[6][1])]


def test_substrings_equal_brute_force(spark):
    rows = substring_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, at string, th int").repartition(5)
    got = substring_dedup.dedup_substrings(df, digest=True).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_substrings(rows, 50)


def test_substrings_carry_columns(spark):
    got = substring_dedup.dedup_substrings(spark.createDataFrame([(1, "a\nb", 7), (2, None, 8)], "doc_id long, text string, n int"), carry=True).collect()
    assert {(r.doc_id, r.kept and bytes(r.kept), r.row.n) for r in got} == {(1, b"a\nb", 7), (2, None, 8)}
    assert substring_dedup.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cover_has_every_distance():
    differences = {(a - b) % substring_dedup.COVER_PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER}
    assert differences == set(range(substring_dedup.COVER_PERIOD))


def near_rows():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for size in (6, 12, 40, 80, 120):
        base = rng.choices(vocabulary, k=size)
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randint(0, max(1, size // 30))):
                w[rng.randrange(size)] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    return [*texts, "", "a", "a", "a b", "A b", "a b c d", "a b c", None]


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def shingles_of(t, length):
    w = (t or "").lower().split()
    return {tuple(w[i : i + length]) for i in range(len(w) - length + 1)} if len(w) >= length else ({tuple(w)} if w else set())


def brute_kept(texts, length, percent):
    """Of each component of near copies the first; texts by id, in order."""
    sets, label = {d: shingles_of(t, length) for d, t in texts.items()}, {d: d for d in texts}
    for d, s in sets.items():
        for e, t in sets.items():
            if e < d and s and t and label[d] != label[e] and 100 * (both := len(s & t)) >= percent * (len(s) + len(t) - both):
                low, high = sorted((label[d], label[e]))
                label = {k: low if v == high else v for k, v in label.items()}
    return {d for d, v in label.items() if d == v}


def test_pipeline_drops_near_copies_of_five_words(spark, sf):
    texts = dict(enumerate(near_rows()))
    docs = spark.createDataFrame([(d, t, "x") for d, t in texts.items()], "doc_id long, text string, component_id string").repartition(4)
    kept = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()]
    want = brute_kept(texts, 5, 80)
    assert sorted(kept) == sorted(want) and len(want) < len(brute_kept(texts, 4, 85))


@pytest.mark.parametrize("tile", [7, 2048])
def test_ngram_join_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    texts = near_rows()
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if s and sets[j] and 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    rows = [*enumerate(texts), (None, "a b c d"), (7, texts[7])]
    got = ngram_join.link(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, component_id int").repartition(6)).collect()
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root(r.doc_id)) for r in got if r.doc_id is not None)
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(1, None)]


@pytest.mark.parametrize(("length", "percent"), [(4, 85), (5, 80)])
def test_ngram_pairs_equal_brute_force(spark, length, percent):
    texts = near_rows()
    first = {}
    for i, t in enumerate(texts):
        if s := frozenset(shingles_of(t, length)):
            first.setdefault(s, i)
    want = {(max(i, j), min(i, j)) for s, i in first.items() for t, j in first.items() if i > j and 100 * (both := len(s & t)) >= percent * (len(s) + len(t) - both)}
    rows = [*enumerate(texts), (None, texts[0]), (7, texts[7])]
    got = [(r.u, r.v) for r in ngram_join.pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), percent, length).collect()]
    assert len(want) > 50 and sorted(got) == sorted(want)
    assert ngram_join.pairs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ngram_join_empty(spark):
    assert ngram_join.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, None)]
    got = dict(components(spark.createDataFrame(chain, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_pipeline_stages_equal_brute_force(spark, sf):
    """Ids and texts that each stage keeps, on the smallest table and two rows with secrets, of which it has none. Near copies
    and passages are held against brute force, toxicity and spans against their operators' own output."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    planted = {1_000_000: "one token=abcdefgh1 two AKIAABCDEFGHIJKL1 three", 1_000_001: "set PRIVATE_KEY=9aQx0LkT7vYc2WmZ5nRbE8uHsJ3dFg6p end"}
    docs = docs.unionByName(spark.createDataFrame([(d, t, "en", "x", len(t)) for d, t in planted.items()], "doc_id long, text string, lang string, source string, n_chars long").select(*[F.col(c).cast(k) for c, k in docs.dtypes]))
    stages = dict(corpus_pipeline.STAGES)

    def step(name, given):
        out = written(stages[name](spark, given, sf), name)
        return out, {r.doc_id: r.text for r in out.collect()}

    before = {r.doc_id: r.text for r in docs.collect()}
    scored = toxicity.score(docs, toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))).select("doc_id", "predicted").collect()
    now, texts = step("toxicity", docs)
    assert texts == {r.doc_id: before[r.doc_id] for r in scored if not r.predicted}

    now, kept = step("ngram_join", now)
    near = brute_kept(dict(sorted(texts.items())), corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)
    assert kept == {d: texts[d] for d in near} and len(kept) < len(texts)

    now, passages = step("substring_dedup", now)
    brute = {d: (n, gone, digest) for d, n, gone, digest in brute_substrings(list(kept.items()), 50)}
    assert passages.keys() == {d for d, (n, gone, _) in brute.items() if not gone or gone < n}
    for d, text in passages.items():
        assert text == kept[d] if not brute[d][1] else hashlib.sha256(" ".join(text.split()).encode()).hexdigest() == brute[d][2]

    spans = {r.doc_id: [(x.start, x.end, x.kind) for x in r.spans] for r in secrets.scan(now).collect()}
    now, clean = step("secret_scan", now)
    for d, text in passages.items():
        want, at = "", -1
        for start, end, kind in spans[d]:
            if start > at:
                want += text[max(at, 0) : start] + f"[REDACTED-{kind}]"
            at = max(at, end)
        assert clean[d] == want + text[max(at, 0) :]
    assert clean.keys() == passages.keys()
    assert [clean[d] for d in planted] == ["one [REDACTED-assign] two [REDACTED-access] three", "set PRIVATE_KEY=[REDACTED-random] end"]
