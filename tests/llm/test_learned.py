"""Toxicity by held-out accuracy, neighbours by recall, and the pipeline's stages."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import nearest, toxicity


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_interactions_are_learned(spark):
    rng = random.Random(5)
    neutral = [f"n{i}" for i in range(40)]
    docs, labels = [], []
    for i in range(2400):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w = rng.choices(neutral, k=20) + ["insult"] * insult + ["group"] * group
        rng.shuffle(w)
        docs.append((i, " ".join(w), "en"))
        labels.append((i, int(insult and group)))
    docs += [(9000, None, "en"), (9001, "", "en"), (None, "insult group", "en"), (3, docs[3][1], "en")]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    machine = toxicity.learn(d, spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int"))
    rows = toxicity.score(d.withColumn("held", toxicity.held_out()), machine).collect()
    truth = dict(labels)
    judged = [r for r in rows if r.doc_id in truth and held_out(r.doc_id)]
    assert all(r.held == held_out(r.doc_id) for r in rows if r.doc_id is not None)
    assert len(judged) > 300 and sum(r.predicted == truth[r.doc_id] for r in judged) / len(judged) > 0.95
    assert {r.predicted for r in rows if r.doc_id in (9000, 9001)} == {0} and all(0 <= r.score <= 1 for r in rows)


def test_no_labels(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    machine = toxicity.learn(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(d, machine).first()["predicted"] == 0
    assert toxicity.score(d.limit(0), machine).count() == 0


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(30, 32))
    v = centers[rng.integers(0, 30, 2000)] + 0.7 * rng.normal(size=(2000, 32))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.nearest(df, k=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 2000, 20))
    hit = 0
    for q, rows in got.items():
        s = v @ v[q]
        s[q] = -np.inf
        rows.sort()
        assert [x[0] for x in rows] == list(range(1, 11)) and [x[2] for x in rows] == sorted((x[2] for x in rows), reverse=True)
        assert all(abs(x[2] - s[x[1]]) < 1e-9 for x in rows)
        hit += len({x[1] for x in rows} & set(np.argsort(-s)[:10].tolist()))
    assert hit / (10 * len(got)) >= 0.9


def test_few_vectors_ties_and_nulls(spark):
    nan = float("nan")
    rows = [(i, [float(i % 7), 1.0, -float(i)], 1) for i in range(12)] + [(None, [1.0, 2.0, 3.0], 1), (20, None, 1), (40, [0.0, 0.0, 0.0], 1), (60, [1.0, 2.0, nan], 1), (80, [1.0, None, 2.0], 1), (3, [3.0, 1.0, -3.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = nearest.nearest(df, every=4).collect()
    assert {r.query_id for r in got} == {0, 4, 8} and len(got) == 33
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], "vec_id long, embedding array<float>")
    top = sorted((r.query_id, r.rank, r.vec_id) for r in nearest.nearest(same, k=5, every=25).collect())
    assert [x[2] for x in top] == [1, 2, 3, 4, 5, 0, 1, 2, 3, 4]
    assert nearest.nearest(df.limit(0)).count() == 0 and nearest.nearest(same.limit(1)).count() == 0


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"spans": F.lit("mine"), "score": F.lit(1), "row": F.lit(2)})
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns, name
        path = f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/stage-{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name in ("toxicity", "ngram_join"):
            assert all(after[d] == before[d] for d in after)
        assert all(r.n_chars == len(r.text) for r in after.values())
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(before)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert docs.where("text RLIKE '[0-9a-f]{32}'").count() == 0


@pytest.mark.parametrize(("factors", "right"), [(8, True), (0, False)])
def test_pairs_tell_what_their_halves_do_not(spark, monkeypatch, factors, right):
    """Toxic is one of two words without the other: a model of weights alone can't learn it."""
    monkeypatch.setattr(toxicity, "FACTORS", factors)
    rng, rows = random.Random(1), []
    for i in range(3000):
        words, one, other = [f"w{rng.randrange(300)}" for _ in range(12)], rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join(words + ["alpha"] * one + ["beta"] * other), int(one != other)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    machine = toxicity.learn(docs, spark.createDataFrame([(d, t) for d, _, t in rows], "doc_id long, toxic int"))
    scored = toxicity.score(docs.withColumn("held_out", toxicity.held_out()), machine, 0.5).where("held_out").collect()
    share = sum(r.predicted == rows[r.doc_id][2] for r in scored) / len(scored)
    assert share > 0.95 if right else share < 0.65


def test_toxicity_of_a_very_long_text(spark):
    machine = toxicity.learn(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.score(spark.createDataFrame([(1, "word other " * 300_000), (2, None)], "doc_id long, text string"), machine).collect()
    assert [r.doc_id for r in got] == [1, 2] and got[0].score == got[1].score
