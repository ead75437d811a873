"""Many questions answered in one plan, and golden questions scored: what ``retrieve`` does for one, for each of them.

Questions are rows (question, text), with ``vector`` and ``k`` where they have any. Every stage is keyed by question; pools are
bounded by k, so what meets for one question is its arms' and its pool's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import paths
from tessella.operators import ann, evaluation, search
from tessella.operators import index as inverted
from tessella.operators.retrieve import Settings, Tables

#: Questions whose vectors a task holds at once; more are answered in several passes.
VECTORS = 4096


def _nearest(rows: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(question, id, score, rank) by cosine times the row's factor, every row compared with every question. rows: id, v, factor."""
    asked = questions.where("vector IS NOT NULL").select(F.col("question").cast("long").alias("question"), F.col("vector").cast("array<double>").alias("q"))
    kind = dict(rows.dtypes)["id"]
    schema = f"question long, id {kind}, score double"
    out = []
    passes = -(-asked.count() // VECTORS)
    for i in range(passes):
        some = asked.where(F.pmod(F.xxhash64("question"), F.lit(passes)) == i).collect()
        numbers, vectors = [r.question for r in some], [np.asarray(r.q, float) for r in some]

        def of(batches: Iterator[pa.RecordBatch], numbers=numbers, vectors=vectors) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, factor = b.column(0), b.column(2).to_numpy(zero_copy_only=False)
                v = [np.asarray(x, float) for x in b.column(1).to_numpy(zero_copy_only=False)]
                sizes = np.array([len(x) for x in v])
                order = np.array(ids.to_pylist(), dtype=object)
                for d in {len(q) for q in vectors}:
                    own = np.flatnonzero(sizes == d)
                    x = np.stack([v[j] for j in own]) if len(own) else np.zeros((0, d))
                    lengths = np.linalg.norm(x, axis=1)
                    for number, q in ((n, q) for n, q in zip(numbers, vectors, strict=True) if len(q) == d):
                        score = np.zeros(len(v))
                        whole = lengths * np.linalg.norm(q)
                        score[own] = np.where(whole > 0, x @ q / np.where(whole > 0, whole, 1), 0)
                        score *= factor
                        near = np.lexsort((order, -np.round(score, 9)))[:k]
                        yield pa.RecordBatch.from_arrays([pa.array([number] * len(near), pa.int64()), ids.take(pa.array(near)), pa.array(score[near])], names=["question", "id", "score"])

        out.append(rows.where("v IS NOT NULL AND id IS NOT NULL").select("id", F.col("v").cast("array<double>").alias("v"), F.col("factor").cast("double").alias("factor")).mapInArrow(of, schema))
    none = rows.sparkSession.createDataFrame([], schema)
    return inverted._first(reduce(DataFrame.unionByName, out, none), k, 9)


def pools(tables: Tables, questions: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(question, chunk_id, rrf_score): each question's fused first k (its own, or the settings')."""
    has_vectors = "vector" in questions.columns
    where = ~F.col("stub") & (paths.under("entry_path", settings.scope) if settings.scope else F.lit(True))
    index = tables.index or inverted.build(tables.chunks, tables.fields)
    arms = []
    if settings.mode != "dense":
        arms.append(inverted.sparse(index, questions, where))
    if settings.mode != "sparse" and has_vectors:
        allowed = index.rows.where(where).select("id")
        if tables.graph is not None and not settings.scope:
            near = ann.nearest(tables.graph, questions.select(F.col("question").alias("query"), F.col("vector").alias("q")), search.ARM)
            found = inverted._first(near.withColumnRenamed("query", "question").drop("rank").join(allowed, "id", "left_semi"), search.ARM, 9)
        else:
            rows = tables.chunks.select(F.col("chunk_id").alias("id"), F.col("embedding").alias("v"), F.lit(1.0).alias("factor"))
            found = _nearest(rows.join(allowed, "id", "left_semi"), questions, search.ARM)
        arms.append(found)
    empty = questions.sparkSession.createDataFrame([], "question long, id long, rank long")
    ranks = reduce(DataFrame.unionByName, [a.select("question", "id", "rank") for a in arms], empty)
    fused = ranks.groupBy("question", "id").agg(F.sum(1.0 / (F.col("rank") + settings.rrf_k + 1)).alias("score"))
    own = F.greatest(F.coalesce(F.col("k"), F.lit(settings.top_k)), F.lit(1)) if "k" in questions.columns else F.lit(settings.top_k)
    sizes = questions.select(F.col("question").cast("long").alias("question"), own.alias("most"))
    return inverted._first(fused.join(sizes, "question"), F.col("most"), 12).select("question", F.col("id").alias("chunk_id"), F.col("score").alias("rrf_score"))


def _placed(hits: DataFrame) -> DataFrame:
    order = Window.partitionBy("question").orderBy(F.desc(F.round("rrf_score", 12)), "chunk_id")
    return hits.withColumn("place", (F.row_number().over(order) - 1).cast("long"))


def _boosted(hits: DataFrame, tables: Tables, questions: DataFrame, settings: Settings) -> DataFrame:
    """Scores by summaries above, weights, history, code and age, in this order."""
    if "vector" in questions.columns and tables.summaries is not None:
        deepest = tables.summaries.agg(F.max("depth").alias("deepest"))
        rows = tables.summaries.where("embedding IS NOT NULL").join(F.broadcast(deepest))
        rows = rows.select(F.col("path").alias("id"), F.col("embedding").alias("v"), (1 + settings.depth_alpha * (F.col("deepest") - F.col("depth"))).alias("factor"))
        found = _nearest(rows, questions, 50).select("question", F.col("id").alias("path"), F.col("score").alias("own"))
        up = hits.select("question", "chunk_id", F.explode(paths.ancestors("entry_path", self_too=True)).alias("path")).join(found, ["question", "path"])
        best = up.groupBy("question", "chunk_id").agg(F.max("own").alias("add"))
        hits = hits.join(best, ["question", "chunk_id"], "left").withColumn("rrf_score", F.col("rrf_score") + settings.summary_weight * F.coalesce("add", F.lit(0.0))).drop("add")
    if tables.weights is not None:
        none = hits.sparkSession.createDataFrame([], "path string, category string, source string")
        known = tables.classifications if tables.classifications is not None else none
        weights = search.weights_for(hits.select(F.col("entry_path").alias("path")).distinct(), tables.weights, known)
        hits = hits.join(weights.withColumnRenamed("path", "entry_path"), "entry_path", "left").withColumn("rrf_score", F.col("rrf_score") * F.coalesce("weight", F.lit(1.0))).drop("weight")
    factor = search.archive_factor(F.col("entry_path"), settings.scope or "", settings.archive_penalty)
    factor = factor * F.when(F.col("code"), search.code_factor(F.col("entry_path"))).otherwise(1.0)
    hits = hits.withColumn("rrf_score", F.col("rrf_score") * factor)
    if settings.now is not None and tables.files is not None:
        ages = tables.files.select(F.col("path").alias("entry_path"), "modified_s")
        hits = hits.join(ages, "entry_path", "left").withColumn("rrf_score", F.col("rrf_score") * search.recency_factor(F.col("modified_s"), settings.now, settings.recency_days)).drop("modified_s")
    return hits


def _spread(hits: DataFrame, settings: Settings) -> DataFrame:
    """Broad questions' pools with no more than a cap of a file's chunks before all others; a pool that the cap holds keeps its order."""
    cap = F.lit(settings.broad_cap) + F.when(F.col("code"), 2).otherwise(0)
    of_file, pool = Window.partitionBy("question", "entry_path"), Window.partitionBy("question")
    rows = hits.withColumns({"n": F.row_number().over(of_file.orderBy("place")), "first": F.min("place").over(of_file), "size": F.count("*").over(pool)})
    spread = F.row_number().over(pool.orderBy(F.col("n") > cap, "first", "n")) - 1
    return rows.withColumn("place", F.when(F.col("broad") & (F.col("size") > cap), spread).otherwise(F.col("place")).cast("long")).drop("n", "first", "size")


def retrieve(tables: Tables, questions: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(question, chunk_id, entry_path, heading, text, rrf_score, place): each question's pool in its final order, as
    ``retrieve.retrieve`` gives it for one. A question that finds nothing has no rows. Numbers of questions are to be distinct."""
    kinds = inverted.asked(questions).groupBy("question").agg(F.max("code").alias("code"), F.max("broad").alias("broad"))
    found = pools(tables, questions, settings)
    hits = tables.chunks.select("chunk_id", "entry_path", "heading", "text", "embedding").join(found, "chunk_id")
    hits = hits.join(kinds, "question", "left").withColumns({"code": F.coalesce("code", F.lit(False)), "broad": F.coalesce("broad", F.lit(False))})
    hits = _placed(_boosted(hits, tables, questions, settings))
    if settings.mode != "sparse" and settings.mmr < 1:
        turned = []
        for code in (True, False):
            lam = min(max(max(settings.mmr, 0.8) if code else settings.mmr, 0.0), 1.0)
            own = hits.where(F.col("code") == code).select("question", "chunk_id", F.col("rrf_score").alias("score"), "embedding")
            turned.append(search.mmr(own, lam, "question"))
        hits = hits.drop("place").join(turned[0].unionByName(turned[1]), ["question", "chunk_id"])
    if settings.broad_cap > 0 and settings.scope is None:
        hits = _spread(hits, settings)
    return hits.select("question", "chunk_id", "entry_path", "heading", "text", "rrf_score", "place")


def reranked(hits: DataFrame, questions: DataFrame, scorer: Callable[[str, list[str]], list[float]]) -> DataFrame:
    """hits in the order of a scorer of (question, texts), a pool at a time; equal scores keep their order."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        scores = np.asarray(scorer(pdf["asked"].iloc[0], pdf["text"].tolist()), float)
        order = np.argsort(-scores, kind="stable")
        return pd.DataFrame({"question": pdf["question"].iloc[order].to_numpy(), "chunk_id": pdf["chunk_id"].iloc[order].to_numpy(), "place": range(len(order))})

    texts = questions.select(F.col("question").cast("long").alias("question"), F.col("text").alias("asked"))
    places = hits.join(texts, "question").select("question", "asked", "chunk_id", "text", "place").groupBy("question").applyInPandas(of, "question long, chunk_id long, place long")
    return hits.drop("place").join(places, ["question", "chunk_id"])


def evaluate(tables: Tables, questions: DataFrame, expected: DataFrame, settings: Settings = Settings(), scorer: Callable[[str, list[str]], list[float]] | None = None) -> DataFrame:
    """Scores of golden questions (``evaluation.golden``) by what retrieval finds for them, reranked where a scorer is given. expected: (question, expect)."""
    hits = retrieve(tables, questions, settings)
    if scorer:
        hits = reranked(hits, questions, scorer)
    own = F.greatest(F.coalesce(F.col("k"), F.lit(settings.top_k)), F.lit(1)) if "k" in questions.columns else F.lit(settings.top_k)
    return evaluation.golden(hits.select("question", F.col("entry_path").alias("item"), "place"), expected, questions.select(F.col("question").cast("long").alias("question"), own.cast("long").alias("k")))
