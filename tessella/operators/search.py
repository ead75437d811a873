"""Ranked retrieval: BM25 and cosine arms, their fusion, boosts, diversity, packing and confidence."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import paths
from tessella.functions.text import is_stub, search_tokens
from tessella.functions.vectors import cosine

RRF_K, ARM, TOP_K = 60, 100, 12
K1, B = 1.2, 0.75

#: Words that a query loses, unless it has no others.
STOPWORDS = frozenset(
    "a an and are as at be by can could do does for from how i in into is it its me my not of on or our should that the this to was we what when where which who why will with would you your".split()
)
#: Extensions of code, and the parts of a question that ask for it.
CODE = ("rs", "py", "js", "mjs", "cjs", "ts", "tsx", "jsx", "go", "java", "c", "h", "cpp", "cc", "rb", "php", "swift", "kt", "scala", "cs", "sh", "lua")


def query_terms(question: str) -> tuple[list[str], list[str]]:
    """(all tokens, the terms): tokens of letters and digits, terms without short and common ones. Without any
    terms left the whole phrase stands alone."""
    tokens = [t for t in re.split(r"[\W_]+", question.lower()) if t]
    return tokens, list(dict.fromkeys(t for t in tokens if len(t) > 1 and t not in STOPWORDS))


def postings(chunks: DataFrame, id_column: str = "id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(term, id, tf) and (id, length). Written once, they serve any number of queries."""
    tokens = chunks.select(F.col(id_column).alias("id"), search_tokens(F.col(text)).alias("w"))
    # Spark filters what ``explode`` takes by its size beforehand, and so would split each text three times; the outer one goes without.
    return tokens.select("id", F.explode_outer("w").alias("term")).where("term IS NOT NULL").groupBy("term", "id").agg(F.count("*").alias("tf")), tokens.select("id", F.size("w").cast("long").alias("length"))


def bm25(index: DataFrame, lengths: DataFrame, terms: list[str], limit: int = ARM) -> DataFrame:
    """(id, score) of the best rows for any of the terms; ties to the smaller id. A term in more than half of all rows
    counts next to nothing. What meets in one place is the query's terms and two totals."""
    n = lengths.agg(F.count("*").alias("n_all"), F.avg("length").alias("mean"))
    hits = index.where(F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    rows = hits.join(F.broadcast(df), "term").join(lengths, "id").join(F.broadcast(n))
    idf = F.log((F.col("n_all") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(1e-6)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return rows.groupBy("id").agg(F.sum(part).alias("score")).orderBy(F.desc(F.round("score", 9)), "id").limit(limit)


def phrase_hits(chunks: DataFrame, tokens: list[str], id_column: str = "id", text: str = "text") -> DataFrame:
    """(id, tf): how often the tokens stand one after the other."""
    w = search_tokens(F.col(text))
    spelled = " " + " ".join(tokens) + " "
    joined = F.concat(F.lit(" "), F.array_join(w, "  "), F.lit(" "))
    found = F.regexp_count(joined, F.lit("(?= " + "  ".join(map(re.escape, tokens)) + " )"))
    return chunks.select(F.col(id_column).alias("id"), found.cast("long").alias("tf")).where(F.col("tf") > 0) if spelled.strip() else chunks.select(F.col(id_column).alias("id"), F.lit(0).cast("long").alias("tf")).where("false")


def cosine_top(vectors: DataFrame, query: list[float], k: int, id_column: str = "id", column: str = "embedding") -> DataFrame:
    """(id, score) of the k nearest; ties to the smaller id, other dimensions and zero vectors score 0."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.where(F.col(column).isNotNull()).select(F.col(id_column).alias("id"), cosine(F.col(column), q).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 9)), "id").limit(k)


def ranked(arm: DataFrame) -> DataFrame:
    """With rank from 0. An arm has ARM rows at most, so one task may order it."""
    return arm.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "id")) - 1).cast("long"))


def rrf(arms: list[DataFrame], k: int = RRF_K, limit: int = ARM) -> DataFrame:
    """(id, score) by reciprocal ranks over ranked arms."""
    rows = arms[0].select("id", "rank")
    for a in arms[1:]:
        rows = rows.unionByName(a.select("id", "rank"))
    return rows.groupBy("id").agg(F.sum(1.0 / (F.col("rank") + k + 1)).alias("score")).orderBy(F.desc(F.round("score", 12)), "id").limit(limit)


def without_stubs(hits: DataFrame) -> DataFrame:
    return hits.where(~is_stub("text"))


def summary_search(summaries: DataFrame, query: list[float], limit: int = 50, alpha: float = 0.15) -> DataFrame:
    """(path, score): cosine of summaries, the more the higher they stand in the tree."""
    deepest = summaries.agg(F.max("depth").alias("deepest"))
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = summaries.where("embedding IS NOT NULL").join(F.broadcast(deepest))
    score = cosine(F.col("embedding"), q) * (1 + alpha * (F.col("deepest") - F.col("depth")))
    return rows.select("path", score.alias("score")).orderBy(F.desc(F.round("score", 9)), "path").limit(limit)


def boost_with_summaries(hits: DataFrame, found: DataFrame, weight: float) -> DataFrame:
    """Adds weight times the best score of a summary above a hit's file, or of the file's own."""
    up = hits.select("chunk_id", F.explode(paths.ancestors("entry_path", self_too=True)).alias("path")).join(F.broadcast(found), "path")
    best = up.groupBy("chunk_id").agg(F.max("score").alias("add"))
    return hits.join(best, "chunk_id", "left").withColumn("rrf_score", F.col("rrf_score") + weight * F.coalesce("add", F.lit(0.0))).drop("add")


def weights_for(files: DataFrame, weights: DataFrame, classifications: DataFrame) -> DataFrame:
    """(path, weight): of the file, or of its nearest directory that has one, or of its category, or 1."""
    dirs = weights.where("target_kind = 'dir'").select(F.col("target").alias("dir"), F.col("weight").alias("w"))
    up = files.select("path", F.posexplode(paths.ancestors("path")).alias("place", "dir")).join(dirs, "dir")
    nearest = up.groupBy("path").agg(F.max_by("w", "place").alias("dir_weight"))
    own = weights.where("target_kind = 'file'").select(F.col("target").alias("path"), F.col("weight").alias("file_weight"))
    cats = weights.where("target_kind = 'category'").select(F.col("target").alias("category"), F.col("weight").alias("category_weight"))
    by_cat = classifications.where("source <> 'ignored'").select("path", "category").join(cats, "category").select("path", "category_weight")
    rows = files.select("path").distinct().join(own, "path", "left").join(nearest, "path", "left").join(by_cat, "path", "left")
    return rows.select("path", F.coalesce("file_weight", "dir_weight", "category_weight", F.lit(1.0)).alias("weight"))


def recency_factor(modified: Column, now: int, window: int = 90) -> Column:
    age = F.floor((F.lit(now) - modified) / 86400)
    return F.when(modified.isNull() | (age > window), 1.0).when(age <= 7, 2.0).when(age <= 30, 1.5).when(age <= 90, 1.2).otherwise(1.0)


def archive_factor(path: Column, scope: str = "", penalty: float = 0.15) -> Column:
    """Less for historical paths, unless the scope itself is one."""
    if penalty in (0, 1) or any(p.lower() in ("archive", "archived", "historical", "deprecated", "old") for p in scope.split("/")):
        return F.lit(1.0)
    return F.when(paths.historical(path), penalty).otherwise(1.0)


def code_factor(path: Column, factor: float = 1.6) -> Column:
    return F.when(paths.extension(path).isin(*CODE), factor).otherwise(1.0)


def cap_per_file(hits: DataFrame, cap: int, rank: str = "rank") -> DataFrame:
    """A new order (``place`` from 0): up to ``cap`` hits of each file, files by their first hit, then all others likewise."""
    of_file = Window.partitionBy("entry_path").orderBy(rank)
    rows = hits.withColumns({"__n": F.row_number().over(of_file), "__first": F.min(rank).over(Window.partitionBy("entry_path"))})
    return numbered(rows.withColumn("__tail", F.col("__n") > cap), ["__tail", "__first", "__n"], "__first").drop("__n", "__first", "__tail")


def numbered(rows: DataFrame, order: list[str], by: str, parts: int = 256) -> DataFrame:
    """rows with ``place`` from 0 in the order of columns, of which the first is a flag and ``by``, a number, the second. Each flag is split
    at quantiles of ``by``; only the sizes of those ranges meet in one task."""
    flag = order[0]
    cuts = rows.agg(F.percentile_approx(by, [i / parts for i in range(1, parts)]).alias("c")).select(F.array_distinct(F.coalesce("c", F.array().cast(f"array<{dict(rows.dtypes)[by]}>"))).alias("__cuts"))
    cut = rows.join(F.broadcast(cuts)).withColumn("__part", F.size(F.filter("__cuts", lambda c: c <= F.col(by)))).drop("__cuts")
    sizes = cut.groupBy(flag, "__part").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy(flag, "__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(flag, "__part", before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy(flag, "__part").orderBy(*order)) - 1
    return cut.withColumn("__inside", inside).join(F.broadcast(starts), [flag, "__part"]).withColumn("place", (F.col("__before") + F.col("__inside")).cast("long")).drop("__part", "__inside", "__before")


def mmr_order(scores: np.ndarray, vectors: list[np.ndarray | None], lam: float) -> list[int]:
    """Greedy marginal relevance over at most a few hundred hits. Of equal gains the last hit goes first; a hit without a vector has no
    penalty and gives none."""
    span = scores.max() - scores.min() if len(scores) else 0
    rel = (scores - scores.min()) / span if span > 1e-7 else np.ones(len(scores))
    unit = [v / np.linalg.norm(v) if v is not None and np.linalg.norm(v) > 0 else None for v in vectors]
    near, left, out = np.zeros(len(scores)), list(range(len(scores))), []
    seen = False
    while left:
        gain = rel if not seen else lam * rel - (1 - lam) * near
        best = max(left, key=lambda i: (gain[i], i))
        left.remove(best)
        out.append(best)
        if unit[best] is not None:
            for i in left:
                if unit[i] is not None:
                    c = float(unit[i] @ unit[best])
                    near[i] = max(near[i], c) if seen else c
            seen = True
        elif not seen and len(out) == 1:
            seen = True
    return out


def mmr(hits: DataFrame, lam: float = 0.5, query: str = "query") -> DataFrame:
    """hits (query, chunk_id, score, embedding) of bounded pools with ``place`` in the diverse order."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "chunk_id"], ascending=[False, True]).reset_index(drop=True)
        order = mmr_order(pdf["score"].to_numpy(float), [None if v is None else np.asarray(v, float) for v in pdf["embedding"]], lam)
        return pd.DataFrame({query: pdf[query].iloc[order].to_numpy(), "chunk_id": pdf["chunk_id"].iloc[order].to_numpy(), "place": range(len(order))})

    kind = dict(hits.dtypes)[query]
    return hits.select(query, "chunk_id", "score", "embedding").groupBy(query).applyInPandas(of, f"{query} {kind}, chunk_id long, place long")


def clusters(vectors: list[np.ndarray | None], least: float = 0.55, most: int = 4) -> list[int]:
    """A cluster for each hit in order of rank: that of the nearest first member if near enough, a new one while
    there may be more, else the nearest all the same. Hits without a vector come last, together."""
    seeds: list[np.ndarray] = []
    out: list[int] = []
    for v in vectors:
        if v is None:
            out.append(-1)
            continue
        sims = [float(v @ s / (np.linalg.norm(v) * np.linalg.norm(s) or 1)) for s in seeds]
        best = max(range(len(sims)), key=lambda i: (sims[i], -i), default=-1)
        if best >= 0 and (sims[best] >= least or len(seeds) >= most):
            out.append(best)
        else:
            out.append(len(seeds))
            seeds.append(v)
    return [len(seeds) if c < 0 else c for c in out]


def confidence(hits: DataFrame, top_k: int = TOP_K, k: int = RRF_K, embeddings: bool = True, query: str = "query") -> DataFrame:
    """(query, confidence): high, medium or low from the shape of each pool's scores."""
    s = F.sort_array(F.collect_list("score"), asc=False)
    rows = hits.groupBy(query).agg(s.alias("s"))
    top, n = F.col("s")[0], F.size("s")
    middle = F.element_at("s", F.floor(n / 2).cast("int") + 1)
    strong = F.size(F.filter("s", lambda x: x >= 1.0 / (k + 10)))
    sure = top >= (1.5 if embeddings else 1.0) / (k + 1)
    gap = F.when(middle > 0, top / middle).otherwise(F.lit(float("inf")))
    label = F.when(strong == 0, "low").when(n == 1, F.when(top >= 1.0 / (k + 1), "medium").otherwise("low"))
    return rows.select(query, label.when(sure & (strong >= 3) & (2 * n >= top_k) & (gap <= 3), "high").otherwise("medium").alias("confidence"))


def packed(hits: DataFrame, budget: int = 8000, query: str = "query") -> DataFrame:
    """(query, n, chunk_id, bytes, cut): the hits that a context of so many bytes holds, by rank; the first that doesn't fit is
    cut where more than its head and 40 bytes are left, and is the last."""
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("entry_path"), F.lit(" — "), F.coalesce("heading", F.lit("")), F.lit("\n"))
    size = F.octet_length(F.concat(head, F.col("text"), F.lit("\n\n"))).cast("long")
    w = Window.partitionBy(query).orderBy("rank")
    rows = hits.withColumns({"head": F.octet_length(head).cast("long"), "bytes": size})
    rows = rows.withColumn("before", F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    left = F.lit(budget) - F.col("before")
    fits = F.col("bytes") <= left
    rows = rows.where((left > 0) & (fits | (left > F.col("head") + 40)))
    return rows.select(query, F.col("rank").alias("n"), "chunk_id", F.least("bytes", left).alias("bytes"), (~fits).alias("cut"))


def uncovered_terms(question: str, hits: DataFrame, most: int = 5) -> list[str]:
    """Words of the question, of four bytes or more, that no hit's path, heading or text holds. hits: a bounded pool."""
    wanted = [t for t in query_terms(question)[1] if len(t.encode()) >= 4]
    all_ = F.lower(F.concat_ws(" ", "entry_path", "heading", "text"))
    if not wanted:
        return []
    row = hits.agg(*[F.max(F.contains(all_, F.lit(t))).alias(f"t{i}") for i, t in enumerate(wanted)]).first()
    return [t for t, found in zip(wanted, row, strict=True) if not found][:most]


def window_of(chunks: DataFrame, path: str, seq: int | None = None, radius: int = 2) -> DataFrame:
    """The chunks of a file around one, or its first ones."""
    r = min(max(radius, 0), 25)
    low, high = (seq - r, seq + r) if seq is not None else (0, 2 * r)
    return chunks.where((F.col("entry_path") == path) & F.col("seq").between(low, high)).orderBy("seq")


def ndcg_discount(place: int) -> float:
    return 1 / math.log2(place + 2)
