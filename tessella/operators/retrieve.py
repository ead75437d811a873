"""A question answered by one ranking: both arms, their fusion, all boosts, diversity and the cap per file, with a trace."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import paths, predicates
from tessella.functions.text import is_stub, search_tokens
from tessella.operators import ann, search
from tessella.operators import index as inverted
from tessella.sources.shared import stored

FIELDS = inverted.FIELDS


@dataclass(frozen=True)
class Settings:
    """mode: rrf, sparse or dense. mmr from 1 on keeps the order of scores; a cap of 0 is none; now: seconds, without
    which what is recent counts for nothing."""

    mode: str = "rrf"
    top_k: int = search.TOP_K
    rrf_k: int = search.RRF_K
    scope: str | None = None
    summary_weight: float = 0.3
    depth_alpha: float = 0.15
    archive_penalty: float = 0.15
    mmr: float = 0.5
    broad_cap: int = 0
    now: int | None = None
    recency_days: int = 90


@dataclass(frozen=True)
class Tables:
    """chunks: (chunk_id, entry_path, heading, text, embedding); the others only where there are any: summaries (path, depth,
    embedding), weights, classifications, files (path, modified_s), an inverted index of the chunks, and a graph of their vectors
    (``ann.build``). Without an index texts are read once for each question, without a graph vectors are."""

    chunks: DataFrame
    summaries: DataFrame | None = None
    weights: DataFrame | None = None
    classifications: DataFrame | None = None
    files: DataFrame | None = None
    fields: tuple[str, ...] = field(default=FIELDS)
    index: inverted.Index | None = None
    graph: DataFrame | None = None


def match(chunks: DataFrame, question: str, fields: tuple[str, ...] = FIELDS, admitted: Column | None = None, limit: int = search.ARM, phrased: bool = True) -> DataFrame:
    """(id, score) by BM25 over several columns, their counts and lengths summed: the terms of a question, and (phrased) the
    whole of it as a phrase where it has several. Numbers of rows and mean lengths are those of all rows; ``admitted`` only says which may
    be found. One pass over the texts and no shuffle of them: words that nobody asked for are never rows, and what is counted, some
    numbers of each row, is written once for totals and scores."""
    tokens, terms = search.query_terms(question)
    wanted = terms or tokens
    if not wanted:
        return chunks.select(F.col("chunk_id").alias("id"), F.lit(0.0).alias("score")).where("false")
    phrase = tokens if not terms or (phrased and len(terms) > 1) else []
    words = [search_tokens(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f"w{i}") for i, f in enumerate(fields)]
    rows = chunks.select(F.col("chunk_id").alias("id"), (admitted if admitted is not None else F.lit(True)).alias("admitted"), *words)
    held = [F.filter(f"w{i}", lambda w: w.isin(wanted)).alias(f"m{i}") for i in range(len(fields))]
    length = reduce(Column.__add__, [F.size(f"w{i}") for i in range(len(fields))])
    spelled = F.lit("(?= " + "  ".join(map(re.escape, phrase)) + " )")

    def said(i: int) -> Column:
        joined = F.concat(F.lit(" "), F.array_join(f"w{i}", "  "), F.lit(" "))
        return F.when(F.size(f"w{i}") >= len(phrase), F.regexp_count(joined, spelled)).otherwise(0)

    phrases = reduce(Column.__add__, [said(i) for i in range(len(fields))]) if phrase else F.lit(0)
    rows = rows.select("id", "admitted", length.alias("length"), phrases.alias("phrase"), *held)
    count = lambda t: reduce(Column.__add__, [F.size(F.filter(f"m{i}", lambda w: w == t)) for i in range(len(fields))])
    # A question without terms is its phrase alone.
    tf = [*([count(F.lit(t)) for t in terms]), *([F.col("phrase")] if phrase else [])]
    rows = stored(rows.select("id", "admitted", "length", *[c.alias(f"tf{i}") for i, c in enumerate(tf)]))
    totals = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(tf))])
    found = rows.where(F.col("admitted") & reduce(Column.__or__, [F.col(f"tf{i}") > 0 for i in range(len(tf))])).join(F.broadcast(totals))

    def part(i: int) -> Column:
        idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        norm = search.K1 * (1 - search.B + search.B * F.col("length") / F.col("mean"))
        return F.when(idf > 0, idf).otherwise(1e-6) * F.col(f"tf{i}") * (search.K1 + 1) / (F.col(f"tf{i}") + norm)

    scored = found.select("id", reduce(Column.__add__, [part(i) for i in range(len(tf))]).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 9)), "id").limit(limit)


def pool(tables: Tables, question: str, vector: list[float] | None, settings: Settings, also: Column | None = None) -> DataFrame:
    """(chunk_id, rrf_score): the fused top_k of the arms that the mode has. also: what more a chunk has to fulfil."""
    where = ~is_stub("text") & (paths.under("entry_path", settings.scope) if settings.scope else F.lit(True))
    where = F.coalesce(where & also if also is not None else where, F.lit(False))
    arms = []
    if settings.mode != "dense":
        if tables.index is not None and also is None:
            one = tables.chunks.sparkSession.createDataFrame([(0, question)], "question long, text string")
            inside = paths.under("entry_path", settings.scope) if settings.scope else F.lit(True)
            arms.append(inverted.sparse(tables.index, one, ~F.col("stub") & inside).select("id", "score"))
        else:
            arms.append(match(tables.chunks, question, tables.fields, where))
    if settings.mode != "sparse" and vector is not None and tables.graph is not None and also is None and not settings.scope:
        arms.append(ann.dense(tables.chunks.where(where), vector, search.ARM, None, tables.graph))
    elif settings.mode != "sparse" and vector is not None:
        arms.append(search.cosine_top(tables.chunks.where(where), vector, search.ARM, "chunk_id"))
    if not arms:
        return tables.chunks.select("chunk_id", F.lit(0.0).alias("rrf_score")).where("false")
    fused = search.rrf([search.ranked(a) for a in arms], settings.rrf_k, settings.top_k)
    return fused.select(F.col("id").alias("chunk_id"), F.col("score").alias("rrf_score"))


def placed(hits: DataFrame) -> DataFrame:
    """With place from 0 by score; a pool has top_k rows, so one task may order it."""
    return hits.withColumn("place", (F.row_number().over(Window.orderBy(F.desc(F.round("rrf_score", 12)), "chunk_id")) - 1).cast("long"))


def diversity(settings: Settings, question: str) -> float:
    """The weight of relevance: for questions about code 0.8 at least, and between 0 and 1."""
    lam = max(settings.mmr, 0.8) if predicates.is_code(question) else settings.mmr
    return min(max(lam, 0.0), 1.0)


def boosted(hits: DataFrame, tables: Tables, question: str, vector: list[float] | None, settings: Settings) -> DataFrame:
    """Scores by summaries above, weights, history, code and age, in this order."""
    if vector is not None and tables.summaries is not None:
        hits = search.boost_with_summaries(hits, search.summary_search(tables.summaries, vector, alpha=settings.depth_alpha), settings.summary_weight)
    if tables.weights is not None:
        none = hits.sparkSession.createDataFrame([], "path string, category string, source string")
        known = tables.classifications if tables.classifications is not None else none
        # Weights are asked for the pool's files only.
        weights = search.weights_for(hits.select(F.col("entry_path").alias("path")).distinct(), tables.weights, known)
        hits = hits.join(weights.withColumnRenamed("path", "entry_path"), "entry_path", "left").withColumn("rrf_score", F.col("rrf_score") * F.coalesce("weight", F.lit(1.0))).drop("weight")
    factor = search.archive_factor(F.col("entry_path"), settings.scope or "", settings.archive_penalty)
    if predicates.is_code(question):
        factor = factor * search.code_factor(F.col("entry_path"))
    hits = hits.withColumn("rrf_score", F.col("rrf_score") * factor)
    if settings.now is not None and tables.files is not None:
        ages = tables.files.select(F.col("path").alias("entry_path"), "modified_s")
        hits = hits.join(ages, "entry_path", "left").withColumn("rrf_score", F.col("rrf_score") * search.recency_factor(F.col("modified_s"), settings.now, settings.recency_days)).drop("modified_s")
    return hits


def retrieve(tables: Tables, question: str, vector: list[float] | None = None, settings: Settings = Settings(), also: Column | None = None) -> DataFrame:
    """(chunk_id, entry_path, heading, text, rrf_score, place) of a question's pool in its final order. Without chunks that
    match there are no rows; chunks without a vector or a heading, and files without a weight, keep their score."""
    found = pool(tables, question, vector, settings, also)
    hits = tables.chunks.select("chunk_id", "entry_path", "heading", "text", "embedding").join(F.broadcast(found), "chunk_id")
    hits = placed(boosted(hits, tables, question, vector, settings))
    lam = diversity(settings, question)
    if lam < 1 and settings.mode != "sparse":
        asked = hits.select(F.lit(0).alias("query"), "chunk_id", F.col("rrf_score").alias("score"), "embedding")
        hits = hits.drop("place").join(search.mmr(asked, lam).drop("query"), "chunk_id")
    if settings.broad_cap > 0 and settings.scope is None and predicates.is_broad(question):
        cap = settings.broad_cap + (2 if predicates.is_code(question) else 0)
        # A pool that the cap holds whole keeps its order.
        size = hits.agg(F.count("*").alias("size"))
        spread = search.cap_per_file(hits.withColumnRenamed("place", "rank"), cap, "rank").join(F.broadcast(size))
        hits = spread.withColumn("place", F.when(F.col("size") > cap, F.col("place")).otherwise(F.col("rank")))
    return hits.select("chunk_id", "entry_path", "heading", "text", "rrf_score", "place")


def asked(tables: Tables, question: str, vector: list[float] | None = None, settings: Settings = Settings()) -> DataFrame:
    """retrieve for a question with path:, ext: and type: in it. Chunks that fail them are never candidates, so a rare
    extension still fills the pool."""
    parsed = predicates.parse(question)
    given = parsed.path or parsed.ext or parsed.kind
    return retrieve(tables, parsed.text, vector, settings, parsed.condition("entry_path") if given else None)


def trace(tables: Tables, question: str, vector: list[float] | None = None, settings: Settings = Settings()) -> DataFrame:
    """(stage, chunk_id, score, place): what each arm finds by itself, and the final order."""
    stages = []
    for mode in ("sparse", "dense"):
        if mode == "sparse" or (vector is not None and settings.mode != "sparse"):
            found = placed(pool(tables, question, vector, replace(settings, mode=mode)))
            stages.append(found.select(F.lit(mode).alias("stage"), "chunk_id", F.col("rrf_score").alias("score"), "place"))
    final = retrieve(tables, question, vector, settings)
    stages.append(final.select(F.lit("final").alias("stage"), "chunk_id", F.col("rrf_score").alias("score"), "place"))
    return reduce(DataFrame.unionByName, stages)
