"""Nearest vectors by layered proximity graphs, one a shard, with a merged top k; and by comparison with all where that is
asked for or cheap.

Vectors are dealt to shards by a hash of their id. A shard's graph links each vector to near ones in different directions; a
few vectors stand in higher layers too, ever fewer, from which a search finds its way down. A search looks through every
shard, all questions of a shard at once, so one question costs a few thousand products a shard and not all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import paths
from tessella.operators import search

#: Links of a vector in a layer (twice as many in the lowest), layers at most, and vectors that a search keeps in view.
LINKS, LAYERS, EF = 24, 16, 256
#: From so many vectors on an index pays; fewer are compared one by one.
LEAST = 50_000
#: Vectors of a shard: what one task holds.
SHARD = 8192
#: A search starts from all vectors of the first layer, from the lowest up, that has no more than so many.
START = 256
#: Rows compared at once while links are made, candidates for links, questions at once, and vectors that they open in a step.
BLOCK, CANDIDATES, ASKED, OPENED = 256, 72, 128, 4

_NODE = "shard int, slot int, ids array<long>, v array<float>, links array<array<int>>"
_HIT = "query long, id long, score double"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]


def _linked(x: np.ndarray, most: int) -> np.ndarray:
    """For each row of x (unit vectors) the places of up to ``most`` others that it is linked with, -1 where there are fewer."""
    n = len(x)
    width = min(n - 1, CANDIDATES)
    if width < 1:
        return np.full((n, 1), -1, np.int32)
    ends, sims = [], []
    for i in range(0, n, BLOCK):
        s = x[i : i + BLOCK] @ x.T
        rows = np.arange(len(s))
        s[rows, rows + i] = -np.inf
        near = np.argpartition(-s, width - 1, axis=1)[:, :width]
        own = np.take_along_axis(s, near, 1)
        order = np.argsort(-own, axis=1, kind="stable")
        near, own = np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1)
        # A candidate that lies nearer to one already taken than to the vector itself can be reached through that one.
        among = np.einsum("bcd,bed->bce", x[near], x[near], optimize=True)
        taken = np.zeros(near.shape, bool)
        for j in range(width):
            shaded = (taken[:, :j] & (among[:, j, :j] >= own[:, j, None])).any(1)
            taken[:, j] = ~shaded & (taken.sum(1) < LINKS)
        # Half of the links go to the nearest in any case.
        taken[:, : LINKS // 2] = True
        b, c = np.nonzero(taken)
        ends.append(np.stack([b + i, near[b, c]]))
        sims.append(own[b, c])
    (a, b), s = np.concatenate(ends, axis=1), np.concatenate(sims)
    a, b, s = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s])
    _, once = np.unique(a.astype(np.int64) * n + b, return_index=True)
    a, b, s = a[once], b[once], s[once]
    order = np.lexsort((b, -s, a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    out = np.full((n, most), -1, np.int32)
    held = place < most
    out[a[held], place[held]] = b[held]
    return out


def _layers(n: int) -> np.ndarray:
    """The highest layer of each of n vectors: every LINKS-th of a layer is in the next."""
    u = np.random.default_rng(n).random(n)
    return np.minimum(-np.log(1 - u) / np.log(LINKS), LAYERS - 1).astype(int)


def _graph(table: pa.Table) -> pa.Table:
    """A shard's nodes of its rows (shard, id, v): equal vectors are one node."""
    v = np.stack(table.column("v").to_numpy()).astype(np.float32)
    ids = table.column("id").to_numpy()
    order = np.argsort(ids)
    x, which = np.unique(v[order], axis=0, return_inverse=True)
    own = np.argsort(which.reshape(-1), kind="stable")
    starts = np.append(np.searchsorted(which.reshape(-1)[own], np.arange(len(x))), len(own))
    unit = _unit(x).astype(np.float32)
    high = _layers(len(x))
    links = [[] for _ in x]
    for layer in range(high.max() + 1):
        among = np.flatnonzero(high >= layer)
        near = _linked(unit[among], LINKS * (1 if layer else 2))
        for at, row in zip(among, near, strict=True):
            links[at].append(among[row[row >= 0]].tolist())
    shard = table.column("shard")[0].as_py()
    held = [ids[order][own[starts[i] : starts[i + 1]]].tolist() for i in range(len(x))]
    return pa.table({
        "shard": pa.array([shard] * len(x), pa.int32()), "slot": pa.array(range(len(x)), pa.int32()), "ids": pa.array(held, pa.list_(pa.int64())),
        "v": pa.array(list(x), pa.list_(pa.float32())), "links": pa.array(links, pa.list_(pa.list_(pa.int32()))),
    })


def build(vectors: DataFrame, id_column: str = "chunk_id", column: str = "embedding", dimension: int | None = None) -> DataFrame:
    """The index's nodes, to be written as a table and given to ``nearest``. Vectors of another dimension than the given one (else
    the most frequent one), null, zero or with parts that aren't finite stay out. An empty table makes an empty index."""
    rows = vectors.select(F.col(id_column).alias("id"), F.col(column).cast("array<float>").alias("v"))
    rows = rows.where("id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = float('infinity')) AND exists(v, x -> x <> 0)")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d")
    found = (sizes.where(F.col("d") == dimension) if dimension else sizes).first()
    if not found:
        return vectors.sparkSession.createDataFrame([], _NODE)
    shards = -(-found["count"] // SHARD)
    dealt = rows.where(F.size("v") == found["d"]).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(_graph, _NODE)


def _beam(x: np.ndarray, links: np.ndarray, asked: np.ndarray, first: np.ndarray, wide: int) -> np.ndarray:
    """The ``wide`` nodes in view of each question at the end, best first; -1 where there are fewer. first: nodes to start from."""
    q, n = len(asked), len(x)
    rows = np.arange(q)[:, None]
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True
    at = np.where(first < 0, n, first)
    seen[rows, at] = True
    score = np.where(at < n, np.einsum("qd,qnd->qn", asked, x[np.minimum(at, n - 1)], optimize=True), -np.inf)
    opened = at == n
    while True:
        best = np.argsort(np.where(opened, np.inf, -score), axis=1, kind="stable")[:, :OPENED]
        live = ~np.take_along_axis(opened, best, 1)
        if not live.any():
            break
        np.put_along_axis(opened, best, True, 1)
        near = np.where(live[:, :, None], links[np.where(live, np.take_along_axis(at, best, 1), 0)], -1).reshape(q, -1)
        near = np.sort(np.where(near < 0, n, near), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[rows, near]] = n
        seen[rows, near] = True
        some = (near < n).any(0)
        near = near[:, some]
        new = np.where(near < n, np.einsum("qd,qnd->qn", asked, x[np.minimum(near, n - 1)], optimize=True), -np.inf)
        at, score, opened = np.hstack([at, near]), np.hstack([score, new]), np.hstack([opened, near == n])
        if at.shape[1] > wide:
            keep = np.argpartition(-score, wide - 1, axis=1)[:, :wide]
            at, score, opened = (np.take_along_axis(a, keep, 1) for a in (at, score, opened))
    order = np.argsort(-score, axis=1, kind="stable")
    at = np.take_along_axis(at, order, 1)
    return np.where(at < n, at, -1)


def _padded(lists: list[list[int]], n: int) -> np.ndarray:
    out = np.full((n, max((len(x) for x in lists), default=0) or 1), -1, np.int32)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _answer(nodes: pa.Table, questions: pa.Table, k: int, wide: int) -> pa.Table:
    """(query, id, score) of a shard's k nearest for each question (query, q)."""
    out = {"query": [], "id": [], "score": []}
    if nodes.num_rows and questions.num_rows:
        nodes = nodes.sort_by("slot")
        raw = np.stack(nodes.column("v").to_numpy()).astype(np.float64)
        x = _unit(raw).astype(np.float32)
        ids, links = nodes.column("ids").to_pylist(), nodes.column("links").to_pylist()
        high = np.array([len(x) for x in links]) - 1
        layers = [_padded([a[i] if len(a) > i else [] for a in links], len(x)) for i in range(high.max() + 1)]
        top = next((i for i in range(high.max() + 1) if (high >= i).sum() <= START), high.max())
        numbers, vectors = questions.column("query").to_pylist(), np.stack(questions.column("q").to_numpy()).astype(np.float64)
        for i in range(0, len(vectors), ASKED):
            exact = vectors[i : i + ASKED]
            asked = _unit(exact).astype(np.float32)
            first = np.tile(np.flatnonzero(high >= top), (len(asked), 1))
            for layer in range(top, -1, -1):
                first = _beam(x, layers[layer], asked, first, wide if layer == 0 else 32)
            for one, number, places in zip(exact, numbers[i:], first, strict=False):
                places = places[places >= 0][:wide]
                s = (raw[places] @ one) / (np.linalg.norm(raw[places], axis=1) * np.linalg.norm(one))
                # All copies at the k-th place: ties go by id, over all shards.
                found = sorted(((-round(c, 9), d, c) for c, p in zip(s.tolist(), places, strict=True) for d in ids[p]))[:k]
                out["query"] += [number] * len(found)
                out["id"] += [d for _, d, _ in found]
                out["score"] += [c for _, _, c in found]
    return pa.table({"query": pa.array(out["query"], pa.int64()), "id": pa.array(out["id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})


def nearest(index: DataFrame, questions: DataFrame, k: int = search.ARM, ef: int = EF) -> DataFrame:
    """(query, id, score, rank from 0): the k nearest found by cosine for each question (query, q) of many; ties to the smaller id.

    Questions that are null, zero or of another dimension find nothing. Each shard answers all questions at once with k rows
    at most, so what meets for one question is k rows a shard.
    """
    wide = max(ef, k)
    asked = questions.select(F.col("query").cast("long").alias("query"), F.col("q").cast("array<double>").alias("q")).where("q IS NOT NULL AND exists(q, x -> x <> 0) AND NOT exists(q, x -> x IS NULL OR isnan(x))")
    size = index.agg(F.max(F.size("v")).alias("d"))
    asked = asked.join(F.broadcast(size), F.size("q") == F.col("d")).drop("d")
    shards = index.agg((F.max("shard") + 1).alias("shards"))
    asked = asked.join(F.broadcast(shards)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")

    def answer(nodes: pa.Table, some: pa.Table) -> pa.Table:
        return _answer(nodes, some, k, wide)

    hits = index.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(answer, _HIT)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id")) - 1
    return hits.withColumn("rank", place.cast("long")).where(F.col("rank") < k)


def worth(chunks: DataFrame, least: int = LEAST, column: str = "embedding") -> bool:
    """Whether there are vectors enough for an index."""
    return chunks.where(F.col(column).isNotNull()).count() >= least


def dense(chunks: DataFrame, query: list[float], k: int = search.ARM, scope: str | None = None, index: DataFrame | None = None, id_column: str = "chunk_id") -> DataFrame:
    """(id, score) of the k nearest chunks: by the index where there is one and no scope is asked for, else by comparison with all.

    The index may be older than the chunks: ids that are gone count for nothing. Where it finds nothing at all, all are compared.
    """
    if index is not None and not scope:
        one = chunks.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query long, q array<double>")
        found = nearest(index, one, k).select("id", "score").join(chunks.select(F.col(id_column).alias("id")), "id", "left_semi")
        # Bounded: k rows.
        rows = found.collect()
        if rows:
            return chunks.sparkSession.createDataFrame(rows, found.schema)
    inside = chunks.where(paths.under("entry_path", scope)) if scope else chunks
    return search.cosine_top(inside, query, k, id_column)
