"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are put on the unit sphere of one more dimension, so that the largest inner product becomes the
smallest angle: v goes to (v / M, sqrt(1 - |v|^2 / M^2)) with M the largest norm, a query to (q / |q|, 0). Each
of ``tables`` tables turns them by a pseudo-rotation (three rounds of random signs and a fast Hadamard
transform) and assigns a vector to the nearest signed axis. A query probes the nearest signed axes of every
table; what it meets there is compared exactly, in double precision. How many axes it probes is fitted: on a
sample of ``SAMPLE`` vectors the true neighbours of ``SAMPLE_QUERIES`` are searched, and so many axes are probed
as find ``TARGET`` of them. Neighbours in a sample are farther than those among all rows, so the fit errs to the
side of more probes. All rows are indexed.

Buckets are compared in tiles of at most about ``TILE`` queries by ``TILE`` vectors, so no task depends on the
size of a bucket. A pair that meets in several tables is scored in the first only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import partitions, written

TABLES = 6
SAMPLE = 20_000
SAMPLE_QUERIES = 300
TARGET = 0.96
TILE = 1024
SEED = 20_251


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalized Hadamard transform of each row; the width is a power of two."""
    n, half = x.shape[1], 1
    while half < n:
        x = x.reshape(len(x), -1, 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


def width(dim: int) -> int:
    """Coordinates after the extra dimension, filled up to a power of two."""
    return 1 << dim.bit_length()


def _signs(dim: int, tables: int) -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1.0, 1.0]), (tables, 3, width(dim)))


def _turned(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    for s in signs:
        x = hadamard(x * s)
    return x


def _lifted(v: np.ndarray, largest: float | None) -> np.ndarray:
    """On the sphere: vectors with the largest norm given, queries without."""
    out = np.zeros((len(v), width(v.shape[1])))
    norm = np.linalg.norm(v, axis=1)
    if largest is None:
        out[:, : v.shape[1]] = v / norm[:, None]
    else:
        out[:, : v.shape[1]] = v / largest
        out[:, v.shape[1]] = np.sqrt(np.maximum(0, 1 - (norm / largest) ** 2))
    return out


def codes(v: np.ndarray, largest: float, signs: np.ndarray) -> np.ndarray:
    """The nearest signed axis of each vector in each table: 2 * axis, and 1 more on its negative side."""
    lifted = _lifted(v, largest)
    out = np.empty((len(v), len(signs)), np.int32)
    for t, s in enumerate(signs):
        x = _turned(lifted, s)
        axis = np.abs(x).argmax(1)
        out[:, t] = 2 * axis + (x[np.arange(len(x)), axis] < 0)
    return out


def probed(v: np.ndarray, signs: np.ndarray, probes: int) -> np.ndarray:
    """(query, table, probe): the signed axes nearest to each query."""
    lifted = _lifted(v, None)
    out = np.empty((len(v), len(signs), probes), np.int32)
    for t, s in enumerate(signs):
        x = _turned(lifted, s)
        both = np.stack([x, -x], 2).reshape(len(x), -1)
        out[:, t] = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    return out


def fitted_probes(v: np.ndarray, largest: float, signs: np.ndarray, k: int) -> int:
    """The least number of probes that finds TARGET of the k nearest in the sample v."""
    asks = np.linspace(0, len(v) - 1, min(len(v), SAMPLE_QUERIES)).astype(int)
    k = min(k, len(v) - 1)
    if k < 1:
        return 1
    s = v[asks] @ v.T
    s[np.arange(len(asks)), asks] = -np.inf
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    own, lifted = codes(v, largest, signs), _lifted(v[asks], None)
    rank = np.full(near.shape, 1 << 30)
    for t, sign in enumerate(signs):
        x = _turned(lifted, sign)
        both = np.stack([x, -x], 2).reshape(len(x), -1)
        place = np.argsort(np.argsort(-both, axis=1), axis=1)
        rank = np.minimum(rank, np.take_along_axis(place, own[near, t], 1))
    return int(np.sort(rank.ravel())[int(np.ceil(TARGET * rank.size)) - 1]) + 1


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1) if n else np.empty((0, 0))


def _encoded(kind: str, largest: float, signs: np.ndarray):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind)
                v = flat.reshape(b.num_rows, -1)
                c = codes(v.astype(np.float64), largest, signs).astype("<i4")
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.tobytes() for x in c], pa.binary()), b.column(2)], ["vec_id", "v", "codes", "is_query"])

    return of


def _counts(kind: str, signs: np.ndarray, probes: int, axes: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bucket = _matrix(b.column(2), "<i4") + axes * np.arange(len(signs))
                n = np.bincount(bucket.ravel(), minlength=axes * len(signs))
                q = np.zeros_like(n)
                asks = b.column(3).to_numpy(zero_copy_only=False)
                if asks.any():
                    p = probed(_matrix(b.column(1), kind)[asks].astype(np.float64), signs, probes) + axes * np.arange(len(signs))[:, None]
                    q = np.bincount(p.ravel(), minlength=len(n))
                at = np.flatnonzero(n + q)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64)), pa.array(q[at].astype(np.int64))], ["bucket", "n", "q"])

    return of


def _dealt(kind: str, signs: np.ndarray, probes: int, axes: int, splits: np.ndarray):
    """Rows for the tiles: each vector to its bucket in every table, each query to the buckets that it probes.
    splits: per bucket the number of parts of its vectors and of its queries."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.arange(len(signs))
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            part = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            bucket = _matrix(b.column(2), "<i4") + axes * tables
            row, t = np.divmod(np.arange(bucket.size), len(tables))
            asks = np.flatnonzero(b.column(3).to_numpy(zero_copy_only=False))
            p = probed(_matrix(b.column(1), kind)[asks].astype(np.float64), signs, probes) if len(asks) else np.empty((0, len(tables), probes), np.int32)
            reach = np.zeros((len(asks), len(tables), axes), bool)
            np.put_along_axis(reach, p, True, axis=2)
            masks = [np.packbits(x).tobytes() for x in reach.reshape(len(asks), -1)]
            qrow, qrest = np.divmod(np.arange(p.size), len(tables) * probes)
            qbucket = p.ravel() + axes * (qrest // probes)
            own, other, which = (np.concatenate(x) for x in ((row, asks[qrow]), (bucket.ravel(), qbucket), (np.zeros(len(row), bool), np.ones(len(qrow), bool))))
            mask_at = np.concatenate([np.full(len(row), -1), qrow]).astype(np.int64)
            copies = np.where(which, splits[other, 0], splits[other, 1])
            again = np.repeat(np.arange(len(own)), copies)
            k = np.arange(len(again)) - np.repeat(np.cumsum(copies) - copies, copies)
            own, other, which, mask_at = own[again], other[again], which[again], mask_at[again]
            mine = (part[own] % np.where(which, splits[other, 1], splits[other, 0]).astype(np.uint64)).astype(np.int64)
            vs, qs = np.where(which, k, mine), np.where(which, mine, k)
            v, c = b.column(1).to_pylist(), b.column(2).to_pylist()
            for i in range(0, len(own), 20_000):
                s = slice(i, i + 20_000)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(other[s].astype(np.int32)), pa.array((vs[s] << 32) + qs[s]), pa.array(~which[s]), pa.array(ids[own[s]]),
                        pa.array([v[x] for x in own[s].tolist()], pa.binary()),
                        pa.array([c[x] if m < 0 else masks[m] for x, m in zip(own[s].tolist(), mask_at[s].tolist(), strict=True)], pa.binary()),
                    ],
                    ["bucket", "tile", "is_vector", "vec_id", "v", "more"],
                )

    return of


def _best(queries: np.ndarray, qids: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int, skip: np.ndarray | None):
    """The k best of each query among the vectors: (query ids, vector ids, scores). Scores add up in one order
    whatever the tile, so equal vectors get equal scores."""
    s = queries @ v.T
    s[qids[:, None] == ids] = -np.inf
    if skip is not None:
        s[skip] = -np.inf
    least = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
    q, c = np.nonzero((s >= (least - slack)[:, None]) & np.isfinite(s))
    score = np.concatenate([np.empty(0), *((queries[q[i : i + 50_000]] * v[c[i : i + 50_000]]).sum(1) for i in range(0, len(q), 50_000))])
    order = np.lexsort((ids[c], -score, q))
    q, c, score = q[order], c[order], score[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return qids[q[keep]], ids[c[keep]], score[keep]


def _tiles(kind: str, axes: int, tables: int, k: int):
    def compared(key: tuple[int, int], queries: list, vectors: list):
        if not queries or not vectors:
            return None
        table = key[0] // axes
        qids, q = np.array([x[0] for x in queries]), np.stack([np.frombuffer(x[1], kind) for x in queries]).astype(np.float64)
        ids, v = np.array([x[0] for x in vectors]), np.stack([np.frombuffer(x[1], kind) for x in vectors]).astype(np.float64)
        skip = None
        if table:
            reach = np.unpackbits(np.stack([np.frombuffer(x[2], np.uint8) for x in queries]), axis=1)[:, : tables * axes].reshape(len(queries), tables, axes).astype(bool)
            own = np.stack([np.frombuffer(x[2], "<i4") for x in vectors])
            skip = np.zeros((len(queries), len(vectors)), bool)
            for t in range(table):
                skip |= reach[:, t][:, own[:, t]]
        return _best(q, qids, v, ids, k, skip)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[int, int] | None = None
        queries: list = []
        vectors: list = []
        found: list = []

        def flush(least: int):
            nonlocal found
            if found and sum(len(x[0]) for x in found) >= least:
                cols = [np.concatenate(x) for x in zip(*found, strict=True)]
                found = []
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])

        for b in batches:
            for bucket, tile, is_vector, i, v, more in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (bucket, tile) != now:
                    if now and (got := compared(now, queries, vectors)):
                        found.append(got)
                        yield from flush(20_000)
                    now, queries, vectors = (bucket, tile), [], []
                (vectors if is_vector else queries).append((i, v, more))
                if len(vectors) >= 4 * TILE:  # queries come first, so vectors may go by parts
                    if got := compared(now, queries, vectors):
                        found.append(got)
                        yield from flush(20_000)
                    vectors = []
        if now and (got := compared(now, queries, vectors)):
            found.append(got)
        yield from flush(1)

    return of


PAIRS = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_column: str, column: str) -> tuple[DataFrame, int, float, int]:
    """(vec_id, v) of the vectors that take part, their dimension, largest norm and number."""
    v = F.col(column)
    v = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    v = v.groupBy("vec_id").agg(F.min("v").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    v = written(v.withColumn("norm", norm), "vectors")
    sizes = v.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max("norm").alias("largest")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return v.drop("norm"), 0, 0.0, 0
    return v.where(F.size("v") == sizes[0]["dim"]).drop("norm"), sizes[0]["dim"], sizes[0]["largest"], sizes[0]["n"]


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_column: str = "vec_id", column: str = "embedding", tables: int = TABLES, probes: int | None = None) -> DataFrame:
    """The k nearest of each query by inner product: (query_id, rank, vec_id, score), rank from 1, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query's own. Rows whose
    id or vector is null, and vectors that are empty, all zero or hold a null, NaN or infinite component, take no part; nor
    do vectors of another dimension than the most frequent (of several such, the smallest). Of rows with one id the
    smallest vector counts, so repeated rows count once. A query that met fewer than k is compared with all rows, so there
    are always k, or all candidates if those are fewer. No rows give none. Other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = "<f4" if dict(vectors.dtypes)[column] == "array<float>" else "<f8"
    rows, dim, largest, count = usable(vectors, id_column, column)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, axes = partitions(spark), 2 * width(dim)
    signs = _signs(dim, tables)
    if probes is None:
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
        probes = fitted_probes(np.array([r["v"] for r in sample], np.float64), largest, signs, k)
    probes = min(probes, axes)
    stored = rows.select("vec_id", F.col("v").cast("array<double>" if kind == "<f8" else "array<float>"), (F.pmod("vec_id", F.lit(every)) == 0).alias("is_query"))
    stored = written(stored.mapInArrow(_encoded(kind, largest, signs), "vec_id long, v binary, codes binary, is_query boolean"), "vectors-coded")
    counted = stored.mapInArrow(_counts(kind, signs, probes, axes), "bucket int, n long, q long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("q").alias("q"))
    splits = np.ones((axes * tables, 2), np.int64)
    for r in counted.collect():  # as many rows as there are buckets: fixed by the dimension
        splits[r["bucket"]] = [max(1, -(-r["n"] // TILE)), max(1, -(-r["q"] // TILE))]
    dealt = stored.mapInArrow(_dealt(kind, signs, probes, axes, splits), "bucket int, tile long, is_vector boolean, vec_id long, v binary, more binary")
    dealt = dealt.repartition(n, "bucket", "tile").sortWithinPartitions("bucket", "tile", "is_vector")
    pairs = dealt.mapInArrow(_tiles(kind, axes, tables, k), PAIRS)
    best = written(_top(pairs, k), "nearest")
    need = min(k, count - 1)
    found = best.groupBy("query_id").count().where(F.col("count") >= need)
    asking = stored.where("is_query").select(F.col("vec_id").alias("query_id"))
    missing = asking.join(found, "query_id", "left_anti") if need else asking.limit(0)
    rest = _all_rows(missing.join(stored.select(F.col("vec_id").alias("query_id"), "v"), "query_id"), stored, kind, k, count)
    return best.join(missing, "query_id", "left_anti").unionByName(_top(rest, k))


def _top(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _all_rows(queries: DataFrame, stored: DataFrame, kind: str, k: int, count: int) -> DataFrame:
    """Queries against all rows in blocks: every block of rows gets every block of queries."""
    blocks = max(1, -(-count // (4 * TILE)))
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    q = queries.select(F.lit(0).alias("bucket"), spread.alias("tile"), F.lit(False).alias("is_vector"), F.col("query_id").alias("vec_id"), "v", F.lit(b"").alias("more"))
    v = stored.select(F.lit(0).alias("bucket"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("tile"), F.lit(True).alias("is_vector"), "vec_id", "v", F.lit(b"").alias("more"))
    # Without any such query the vectors need not move.
    asked = queries.select(F.lit(0).alias("bucket")).limit(1)
    both = q.unionByName(v.join(asked, "bucket", "left_semi"))
    return both.repartition(partitions(stored.sparkSession), "bucket", "tile").sortWithinPartitions("bucket", "tile", "is_vector").mapInArrow(_tiles(kind, 1, 1, k), PAIRS)
