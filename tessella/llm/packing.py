"""Best-fit packing by a grouping genetic algorithm, in islands.

Documents become pieces of at most ``capacity`` tokens. Pieces shorter than that are dealt into groups of
``GROUP`` or fewer, and every group is packed by several islands, each with a small population of whole
packings. Crossover injects the best-filled bins of one parent into the other, drops the bins that hold
any of their pieces a second time, and puts the pieces displaced so back by best fit, longest first.
After an epoch each island sends its elite to the next one in the ring. A packing that needs no more bins
than the tokens fill can't be beaten, and its island stops; best fit alone mostly gets there.

The groups bound what a task holds; each costs part of one bin at most, a thousandth of what it packs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut, partitions, text_or_empty, written
from tessella.llm.token_ids import SLICE_BYTES, chunk_encoder

CAPACITY = 2048
GROUP = 4096
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 6
POPULATION = 3

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """docs' (doc_id, text) in pieces of at most ``capacity`` ids, a document's ids being those of its text
    and ``end_id``: (doc_id, piece, start, length, ids_crc32)."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = chunk_encoder(tokenizer)
        for b in cut(batches, 1, SLICE_BYTES):
            rows = []
            ids, bounds = own.encode(b.column(1).to_pylist(), end_id)
            view, bounds = memoryview(ids.astype("<u4", copy=False)), bounds.tolist()
            for doc, first, last in zip(b.column(0).to_pylist(), bounds, bounds[1:], strict=False):
                for k, at in enumerate(range(first, last, capacity)):
                    one = view[at : min(at + capacity, last)]
                    rows.append((doc, k, at - first, len(one), zlib.crc32(one)))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(of, PIECES)


class _Bins:
    """Open bins by free room: a number whose bit r is set where some bin has room r."""

    def __init__(self, capacity: int):
        self.capacity, self.mask = capacity, 0
        self.by_room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
        self.all: list[list[int]] = []

    def add(self, items: list[int], room: int) -> None:
        self.all.append(items)
        self.by_room[room].append(items)
        self.mask |= 1 << room

    def put(self, item: int, size: int) -> None:
        """Into the fullest bin with room for it, or a new one."""
        fitting = self.mask >> size
        if not fitting:
            self.add([item], self.capacity - size)
            return
        room = size + (fitting & -fitting).bit_length() - 1
        held = self.by_room[room]
        items = held.pop()
        if not held:
            self.mask ^= 1 << room
        items.append(item)
        self.by_room[room - size].append(items)
        self.mask |= 1 << (room - size)


def _best_fit(sizes: list[int], capacity: int, order) -> list[list[int]]:
    bins = _Bins(capacity)
    for i in order:
        bins.put(i, sizes[i])
    return bins.all


def _fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(one: list[list[int]], other: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Injects well-filled whole bins of ``other`` into ``one``."""
    fill = np.array([sum(sizes[i] for i in b) for b in other])
    best = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = [other[k] for k in best[rng.random(len(best)) < 0.5]]
    injected = {i for b in chosen for i in b}
    bins, displaced = _Bins(capacity), []
    for b in chosen:
        bins.add(list(b), capacity - sum(sizes[i] for i in b))
    fills = []
    for b in one:
        if injected.isdisjoint(b):
            fills.append((sum(sizes[i] for i in b), b))
        else:
            displaced += [i for i in b if i not in injected]
    fills.sort(key=lambda x: x[0])
    # The emptiest twentieth is opened too, or the displaced pieces would find room in the same bins again.
    for k, (f, b) in enumerate(fills):
        if k < len(fills) // 20:
            displaced += b
        else:
            bins.add(list(b), capacity - f)
    for i in sorted(displaced, key=lambda i: -sizes[i]):
        bins.put(i, sizes[i])
    return bins.all


def evolve(sizes: list[int], capacity: int, seed: int, start: list[list[list[int]]], generations: int = GENERATIONS) -> list[list[int]]:
    """The elite of one island after an epoch; ``start``: packings that it begins with."""
    rng = np.random.default_rng(seed)
    least = -(-sum(sizes) // capacity)
    population = list(start)
    longest = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    while len(population) < POPULATION:
        if not population:
            order = longest
        else:  # nearly longest first
            noisy = np.array(sizes) * rng.uniform(0.8, 1.2, len(sizes))
            order = np.argsort(-noisy, kind="stable").tolist()
        population.append(_best_fit(sizes, capacity, order))
        if len(population[-1]) == least:
            return population[-1]
    rated = sorted(((_fitness(b, sizes, capacity), k, b) for k, b in enumerate(population)), key=lambda x: (x[0], -x[1]), reverse=True)
    for k in range(generations):
        if -rated[0][0][0] == least:
            break
        i, j = rng.choice(len(rated), 2, replace=False)
        child = crossover(rated[i][2], rated[j][2], sizes, capacity, rng)
        rated.append((_fitness(child, sizes, capacity), POPULATION + k, child))
        rated.sort(key=lambda x: (x[0], -x[1]), reverse=True)
        rated = rated[:POPULATION]
    return rated[0][2]


def _labels(bins: list[list[int]], n: int) -> bytes:
    out = np.empty(n, "<i4")
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def _unlabelled(labels: bytes) -> list[list[int]]:
    at = np.frombuffer(labels, "<i4")
    order = np.argsort(at, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(at[order])) + 1)] if len(at) else []


def _island(capacity: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                sizes = r["sizes"]
                start = [_unlabelled(x) for x in (r["own"], r["migrant"]) if x is not None]
                best = evolve(sizes, capacity, (r["grp"] * 1009 + r["island"]) * 31 + r["epoch"], start)
                rows.append((r["grp"], r["island"], sizes, _labels(best, len(sizes)), len(best), _fitness(best, sizes, capacity)[1]))
            types = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.int32(), pa.float64())
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["grp", "island", "sizes", "own", "n_bins", "fill"])

    return of


_STATE = "grp long, island int, sizes array<int>, own binary, n_bins int, fill double"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    for b in batches:
        rows = []
        for r in b.to_pylist():
            at: dict[int, int] = {}
            for item, k in zip(r["items"], np.frombuffer(r["own"], "<i4").tolist(), strict=True):
                rows.append((item["doc_id"], item["piece"], item["start"], item["length"], item["ids_crc32"], (r["grp"] << 24) + k, at.get(k, 0)))
                at[k] = at.get(k, 0) + item["length"]
        cols = zip(*rows, strict=True) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their place: sequence_id and offset, gapless from 0 in each sequence. ``found``: from a written table.

    Sequence ids are not negative for packed pieces and negative for those that fill one alone. Repeated rows are
    pieces of their own. No rows give none. A piece that is longer than the capacity is an error of the caller.
    """
    spark = found.sparkSession
    row = F.monotonically_increasing_id()
    full = found.where(F.col("length") >= capacity).select("*", (-1 - row).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = found.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // GROUP))
    item = F.struct("length", "doc_id", "piece", "start", "ids_crc32")
    grouped = short.withColumn("grp", F.pmod(F.xxhash64(row), F.lit(groups))).groupBy("grp").agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))
    grouped = written(grouped, "packing-groups")
    n = min(partitions(spark), groups * ISLANDS)
    state = (
        grouped.select("grp", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("items.length").cast("array<int>").alias("sizes"))
        .select("*", F.lit(None).cast("binary").alias("own"), F.lit(None).cast("binary").alias("migrant"))
    )
    for epoch in range(EPOCHS):
        state = state.withColumn("epoch", F.lit(epoch)).repartition(n, "grp", "island").mapInArrow(_island(capacity), _STATE)
        state = written(state, f"packing-epoch{epoch}")
        if epoch < EPOCHS - 1:
            sent = state.select("grp", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("own").alias("migrant"))
            state = state.drop("n_bins", "fill").join(sent, ["grp", "island"])
    best = state.groupBy("grp").agg(F.max_by("own", F.struct(-F.col("n_bins"), "fill", -F.col("island"))).alias("own"))
    placed = grouped.join(best, "grp").mapInArrow(_placed, PIECES + ", sequence_id long, offset long")
    return placed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """docs' (doc_id, text) packed into as few sequences of ``capacity`` tokens as the islands find: per piece
    (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A null or empty text is a piece of one id, ``end_id``. Only documents of more than ``capacity`` ids are cut.
    Repeated rows and rows without doc_id are packed as any other. Other columns are ignored.
    """
    return pack(written(pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
