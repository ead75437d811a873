"""N-gram Jaccard join: size-banded tiles, bitmap bounds and exact intersections.

Sets s and t with a Jaccard similarity of J or more have at least J * max(|s|, |t|) elements in common. So with all
elements in one order, s and t have a common element among the first |s| - ceil(J * |s|) + 1 of s and the first
|t| - ceil(J * |t|) + 1 of t. The order is by hash, but for the most frequent elements, which come last: passages that
many documents hold are then among the first ones of no set that has enough of its own. Which elements count as
frequent changes only the work, never the result. A set meets others in *tiles*: one for each of its first elements
and each band of sizes (powers of BAND_RATIO) that its partners may be the smaller ones of.

A batch of documents sends one row for each tile, that of its smallest document; the others of the batch are paired
with that one already, and their rows go anywhere. Documents with equal sets are linked by a digest of the set, and
only the smallest of them goes on from there.

In a tile every set is first compared with the smallest document only. Where that leaves several components,
the tile's sets of different components are compared too. That goes in two rounds: the first takes one pair for two
components that would join if the bound were the truth, the second all pairs that are still between components and
not compared yet. Pairs inside a component need no comparison, so a group of near copies costs about as many
comparisons as it has members, and no link between components is missed.

Each comparison first takes bitmaps of the elements' parities: equal elements cancel, so their difference counts at
most the elements in which the sets differ and bounds the overlap from above. A bitmap has about a bit for each
element, so the bound is as sharp for large sets as for small ones; larger bitmaps are folded onto smaller ones. Only
pairs that pass take their texts along, for an exact intersection of sorted arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import by_ids, cut, delete_written, partitions, sliced, trimmed, written
from tessella.llm.components import components
from tessella.llm.substring_dedup import _firsts, _groups, _mix, run_hashes

SHINGLE = 4
PERCENT = 85
BAND_RATIO = 2
TILE = 2048

#: Shingles that so many documents of a batch have count as frequent, and so many of the most frequent come last.
FREQUENT_LEAST = 4
FREQUENT = 1 << 18

#: Bytes of text that a worker takes at a time: those of a batch's rows, and those that are cut into words.
ROWS_BYTES, WORDS_BYTES = 4_000_000, 1_000_000


def batch_shingles(texts: pa.Array, length: int) -> Iterator[np.ndarray]:
    """Of each text (strings or null) the sorted distinct hashes of its shingles; of all its words where they are fewer.

    Arrow splits at ASCII white space and lower-cases A-Z; each distinct word is hashed once.
    """
    for start, n in sliced(texts, WORDS_BYTES):
        part = texts.slice(start, n)
        chunks = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(part, "")))
        offsets = chunks.offsets.to_numpy().astype(np.int64)
        coded = chunks.values.dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        at = coded.indices.to_numpy()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        if b"" in words:  # next to white space at an end of a text
            there = at != words.index(b"")
            at, offsets = at[there], np.concatenate([[0], np.cumsum(there)])[offsets]
        h = hashes[at] if len(words) else np.empty(0, np.uint64)
        n = np.diff(offsets)
        size = np.minimum(n, length)
        count = np.where(n > 0, n - size + 1, 0)
        ends = np.cumsum(count)
        starts = np.repeat(offsets[:-1] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
        size = np.repeat(size, count)
        every = run_hashes(h, size, starts) ^ size.astype(np.uint64)
        for end, c in zip(ends.tolist(), count.tolist(), strict=True):
            yield np.unique(every[end - c : end])


def least_overlap(n: int, percent: int) -> int:
    """Elements that a set of size n has in common with any that is similar enough."""
    return -(-percent * n // 100)


def bands(n: int, percent: int) -> range:
    """The bands in which a set of size n takes part: those of its smallest possible partner up to its own."""
    return range(_band(max(1, least_overlap(n, percent))), _band(n) + 1)


def _band(n: int) -> int:
    return int(np.floor(np.log(n) / np.log(BAND_RATIO) + 1e-9))


def first_elements(h: np.ndarray, percent: int, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Those elements of a set that decide in which tiles it is. frequent: sorted hashes; rank: higher for more frequent ones."""
    order = _mix(h) >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        order = np.where(frequent[at] == h, np.uint64(1 << 63) + rank[at], order)
    n = len(h) - least_overlap(len(h), percent) + 1
    return h[np.argpartition(order, n - 1)[:n]]


def bitmap(h: np.ndarray) -> bytes:
    """The parities of a set's elements: four bits for each element of small sets, and one of large ones, whose counts scatter
    less; 512 at least, and a power of two."""
    n = max(512, min(_power(4 * len(h)), 2048), _power(len(h)))
    odd = np.bincount((_mix(h) >> np.uint64(40)).astype(np.int64) & (n - 1), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _power(n: int) -> int:
    return 1 << (n - 1).bit_length()


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, each folded onto the smallest size: a bit's place is a hash modulo the size."""
    least = min(map(len, maps)) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(m, np.uint64).reshape(-1, least), axis=0) for m in maps])


def may_link(n: np.ndarray, m: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes n and m may be similar enough, if their bitmaps differ in so many bits."""
    both = np.minimum((n + m - differ) // 2, np.minimum(n, m))
    return 100 * both >= percent * (n + m - both)


_SETS = "doc long, n long, name binary, bitmap binary, same long, k long, c long"


def _sets(length: int):
    """A row for each document: with a digest and the bitmap of its set, or for all but the smallest of a batch's documents
    with one set, that smallest as ``same``. And rows (k, c) for shingles k that c documents of the batch have."""
    schema = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("name", pa.binary()), ("bitmap", pa.binary()), ("same", pa.int64()), ("k", pa.int64()), ("c", pa.int64())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, 1, ROWS_BYTES):
            b, seen, rows = b.sort_by("doc_id"), {}, []
            sets = list(batch_shingles(b.column(1), length))
            for doc, h in zip(b.column(0).to_pylist(), sets, strict=True):
                name = xxhash.xxh3_128_digest(h.tobytes()) if len(h) and doc is not None else None
                same = seen.setdefault(name, doc) if name else None
                rows.append((None, None, same) if same != doc or name is None else (name, bitmap(h), None))
            cols = [pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), list(schema)[2:5], strict=True)]
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(h) for h in sets], pa.int64()), *cols, none, none], schema=schema)
            every = np.sort(np.concatenate([*sets, np.empty(0, np.uint64)]))
            starts = np.flatnonzero(_firsts([every])) if len(every) else np.empty(0, np.int64)
            count = np.diff(np.r_[starts, len(every)])
            often = count >= FREQUENT_LEAST
            none = [pa.nulls(int(often.sum()), t) for t in schema.types[:5]]
            yield pa.RecordBatch.from_arrays([*none, pa.array(every[starts[often]].view(np.int64)), pa.array(count[often])], schema=schema)

    return of


#: Rows of a tile: the only document of a batch in it, the smallest of several, and the others, paired with that one.
_ALONE, _FIRST, _PAIRED = range(3)
_MEMBERS = "key long, k long, doc long, other long, kind int"


def _members(length: int, percent: int, frequent: np.ndarray, rank: np.ndarray):
    """Rows (key, k, doc, other, kind) of a batch: a document in tile k. Of equal sets the smallest document alone goes on."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, 1, ROWS_BYTES):
            seen: set[bytes] = set()
            tiles, docs = [], []
            b = b.sort_by("doc_id")
            for doc, h in zip(b.column(0).to_pylist(), batch_shingles(b.column(1), length), strict=True):
                if doc is None or not len(h) or (name := xxhash.xxh3_128_digest(h.tobytes())) in seen:
                    continue
                seen.add(name)
                first = first_elements(h, percent, frequent, rank)
                for band in bands(len(h), percent):
                    tiles.append(_mix(first ^ np.uint64((band + 1) * 0x9E3779B97F4A7C15 % (1 << 64))))
                    docs.append(np.full(len(first), doc, np.int64))
            k = np.concatenate([*tiles, np.empty(0, np.uint64)]).view(np.int64)
            d = np.concatenate([*docs, np.empty(0, np.int64)])
            # Rows come by ascending document, and of rows with one doc_id all but one of a tile go.
            by = np.argsort(k, kind="stable")
            k, d = k[by], d[by]
            new = _firsts([k, d])
            k, d = k[new], d[new]
            starts = np.flatnonzero(_firsts([k])) if len(k) else np.empty(0, np.int64)
            size = np.diff(np.r_[starts, len(k)])
            first = np.zeros(len(k), bool)
            first[starts] = True
            kind = np.where(first, np.where(np.repeat(size, size) > 1, _FIRST, _ALONE), _PAIRED).astype(np.int32)
            least = np.repeat(d[starts], size)
            away = _mix(d.view(np.uint64) ^ _mix(k.view(np.uint64))).view(np.int64)
            cols = [np.where(first, k, away), np.where(first, 0, k), d, np.where(first, 0, least), kind]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["key", "k", "doc", "other", "kind"])

    return of


_TILES = "k long, doc long, other long"


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members (k, doc, other) of tiles with several documents; ``other``: the one that doc is to be compared with first,
    its batch's smallest or, for that one, the tile's. Rows are sorted by key."""
    for key, k, doc, other, kind in _groups(batches, 1):
        paired = kind == _PAIRED
        out = [(k[paired], doc[paired], other[paired])]
        wait = ~paired
        if wait.any():
            k, doc, kind = key[wait], doc[wait], kind[wait]
            starts = np.flatnonzero(_firsts([k]))
            size = np.diff(np.r_[starts, len(k)])
            least = np.minimum.reduceat(doc, starts)
            several = (np.maximum.reduceat(doc, starts) != least) | (np.maximum.reduceat(kind, starts) == _FIRST)
            keep = np.repeat(several, size)
            out.append((k[keep], doc[keep], np.repeat(least, size)[keep]))
        k, doc, other = (np.concatenate(x) for x in zip(*out, strict=True))
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(doc), pa.array(other)], ["k", "doc", "other"])


def _bounded(percent: int):
    """Of pairs (u, v) with their sizes and bitmaps those that may be similar enough."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trimmed(batches):
            u, v, n, m, one, two = b.columns
            differ = [int(np.bitwise_count(np.bitwise_xor.reduce(folded([x, y]), axis=0)).sum()) for x, y in zip(one.to_pylist(), two.to_pylist(), strict=True)]
            ok = pa.array(may_link(n.to_numpy(), m.to_numpy(), np.array(differ, np.int64), percent), pa.bool_())
            yield pa.RecordBatch.from_arrays([u.filter(ok), v.filter(ok)], ["u", "v"])

    return of


def _links(percent: int, length: int):
    """(u, v) of the pairs whose sets are similar enough; rows: two ids and two texts."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trimmed(batches):
            ok = []
            texts = [c.dictionary_encode() for c in b.columns[2:]]
            sets = [list(batch_shingles(t.dictionary, length)) for t in texts]
            for i, j in zip(*(t.indices.to_pylist() for t in texts), strict=True):
                s, t = sets[0][i], sets[1][j]
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], ["u", "v"])

    return of


def _crossed(percent: int, forest: bool):
    """Pairs of a tile's sets of different components that may be similar enough; rows are sorted by (k, x, y). With
    ``forest`` two components count as joined from their first pair on."""

    def compared(rows: list[tuple], square: bool) -> tuple[np.ndarray, np.ndarray] | None:
        doc, label, n = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 2))
        bits = folded([r[3] for r in rows])
        side = np.array([r[4] for r in rows])
        us, vs = [], []
        for i in range(len(rows)):
            if not square and side[i]:
                continue
            others = slice(i + 1, None) if square else np.flatnonzero(side == 1)
            differ = np.bitwise_count(bits[i] ^ bits[others]).sum(1, dtype=np.int64)
            ok = (label[others] != label[i]) & may_link(n[i], n[others], differ, percent)
            if ok.any():
                found = doc[others][ok]
                if forest:
                    joined, first = np.unique(label[others][ok], return_index=True)
                    found = found[first]
                    label[np.isin(label, joined)] = label[i]
                us.append(np.maximum(found, doc[i]))
                vs.append(np.minimum(found, doc[i]))
        return (np.concatenate(us), np.concatenate(vs)) if us else None

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in trimmed(batches):
            for k, x, y, side, doc, label, n, bits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (k, x, y) != now:
                    if len(rows) > 1 and (got := compared(rows, now[1] == now[2])):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], ["u", "v"])
                    now, rows = (k, x, y), []
                rows.append((doc, label, n, bits, side))
        if len(rows) > 1 and (got := compared(rows, now[1] == now[2])):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], ["u", "v"])

    return of


def _verified(pairs: DataFrame, docs: DataFrame, percent: int, length: int) -> DataFrame:
    """pairs: distinct (u, v), from a written table. The text of u goes to the rows of v, which may be many for one v."""
    ids = pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id"))).distinct()
    texts = written(by_ids(docs, ids, "left_semi"), "texts")
    one = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("one"))
    two = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("two"))
    found = written(pairs.join(one, "u").join(two, "v").select("u", "v", "one", "two").mapInArrow(_links(percent, length), "u long, v long").distinct(), "links")
    delete_written(texts)
    return found


def _tiles(members: DataFrame, labels: DataFrame, maps: DataFrame) -> DataFrame:
    """The members of tiles that hold several components. A large tile is cut into parts, and each pair of parts is a
    tile (k, x, y) of its own."""
    labelled = members.join(labels.withColumnRenamed("id", "doc"), "doc", "left").select("k", "doc", F.coalesce("component", "doc").alias("label"))
    mixed = labelled.groupBy("k").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    inside = labelled.join(mixed.select("k", "size"), "k").join(maps, "doc")
    inside = inside.withColumn("parts", F.ceil(F.col("size") / F.lit(TILE)).cast("int")).withColumn("part", F.pmod(F.hash("doc"), F.col("parts")))
    inside = inside.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    side = F.when(F.col("part") > F.col("with"), 1).otherwise(0).alias("side")
    return inside.select("k", F.least("part", "with").alias("x"), F.greatest("part", "with").alias("y"), side, "doc", "label", "n", "bitmap")


@dataclass
class _Found:
    """every: each row's doc and n. equal: (u, v), v the smallest document with u's set. star: pairs that may link, of smallest
    documents with their sets. members: tiles of three and more such documents, one of those that hold the same ones (in a tile of
    two, star has the pair). maps: sizes and bitmaps of all sets. tables: all written ones."""

    every: DataFrame
    equal: DataFrame
    star: DataFrame
    members: DataFrame
    maps: DataFrame
    tables: list[DataFrame]


def _found(docs: DataFrame, percent: int, length: int) -> _Found:
    """docs: doc_id and text."""
    n, tables = partitions(docs.sparkSession), []

    def kept(df: DataFrame, name: str) -> DataFrame:
        tables.append(written(df, name))
        return tables[-1]

    sets = kept(docs.mapInArrow(_sets(length), _SETS), "sets")
    often = sets.where("k IS NOT NULL").groupBy("k").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "k").limit(FREQUENT).collect()
    rank = {r["k"] % (1 << 64): len(often) - i for i, r in enumerate(often)}
    frequent = np.array(sorted(rank), np.uint64)
    rank = np.array([rank[k] for k in frequent.tolist()], np.uint64)
    every = sets.where("k IS NULL").select("doc", "n")
    named = sets.where("name IS NOT NULL")
    first = named.groupBy("name").agg(F.min("doc").alias("first"))
    far = named.select("name", "doc").join(first, "name").where("doc <> first").select(F.col("doc").alias("same"), F.col("first").alias("v"))
    near = sets.where("same <> doc").select("doc", "same").join(far, "same", "left").select(F.col("doc").alias("u"), F.coalesce("v", "same").alias("v"))
    equal = kept(near.unionByName(far.withColumnRenamed("same", "u")).distinct(), "equal")
    # A doc_id of several rows may be first with one of its sets only.
    gone = equal.groupBy("u").agg(F.min("v").alias("v")).join(first.select(F.col("first").alias("u")), "u", "left_anti")

    rows = docs.mapInArrow(_members(length, percent, frequent, rank), _MEMBERS).repartition(n, "key").sortWithinPartitions("key").mapInArrow(_met, _TILES)
    rows = kept(rows, "tiles")
    star = rows.where("doc <> other").select("doc", "other").distinct()
    star = star.join(gone.select(F.col("u").alias("doc"), F.col("v").alias("d")), "doc", "left").join(gone.select(F.col("u").alias("other"), F.col("v").alias("o")), "other", "left")
    u, v = F.coalesce("d", "doc"), F.coalesce("o", "other")
    star = star.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    maps = named.select("doc", "n", "bitmap")
    one, two = (maps.select(F.col("doc").alias(k), F.col("n").alias(f"n_{k}"), F.col("bitmap").alias(f"bitmap_{k}")) for k in "uv")
    star = star.join(one, "u").join(two, "v").select("u", "v", "n_u", "n_v", "bitmap_u", "bitmap_v").mapInArrow(_bounded(percent), "u long, v long")
    star = kept(star.distinct(), "pairs")

    firsts = rows.select("k", "doc").join(gone.select(F.col("u").alias("doc")), "doc", "left_anti")
    held = firsts.groupBy("k").agg(F.count("*").alias("size"), F.sum(F.xxhash64("doc").cast("decimal(20,0)")).alias("one"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("two"))
    held = held.where("size > 2").groupBy("size", "one", "two").agg(F.min("k").alias("k")).select("k")
    members = kept(firsts.join(held, "k"), "members")
    return _Found(every, equal, star, members, maps, tables)


def link(docs: DataFrame, percent: int = PERCENT, length: int = SHINGLE) -> DataFrame:
    """docs' (doc_id, text) as (doc_id, n_shingles, component_id): components of the documents whose sets of
    ``length``-word shingles have a Jaccard similarity of ``percent`` hundredths or more.

    One row for each row. A-Z are lower-cased, words are runs of anything but ASCII white space. A text of
    fewer words than a shingle is one shingle; a null text or one without words has none and is linked with nothing.
    component_id is the smallest doc_id that is reached by links. Rows without doc_id are linked with nothing, and their
    component_id is null. Rows with one doc_id are one document with any of their texts. Very long texts are taken whole;
    a worker holds one text's words at a time beside ROWS_BYTES. No rows give none. Other columns are ignored.
    """
    n = partitions(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _found(docs, percent, length)
    first = _verified(found.star, docs, percent, length)
    found.tables.append(first)
    labels = components(first.unionByName(found.equal))
    checked = found.star
    for forest in (True, False):
        crossed = _tiles(found.members, labels, found.maps).repartition(n, "k", "x", "y").sortWithinPartitions("k", "x", "y").mapInArrow(_crossed(percent, forest), "u long, v long")
        crossed = written(crossed.distinct().join(checked, ["u", "v"], "left_anti"), "pairs")
        found.tables.append(crossed)
        second = _verified(crossed, docs, percent, length)
        found.tables.append(second)
        if not second.isEmpty():
            labels = components(labels.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(second))
        checked = checked.unionByName(crossed)
    joined = found.every.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles")).join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    out = written(joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")), "linked")
    delete_written(*found.tables)
    return out


def pairs(docs: DataFrame, percent: int = PERCENT, length: int = SHINGLE) -> DataFrame:
    """docs' (doc_id, text) as (u, v), u > v: all pairs of documents whose sets are similar enough and differ.

    Of documents with equal sets the smallest doc_id stands for all. Rows without doc_id are in no pair. Unlike ``link`` this
    compares pairs inside a component too, so a group of different near copies costs the square of its size.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _found(docs, percent, length)
    apart = spark.createDataFrame([], "id long, component long")
    met = _tiles(found.members, apart, found.maps).repartition(n, "k", "x", "y").sortWithinPartitions("k", "x", "y").mapInArrow(_crossed(percent, False), "u long, v long")
    met = written(met.unionByName(found.star).distinct(), "pairs")
    out = _verified(met, docs, percent, length)
    delete_written(*found.tables, met)
    return out
