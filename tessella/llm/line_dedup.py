"""Lines that many documents share, kept in the last of them: an index that documents enter and leave again.

The index has, for each line's key (128 bits of it), an exact row with the number of documents that hold it and the last of
them, and for each of SHARDS shards a cuckoo filter of the keys that repeat often enough. Lines ask the filter first, so only
lines that may repeat meet the exact table. A deletion lowers the counts and takes fingerprints out of the filter, and the
lines of other documents come back.
"""

from __future__ import annotations

import hashlib
import random
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import cut

#: Shards of the index, each with a filter of its own.
SHARDS = 256
#: A bucket has four fingerprints of 16 bits. A filter is made anew, larger, once it would be fuller than this.
LANES, FULLEST = 4, 0.85
#: Moves before a key goes to the stash, a list beside the filter.
MOVES = 200
#: Parts that a hot key's lines are dealt to.
SALTS = 8
#: Bytes of text that a task holds as lines at once.
SLICE = 4_000_000

_BLANK = b" \t\n\x0b\x0c\r"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _key(line: bytes, least_chars: int) -> bytes | None:
    """128 bits of a line without blanks at its ends, A-Z in lower case; None of a shorter one."""
    line = line.strip(_BLANK)
    if len(line) < least_chars or (len(line) < 4 * least_chars and len(line.decode()) < least_chars):
        return None
    return hashlib.md5(line.translate(_LOWER), usedforsecurity=False).digest()


def _lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(hi, lo, doc_id) of the distinct keys of each row. Rows without doc_id have none."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, 1, SLICE):
            ids, keys = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                own = {k for x in (t.as_py() or b"").split(b"\n") if (k := _key(x, least_chars))}
                keys += own
                ids += [d] * len(own)
            halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(ids, pa.int64())], names=["hi", "lo", "doc_id"])

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(explode, "hi long, lo long, doc_id long")


# Where a key lies in a filter, for columns and for integers alike.
def _shard(hi: Column) -> Column:
    return F.pmod(hi, F.lit(SHARDS)).cast("int")


def _print(lo: int) -> int:
    return max(lo & 0xFFFF, 1)


def _other(place: int, mark: int, mask: int) -> int:
    return place ^ ((mark * 0x5BD1E995) & mask)


class CuckooFilter:
    """Fingerprints of keys (hi, lo) in buckets of four, each key in one of two buckets; keys that find no room are in the stash."""

    def __init__(self, buckets: np.ndarray, stash: list[int] = (), n: int = 0):
        self.lanes = buckets.view(np.uint16).reshape(-1, LANES)
        self.mask, self.stash, self.n = len(self.lanes) - 1, list(stash), n

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        """An empty filter with room for twice as many keys."""
        return cls(np.zeros(1 << max(1, int(2 * n / LANES / FULLEST)).bit_length(), np.uint64))

    def _places(self, hi: int, lo: int) -> tuple[int, int, int]:
        mark, first = _print(lo), ((hi & (1 << 64) - 1) >> 16) & self.mask
        return mark, first, _other(first, mark, self.mask)

    def _put(self, place: int, mark: int) -> bool:
        free = np.flatnonzero(self.lanes[place] == 0)
        if len(free):
            self.lanes[place, free[0]] = mark
        return len(free) > 0

    def add(self, hi: int, lo: int) -> None:
        """Puts a key in that is not in the filter yet."""
        self.n += 1
        mark, first, second = self._places(hi, lo)
        if self._put(first, mark) or self._put(second, mark):
            return
        moves, place, rng = [], first, random.Random(lo)
        for _ in range(MOVES):
            lane = rng.randrange(LANES)
            moves.append((place, lane, int(self.lanes[place, lane])))
            self.lanes[place, lane], mark = mark, moves[-1][2]
            place = _other(place, mark, self.mask)
            if self._put(place, mark):
                return
        for place, lane, mark in reversed(moves):
            self.lanes[place, lane] = mark
        self.stash.append(lo)

    def remove(self, hi: int, lo: int) -> None:
        """Takes a key out that is in the filter."""
        self.n -= 1
        if lo in self.stash:
            self.stash.remove(lo)
            return
        mark, first, second = self._places(hi, lo)
        for place in (first, second):
            held = np.flatnonzero(self.lanes[place] == mark)
            if len(held):
                self.lanes[place, held[0]] = 0
                return
        raise KeyError((hi, lo))

    def __contains__(self, key: tuple[int, int]) -> bool:
        mark, first, second = self._places(*key)
        return key[1] in self.stash or mark in self.lanes[first] or mark in self.lanes[second]

    @property
    def buckets(self) -> np.ndarray:
        return self.lanes.reshape(-1).view(np.int64)


def _may_hold() -> Column:
    """Whether a filter's row (buckets, stash) may hold the key (hi, lo): what CuckooFilter says, as columns."""
    mark = F.greatest(F.col("lo").bitwiseAND(F.lit(0xFFFF)), F.lit(1))
    mask = F.size("buckets") - 1
    first = F.shiftrightunsigned("hi", 16).bitwiseAND(mask)
    second = first.bitwiseXOR((mark * 0x5BD1E995).bitwiseAND(mask))
    held = F.array_contains("stash", F.col("lo"))
    for place in (first, second):
        bucket = F.get("buckets", place.cast("int"))
        for lane in range(LANES):
            held |= F.shiftrightunsigned(bucket, 16 * lane).bitwiseAND(F.lit(0xFFFF)) == mark
    return held


_FILTER = "shard int, buckets array<long>, stash array<long>, n long"
_FILTER_ARROW = pa.schema([("shard", pa.int32()), ("buckets", pa.list_(pa.int64())), ("stash", pa.list_(pa.int64())), ("n", pa.int64())])


def _turned(old: pa.Table, changes: pa.Table) -> pa.Table:
    """A shard's filter after its changes (shard, hi, lo, held: whether the key is to be in it). Without an old one, of all keys anew."""
    hi, lo, held = (changes.column(c).to_pylist() for c in ("hi", "lo", "held"))
    if old.num_rows:
        o = old.to_pylist()[0]
        out = CuckooFilter(np.array(o["buckets"], np.int64).view(np.uint64), o["stash"], o["n"])
        shard = o["shard"]
    else:
        out, shard = CuckooFilter.sized(sum(held)), changes.column("shard")[0].as_py()
    for h, x, keep in zip(hi, lo, held, strict=True):
        (out.add if keep else out.remove)(h, x)
    return pa.table([[shard], [out.buckets.tolist()], [out.stash], [out.n]], schema=_FILTER_ARROW)


class LineIndex:
    """The index of lines in a folder that all executors share.

    Each change writes its own tables and then one row of the manifest that names them, so a change counts whole or not at
    all; a writer that was stopped leaves tables that nobody reads. One writer at a time.

    Keys of at least ``least_chars`` code points that at least ``least_docs`` documents hold lose their lines in all but the
    largest doc_id. Documents are known by doc_id: rows that share one are one document, a row without one is none and keeps
    its lines. Null and empty texts are one empty line. Very long texts are taken whole, each by itself.
    """

    def __init__(self, spark: SparkSession, path: str, least_docs: int = 3, least_chars: int = 20):
        self.spark, self.path, self.least_docs, self.least_chars = spark, path.rstrip("/"), least_docs, least_chars
        self._known: list | None = None

    # -- tables ---------------------------------------------------------------------------------------------------------

    _SCHEMAS = {
        "postings": "hi long, lo long, doc_id long, v int",
        "gone": "doc_id long, v int",
        "counts": "hi long, lo long, n long, last long, v int",
        "filters": _FILTER,
    }

    def _versions(self) -> list:
        if self._known is None:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
            there = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)
            self._known = sorted(self.spark.read.parquet(f"{self.path}/manifest").collect(), key=lambda r: r.v) if there else []
        return self._known

    def _read(self, kind: str) -> DataFrame | None:
        paths = [p for r in self._versions() if (p := r[kind])]
        if kind == "filters":
            paths = paths[-1:]
        return self.spark.read.schema(self._SCHEMAS[kind]).parquet(*paths) if paths else None

    def _write(self, df: DataFrame, kind: str) -> str:
        path = f"{self.path}/{kind}/{uuid.uuid4().hex}"
        df.select(*[x.split(" ")[0] for x in self._SCHEMAS[kind].split(", ")]).write.parquet(path)
        return path

    def _open(self, path: str, kind: str) -> DataFrame:
        return self.spark.read.schema(self._SCHEMAS[kind]).parquet(path)

    def postings(self) -> DataFrame | None:
        """(hi, lo, doc_id) of the documents in the index, without those that have left since they came."""
        rows, gone = self._read("postings"), self._read("gone")
        if rows is None or gone is None:
            return rows and rows.drop("v")
        left = gone.groupBy("doc_id").agg(F.max("v").alias("left"))
        return rows.join(left, "doc_id", "left").where("left IS NULL OR v > left").select("hi", "lo", "doc_id")

    def counts(self) -> DataFrame | None:
        """(hi, lo, n, last) of every key that some document holds: the number of documents and the largest doc_id."""
        rows = self._read("counts")
        if rows is None:
            return None
        if len([r for r in self._versions() if r.counts]) == 1:
            return rows.drop("v")
        now = rows.groupBy("hi", "lo").agg(F.max_by(F.struct("n", "last"), "v").alias("x"))
        return now.where("x.n > 0").select("hi", "lo", "x.n", "x.last")

    # -- changes --------------------------------------------------------------------------------------------------------

    def _commit(self, v: int, **paths: str) -> None:
        row = [(v, *[paths.get(k) for k in self._SCHEMAS])]
        self.spark.createDataFrame(row, "v int, " + ", ".join(f"{k} string" for k in self._SCHEMAS)).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self._known = None

    def insert(self, docs: DataFrame) -> None:
        """Takes documents (doc_id, text) in. Keys that a doc_id has in the index already count once."""
        v = len(self._versions())
        old, counts = self.postings(), self.counts()
        rows = _lines(docs, self.least_chars).distinct()
        if old is not None:
            rows = rows.join(old, ["hi", "lo", "doc_id"], "left_anti")
        postings = self._write(rows.withColumn("v", F.lit(v)), "postings")
        new = self._open(postings, "postings").groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
        if counts is not None:
            was = counts.select("hi", "lo", F.col("n").alias("was"), F.col("last").alias("before"))
            new = new.join(was, ["hi", "lo"], "left").select("hi", "lo", F.expr("n + coalesce(was, 0) AS n"), F.greatest("last", "before").alias("last"))
        self._recount(v, new, counts, postings=postings)

    def delete(self, ids: DataFrame) -> None:
        """Takes documents out by doc_id. Ids that the index doesn't hold change nothing."""
        v = len(self._versions())
        old, counts = self.postings(), self.counts()
        if old is None:
            return
        gone = self._write(ids.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(v).alias("v")).distinct(), "gone")
        left = self._open(gone, "gone").select("doc_id", F.lit(True).alias("left"))
        marked = old.join(left, "doc_id", "left")
        keys = marked.groupBy("hi", "lo").agg(F.max("left").alias("hit"), F.count(F.when(F.col("left").isNull(), 1)).alias("n"), F.max(F.when(F.col("left").isNull(), F.col("doc_id"))).alias("last"))
        self._recount(v, keys.where("hit").select("hi", "lo", "n", "last"), counts, gone=gone)

    def _recount(self, v: int, new: DataFrame, counts: DataFrame | None, **paths: str) -> None:
        """Writes the new counts of changed keys, and the filters of their shards."""
        where = self._write(new.withColumn("v", F.lit(v)), "counts")
        new = self._open(where, "counts")
        held = F.col("n") >= self.least_docs
        changes = new.select("hi", "lo", held.alias("held"))
        if counts is not None:
            was = counts.select("hi", "lo", held.alias("was"))
            changes = changes.join(was, ["hi", "lo"], "left").where("held <> coalesce(was, false)").select("hi", "lo", "held")
        else:
            changes = changes.where("held")
        changes = changes.select(_shard(F.col("hi")).alias("shard"), "hi", "lo", "held")
        filters = self._read("filters")
        if filters is not None:
            # Shards whose filter would be too full are made anew from the exact table.
            more = changes.groupBy("shard").agg(F.sum(F.when(F.col("held"), 1).otherwise(-1)).alias("more"))
            full = more.join(filters.select("shard", "n", F.size("buckets").alias("m")), "shard").where(F.col("n") + F.col("more") > FULLEST * LANES * F.col("m")).select("shard")
            changed = new.select("hi", "lo", "n")
            now = counts.join(changed.select("hi", "lo"), ["hi", "lo"], "left_anti").select("hi", "lo", "n").unionByName(changed)
            whole = now.where(held).select(_shard(F.col("hi")).alias("shard"), "hi", "lo", F.lit(True).alias("held"))
            changes = changes.join(full, "shard", "left_anti").unionByName(whole.join(full, "shard", "left_semi"))
            filters = filters.join(full, "shard", "left_anti")
        else:
            filters = self.spark.createDataFrame([], _FILTER)
        turned = filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(_turned, _FILTER)
        self._commit(v, counts=where, filters=self._write(turned, "filters"), **paths)

    # -- answers --------------------------------------------------------------------------------------------------------

    def candidates(self) -> DataFrame:
        """(hi, lo, doc_id) of lines that the filters don't rule out."""
        rows = self.postings().withColumn("shard", _shard(F.col("hi"))).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        filters = self._read("filters").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
        return rows.join(filters, ["shard", "salt"]).where(_may_hold()).select("hi", "lo", "doc_id", "salt")

    def dropped(self) -> DataFrame:
        """(doc_id, keys) of documents that lose lines: the keys of those lines, as bytes."""
        exact = self.counts().where(F.col("n") >= self.least_docs).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
        lost = self.candidates().join(exact, ["hi", "lo", "salt"]).where("doc_id < last")
        return lost.groupBy("doc_id").agg(F.collect_list(F.struct("hi", "lo")).alias("keys"))

    def keep(self, docs: DataFrame, digest: bool = False) -> DataFrame:
        """docs' rows (doc_id, n_lines, n_dropped, kept): the lines that stay, joined by newlines, or with ``digest`` kept_sha256.

        docs: doc_id and text of documents in the index; other columns play no part. An empty table has no rows.
        """
        least = self.least_chars

        def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in cut(batches, 1, SLICE):
                numbers, out = [], []
                for t, keys in zip(b.column(1).cast(pa.binary()), b.column(2), strict=True):
                    kept = lines = (t.as_py() or b"").split(b"\n")
                    if keys.is_valid:
                        halves = [keys.values.field(k).to_numpy(zero_copy_only=False).astype("<i8") for k in (0, 1)]
                        lost = np.stack(halves, 1).tobytes()
                        lost = {lost[i : i + 16] for i in range(0, len(lost), 16)}
                        kept = [x for x in lines if _key(x, least) not in lost]
                    numbers.append((len(lines), len(lines) - len(kept)))
                    text = b"\n".join(kept)
                    out.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
                n, m = zip(*numbers, strict=True) if numbers else ((), ())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_lines", "n_dropped", name])

        name = "kept_sha256" if digest else "kept"
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        joined = rows.join(self.dropped(), "doc_id", "left").select("doc_id", "text", "keys")
        return joined.mapInArrow(rebuild, f"doc_id long, n_lines long, n_dropped long, {name} string")


def dedup_lines(docs: DataFrame, path: str, digest: bool = False, least_docs: int = 3, least_chars: int = 20) -> DataFrame:
    """All documents put into a new index at path, and what is left of them: see ``LineIndex``."""
    index = LineIndex(docs.sparkSession, path, least_docs, least_chars)
    index.insert(docs)
    return index.keep(docs, digest)
