"""History from a repository's object store: a data source of objects, and commits and their files from it by joins.

No program is run. Loose objects and packs, with their deltas, are read by the executors, so the repository has to lie on a
file system that all of them have. Packs are read in ranges of their index; blobs aren't unpacked unless asked for.
"""

from __future__ import annotations

import mmap
import os
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessella.operators import insights
from tessella.sources.shared import stored

#: Commits of a log, objects of a partition, bytes of unpacked bases that a task keeps, and bytes of a batch.
COMMITS, OBJECTS, KEPT, BATCH = 2000, 20_000, 64 << 20, 8 << 20

_TYPES = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
_SCHEMA = "sha string, kind string, data binary"


def directory(root: str) -> str:
    """The folder of a working tree's or a bare repository's objects and refs."""
    own = os.path.join(root, ".git")
    if os.path.isfile(own):
        with open(own) as f:
            own = os.path.normpath(os.path.join(root, f.read().partition(":")[2].strip()))
    found = own if os.path.isdir(own) else root
    common = os.path.join(found, "commondir")
    if os.path.isfile(common):
        with open(common) as f:
            found = os.path.normpath(os.path.join(found, f.read().strip()))
    if not os.path.isdir(os.path.join(found, "objects")):
        raise FileNotFoundError(f"no repository at {root}")
    return found


def resolve(root: str, ref: str = "HEAD") -> str | None:
    """The commit that a ref names, by way of others; None of one that isn't born."""
    base = directory(root)
    for _ in range(8):
        path = os.path.join(base, ref)
        value = None
        if os.path.isfile(path):
            with open(path) as f:
                value = f.read().strip()
        elif os.path.isfile(packed := os.path.join(base, "packed-refs")):
            with open(packed) as f:
                value = next((x.split(" ")[0] for x in f.read().splitlines() if x.endswith(f" {ref}")), None)
        if value is None or not value.startswith("ref:"):
            return value or (ref if len(ref) == 40 and set(ref) <= set("0123456789abcdef") else None)
        ref = value.partition(":")[2].strip()
    return None


class Pack:
    """A pack file with its index."""

    def __init__(self, path: str):
        with open(path.removesuffix(".pack") + ".idx", "rb") as f:
            index = f.read()
        if index[:8] != b"\xfftOc\0\0\0\2":
            raise ValueError(f"{path}: only version 2 of pack indexes is read")
        n = struct.unpack_from(">I", index, 8 + 255 * 4)[0]
        names, small = 8 + 1024, 8 + 1024 + 24 * n
        offsets = []
        for i in range(n):
            at = struct.unpack_from(">I", index, small + 4 * i)[0]
            offsets.append(struct.unpack_from(">Q", index, small + 4 * n + 8 * (at & 0x7FFFFFFF))[0] if at >> 31 else at)
        self.at = {index[names + 20 * i : names + 20 * i + 20]: o for i, o in enumerate(offsets)}
        self.names = sorted((o, s.hex()) for s, o in self.at.items())
        with open(path, "rb") as f:
            self.data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        # An object ends where the next one begins; the last 20 bytes are the pack's own digest.
        self.ends = dict(zip([o for o, _ in self.names], [*[o for o, _ in self.names[1:]], len(self.data) - 20], strict=True))
        self.bases: OrderedDict[int, tuple[int, bytes]] = OrderedDict()
        self.held = 0

    def _head(self, at: int) -> tuple[int, int | None, int]:
        """(type, place of the base or None, where the packed bytes begin)."""
        start, c = at, self.data[at]
        kind = c >> 4 & 7
        while c & 0x80:
            at += 1
            c = self.data[at]
        at += 1
        if kind == 6:
            c = self.data[at]
            back = c & 0x7F
            while c & 0x80:
                at += 1
                c = self.data[at]
                back = (back + 1 << 7) | (c & 0x7F)
            return kind, start - back, at + 1
        if kind == 7:
            return kind, self.at[self.data[at : at + 20]], at + 20
        return kind, None, at

    def kind(self, at: int) -> str:
        kind, base, _ = self._head(at)
        while base is not None:
            kind, base, _ = self._head(base)
        return _TYPES[kind]

    def read(self, at: int) -> bytes:
        """An object's bytes: the base at its chain's end, and the deltas on it."""
        chain = []
        place = at
        while place not in self.bases:
            _, base, begins = self._head(place)
            chain.append((place, begins))
            if base is None:
                break
            place = base
        out = self.bases[place][1] if place in self.bases else None
        for place, begins in reversed(chain):
            unpacked = zlib.decompress(self.data[begins : self.ends[place]])
            out = unpacked if out is None else _patched(out, unpacked)
            self._keep(place, out)
        return out

    def _keep(self, place: int, data: bytes) -> None:
        self.bases[place] = (len(data), data)
        self.held += len(data)
        while self.held > KEPT and len(self.bases) > 1:
            self.held -= self.bases.popitem(last=False)[1][0]


def _patched(base: bytes, delta: bytes) -> bytes:
    """A delta's target: copies from the base, and bytes of its own."""
    at = 0
    for _ in range(2):
        while delta[at] & 0x80:
            at += 1
        at += 1
    out = []
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 0x80:
            place = size = 0
            for i in range(4):
                if op >> i & 1:
                    place |= delta[at] << 8 * i
                    at += 1
            for i in range(3):
                if op >> (4 + i) & 1:
                    size |= delta[at] << 8 * i
                    at += 1
            out.append(base[place : place + (size or 0x10000)])
        else:
            out.append(delta[at : at + op])
            at += op
    return b"".join(out)


@dataclass
class _Part(InputPartition):
    """A folder of loose objects, or a range of a pack's objects by place."""

    path: str
    first: int = 0
    last: int = -1


class GitObjects(DataSource):
    """Objects of a repository (option ``path``); option ``kinds``: those to read, commit and tree unless said."""

    @classmethod
    def name(cls) -> str:
        return "git_objects"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("kinds", "commit,tree").split(","))


class _Reader(DataSourceReader):
    def __init__(self, path: str, kinds: list[str]):
        self.objects, self.kinds = os.path.join(directory(path), "objects"), kinds

    def partitions(self) -> list[_Part]:
        out = [_Part(p) for x in sorted(os.listdir(self.objects)) if len(x) == 2 and os.path.isdir(p := os.path.join(self.objects, x))]
        packs = os.path.join(self.objects, "pack")
        for x in sorted(os.listdir(packs)) if os.path.isdir(packs) else []:
            index = os.path.join(packs, x.removesuffix(".pack") + ".idx")
            if x.endswith(".pack") and os.path.isfile(index):
                with open(index, "rb") as f:
                    n = struct.unpack_from(">I", f.read(8 + 1024), 8 + 255 * 4)[0]
                out += [_Part(os.path.join(packs, x), i, min(i + OBJECTS, n)) for i in range(0, n, OBJECTS)]
        return out

    def _found(self, part: _Part) -> Iterator[tuple[str, str, bytes]]:
        if part.last < 0:
            for name in sorted(os.listdir(part.path)):
                if len(name) == 38:
                    with open(os.path.join(part.path, name), "rb") as f:
                        packed = f.read()
                    head = zlib.decompressobj().decompress(packed, 64)
                    kind = head.partition(b" ")[0].decode()
                    if kind in self.kinds:
                        yield os.path.basename(part.path) + name, kind, zlib.decompress(packed).partition(b"\0")[2]
            return
        pack = Pack(part.path)
        for at, sha in pack.names[part.first : part.last]:
            if (kind := pack.kind(at)) in self.kinds:
                yield sha, kind, pack.read(at)

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in self._found(part):
            rows.append(row)
            size += len(row[2]) + 100
            if size > BATCH:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple[str, str, bytes]]) -> pa.RecordBatch:
    sha, kind, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(sha), pa.array(kind), pa.array(data, pa.binary())], names=["sha", "kind", "data"])


def objects(spark: SparkSession, root: str, kinds: str = "commit,tree") -> DataFrame:
    """(sha, kind, data), each object once: it may lie in several packs."""
    spark.dataSource.register(GitObjects)
    return spark.read.format("git_objects").option("path", root).option("kinds", kinds).load().dropDuplicates(["sha"])


_COMMIT = "sha string, tree string, parents array<string>, author string, authored long, committed long, message string"
_ENTRY = "tree string, mode string, name string, sha string"


def commits(found: DataFrame) -> DataFrame:
    """(sha, tree, parents, author, authored, committed, message) of commit objects; times in seconds."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for sha, data in zip(b["sha"], b["data"], strict=True):
                head, _, message = bytes(data).decode("utf-8", "replace").partition("\n\n")
                fields = [x.partition(" ") for x in head.split("\n") if not x.startswith(" ")]
                one = {k: v for k, _, v in reversed(fields)}
                seconds = {k: int(one[k].rsplit(" ", 2)[1]) for k in ("author", "committer")}
                rows.append((sha, one["tree"], [v for k, _, v in fields if k == "parent"], one["author"].rsplit(" ", 2)[0], seconds["author"], seconds["committer"], message))
            yield pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in _COMMIT.split(",")])

    return found.where("kind = 'commit'").select("sha", "data").mapInPandas(parse, _COMMIT)


def entries(found: DataFrame) -> DataFrame:
    """(tree, mode, name, sha) of what trees hold."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for tree, data in zip(b["sha"], b["data"], strict=True):
                data, at = bytes(data), 0
                while at < len(data):
                    blank, end = data.index(b" ", at), data.index(b"\0", at)
                    rows.append((tree, data[at:blank].decode(), data[blank + 1 : end].decode("utf-8", "replace"), data[end + 1 : end + 21].hex()))
                    at = end + 21
            yield pd.DataFrame(rows, columns=["tree", "mode", "name", "sha"])

    return found.where("kind = 'tree'").select("sha", "data").mapInPandas(parse, _ENTRY)


def reachable(known: DataFrame, head: str) -> DataFrame:
    """(sha) of commits from head on. Steps double: after k turns all within 2 ** k steps are found, so a long history takes few turns."""
    step = stored(known.select(F.col("sha").alias("a"), F.explode("parents").alias("b")))
    found = known.where(F.col("sha") == head).select("sha")
    while step.limit(1).count():
        found = stored(found.unionByName(found.join(step, F.col("sha") == F.col("a")).select(F.col("b").alias("sha"))).distinct())
        far = step.select(F.col("a").alias("x"), F.col("b").alias("a")).join(step, "a").select(F.col("x").alias("a"), "b")
        step = stored(far.distinct())
    return found


def changes(known: DataFrame, held: DataFrame) -> DataFrame:
    """(commit, path, status, sha, before) of commits (sha, tree, parents) without or with one parent: files added (A), changed (M) or gone (D).

    Trees are compared level by level, and where both sides hold the same tree no further; a file that is gone from one path and
    whole at a new one has moved, and counts there alone.
    """
    trees = known.select(F.col("sha").alias("parent"), F.col("tree").alias("old"))
    own = known.where(F.size("parents") <= 1).select(F.col("sha").alias("commit"), F.get("parents", F.lit(0)).alias("parent"), F.col("tree").alias("new"))
    # Of a parent that isn't there, as at the edge of a shallow copy, nothing is known: the commit is the first one.
    level = own.join(trees, "parent", "left").select("commit", F.lit("").alias("above"), "new", "old").where("NOT new <=> old")
    side = lambda c: held.select(F.col("tree").alias(c), "name", F.struct("mode", "sha").alias(f"{c}_e"))
    out = None
    while True:
        level = stored(level)
        if not level.limit(1).count():
            break
        now, was = (level.select("commit", "above", c).join(side(c), c).drop(c) for c in ("new", "old"))
        met = now.join(was, ["commit", "above", "name"], "full").where("NOT new_e <=> old_e")
        path = F.concat("above", "name")
        tree = lambda c: F.when(F.col(f"{c}_e.mode").isin("40000", "040000"), F.col(f"{c}_e.sha"))
        file = lambda c: F.when(~F.col(f"{c}_e.mode").isin("40000", "040000"), F.col(f"{c}_e.sha"))
        sides = stored(met.select("commit", path.alias("path"), tree("new").alias("new"), tree("old").alias("old"), file("new").alias("sha"), file("old").alias("before")))
        files = sides.where("sha IS NOT NULL OR before IS NOT NULL").select("commit", "path", F.expr("CASE WHEN sha IS NULL THEN 'D' WHEN before IS NULL THEN 'A' ELSE 'M' END").alias("status"), "sha", "before")
        out = files if out is None else out.unionByName(files)
        level = sides.where("NOT new <=> old").select("commit", F.concat("path", F.lit("/")).alias("above"), "new", "old")
    if out is None:
        return level.select("commit", F.lit("").alias("path"), F.lit("").alias("status"), "new", "old").toDF("commit", "path", "status", "sha", "before").where("false")
    order = Window.partitionBy("commit", "blob", "status").orderBy("path")
    numbered = out.withColumn("blob", F.coalesce("sha", "before")).withColumn("n", F.row_number().over(order))
    added = numbered.where("status = 'A'").select("commit", "blob", "n", F.lit("D").alias("status"))
    return numbered.join(added, ["commit", "blob", "n", "status"], "left_anti").select("commit", "path", "status", "sha", "before")


def log(spark: SparkSession, root: str, limit: int = COMMITS, ref: str = "HEAD", under: str = "") -> DataFrame:
    """(commit, time, path) of the newest commits from ref on that have no second parent and change a file below ``under``: each with
    its changed files there. Newest by their time, ties by their name. A ref that isn't born has none. Files that moved are told by
    equal contents alone."""
    head = resolve(root, ref)
    if head is None:
        return spark.createDataFrame([], "commit string, time long, path string")
    found = stored(objects(spark, root))
    known = stored(commits(found))
    live = known.join(reachable(known, head), "sha")
    changed = changes(live, stored(entries(found)))
    if under.strip("/"):
        changed = changed.where(F.startswith("path", F.lit(under.strip("/") + "/")))
    changed = stored(changed)
    newest = known.select(F.col("sha").alias("commit"), F.col("committed").alias("time")).join(changed.select("commit").distinct(), "commit").orderBy(F.desc("time"), "commit").limit(limit)
    return changed.join(F.broadcast(newest), "commit").select("commit", "time", "path")


def co_change(spark: SparkSession, root: str, limit: int = COMMITS, under: str = "", most: int = 50) -> DataFrame:
    """(path_a, path_b, n) of files that changed together, by paths on disk; see ``insights.co_change``."""
    top = root.rstrip("/")
    rows = log(spark, root, limit, under=under)
    return insights.co_change(rows.select("commit", F.concat(F.lit(f"{top}/"), "path").alias("path")), most)
