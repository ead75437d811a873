"""All tables of the model as one store of versions: a change of several tables counts whole or not at all.

A table is dealt to buckets by a hash of its path; a change writes the buckets that it touches anew, and then one small file that
names, for every table, the folder of each bucket. That file is made only where its version isn't there yet, so of two
writers from one version one wins and the other begins again. Folders of changes that never counted are read by nobody.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import paths
from tessella.schema import SCHEMAS

#: Buckets of a table.
BUCKETS = 64
#: Tables that follow a path, and the column that has it; ``co_change`` has two.
CHILDREN = {
    "chunks": "entry_path", "edges": "from_path", "symbols": "path", "note_anchors": "note_path", "summaries": "path", "summary_queue": "path", "classifications": "path", "directory_apps": "path",
}
KEYS = CHILDREN | {"entries": "path", "co_change": "path_a"}
#: What a file's new content replaces.
CONTENTS = ("entries", "chunks", "edges", "symbols")

#: Stores without an exclusive creation of their own, such as a local disk, are at least safe within a process.
_LOCK = threading.Lock()


class Conflict(Exception):
    """Another writer was first."""


@dataclass
class Version:
    number: int = 0
    #: Of each table the folder of each bucket.
    folders: dict[str, dict[str, str]] = field(default_factory=dict)
    #: The last batch of each stream that the tables hold.
    batches: dict[str, int] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, number: int):
        return self._fs_path(f"{self.path}/versions/{number:012d}.json")

    def version(self) -> Version:
        """The newest version."""
        top = self._fs_path(f"{self.path}/versions")
        numbers = [int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(top)] if self._fs.exists(top) else []
        if not numbers:
            return Version()
        for wait in range(50):
            stream = self._fs.open(self._file(max(numbers)))
            try:
                text = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
            finally:
                stream.close()
            if text.endswith("\n"):
                return Version(**json.loads(text))
            # Its writer isn't through with it.
            time.sleep(0.02 * (wait + 1))
        raise OSError(f"version {max(numbers)} of {self.path} was never finished")

    def _commit(self, new: Version) -> None:
        with _LOCK:
            try:
                if self._fs.exists(self._file(new.number)):
                    raise Conflict
                out = self._fs.create(self._file(new.number), False)
            except Py4JJavaError as e:
                raise Conflict from e
            out.write(bytearray((json.dumps(vars(new)) + "\n").encode()))
            out.close()

    def table(self, name: str, at: Version | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table's rows, of some buckets alone where they are given."""
        at = at or self.version()
        held = at.folders.get(name, {})
        folders = [p for b, p in held.items() if buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*folders)

    def change(self, changes: dict[str, Callable[[DataFrame], tuple[DataFrame, DataFrame]]], stream: str | None = None, batch: int = 0, at: Version | None = None) -> Version:
        """One version on: for each table a function from its rows to (rows that go, rows that come). Of the rows that go the whole
        rows are given, so that each falls into its bucket; equal rows go together.

        A batch of a stream that the tables hold already changes nothing.
        """
        at = at or self.version()
        if stream is not None and at.batches.get(stream, -1) >= batch:
            return at
        new = Version(at.number + 1, {t: dict(f) for t, f in at.folders.items()}, dict(at.batches))
        if stream is not None:
            new.batches[stream] = batch
        for name, of in changes.items():
            key, columns = KEYS.get(name, SCHEMAS[name].names[0]), SCHEMAS[name].names
            bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(BUCKETS)).cast("int")
            gone, come = (df.select(*columns).withColumn("bucket", bucket) for df in of(self.table(name, at)))
            come = come.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]], "bucket")
            touched = [r.bucket for r in gone.select("bucket").unionByName(come.select("bucket")).distinct().collect()]
            if not touched:
                continue
            # Rows may hold arrays, so they are compared by a digest of the whole.
            digest = F.sha2(F.to_json(F.struct(*columns)), 256)
            kept = self.table(name, at, touched).withColumns({"bucket": bucket, "digest": digest}).join(gone.select(digest.alias("digest")).distinct(), "digest", "left_anti").drop("digest")
            folder = f"{self.path}/{name}/{uuid.uuid4().hex}"
            kept.unionByName(come).repartition("bucket").write.partitionBy("bucket").parquet(folder)
            there = {s.getPath().getName() for s in self._fs.listStatus(self._fs_path(folder))}
            own = new.folders.setdefault(name, {})
            for b in touched:
                own.pop(str(b), None)
                if f"bucket={b}" in there:
                    own[str(b)] = f"{folder}/bucket={b}"
        self._commit(new)
        return new


def _below(rows: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """rows at or below one of the paths of gone (path): by their own ancestors, so no path is compared with all."""
    marked = rows.withColumn("__up", paths.ancestors(column, self_too=True))
    hit = marked.select(F.col(column).alias("__p"), F.explode("__up").alias("path")).distinct().join(gone, "path", "left_semi").select("__p").distinct()
    return rows.join(hit, F.col(column).eqNullSafe(F.col("__p")), "left_semi")


def cascade(gone: DataFrame) -> dict[str, Callable[[DataFrame], tuple[DataFrame, DataFrame]]]:
    """The changes that take paths (path), with all that lies below them, out of the entries and of every table that follows them."""
    out = {t: (lambda rows, c=c: (_below(rows, c, gone), rows.limit(0))) for t, c in (CHILDREN | {"entries": "path"}).items()}
    out["co_change"] = lambda rows: (_below(rows, "path_a", gone).unionByName(_below(rows, "path_b", gone)).distinct(), rows.limit(0))
    return out


def pending(changed: DataFrame, now: int) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """The change that puts changed files (path) and all directories above them into the summary queue again."""
    up = changed.select(F.explode(paths.ancestors("path")).alias("path")).distinct().withColumn("kind", F.lit("dir"))
    wanted = changed.select("path").distinct().withColumn("kind", F.lit("file")).unionByName(up)
    stamp = F.lit(now).cast("long")
    rows = wanted.select("path", "kind", paths.depth("path").cast("long").alias("depth"), F.lit("pending").alias("state"), F.lit(0).cast("long").alias("attempts"), stamp.alias("enqueued_at"), stamp.alias("updated_at"), F.lit(None).cast("string").alias("error"))
    return lambda queue: (queue.join(rows.select("path"), "path", "left_semi"), rows)


def claim(store: Store, now: int, most: int = 1, tries: int = 20) -> list[tuple[str, str]]:
    """(path, kind) of up to ``most`` pending items, now in flight and nobody else's: the deepest first, ties by path, and no directory
    below which anything is still pending or in flight."""
    for _ in range(tries):
        at = store.version()
        queue = store.table("summary_queue", at)
        busy = queue.where("state IN ('pending', 'in_flight')").select(F.explode(paths.ancestors("path")).alias("path")).distinct()
        free = queue.where("state = 'pending'").join(busy, "path", "left_anti").orderBy(F.desc("depth"), "path").limit(most)
        taken = [(r.path, r.kind) for r in free.collect()]
        if not taken:
            return []
        own = store.spark.createDataFrame([(p,) for p, _ in taken], "path string")
        try:
            store.change({"summary_queue": lambda q, own=own: _updated(q.join(F.broadcast(own), "path", "left_semi"), {"state": F.lit("in_flight"), "attempts": F.col("attempts") + 1}, now)}, at=at)
        except Conflict:
            continue
        return taken
    raise Conflict


def _updated(rows: DataFrame, values: dict[str, Column], now: int) -> tuple[DataFrame, DataFrame]:
    return rows, rows.withColumns(values | {"updated_at": F.lit(now).cast("long")})


def finish(store: Store, path: str, state: str, now: int, error: str | None = None, tries: int = 20) -> None:
    """An item in flight is done, failed, or, with ``deferred``, pending again without the attempt counting."""
    values = {"state": F.lit("pending" if state == "deferred" else state), "error": F.lit(error).cast("string")}
    if state == "deferred":
        values["attempts"] = F.greatest(F.col("attempts") - 1, F.lit(0))
    for _ in range(tries):
        try:
            store.change({"summary_queue": lambda q: _updated(q.where((F.col("path") == path) & (F.col("state") == "in_flight")), values, now)})
            return
        except Conflict:
            continue
    raise Conflict
