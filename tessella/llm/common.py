"""What the operators share: tables, shared folders and written intermediate tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one set here where it is unset.

    The own folder is for a single machine; on several machines the setting has to be there.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder in whatever store holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def delete_written(*tables: DataFrame) -> None:
    """Removes tables that ``written`` has made and that no later result reads."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(df.sparkSession, path)


#: Ids that are broadcast at most, about 40 MB; beyond, both sides are dealt by id.
BROADCAST_IDS = 500_000


def by_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs' rows whose doc_id is among ids, or with ``left_anti`` is not. ids: distinct doc_ids of a written table, which are counted."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine) -> Column:
    """For each of an array's integers what ``combine`` (a sum, a maximum) makes of those before it, from 0 on.

    In blocks of the root of their number: an array that grows by one element is copied, so one block would cost the square.
    """
    state = "struct<last:int,out:array<int>>"
    none = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("out"))

    def over(items: Column, value) -> Column:
        return F.aggregate(items, none, lambda a, x: F.struct(combine(a["last"], value(x)).alias("last"), F.concat(a["out"], F.array(a["last"])).alias("out")).cast(state))

    width = F.ceil(F.sqrt(F.size(values))).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), F.size(values), width), lambda i: over(F.slice(values, i, width), lambda x: x))
    joined = let(blocks, lambda b: let(over(b, lambda x: x["last"])["out"], lambda first: F.flatten(F.transform(b, lambda x, j: F.transform(x["out"], lambda v: combine(first[j], v))))))
    return F.when(F.size(values) > 0, joined).otherwise(F.array().cast("array<int>"))


def sliced(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """(start, number) of runs of texts of about so many bytes; a longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield start, end - start
        start = end


def cut(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Batches in parts of about so many bytes of a text column: bounds what a worker holds beside a batch."""
    for b in trimmed(batches):
        for start, n in sliced(b.column(column), size):
            yield b.slice(start, n)


#: glibc's, where there is one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after each the worker gives back memory that it has freed, as it lives on for other stages."""
    for b in batches:
        yield b
        del b
        pa.default_memory_pool().release_unused()
        if _trim:
            _trim(0)
