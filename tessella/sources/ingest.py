"""Trees of files as tables: entries, chunks, edges and symbols."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import paths
from tessella.sources import ignores
from tessella.sources.parsers import Registry

MOST_BYTES = 8 << 20
#: A longer ignore file is no ignore file.
MOST_IGNORE_BYTES = 1 << 20
#: Directories and files that are never read.
SKIPPED = (".git", ".hg", ".svn", "node_modules", "target", "__pycache__", ".venv", "venv", "dist", "build", ".cache", ".idea", ".vscode", "vendor")
SENSITIVE = (".ssh", ".gnupg", ".aws", ".kube")
SECRET_FILES = (".env", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", ".netrc", ".pgpass", "credentials.json", "secrets.yaml", "secrets.yml")


def admitted(path: Column, length: Column, ignored: tuple[str, ...] = (), most: int = MOST_BYTES) -> Column:
    """Whether a file is read: not too long, in no skipped directory, no secret itself. The same test serves streams.
    ignored: regular expressions over whole paths."""
    parts = F.split(path, "/")
    out = (length <= most) & ~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED + SENSITIVE))) & ~F.lower(paths.basename(path)).isin(*SECRET_FILES) & ~F.lower(path).rlike(r"\.(pem|key|p12|pfx)$")
    for pattern in ignored:
        out = out & ~path.rlike(pattern)
    return out


def files(spark: SparkSession, root: str, ignored: tuple[str, ...] = (), rules: tuple[str, ...] = (), respect: bool = True) -> DataFrame:
    """(path, content, size, modified_s) of a tree. What isn't admitted isn't opened, nor, with ``respect``, what the tree's ignore
    files or the given ``rules`` (their lines, for the root) ignore. ignored: regular expressions over whole paths."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    path = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    df = read.load(root).where(admitted(F.col("path"), F.col("length"), ignored))
    found = df.select(path.alias("path"), "content", F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("modified_s"))
    if not respect and not rules:
        return found
    clean = re.sub("^[a-z0-9]+:/+", "/", root)
    told = _ignore_files(spark, root, found) if respect else []
    told = spark.createDataFrame(told, "path string, content binary").where(admitted(F.col("path"), F.lit(0)))
    lines = ignores.rules(told, rules, clean)
    # Names alone are judged; of what stays the content is read.
    listed = ignores.kept(found.select("path"), lines)
    return found.join(listed, "path", "left_semi")


def _ignore_files(spark: SparkSession, root: str, found: DataFrame) -> list[tuple[str, bytearray]]:
    """(path, content) of a tree's ignore files. Spark's own listing leaves out names that begin with a dot, so the store is asked
    for these names alone, level by level."""
    base = root.rstrip("/")
    deepest = found.agg(F.max(paths.depth("path"))).first()[0]
    jvm, top = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(base)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    levels = max(0, (deepest or 0) - re.sub("^[a-z0-9]+:/+", "/", base).count("/"))
    out = []
    for level in range(levels):
        pattern = f"{base}{'/*' * level}/{{{','.join(ignores.KINDS)}}}"
        for status in store.globStatus(jvm.org.apache.hadoop.fs.Path(pattern)) or []:
            if status.isFile() and status.getLen() <= MOST_IGNORE_BYTES:
                stream = store.open(status.getPath())
                try:
                    data = bytearray(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
                finally:
                    stream.close()
                out.append((re.sub("^[a-z0-9]+:/+", "/", status.getPath().toString()), data))
    return out


def entries(found: DataFrame, now: int, generation: int = 1) -> DataFrame:
    f = found.select("path", paths.parent("path").alias("parent_path"), F.lit("file").alias("kind"), "size", "modified_s")
    d = f.select(F.explode(paths.ancestors("path")).alias("path")).distinct().select("path", paths.parent("path").alias("parent_path"), F.lit("dir").alias("kind"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("modified_s"))
    stamp = F.lit(now).cast("long")
    return f.unionByName(d).select("*", stamp.alias("indexed_at"), stamp.alias("first_indexed_at"), F.lit(generation).cast("long").alias("scan_generation"))


_PARSED = "path string, what string, seq bigint, a string, b string, language string, first bigint, last bigint"


#: Bytes of content whose parsed rows a task holds at once, but for one file's.
HELD = 4 << 20


def _parse(registry: Registry):
    columns = [c.split(" ")[0] for c in _PARSED.split(", ")]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, held = [], 0
            for path, data in zip(b["path"], b["content"], strict=True):
                got = registry.parse(path, bytes(data))
                if got:
                    rows += [(path, "chunk", i, h, t, got.language, 0, 0) for i, (h, t) in enumerate(got.chunks)]
                    rows += [(path, "edge", i, k, r, got.language, 0, 0) for i, (k, r) in enumerate(got.edges)]
                    rows += [(path, "symbol", i, n, k, got.language, s, e) for i, (n, k, s, e) in enumerate(got.symbols)]
                held += len(data)
                if held >= HELD:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    return of


def parsed(found: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Rows of all that the parsers find: what is 'chunk' (heading, text), 'edge' (kind, ref) or 'symbol' (name, kind, lines)."""
    return found.select("path", "content").mapInPandas(_parse(registry or Registry()), _PARSED)


def chunks(rows: DataFrame) -> DataFrame:
    c = rows.where("what = 'chunk'")
    return c.select(F.xxhash64("path", "seq").alias("id"), F.col("path").alias("entry_path"), "seq", F.col("a").alias("heading"), F.col("b").alias("text"), "language", F.sha2("b", 256).alias("content_hash"))


def edges(rows: DataFrame) -> DataFrame:
    return rows.where("what = 'edge'").select(F.col("path").alias("from_path"), F.col("a").alias("kind"), F.col("b").alias("to_ref")).distinct()


def symbols(rows: DataFrame) -> DataFrame:
    return rows.where("what = 'symbol'").select("path", F.col("a").alias("name"), F.col("b").alias("kind"), F.col("first").alias("start_line"), F.col("last").alias("end_line"))


def binary(content: Column) -> Column:
    """A zero byte among the first 8192, unless they begin with a UTF-16 mark."""
    return F.contains(F.substring(content, 1, 8192), F.lit(bytearray(1))) & ~F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF")


def hunks(diff: DataFrame, by: tuple[str, ...] = (), block: int = 4096) -> DataFrame:
    """(by..., path, first, last) of unified diffs as numbered lines (n, line): the new side's changed lines. by: columns that tell diffs
    apart, such as the commit. A file's name is carried within blocks of lines; one row of each block is carried further."""
    path = F.regexp_extract("line", r"^\+\+\+ b/(.*)$", 1)
    head = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    lines = diff.where(F.col("line").rlike(r"^(\+\+\+ b/|@@ )")).withColumns({"block": F.floor(F.col("n") / block), "p": F.when(path != "", path)})
    within = Window.partitionBy(*by, "block").orderBy("n")
    lasts = lines.groupBy(*by, "block").agg(F.max_by("p", F.when(F.col("p").isNotNull(), F.col("n"))).alias("p"))
    above = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*by, "block", F.last("p", ignorenulls=True).over(above).alias("carried"))
    named = lines.withColumn("p", F.last("p", ignorenulls=True).over(within)).join(carried, [*by, "block"])
    count = F.coalesce(F.nullif(F.regexp_extract("line", head, 2), F.lit("")).cast("long"), F.lit(1))
    rows = named.where(F.col("line").rlike(head)).select(*by, F.coalesce("p", "carried").alias("path"), F.regexp_extract("line", head, 1).cast("long").alias("first"), count.alias("n"))
    return rows.where("n > 0").select(*by, "path", "first", (F.col("first") + F.col("n") - 1).alias("last"))
