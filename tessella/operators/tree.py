"""Rollups over the tree of paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import paths
from tessella.functions.text import abstract
from tessella.sources.shared import stored


def rolled_up(files: DataFrame, measures: dict[str, str], column: str = "path") -> DataFrame:
    """(path, measures...) per directory: sums over all that lies below, by way of every file's ancestors."""
    up = files.select(F.explode(paths.ancestors(column)).alias("dir"), *measures)
    return up.groupBy(F.col("dir").alias("path")).agg(*[F.sum(c).alias(name) for c, name in measures.items()])


def tree_level(entries: DataFrame, chunks: DataFrame, queue: DataFrame, parent: str) -> DataFrame:
    """The children of a directory: files in it, chunks below it (not its own), and directories below and at it that are
    covered, partly covered, and in all. Files before directories."""
    at = entries.where(F.col("parent_path") == parent).select("path", "kind")
    n_files = entries.where("kind = 'file'").groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("file_count"))
    n_chunks = chunks.select(F.explode(paths.ancestors("entry_path")).alias("path")).groupBy("path").agg(F.count("*").alias("chunk_count"))
    state = queue.select("path", "state")
    dirs = entries.where("kind = 'dir'").join(state, "path", "left").select(F.explode(paths.ancestors("path", self_too=True)).alias("path"), "state")
    cover = dirs.groupBy("path").agg(F.count_if(F.col("state") == "done").alias("covered_dirs"), F.count_if(F.col("state").isin("pending", "in_flight")).alias("partial_dirs"), F.count("*").alias("total_dirs"))
    rows = at.join(n_files, "path", "left").join(n_chunks, "path", "left").join(cover, "path", "left")
    zero = F.lit(0).cast("long")
    file = F.col("kind") == "file"
    counts = [F.when(file, zero).otherwise(F.coalesce(F.col(c), zero)).alias(c) for c in ("file_count", "chunk_count", "covered_dirs", "partial_dirs", "total_dirs")]
    return rows.select("path", "kind", *counts).orderBy(F.desc("kind"), "path")


def coverage(entries: DataFrame, chunks: DataFrame, path: str) -> DataFrame:
    """One row: files below a path, and those with chunks."""
    files = entries.where("kind = 'file'").where(paths.under("path", path)).select("path")
    with_chunks = chunks.select(F.col("entry_path").alias("path")).distinct().withColumn("has", F.lit(1))
    return files.join(with_chunks, "path", "left").agg(F.count("*").alias("files"), F.coalesce(F.sum("has"), F.lit(0)).alias("chunked"))


def treemap(files: DataFrame, depth: int = 4, children: int = 30, size: str = "size") -> DataFrame:
    """(path, parent_path, bytes, n): directories down to a depth, the largest of each parent."""
    rows = rolled_up(files.withColumn("__one", F.lit(1)), {size: "bytes", "__one": "n"})
    rows = rows.where(paths.depth("path") <= depth).withColumn("parent_path", F.coalesce(paths.parent("path"), F.lit("/")))
    rank = F.row_number().over(Window.partitionBy("parent_path").orderBy(F.desc("bytes"), "path"))
    return rows.withColumn("place", rank).where(F.col("place") <= children).drop("place")


def breadcrumb(summaries: DataFrame, path: str) -> DataFrame:
    """Summaries above a path, from the root down."""
    parts = path.split("/")
    above = ["/".join(parts[:n]) for n in range(2, len(parts))]
    return summaries.where(F.col("path").isin(above)).orderBy("depth")


def summarised(files: DataFrame, most: int = 50, chars: int = 400) -> DataFrame:
    """Directories' summaries bottom-up: (path, kind, parent_path, depth, summary, summary_l0, byte_size, child_count). files:
    summaries of files. A directory's text puts together the first sentences of so many children; its sizes count all.

    One level after the other: a level depends on the one below it alone, is one group-by over parents, and is written to the
    shared folder, so the plan of the next one doesn't grow.
    """
    columns = ["path", "kind", "parent_path", "depth", "summary", "summary_l0", "byte_size", "child_count"]
    leaves = files.withColumn("child_count", F.lit(0).cast("long")).select(*columns)
    levels, made = [leaves], None
    deepest = files.agg(F.max("depth")).first()[0] or 0
    for level in range(deepest - 1, 0, -1):
        below = leaves.where(F.col("depth") == level + 1)
        below = below.unionByName(made) if made is not None else below
        rank = F.row_number().over(Window.partitionBy("parent_path").orderBy(F.desc("kind"), "path"))
        line = F.concat(F.lit("- "), paths.basename("path"), F.lit(": "), F.coalesce("summary_l0", F.lit("")))
        rows = below.withColumn("place", rank)
        heads = F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.struct("place", line.alias("line")))))
        grouped = rows.groupBy("parent_path").agg(heads.alias("l"), F.sum("byte_size").alias("byte_size"), F.count("*").alias("child_count"))
        text = F.substring(F.array_join(F.col("l.line"), "\n"), 1, chars)
        dirs = grouped.select(F.col("parent_path").alias("path"), F.lit("dir").alias("kind"), F.coalesce(paths.parent("parent_path"), F.lit("/")).alias("parent_path"), F.lit(level).cast("long").alias("depth"), text.alias("summary"), "byte_size", "child_count")
        made = stored(dirs.withColumn("summary_l0", abstract("summary")).select(*columns))
        levels.append(made)
    return reduce(DataFrame.unionByName, levels)


def fingerprints(children: DataFrame, definitions: DataFrame) -> DataFrame:
    """(path, app, specificity, is_primary) of directories by what lies in them. children: (path, name); definitions: (app,
    specificity, all_of, any_of, none_of) with arrays of names. A definition needs all of the first, one of the second if
    there are any, and none of the third; without a positive marker it counts for nothing."""
    marks = definitions.select("app", "specificity", F.size("all_of").alias("need"), F.size("any_of").alias("choice"), F.explode(F.concat(F.transform("all_of", lambda m: F.struct(F.lit("all").alias("how"), m.alias("name"))), F.transform("any_of", lambda m: F.struct(F.lit("any").alias("how"), m.alias("name"))), F.transform("none_of", lambda m: F.struct(F.lit("none").alias("how"), m.alias("name"))))).alias("m"))
    marks = marks.select("app", "specificity", "need", "choice", F.col("m.how").alias("how"), F.col("m.name").alias("name"))
    met = children.select("path", "name").distinct().join(marks, "name")
    n = met.groupBy("path", "app", "specificity", "need", "choice").agg(*[F.countDistinct(F.when(F.col("how") == h, F.col("name"))).alias(h) for h in ("all", "any", "none")])
    ok = n.where((F.col("all") == F.col("need")) & ((F.col("choice") == 0) | (F.col("any") > 0)) & (F.col("none") == 0) & (F.col("need") + F.col("choice") > 0))
    first = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("specificity"), "app"))
    return ok.select("path", "app", "specificity", (first == 1).alias("is_primary"))


def top_level(apps: DataFrame) -> DataFrame:
    """Primary apps that don't lie in another one."""
    primary = apps.where("is_primary")
    nested = primary.select("path", F.explode(paths.ancestors("path")).alias("up")).join(primary.select(F.col("path").alias("up")).distinct(), "up", "left_semi")
    return primary.join(nested.select("path").distinct(), "path", "left_anti")
