"""What a question's hits lie in: the nearest summarised directory above them all, and its parts, within a budget of bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import paths

#: Hits that say where a question's answer lies, and parts that are named.
HITS, PARTS = 5, 6
HEAD = "PROJECT OVERVIEW (directory roll-up summaries — background context; cite numbered excerpts below for specific claims):\n"


def common_ancestors(hits: DataFrame, most: int = HITS) -> DataFrame:
    """(question, path): the deepest path at or above the first hits (question, entry_path, place) of each question; none where they
    have nothing in common. Prefixes are counted, so no path is compared with another."""
    first = Window.partitionBy("question").orderBy("place", "entry_path")
    top = hits.where("entry_path IS NOT NULL").withColumn("n", F.row_number().over(first)).where(F.col("n") <= most)
    held = top.select("question", "n", F.explode(paths.ancestors(F.rtrim("entry_path", F.lit("/")), self_too=True)).alias("path"))
    shared = held.groupBy("question", "path").agg(F.count("*").alias("held"))
    sizes = top.groupBy("question").agg(F.count("*").alias("size"))
    return shared.join(sizes, "question").where("held = size").groupBy("question").agg(F.max_by("path", F.length("path")).alias("path"))


def floor_bytes(text: Column, most: int) -> Column:
    """A text's first bytes, so many at most, that don't cut a character."""
    data = F.encode(text, "utf-8")
    # A character has four bytes at most, so of four cuts one is clean.
    cuts = [F.try_validate_utf8(F.substring(data, 1, max(most - k, 0)).cast("string")) for k in range(4)]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*cuts))


def overviews(roots: DataFrame, summaries: DataFrame, apps: DataFrame | None = None, budget: int = 2000) -> DataFrame:
    """(question, root, overview) for the roots (question, path): the nearest directory at or above each that has a summary, with what it
    and its first directories hold, a line each; as many lines as the budget of bytes takes, none after the first that it doesn't.

    summaries: (path, kind, parent_path, summary, summary_l0), a row a path; apps: (path, app_name, is_primary). Questions
    without a summarised directory, or with an empty summary there, have no row. The root '/' has no summary.
    """
    dirs = summaries.where("kind = 'dir'")
    up = roots.where("path IS NOT NULL").select("question", F.explode(paths.ancestors(F.rtrim("path", F.lit("/")), self_too=True)).alias("path"))
    found = up.join(dirs.select("path", "summary"), "path").groupBy("question").agg(F.max_by(F.struct("path", "summary"), F.length("path")).alias("r"))
    none = summaries.sparkSession.createDataFrame([], "path string, app_name string")
    tags = apps.where("is_primary").groupBy("path").agg(F.min("app_name").alias("app_name")) if apps is not None else none
    tag = F.when(F.col("app_name").isNotNull(), F.concat(F.lit(" ["), "app_name", F.lit("]"))).otherwise("")
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    rows = found.select("question", F.col("r.path").alias("path"), trimmed("r.summary").alias("said")).where("said <> ''")
    heads = rows.join(tags, "path", "left").select("question", F.col("path").alias("root"), F.concat(F.lit(HEAD), paths.basename("path"), tag, F.lit(": "), "said", F.lit("\n")).alias("head"))
    # Directories are named once for each root, not for each question.
    order = Window.partitionBy("parent_path").orderBy("path")
    parts = dirs.join(heads.select(F.col("root").alias("parent_path")).distinct(), "parent_path", "left_semi")
    parts = parts.withColumn("n", F.row_number().over(order)).where(F.col("n") <= PARTS).join(tags, "path", "left")
    parts = parts.select(F.col("parent_path").alias("root"), "n", paths.basename("path").alias("name"), tag.alias("tag"), trimmed(F.coalesce("summary_l0", "summary")).alias("said")).where("said <> ''")
    parts = parts.select("root", "n", F.concat(F.lit("  - "), "name", "tag", F.lit(": "), "said", F.lit("\n")).alias("line"))
    lines = parts.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("lines"))
    # Bytes after each line, from the head's on.
    after = F.transform(F.sequence(F.lit(1), F.size("lines")), lambda i: F.octet_length("head") + F.aggregate(F.slice("lines", 1, i), F.lit(0), lambda a, x: a + F.octet_length(x["line"])))
    fitting = F.when(F.size("lines") > 0, F.size(F.filter(after, lambda n: n <= budget))).otherwise(0)
    body = F.array_join(F.transform(F.slice("lines", 1, fitting), lambda x: x["line"]), "")
    return heads.join(lines, "root", "left").select("question", "root", floor_bytes(F.concat("head", F.coalesce(body, F.lit(""))), budget).alias("overview"))
