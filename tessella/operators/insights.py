"""Aggregations, duplicates, freshness and usage over entries, summaries, chunks and the usage ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400
WEEK = 7 * DAY
RETENTION = 90 * DAY


def region_summary(entries: DataFrame) -> DataFrame:
    """Files and bytes by category; without one they are 'unknown'."""
    cat = F.coalesce("hint_cat", F.lit("unknown"))
    return entries.groupBy(cat.alias("category")).agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


def language_breakdown(chunks: DataFrame) -> DataFrame:
    return chunks.where("language <> ''").groupBy("language").agg(F.count("*").alias("n"))


def child_histogram(entries: DataFrame) -> DataFrame:
    """Files by parent and category, those without a category left out."""
    return entries.where("kind = 'file' AND hint_cat IS NOT NULL").groupBy("parent_path", "hint_cat").agg(F.count("*").alias("n"))


def dominant_category(histogram: DataFrame, mapped: list[str], share: float = 0.6) -> DataFrame:
    """Per parent its most frequent mapped category where that has the share of all children with a category.
    Ties go to the first name."""
    total = F.sum("n").over(Window.partitionBy("parent_path"))
    best = F.row_number().over(Window.partitionBy("parent_path").orderBy(F.desc("n"), "hint_cat"))
    ranked = histogram.withColumn("confidence", F.col("n") / total).where(F.col("hint_cat").isin(mapped)).withColumn("place", best)
    return ranked.where((F.col("place") == 1) & (F.col("confidence") >= share)).select("parent_path", F.col("hint_cat").alias("category"), "confidence")


def exact_duplicates(summaries: DataFrame) -> DataFrame:
    """Groups of files with one source hash: hash, number, first path. The members: duplicate_members."""
    live = summaries.where("kind = 'file' AND source_hash <> ''")
    return live.groupBy("source_hash").agg(F.count("*").alias("n"), F.min("path").alias("first_path")).where("n > 1")


def duplicate_members(summaries: DataFrame) -> DataFrame:
    """(source_hash, path) of the files that another has the hash of: one row a file, whatever the group's size."""
    live = summaries.where("kind = 'file' AND source_hash <> ''").select("source_hash", "path")
    return live.join(live.groupBy("source_hash").count().where("count > 1").select("source_hash"), "source_hash")


def largest(entries: DataFrame, k: int = 20) -> DataFrame:
    return entries.where("kind = 'file'").select("path", "size").orderBy(F.desc("size"), "path").limit(k)


def stale(entries: DataFrame, now: int, days: int, limit: int = 500) -> DataFrame:
    """Entries older than so many days, or of unknown age, oldest first."""
    old = entries.where(F.col("modified_s").isNull() | (F.col("modified_s") < now - days * DAY))
    return old.select("path", "modified_s", F.floor((F.lit(now) - F.col("modified_s")) / DAY).alias("age_days")).orderBy(F.asc_nulls_first("modified_s"), "path").limit(limit)


def weekly_diff(entries: DataFrame, since: int, limit: int = 500) -> DataFrame:
    """Files added since then, and older ones that were modified since then; so many of each at most."""
    added = F.col("first_indexed_at") >= since
    rows = entries.where("kind = 'file'").where(added | (F.col("modified_s") >= since))
    rows = rows.select(F.when(added, "added").otherwise("modified").alias("change"), "path", F.when(added, F.col("first_indexed_at")).otherwise(F.col("modified_s")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("change").orderBy(F.desc("at"), "path"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")


def health(entries: DataFrame, chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """(metric, n): counts over three tables."""
    e = entries.agg(F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "dir").alias("dirs"), F.sum("size").alias("bytes"))
    c = chunks.agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded_chunks"), F.countDistinct("entry_path").alias("chunked_files"))
    s = summaries.agg(F.count("*").alias("summaries"), F.count_if(F.coalesce("source_hash", F.lit("")) == "").alias("unhashed"))
    rows = [d.unpivot([], d.columns, "metric", "n") for d in (e, c, s)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def usage_summary(usage: DataFrame, keys: list[str] | None = None, since: int | None = None) -> DataFrame:
    """Calls and bytes, in all or by keys (tool, served_basis, session_id), from a time on."""
    rows = usage if since is None else usage.where(F.col("at") >= since)
    served, whole = F.coalesce(F.sum("bytes_served"), F.lit(0)), F.coalesce(F.sum("bytes_counterfactual"), F.lit(0))
    return rows.groupBy(*(keys or [])).agg(F.count("*").alias("calls"), served.alias("bytes_served"), whole.alias("bytes_counterfactual"))


def savings(summary: DataFrame) -> DataFrame:
    """With tokens saved (four bytes each, never below none) and the percentage, 99 at most."""
    saved = F.greatest(F.col("bytes_counterfactual") - F.col("bytes_served"), F.lit(0))
    percent = F.when(F.col("bytes_counterfactual") > 0, F.least(F.lit(99), F.floor(100.0 * saved / F.col("bytes_counterfactual") + 0.5))).otherwise(0).cast("long")
    return summary.withColumns({"tokens_saved": F.floor(saved / 4).cast("long"), "percent_saved": percent})


def kept_usage(usage: DataFrame, now: int, retention: int = RETENTION) -> DataFrame:
    return usage.where(F.col("at") >= now - retention)


def unlabelled_files(chunks: DataFrame, least: int = 3) -> DataFrame:
    """Files of which no chunk has a language and that have so many chunks."""
    counted = chunks.groupBy("entry_path").agg(F.count("*").alias("n"), F.count_if(F.coalesce("language", F.lit("")) != "").alias("labelled"))
    return counted.where((F.col("n") >= least) & (F.col("labelled") == 0)).select("entry_path", "n")


def counterfactual_sizes(wanted: DataFrame, entries: DataFrame, summaries: DataFrame) -> DataFrame:
    """Per distinct path the size of its file, or what its summary covers, or nothing."""
    rows = wanted.select("path").distinct().join(entries.select("path", "size"), "path", "left").join(summaries.select("path", "byte_size"), "path", "left")
    return rows.select("path", F.coalesce(F.nullif("size", F.lit(0)), "byte_size", F.lit(0)).alias("bytes"))


def mean_vectors(chunks: DataFrame) -> DataFrame:
    """Per file the mean of its chunks' vectors, by place: (entry_path, pos, value)."""
    return chunks.where("embedding IS NOT NULL").select("entry_path", F.posexplode("embedding").alias("pos", "x")).groupBy("entry_path", "pos").agg(F.avg(F.col("x").cast("double")).alias("value"))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def directory_hashes(children: DataFrame) -> DataFrame:
    """Per parent a hash of its children's paths and hashes; '' where a child has none."""
    piece = F.concat("path", F.lit("\0"), "source_hash", F.lit("\0"))
    grouped = children.groupBy("parent_path").agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.count_if(F.coalesce("source_hash", F.lit("")) == "").alias("missing"))
    return grouped.select("parent_path", F.when(F.col("missing") > 0, "").otherwise(F.sha2(F.array_join("pieces", ""), 256)).alias("source_hash"))


def co_change(commits: DataFrame, most: int = 50) -> DataFrame:
    """(path_a, path_b, n): pairs of files that changed together, over commits of two to ``most`` files."""
    sizes = commits.groupBy("commit").agg(F.countDistinct("path").alias("size")).where(F.col("size").between(2, most)).select("commit")
    rows = commits.distinct().join(sizes, "commit")
    a, b = rows.select("commit", F.col("path").alias("path_a")), rows.select("commit", F.col("path").alias("path_b"))
    return a.join(b, "commit").where("path_a < path_b").groupBy("path_a", "path_b").agg(F.count("*").alias("n"))


def canonical_pairs(pairs: DataFrame) -> DataFrame:
    """(path_a, path_b, count) with a < b, sums for pairs given both ways, no pairs of one file."""
    return pairs.where("path_a <> path_b").groupBy(F.least("path_a", "path_b").alias("path_a"), F.greatest("path_a", "path_b").alias("path_b")).agg(F.sum("count").alias("count"))


def co_change_of(pairs: DataFrame, path: str, limit: int = 10) -> DataFrame:
    other = F.when(F.col("path_a") == path, F.col("path_b")).otherwise(F.col("path_a"))
    return pairs.where((F.col("path_a") == path) | (F.col("path_b") == path)).select(other.alias("path"), "count").orderBy(F.desc("count"), "path").limit(limit)
