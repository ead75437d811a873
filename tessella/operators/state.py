"""Changes of tables as new DataFrames: replacing, merging, reconciling, queues, packs, weights and the decision ledger.

A table is replaced by writing the result beside it; nothing here changes a table in place.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import paths
from tessella.operators.graph import latest

DAY = 86400


def replaced(base: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """base without the rows of the batch's keys, and the batch."""
    return base.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(batch, allowMissingColumns=True)


def merged(base: DataFrame, batch: DataFrame, keys: list[str], unless: Column | None = None) -> DataFrame:
    """Upserts the batch (one row a key); rows of base for which ``unless`` holds stay as they are."""
    locked = base.where(unless) if unless is not None else base.where("false")
    accepted = batch.join(locked.select(*keys), keys, "left_anti")
    return replaced(base, accepted, keys)


def upsert_classifications(base: DataFrame, batch: DataFrame) -> DataFrame:
    """Automatic classifications don't replace those of a user."""
    return merged(base, batch, ["path"], F.col("source") != "auto")


def with_generation(base: DataFrame, scanned: DataFrame, generation: int) -> DataFrame:
    """Entries after a scan: first_indexed_at stays from the first time, the generation is stamped."""
    first = base.select("path", F.col("first_indexed_at").alias("__first"))
    new = scanned.join(first, "path", "left").withColumn("first_indexed_at", F.coalesce("__first", "first_indexed_at")).drop("__first")
    return replaced(base, new.withColumn("scan_generation", F.lit(generation).cast("long")), ["path"])


def ghosts(entries: DataFrame, root: str, generation: int) -> DataFrame:
    """Entries under a root that the scan of a generation hasn't seen."""
    return entries.where(paths.under("path", root) & (F.coalesce("scan_generation", F.lit(-1)) < generation))


def without_subtree(table: DataFrame, prefix: str, column: str = "path") -> DataFrame:
    return table.where(~paths.under(column, prefix))


def orphans(table: DataFrame, entries: DataFrame, column: str = "path") -> DataFrame:
    """Rows whose path has no entry; none while there are no entries at all."""
    alive = entries.select(F.col("path").alias(column)).distinct()
    some = entries.limit(1).select(F.lit(True).alias("__some"))
    return table.join(alive, column, "left_anti").join(F.broadcast(some)).drop("__some")


def pruned(table: DataFrame, entries: DataFrame, column: str = "path") -> DataFrame:
    return table.join(orphans(table, entries, column).select(column).distinct(), column, "left_anti")


def embedding_misses(chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks with a cached vector of their content, chunks without one)."""
    known = cache.where("embedding IS NOT NULL").groupBy("content_hash").agg(F.first("embedding").alias("cached"))
    rows = chunks.drop("embedding").join(known, "content_hash", "left").withColumnRenamed("cached", "embedding")
    return rows.where("embedding IS NOT NULL"), rows.where("embedding IS NULL")


def with_dimension(chunks: DataFrame, dim: int) -> DataFrame:
    """Vectors of another dimension become null."""
    return chunks.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")))


def current_files(chunks: DataFrame, entries: DataFrame) -> DataFrame:
    """Files of which a chunk is as new as they are, and all such chunks have vectors."""
    rows = chunks.join(entries.select(F.col("path").alias("entry_path"), "modified_s"), "entry_path").where("indexed_at >= modified_s")
    return rows.groupBy("entry_path").agg(F.bool_and(F.col("embedding").isNotNull()).alias("ok")).where("ok").select("entry_path")


def dirty(entries: DataFrame, summaries: DataFrame, root: str) -> DataFrame:
    """(path, depth) to summarise again: new files, files changed since their summary, and all directories above."""
    rows = entries.where(F.col("kind") == "file").where(paths.under("path", root)).join(summaries.select("path", "generated_at"), "path", "left")
    seeds = rows.where("generated_at IS NULL OR modified_s >= generated_at").select("path")
    up = seeds.select(F.explode(paths.ancestors("path")).alias("path")).where(paths.under("path", root))
    return seeds.unionByName(up).distinct().withColumn("depth", paths.depth("path").cast("long"))


def enqueued(queue: DataFrame, items: DataFrame, now: int) -> DataFrame:
    """Items as pending, but for those in flight."""
    new = items.select("path", F.coalesce(*[F.col(c) for c in ("kind",) if c in items.columns], F.lit("dir")).alias("kind"), "depth", F.lit("pending").alias("state"), F.lit(0).cast("long").alias("attempts"), F.lit(now).cast("long").alias("enqueued_at"), F.lit(now).cast("long").alias("updated_at"), F.lit(None).cast("string").alias("error"))
    return merged(queue, new, ["path"], F.col("state") == "in_flight")


def next_level(queue: DataFrame) -> DataFrame:
    """All pending items of the deepest level: a level can be worked on at once, parents after children."""
    deepest = queue.where("state = 'pending'").agg(F.max("depth").alias("depth"))
    return queue.where("state = 'pending'").join(F.broadcast(deepest), "depth")


def requeued(queue: DataFrame, now: int, older: int, most: int = 3) -> DataFrame:
    """Items in flight for too long are pending again, or failed after so many attempts."""
    late = (F.col("state") == "in_flight") & (F.col("updated_at") < now - older)
    return queue.withColumns({"state": F.when(late, F.when(F.col("attempts") + 1 >= most, "failed").otherwise("pending")).otherwise(F.col("state")), "attempts": F.when(late, F.col("attempts") + 1).otherwise(F.col("attempts"))})


def queue_stats(queue: DataFrame, entries: DataFrame) -> DataFrame:
    """Items by state, and of these the ones with an entry."""
    live = entries.select("path", F.lit(1).alias("live")).distinct()
    return queue.join(live, "path", "left").groupBy("state").agg(F.count("*").alias("n"), F.sum(F.coalesce("live", F.lit(0))).alias("live"))


def suggested_weights(entries: DataFrame, weights: DataFrame, now: int, limit: int = 200) -> DataFrame:
    """Higher weights for the files that changed last and have none: 2 within a week, 1.5 within 30 days."""
    age = (F.lit(now) - F.col("modified_s")) / DAY
    rows = entries.where(F.col("kind") == "file").join(weights.where("target_kind = 'file'").select(F.col("target").alias("path")), "path", "left_anti")
    w = F.when(age <= 7, 2.0).when(age <= 30, 1.5)
    return rows.select("path", w.alias("weight"), "modified_s").where("weight IS NOT NULL").orderBy(F.desc("modified_s"), "path").limit(limit)


def packs_listed(packs: DataFrame, members: DataFrame, events: DataFrame) -> DataFrame:
    """Packs with their number of paths and their last event."""
    n = members.groupBy("pack_id").agg(F.count("*").alias("n_paths"))
    last = events.groupBy("pack_id").agg(F.max_by("event", F.struct("at", "id")).alias("last_event"), F.max("at").alias("last_at"))
    return packs.withColumnRenamed("id", "pack_id").join(n, "pack_id", "left").join(last, "pack_id", "left").withColumn("n_paths", F.coalesce("n_paths", F.lit(0)))


def stale_members(members: DataFrame, entries: DataFrame) -> DataFrame:
    return members.join(entries.select("path"), "path", "left_anti")


def in_pack(rows: DataFrame, members: DataFrame, column: str = "entry_path") -> DataFrame:
    """Rows at or below a path of a pack: meets the ancestors of each path by equality."""
    up = rows.select(column, F.explode(paths.ancestors(column, self_too=True)).alias("__up")).join(members.select(F.col("path").alias("__up")).distinct(), "__up", "left_semi")
    return rows.join(up.select(column).distinct(), column, "left_semi")


def suggested_members(hits: DataFrame, members: DataFrame, limit: int = 20) -> DataFrame:
    """(path, rank) for a pack: the files of hits (entry_path, rank) by their best one, without those that it has."""
    best = hits.where("entry_path IS NOT NULL").groupBy(F.col("entry_path").alias("path")).agg(F.min("rank").alias("rank"))
    return best.join(members.select("path"), "path", "left_anti").orderBy("rank", "path").limit(limit)


def appended_turns(turns: DataFrame, new: DataFrame) -> DataFrame:
    """New questions and answers of sessions, in their order (seq), after the turns that are there."""
    last = turns.groupBy("session_id").agg((F.max("turn_index") + 1).alias("next"))
    at = F.row_number().over(Window.partitionBy("session_id").orderBy("seq")) - 1
    rows = new.join(last, "session_id", "left").withColumn("turn_index", (F.coalesce("next", F.lit(0)) + at).cast("long")).drop("next", "seq")
    return turns.unionByName(rows, allowMissingColumns=True)


def recent_turns(turns: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn_index")))
    return turns.withColumn("__n", rank).where(F.col("__n") <= n).drop("__n")


def recorded(ledger: DataFrame, found: DataFrame) -> DataFrame:
    """Findings that open a decision: not dismissed on the same evidence, and none open for type and subject. Of several
    for one subject the first by evidence counts."""
    keys = ["decision_type", "subject"]
    one = latest(found, keys, "evidence_hash")
    one = one.join(ledger.where("status = 'dismissed'").select(*keys, "evidence_hash"), [*keys, "evidence_hash"], "left_anti")
    return one.join(ledger.where("status = 'open'").select(*keys), keys, "left_anti")


def answered(ledger: DataFrame, answers: DataFrame, now: int) -> DataFrame:
    """Open decisions with an answer (id, chosen) are decided; others are left alone."""
    a = answers.select("id", F.col("chosen").alias("__chosen"))
    rows = ledger.join(a, "id", "left")
    hit = F.col("__chosen").isNotNull() & (F.col("status") == "open")
    return rows.select(*[
        F.when(hit, v).otherwise(F.col(c)).alias(c) if (v := {"status": F.lit("decided"), "chosen": F.col("__chosen"), "source": F.lit("user"), "decided_at": F.lit(now)}.get(c)) is not None else F.col(c)
        for c in ledger.columns
    ])


def closed(ledger: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """Open decisions of ids as dismissed or expired."""
    if status not in ("dismissed", "expired"):
        raise ValueError(status)
    rows = ledger.join(ids.select("id", F.lit(True).alias("__hit")).distinct(), "id", "left")
    return rows.withColumn("status", F.when(F.col("__hit") & (F.col("status") == "open"), status).otherwise(F.col("status"))).select(*ledger.columns)


def current_decisions(ledger: DataFrame) -> DataFrame:
    """The last decided row of each type and subject that no other supersedes."""
    return latest(ledger.where("status = 'decided' AND superseded_by IS NULL"), ["decision_type", "subject"])


def inbox(ledger: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    return ledger.where("status = 'open'").orderBy(F.desc("priority"), F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def unapplied(ledger: DataFrame) -> DataFrame:
    return current_decisions(ledger).where("effects_applied_at IS NULL")


def kept_decisions(ledger: DataFrame, now: int, days: int = 90) -> DataFrame:
    """Without dismissed and expired rows that are older."""
    done = F.col("status").isin("dismissed", "expired") & (F.coalesce("decided_at", "created_at") < now - days * DAY)
    return ledger.where(~done)


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *parts), 256)


def duplicate_findings(clusters: DataFrame) -> DataFrame:
    """Findings for groups of equal files: subject the first path, evidence the sorted paths. Groups are hashed member by
    member, so a group of any size stays out of one row."""
    piece = F.xxhash64("path")
    g = clusters.groupBy("source_hash").agg(F.min("path").alias("subject"), F.count("*").alias("n"), F.bit_xor(piece).alias("x"))
    return g.select(F.lit("duplicate").alias("decision_type"), "subject", fingerprint(F.col("source_hash"), F.col("n").cast("string"), F.col("x").cast("string")).alias("evidence_hash"))


def archive_findings(entries: DataFrame, now: int, days: int = 365, bucket: int = 90) -> DataFrame:
    """Directories unchanged for so long, with the age in buckets as evidence."""
    age = F.floor((F.lit(now) - F.col("modified_s")) / DAY)
    rows = entries.where(F.col("kind") == "dir").withColumn("age", age).where(F.col("age") >= days)
    return rows.select(F.lit("archive").alias("decision_type"), F.col("path").alias("subject"), fingerprint(F.col("path"), F.floor(F.col("age") / bucket).cast("string")).alias("evidence_hash"))


def duplicate_weights(decided: DataFrame, members: DataFrame) -> DataFrame:
    """Weight 0 for the members of a decided group but the one that was chosen."""
    rows = decided.where("decision_type = 'duplicate'").select("subject", "chosen").join(members, "subject")
    return rows.where(F.col("path") != F.col("chosen")).select(F.lit("file").alias("target_kind"), F.col("path").alias("target"), F.lit(0.0).alias("weight"))


def all_of(*conditions: Column) -> Column:
    return reduce(and_, conditions)
