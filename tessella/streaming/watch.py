"""Changes of files as a stream into a store: each batch replaces the rows of its files in all tables, or removes them, at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources import ingest, store
from tessella.sources.parsers import Registry
from tessella.sources.shared import stored
from tessella.streaming.changes import coalesced


def apply(into: store.Store, changes: DataFrame, now: int, stream: str | None = None, batch: int = 0, registry: Registry | None = None, embed: Callable[[DataFrame], DataFrame] | None = None) -> store.Version:
    """Changes (path, change, at, content, and modified_s where known) into the store, as one version.

    Of a path's changes the last counts. Files that aren't admitted are left alone; a removed path takes all that lies below it
    out of every table. New content replaces a file's entry, chunks, edges and symbols and puts it and the directories above it
    into the summary queue; an entry keeps the time when it was first seen. embed: chunks with their vectors. A batch that the
    store holds already is not applied again.
    """
    last = stored(coalesced(changes.where("path IS NOT NULL")))
    files = last.where("change = 'upsert' AND content IS NOT NULL").withColumn("size", F.octet_length("content").cast("long"))
    files = files.where(ingest.admitted(F.col("path"), F.col("size")))
    files = files.select("path", "content", "size", F.col("modified_s").cast("long").alias("modified_s") if "modified_s" in changes.columns else F.lit(None).cast("long").alias("modified_s"))
    rows = stored(ingest.parsed(files, registry))
    stamp = F.lit(now).cast("long")
    gone = last.where("change = 'remove'").select("path").distinct()
    chunks = ingest.chunks(rows).withColumns({"embedding": F.lit(None).cast("array<float>"), "embed_model": F.lit(None).cast("string"), "indexed_at": stamp})
    made = {
        "entries": ingest.entries(files, now).withColumns({c: F.lit(None).cast("string") for c in ("hint_label", "hint_cat", "deep_policy")}),
        "chunks": embed(chunks) if embed else chunks, "edges": ingest.edges(rows), "symbols": ingest.symbols(rows),
    }
    changed = files.select("path")
    plan = store.cascade(gone)
    for name, new in made.items():
        plan[name] = _replacing(store.KEYS[name], changed, new, plan[name], name == "entries")
    removed, queued = plan["summary_queue"], store.pending(changed, now)

    def queue(q: DataFrame) -> tuple[DataFrame, DataFrame]:
        out, (old, come) = removed(q)[0], queued(q)
        return out.unionByName(old).distinct(), come

    plan["summary_queue"] = queue
    return into.change(plan, stream, batch)


def _replacing(column: str, changed: DataFrame, new: DataFrame, removed: Callable, entries: bool) -> Callable:
    def of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        if not entries:
            old = rows.join(changed.select(F.col("path").alias(column)), column, "left_semi").select(*rows.columns)
            return removed(rows)[0].unionByName(old), new
        # Directories above are entries too: those that are there stay as they are.
        first = rows.select("path", F.col("first_indexed_at").alias("seen"), F.col("kind").alias("was"))
        come = new.join(first, "path", "left").where("kind = 'file' OR was IS NULL").withColumn("first_indexed_at", F.coalesce("seen", "first_indexed_at")).drop("seen", "was")
        return removed(rows)[0].unionByName(rows.join(come.select("path"), "path", "left_semi").select(*rows.columns)), come

    return of


def follow(into: store.Store, events: DataFrame, checkpoint: str, name: str, now: Callable[[], int], registry: Registry | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, **trigger):
    """Starts a query that applies each batch of changes. ``name`` stands for the stream in the store: a batch that was applied before its
    progress was written down is not applied twice."""

    def batch(df: DataFrame, number: int) -> None:
        apply(into, df, now(), name, number, registry, embed)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
