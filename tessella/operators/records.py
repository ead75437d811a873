"""Records that users keep: packs, classifications, weights, saved questions, sessions, notes, and what is written to summaries
and queues by hand. Changes come as tables of commands, so that one plan applies any number of them; where several of one batch
meet one row, the last by ``seq`` counts. Lookups ask for many keys at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import paths, text
from tessella.operators import state


def _last(commands: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: the last by seq, without seq. Rows with a null key are no commands."""
    rest = [c for c in commands.columns if c not in (*keys, "seq")]
    rows = commands.dropna(subset=keys).groupBy(*keys).agg(F.max_by(F.struct(F.lit(1).alias("__one"), *rest), "seq").alias("__row"))
    return rows.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def _updated(base: DataFrame, keys: list[str], given: DataFrame, **values: Column) -> DataFrame:
    """base where rows whose keys are given (as columns named with two underscores) take the values."""
    renamed = given.select(*keys, *[F.col(c).alias(f"__{c}") for c in given.columns if c not in keys], F.lit(True).alias("__hit"))
    rows = base.join(renamed, keys, "left")
    return rows.select(*[F.when(F.col("__hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in base.columns])


def _new(rows: DataFrame, like: DataFrame) -> DataFrame:
    """rows with the columns of ``like``, null where they lack one."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields])


# Packs


def packs_after(packs: DataFrame, members: DataFrame, events: DataFrame, commands: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(packs, members, events) after commands (seq, op, pack_id, name, description, paths, detail) in the order of seq, which is
    unique and from 1 on. op: create, rename, add, remove, export, refresh, delete. A pack lives from its creation to its deletion;
    commands outside are without effect, as is a second creation. Adding what is there, and removing what isn't, changes no member
    but is an event; with no paths it is none. A deleted pack takes its members and events along."""
    known = packs.select(F.col("id").alias("pack_id"), F.lit(0).cast("long").alias("known"))
    orders = commands.dropna(subset=["pack_id", "op", "seq"]).join(known, "pack_id", "left")
    born = orders.groupBy("pack_id").agg(F.coalesce(F.min("known"), F.min(F.when(F.col("op") == "create", F.col("seq")))).alias("born")).where("born IS NOT NULL")
    alive = orders.drop("known").join(born, "pack_id").where("seq >= born")
    dead = alive.where("op = 'delete'").groupBy("pack_id").agg(F.min("seq").alias("dead"))
    alive = alive.join(dead, "pack_id", "left").where("dead IS NULL OR seq <= dead").where("op <> 'create' OR seq = born")
    gone = dead.select("pack_id")

    names = _last(alive.where("op IN ('create', 'rename')").select("pack_id", "seq", "name"), ["pack_id"])
    made = alive.where("op = 'create'").join(gone, "pack_id", "left_anti").select(F.col("pack_id").alias("id"), "name", "description", F.lit(now).alias("created_at"))
    kept = packs.join(gone.withColumnRenamed("pack_id", "id"), "id", "left_anti").select(*packs.columns).unionByName(_new(made, packs))
    packs_now = _updated(kept, ["id"], names.withColumnRenamed("pack_id", "id"), name=F.col("__name"))

    moved = alive.where("op IN ('add', 'remove')").select("pack_id", "seq", "op", F.explode("paths").alias("path"))
    moved = _last(moved, ["pack_id", "path"])
    members_now = members.select("pack_id", "path").join(moved, ["pack_id", "path"], "left_anti").unionByName(moved.where("op = 'add'").select("pack_id", "path")).distinct()
    members_now = members_now.join(gone, "pack_id", "left_anti")

    event = F.create_map(*[F.lit(x) for pair in (("create", "created"), ("rename", "renamed"), ("add", "path_added"), ("remove", "path_removed"), ("export", "exported"), ("refresh", "refreshed")) for x in pair])[F.col("op")]
    detail = F.when(F.col("op").isin("create", "rename"), F.col("name")).when(F.col("op").isin("add", "remove"), F.array_join("paths", ", ")).otherwise(F.col("detail"))
    said = alive.where("op <> 'delete'").where("op NOT IN ('add', 'remove') OR size(paths) > 0").where(event.isNotNull()).join(gone, "pack_id", "left_anti")
    last = events.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))
    said = said.join(F.broadcast(last)).select((F.col("__last") + F.col("seq")).alias("id"), "pack_id", event.alias("event"), detail.alias("detail"), F.lit(now).alias("at"))
    events_now = events.join(gone, "pack_id", "left_anti").select(*events.columns).unionByName(_new(said, events))
    return packs_now, members_now, events_now


def stale_files(members: DataFrame, chunks: DataFrame, entries: DataFrame) -> DataFrame:
    """(pack_id, path): files with chunks at or below a member of the pack that changed since, are gone, or lack a vector."""
    files = chunks.select("entry_path").distinct()
    up = files.select("entry_path", F.explode(paths.ancestors("entry_path", self_too=True)).alias("path"))
    rows = up.join(members.select("pack_id", "path").distinct(), "path").select("pack_id", "entry_path").distinct()
    return rows.join(state.current_files(chunks, entries), "entry_path", "left_anti").select("pack_id", F.col("entry_path").alias("path"))


def import_plan(items: DataFrame, entries: DataFrame, roots: DataFrame, summaries: DataFrame, force: bool = False) -> DataFrame:
    """(path, verdict, current, taken) for the root items (path, hash, is_root) of a pack's manifest: missing where no entry is there,
    outside where it lies under none of roots (path), changed where the summary's hash isn't the item's, else valid. Changed ones are
    taken only by force."""
    rows = items.where("is_root").join(entries.select("path", F.lit(True).alias("there")).distinct(), "path", "left")
    root = roots.select(paths.normalised("path").alias("__up")).distinct()
    inside = rows.select("path", F.explode(F.array_append(paths.ancestors("path", self_too=True), F.lit("/"))).alias("__up")).join(root, "__up", "left_semi").select("path", F.lit(True).alias("inside")).distinct()
    rows = rows.join(inside, "path", "left").join(summaries.select("path", F.col("source_hash").alias("current")), "path", "left").withColumn("current", F.coalesce("current", F.lit("")))
    verdict = F.when(F.col("there").isNull(), "missing").when(F.col("inside").isNull(), "outside").when(F.col("current") != F.coalesce("hash", F.lit("")), "changed").otherwise("valid")
    rows = rows.select("path", verdict.alias("verdict"), "current")
    return rows.withColumn("taken", F.col("verdict").isin("valid", *(["changed"] if force else [])))


# Classifications, weights, saved questions, sessions, notes


def confirmed(base: DataFrame, given: DataFrame, now: int) -> DataFrame:
    """Classifications where a user says the category (path, category, seq): sure, and theirs; of kind dir where none was there."""
    said = _last(given, ["path"])
    old = _updated(base, ["path"], said, category=F.col("__category"), confidence=F.lit(1.0), source=F.lit("user"), confirmed_at=F.lit(now).cast("long"))
    new = said.join(base.select("path"), "path", "left_anti").select("path", "category", F.lit("dir").alias("kind"), F.lit(1.0).alias("confidence"), F.lit("user").alias("source"), F.lit(now).alias("confirmed_at"), F.lit(now).alias("created_at"))
    return old.unionByName(_new(new, base))


def ignored(base: DataFrame, given: DataFrame, now: int) -> DataFrame:
    """Classifications where a user wants no suggestions for paths: known ones keep category and confidence, others are marked by a
    row without a category. Automatic classifications don't replace either (``state.upsert_classifications``)."""
    said = given.select("path").where("path IS NOT NULL").distinct()
    old = _updated(base, ["path"], said, source=F.lit("ignored"), confirmed_at=F.lit(now).cast("long"))
    new = said.join(base.select("path"), "path", "left_anti").select("path", F.lit("").alias("category"), F.lit("dir").alias("kind"), F.lit(0.0).alias("confidence"), F.lit("ignored").alias("source"), F.lit(now).alias("created_at"))
    return old.unionByName(_new(new, base))


def classifications_listed(base: DataFrame, source: str | None = None, category: str | None = None, limit: int = 0) -> DataFrame:
    """The surest first, of a source or a category; limit 0: all."""
    rows = reduce(lambda d, p: d.where(F.col(p[0]) == p[1]) if p[1] is not None else d, (("source", source), ("category", category)), base).orderBy(F.desc("confidence"), "path")
    return rows.limit(limit) if limit else rows


def weights_set(base: DataFrame, given: DataFrame, now: int) -> DataFrame:
    """Weights after those given (target_kind, target, weight, source, reason, seq), for paths without entries too."""
    keys = ["target_kind", "target"]
    return state.replaced(base, _new(_last(given, keys).withColumn("updated_at", F.lit(now)), base), keys).select(*base.columns)


def without(base: DataFrame, keys: DataFrame) -> DataFrame:
    """base without the rows that have the values of keys in its columns: weights, saved questions, classifications or summaries."""
    return base.join(keys.distinct(), keys.columns, "left_anti").select(*base.columns)


def recent_weights(entries: DataFrame, now: int, days: int, limit: int = 200) -> DataFrame:
    """(path, weight) of the entries that changed last within days: 2 within a week, 1.5 within 30 days, 1.2 within 90, else 1."""
    age = F.floor(F.greatest(F.lit(now) - F.col("modified_s"), F.lit(0)) / state.DAY)
    rows = entries.where(F.col("modified_s") > now - days * state.DAY).orderBy(F.desc("modified_s"), "path").limit(limit)
    return rows.select("path", F.when(age <= 7, 2.0).when(age <= 30, 1.5).when(age <= 90, 1.2).otherwise(1.0).alias("weight"))


def saved(base: DataFrame, given: DataFrame, now: int) -> DataFrame:
    """Saved questions after those given (name, question, mode, scope, seq); a name's new question replaces its old one."""
    return state.replaced(base, _new(_last(given, ["name"]).withColumn("created_at", F.lit(now)), base), ["name"]).select(*base.columns)


def sessions_after(base: DataFrame, asked: DataFrame, turns: DataFrame, now: int) -> DataFrame:
    """Sessions (id, scope, created_at, updated_at) with those asked for (id, scope, seq) that are new, the first scope counting; the
    ones with new turns (session_id) were updated now."""
    first = asked.dropna(subset=["id"]).groupBy("id").agg(F.min_by(F.struct("scope"), "seq").alias("s")).select("id", F.col("s.scope").alias("scope"))
    new = first.join(base.select("id"), "id", "left_anti").select("id", "scope", F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"))
    return _updated(base.unionByName(_new(new, base)), ["id"], turns.select(F.col("session_id").alias("id")).distinct(), updated_at=F.lit(now).cast("long"))


def notes_after(base: DataFrame, given: DataFrame) -> DataFrame:
    """Anchors of notes after those given (note_path, anchor, anchor_kind, title, pack, seq): one a note."""
    return state.replaced(base, _new(_last(given, ["note_path"]), base), ["note_path"]).select(*base.columns)


def notes_of(base: DataFrame, anchors: DataFrame) -> DataFrame:
    """The notes of anchors (anchor), of each the last by path first."""
    return base.join(anchors.select("anchor").distinct(), "anchor", "left_semi").orderBy("anchor", F.desc("note_path"))


# Summaries, chunks, queues


def summaries_written(base: DataFrame, given: DataFrame) -> DataFrame:
    """Summaries after those given, whole rows with a seq: the short form comes from the text where there is none, and where they came
    from isn't known."""
    rows = _last(given, ["path"]).withColumns({"summary_l0": F.coalesce("summary_l0", text.abstract("summary"))}).drop("provider", "passes", "fallback")
    return state.replaced(base, _new(rows, base), ["path"]).select(*base.columns)


def summaries_restored(base: DataFrame, given: DataFrame) -> DataFrame:
    """Summaries with older texts again (path, summary, summary_l0, model, seq); their vectors go, the rest stays."""
    l0 = F.coalesce("__summary_l0", text.abstract("__summary"))
    return _updated(base, ["path"], _last(given, ["path"]), summary=F.col("__summary"), summary_l0=l0, embedding=F.lit(None).cast("array<float>"), model=F.coalesce("__model", "model"))


def summaries_sourced(base: DataFrame, given: DataFrame) -> DataFrame:
    """Summaries with where they came from (path, provider, passes, fallback, seq)."""
    return _updated(base, ["path"], _last(given, ["path"]), provider=F.col("__provider"), passes=F.col("__passes"), fallback=F.col("__fallback"))


def languages_set(chunks: DataFrame, given: DataFrame) -> DataFrame:
    """Chunks of files with a language said for the file (entry_path, language, seq)."""
    return _updated(chunks, ["entry_path"], _last(given, ["entry_path"]), language=F.col("__language"))


def chunks_for_mode(chunks: DataFrame, root: str, mode: str) -> DataFrame:
    """What stays of chunks after a summary of root: all to augment it, none below it to compress or to keep summaries alone."""
    if mode not in ("augment", "compress", "summaries-only"):
        raise ValueError(mode)
    return chunks if mode == "augment" else state.without_subtree(chunks, root, "entry_path")


def queue_marked(queue: DataFrame, given: DataFrame, now: int) -> DataFrame:
    """The queue with states and errors as given (path, state, error, seq); other paths than its own change nothing."""
    return _updated(queue, ["path"], _last(given, ["path"]), state=F.col("__state"), error=F.col("__error"), updated_at=F.lit(now).cast("long"))


# Lookups and ordered lists


def lookup(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Each distinct row of keys with its row of table, if there is one, and whether there is (found); of several rows one counts.
    Key columns have the same names in both; null is a key like others."""
    rest = [c for c in table.columns if c not in keys.columns]
    there = table.dropDuplicates(keys.columns).withColumn("__there", F.lit(True)).alias("t")
    match = reduce(Column.__and__, [F.col(f"k.{c}").eqNullSafe(F.col(f"t.{c}")) for c in keys.columns])
    rows = keys.distinct().alias("k").join(there, match, "left")
    return rows.select(*[F.col(f"k.{c}").alias(c) for c in keys.columns], F.col("__there").isNotNull().alias("found"), *rest)


def ranked(ranking: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """Rows of table for a ranking (key, rank) in its order; keys without a row are left out."""
    return ranking.select(key, "rank").join(table, key).orderBy("rank", key)


def children(summaries: DataFrame, parents: DataFrame) -> DataFrame:
    """Summaries of what lies in directories (path), of each the files before the directories, then by path."""
    rows = summaries.join(parents.select(F.col("path").alias("parent_path")).distinct(), "parent_path", "left_semi")
    return rows.orderBy("parent_path", F.desc("kind"), "path")


def apps_of(apps: DataFrame, directories: DataFrame | None = None, primary: bool = False) -> DataFrame:
    """Applications of directories (path), of each the primary one first, or that one alone; of all, by family and name."""
    rows = apps.where("is_primary") if primary else apps
    if directories is None:
        return rows.orderBy("family", "app_name", "path")
    return rows.join(directories.select("path").distinct(), "path", "left_semi").orderBy("path", F.desc("is_primary"), F.desc("specificity"), "app_name")


def history(ledger: DataFrame, subjects: DataFrame) -> DataFrame:
    """All decisions about (decision_type, subject), of each in the order in which they were made."""
    keys = ["decision_type", "subject"]
    return ledger.join(subjects.select(*keys).distinct(), keys, "left_semi").orderBy(*keys, "id")


def failed(queue: DataFrame, limit: int = 50) -> DataFrame:
    """(path, error) of the items that failed last."""
    return queue.where("state = 'failed'").orderBy(F.desc("updated_at"), "path").select("path", "error").limit(limit)


def first_texts(chunks: DataFrame) -> DataFrame:
    """(entry_path, text) of each file's first chunk."""
    return chunks.groupBy("entry_path").agg(F.min_by(F.struct("text"), "seq").alias("t")).select("entry_path", F.col("t.text").alias("text"))


def code_chunks(chunks: DataFrame, prefix: str = "", limit: int = 0) -> DataFrame:
    """Chunks with a language at or below a path, in their order; limit 0: all."""
    rows = chunks.where(paths.under("entry_path", prefix)).where("language IS NOT NULL").orderBy("entry_path", "seq")
    return rows.limit(limit) if limit else rows


def vectors_of(chunks: DataFrame) -> DataFrame:
    """(id, embedding) of the chunks that have a vector, for a stream or a file."""
    return chunks.where("embedding IS NOT NULL").select("id", "embedding")


def first_dimension(chunks: DataFrame) -> int | None:
    """The number of components of the vector of least id, None without vectors."""
    row = vectors_of(chunks).where(F.size("embedding") > 0).agg(F.min_by(F.size("embedding"), "id").alias("n")).first()
    return row["n"]
