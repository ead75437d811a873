"""Questions to a user about the corpus: detectors that find them, the caps under which they open, and what answers change.

Findings are (decision_type, subject, params, auto_value, confidence, evidence_hash, priority, turn, weight): what comes first under
the caps has the smaller turn, then the larger weight. The paths that a finding is about are rows beside it (decision_type, subject,
evidence_hash, path), never an array, so a group of copies of any size is spread like other rows. Evidence is a digest that changes with what was
found, so that an answered or dismissed question stays quiet until then. Null paths are about nothing; repeated rows count once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import paths, predicates, text, vectors
from tessella.operators import classify, graph, state, tree
from tessella.operators.state import fingerprint
from tessella.schema import SCHEMAS

#: Languages by the extensions of files whose chunks should have one.
LANGUAGES = {
    "rust": "rs", "python": "py", "javascript": "js mjs cjs", "typescript": "ts mts cts", "tsx": "tsx", "go": "go", "java": "java", "c": "c h", "cpp": "cpp cc cxx hpp hh", "csharp": "cs", "ruby": "rb",
    "php": "php", "swift": "swift", "kotlin": "kt kts", "scala": "scala", "shell": "sh bash zsh", "perl": "pl pm", "lua": "lua", "r": "r", "dart": "dart", "elixir": "ex exs", "erlang": "erl", "haskell": "hs",
    "clojure": "clj cljs", "vue": "vue", "svelte": "svelte", "sql": "sql", "zig": "zig", "julia": "jl", "nim": "nim", "ocaml": "ml mli", "fsharp": "fs fsx", "groovy": "groovy", "objective-c": "m",
}
#: How old a directory has to be and in which steps it ages; how many chunks, definers and symbols are asked about.
STALE_DAYS, BUCKET_DAYS, LEAST_CHUNKS, MOST_DEFINERS, HOTTEST, DRIFT = 365, 90, 3, 6, 10, 0.80
#: Generated directories that can still be worth a question of age.
_ASKED = ("/assets/", "/competitors/")
#: Weights with this reason are the ledger's own; others are a user's and stay.
OWNED = "decision:"

_KEY = ["decision_type", "subject", "evidence_hash"]
_FINDING = ("decision_type", "subject", "params", "auto_value", "confidence", "evidence_hash", "priority", "turn", "weight")


def _findings(rows: DataFrame, kind: str, priority: int, turn: Column | int, **values: Column) -> DataFrame:
    given = {"params": F.lit("{}"), "auto_value": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), **values}
    given |= {"decision_type": F.lit(kind), "priority": F.lit(priority).cast("long"), "turn": turn if isinstance(turn, Column) else F.lit(turn)}
    return rows.select(*[given[c].alias(c) for c in _FINDING])


def _about(findings: DataFrame) -> DataFrame:
    return findings.select(*_KEY, F.col("subject").alias("path"))


def _hundredths() -> Column:
    return F.round(F.col("similarity") * 100).cast("long")


def _copies_evidence() -> Column:
    return fingerprint(F.when(F.col("exact"), "exact").otherwise("near"), _hundredths().cast("string"), F.col("weight").cast("string"), F.col("x").cast("string"))


def duplicates(clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (cluster, path, exact, similarity), one cluster's rows alike but for the path: findings and their paths. Exact ones come
    first. Not asked about: assets, generated files, near copies by different names, and manifests but for exact copies in one
    directory. Evidence is of the set of paths, added up hash by hash."""
    rows = clusters.where("path IS NOT NULL").select("cluster", "path", "exact", "similarity").distinct()
    piece = F.conv(F.substring(F.sha2("path", 256), 1, 15), 16, 10).cast("decimal(38,0)")
    told = rows.groupBy("cluster").agg(F.min("path").alias("subject"), F.count("*").alias("weight"), F.sum(piece).alias("x"), F.bool_and("exact").alias("exact"), F.max("similarity").alias("similarity"))
    asked = F.col("actionable") & (F.col("exact") | F.col("same_name")) & (~F.col("siblings") | (F.col("exact") & F.col("same_parent")))
    told = told.where("weight > 1").join(classify.actionable(rows), "cluster").where(asked)
    told = told.withColumn("evidence", _copies_evidence())
    found = _findings(
        told, "duplicate", 60, F.when(F.col("exact"), 0).otherwise(1), subject=F.col("subject"), auto_value=F.col("subject"), confidence=F.col("similarity").cast("double"), weight=F.col("weight").cast("double"),
        params=F.to_json(F.struct("exact", _hundredths().alias("similarity"), F.col("weight").alias("n"))), evidence_hash=F.col("evidence"),
    )
    members = rows.join(told.select("cluster", "subject", "evidence"), "cluster").select(F.lit("duplicate").alias("decision_type"), "subject", F.col("evidence").alias("evidence_hash"), "path")
    return found, members


def archives(entries: DataFrame, classifications: DataFrame, now: int, days: int = STALE_DAYS) -> DataFrame:
    """Directories of entries (path, kind, modified_s) unchanged for so long, the topmost ones, but for generated ones and those that
    are archived or the system's already. Evidence: the age in steps of 90 days and the number of files below."""
    age = F.floor((F.lit(now) - F.col("modified_s")) / state.DAY)
    padded = F.concat(F.replace("path", F.lit("\\"), F.lit("/")), F.lit("/"))
    noise = reduce(Column.__or__, [F.contains(padded, F.lit(g)) for g in classify.GENERATED if g not in _ASKED])
    stale = entries.where((F.col("kind") == "dir") & ~noise).select("path", age.alias("age"), F.lit(True).alias("is_primary")).where(F.col("age") >= days)
    stale = tree.top_level(stale.groupBy("path", "is_primary").agg(F.min("age").alias("age")))
    known = classifications.where(F.col("category").isin("archive", "system")).select("path")
    stale = stale.join(known, "path", "left_anti")
    files = entries.where("kind = 'file' AND path IS NOT NULL").select("path").distinct().select(F.explode(paths.ancestors("path")).alias("path"))
    stale = stale.join(files.groupBy("path").agg(F.count("*").alias("files")), "path", "left").withColumn("files", F.coalesce("files", F.lit(0)))
    return _findings(
        stale, "archive", 30, 2, subject=F.col("path"), auto_value=F.lit("archive"), weight=F.lit(0.0), params=F.to_json(F.struct(F.col("age").alias("days"), "files")),
        evidence_hash=fingerprint(F.floor(F.col("age") / BUCKET_DAYS).cast("string"), F.col("files").cast("string")),
    )


def languages(chunks: DataFrame, least: int = LEAST_CHUNKS) -> DataFrame:
    """Files with an extension of code and so many chunks without a language. All are found; the caps choose."""
    table = F.create_map(*[F.lit(v) for lang, es in LANGUAGES.items() for e in es.split() for v in (e, lang)])
    rows = chunks.where("language IS NULL AND entry_path IS NOT NULL").groupBy("entry_path").agg(F.count("*").alias("n"))
    rows = rows.where(F.col("n") >= least).withColumn("lang", F.try_element_at(table, paths.extension("entry_path"))).where("lang IS NOT NULL")
    return _findings(
        rows, "language", 20, 3, subject=F.col("entry_path"), auto_value=F.col("lang"), weight=F.col("n").cast("double"), params=F.to_json(F.struct(F.col("lang").alias("language"), F.col("n").alias("chunks"))),
        evidence_hash=fingerprint(F.col("lang"), F.col("n").cast("string")),
    )


def symbols(edges: DataFrame, hottest: int = HOTTEST) -> tuple[DataFrame, DataFrame]:
    """Findings and paths of the most called symbols with 2 to 6 definers, idioms left out. The answer names the definer."""
    hot = graph.ambiguous(edges).where("to_ref IS NOT NULL").orderBy(F.desc("callers"), "to_ref").limit(hottest)
    hot = hot.where(~predicates.idiom(F.col("to_ref")) & (F.col("definers") <= MOST_DEFINERS))
    at = edges.where("kind = 'defines' AND from_path IS NOT NULL").select("to_ref", F.col("from_path").alias("path")).distinct()
    # There are ``hottest`` symbols with six definers at most.
    members = at.join(F.broadcast(hot.select("to_ref", "callers")), "to_ref")
    told = members.groupBy("to_ref", "callers").agg(F.sort_array(F.collect_set("path")).alias("definers"))
    told = told.withColumn("evidence", F.sha2(F.concat(F.array_join("definers", "\0"), F.lit("\0")), 256))
    found = _findings(
        told, "symbol_ambiguity", 20, 4, subject=F.col("to_ref"), weight=F.col("callers").cast("double"), params=F.to_json(F.struct("definers", "callers")), evidence_hash=F.col("evidence"),
    )
    about = told.select(F.lit("symbol_ambiguity").alias("decision_type"), F.col("to_ref").alias("subject"), F.col("evidence").alias("evidence_hash"), F.explode("definers").alias("path"))
    return found, about


def drifts(old: DataFrame, new: DataFrame, least: float = DRIFT) -> DataFrame:
    """Summaries made again of the same content (path, source_hash) that mean something else than before. Those without a vector
    can't be compared. params hold the old text, which an answer can restore."""
    names = ["summary", "summary_l0", "embedding", "model"]
    before = old.select("path", "source_hash", *[F.col(c).alias(f"old_{c}") for c in names])
    rows = new.select("path", "source_hash", *names).join(before, ["path", "source_hash"]).where("embedding IS NOT NULL AND old_embedding IS NOT NULL")
    rows = rows.withColumn("cosine", vectors.cosine(F.col("old_embedding"), F.col("embedding"))).where(F.col("cosine") < least)
    kept = F.struct("old_summary", F.coalesce("old_summary_l0", text.abstract("old_summary")).alias("old_l0"), text.abstract("summary").alias("new_l0"), "cosine", "old_model", F.col("model").alias("new_model"))
    return _findings(rows, "summary_drift", 40, 5, subject=F.col("path"), auto_value=F.lit("keep_new"), weight=F.lit(0.0), params=F.to_json(kept), evidence_hash=fingerprint(F.col("source_hash"), F.col("model")))


def _paths_of(findings: DataFrame, members: DataFrame | None) -> DataFrame:
    own = _about(findings.where("decision_type <> 'symbol_ambiguity'"))
    return own if members is None else members.select(*_KEY, "path").unionByName(own).distinct()


def askable(ledger: DataFrame, touched: DataFrame, findings: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Findings that no answer covers, with parent_id where they ask again. touched: (decision_id, path) of the ledger.

    Duplicates and archives are covered by any open or standing decision about one of their paths, but that a directory kept active
    is asked about again once its evidence moved. A language's answer stands; symbols and drifts are asked again on other evidence.
    What was dismissed on this evidence or is open stays as it is. Near copies aren't asked about with an exact copy's paths."""
    about = _paths_of(findings, members)
    live = ledger.where("status = 'open' OR (status = 'decided' AND superseded_by IS NULL)").select(
        F.col("id").alias("decision_id"), F.col("evidence_hash").alias("old_evidence"), ((F.col("decision_type") == "archive") & (F.col("status") == "decided") & F.coalesce(F.col("chosen") == "keep_active", F.lit(False))).alias("kept")
    )
    by_path = about.where("decision_type IN ('duplicate', 'archive')").join(touched.join(live, "decision_id").select("path", "decision_id", "old_evidence", "kept"), "path")
    again = F.col("kept") & (F.col("decision_type") == "archive")
    by_path = by_path.groupBy(*_KEY).agg(
        F.max(~again | (F.col("old_evidence") == F.col("evidence_hash"))).alias("covered"), F.max(F.when(again & (F.col("old_evidence") != F.col("evidence_hash")), F.col("decision_id"))).alias("parent_id")
    )
    standing = state.current_decisions(ledger).where("decision_type IN ('language', 'symbol_ambiguity', 'summary_drift')").select("decision_type", "subject", F.col("evidence_hash").alias("old_evidence"), F.col("id").alias("parent_id"))
    by_subject = findings.join(standing, ["decision_type", "subject"]).select(*_KEY, ((F.col("decision_type") == "language") | (F.col("old_evidence") == F.col("evidence_hash"))).alias("covered"), "parent_id")
    rows = findings.join(by_path.unionByName(by_subject), _KEY, "left").where("NOT coalesce(covered, false)").drop("covered")
    rows = rows.join(ledger.where("status = 'dismissed'").select(*_KEY), _KEY, "left_anti").join(ledger.where("status = 'open'").select("decision_type", "subject"), ["decision_type", "subject"], "left_anti")
    exact = about.join(rows.where("decision_type = 'duplicate' AND turn = 0").select(*_KEY), _KEY, "left_semi").select("path").distinct()
    near = about.join(exact, "path", "left_semi").join(rows.where("decision_type = 'duplicate' AND turn = 1").select(*_KEY), _KEY, "left_semi").select(*_KEY).distinct()
    rows = rows.join(near, _KEY, "left_anti")
    # Of several about one subject the first counts; there are as many as detectors that know it.
    first = F.row_number().over(Window.partitionBy("decision_type", "subject").orderBy("turn", "evidence_hash"))
    return rows.withColumn("__n", first).where("__n = 1").select(*_FINDING, "parent_id")


def opened(ledger: DataFrame, touched: DataFrame, findings: DataFrame, now: int, members: DataFrame | None = None, most_new: int = 20, most_open: int = 50) -> tuple[DataFrame, DataFrame]:
    """(new rows of decisions, new rows of decision_paths) of askable findings: at most ``most_new`` a scan, and no more than leave
    ``most_open`` open, in order of turn, weight and subject. The caps are the feature: a user answers questions one by one."""
    has = ledger.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"), F.count(F.when(F.col("status") == "open", 1)).alias("open")).first()
    order = [F.asc("turn"), F.desc("weight"), F.asc("subject"), F.asc("decision_type")]
    rows = askable(ledger, touched, findings, members).orderBy(*order).limit(max(0, min(most_new, most_open - has["open"])))
    # As many rows as the cap lets through: one task numbers them.
    rows = rows.withColumn("id", F.lit(has["last"]).cast("long") + F.row_number().over(Window.orderBy(*order)))
    given = {"status": F.lit("open"), "source": F.lit("auto"), "created_at": F.lit(now)}
    new = rows.select(*[(given[f.name] if f.name in given else F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS["decisions"].fields])
    at = _paths_of(findings, members).join(F.broadcast(new.select(*_KEY, F.col("id").alias("decision_id"))), _KEY).select("decision_id", "path").distinct()
    return new, at


def vanished(ledger: DataFrame, touched: DataFrame, entries: DataFrame, summaries: DataFrame) -> DataFrame:
    """(id) of open decisions about a path that has neither entry nor summary any more."""
    rows = ledger.where("status = 'open'").select("id", "subject").join(touched.select(F.col("decision_id").alias("id"), "path"), "id", "left")
    rows = rows.select("id", F.coalesce("path", "subject").alias("path"))
    return rows.join(entries.select("path").unionByName(summaries.select("path")).distinct(), "path", "left_anti").select("id").distinct()


def swept(ledger: DataFrame, touched: DataFrame) -> DataFrame:
    """(id) of open decisions that the detectors wouldn't ask now: idioms, assets, generated files, near copies by other names."""
    mine = ledger.where("status = 'open'")
    rows = mine.where("decision_type = 'duplicate'").select(F.col("id").alias("cluster"), F.coalesce(F.get_json_object("params", "$.exact") == "true", F.lit(True)).alias("exact"))
    told = classify.actionable(rows.join(touched.select(F.col("decision_id").alias("cluster"), "path"), "cluster")).join(rows, "cluster")
    asked = F.col("actionable") & (F.col("exact") | F.col("same_name")) & (~F.col("siblings") | (F.col("exact") & F.col("same_parent")))
    named = mine.where((F.col("decision_type") == "symbol_ambiguity") & predicates.idiom(F.col("subject")))
    return told.where(~asked).select(F.col("cluster").alias("id")).unionByName(named.select("id"))


def weights_after(weights: DataFrame, decided: DataFrame, touched: DataFrame, now: int) -> DataFrame:
    """importance_weights after answers: 0 for copies that weren't chosen, 0.5 for archived directories. Rows with a reason that
    isn't the ledger's are a user's and stay. Keeping all, or a directory active, takes the ledger's own weights back, as does
    being chosen. Of several answers about a path the last counts."""
    copies = decided.where("decision_type = 'duplicate' AND chosen IS NOT NULL").select(F.col("id").alias("decision_id"), "chosen").join(touched, "decision_id")
    silent = (F.col("chosen") != "keep_all") & (F.col("path") != F.col("chosen"))
    number = F.concat(F.lit(OWNED), F.col("decision_id").cast("string"))
    copies = copies.select(F.lit("file").alias("target_kind"), F.col("path").alias("target"), F.when(silent, 0.0).alias("weight"), F.concat(number, F.lit(" duplicate of "), F.col("chosen")).alias("reason"), "decision_id")
    old = decided.where("decision_type = 'archive' AND chosen IN ('archive', 'keep_active')").withColumnRenamed("id", "decision_id")
    old = old.select(F.lit("dir").alias("target_kind"), F.col("subject").alias("target"), F.when(F.col("chosen") == "archive", 0.5).alias("weight"), F.concat(number, F.lit(" archived")).alias("reason"), "decision_id")
    keys = ["target_kind", "target"]
    wanted = copies.unionByName(old).groupBy(*keys).agg(F.max_by(F.struct("weight", "reason"), "decision_id").alias("w")).select(*keys, "w.*")
    own = F.coalesce(F.startswith("reason", F.lit(OWNED)), F.lit(False))
    manual = weights.where(~own)
    # A row that stands for the answer already keeps its time.
    same = weights.where(own).join(wanted.where("weight IS NOT NULL"), [*keys, "weight", "reason"], "left_semi")
    others = weights.where(own).join(wanted.select(*keys), keys, "left_anti")
    new = wanted.where("weight IS NOT NULL").join(manual.select(*keys), keys, "left_anti").join(same.select(*keys), keys, "left_anti")
    new = new.select(*keys, "weight", F.lit("user").alias("source"), "reason", F.lit(now).cast("long").alias("updated_at"))
    return manual.unionByName(others).unionByName(same.select(*weights.columns)).unionByName(new, allowMissingColumns=True)


def classifications_after(base: DataFrame, decided: DataFrame, now: int) -> DataFrame:
    """classifications after answers: confirmed as the user's, or kept as ignored so that they aren't proposed again."""
    said = decided.where("chosen IS NOT NULL AND (decision_type = 'classification' OR (decision_type = 'archive' AND chosen = 'archive'))")
    said = said.groupBy(F.col("subject").alias("path")).agg(F.max_by("chosen", "id").alias("chosen"))
    both = base.join(said, "path", "full")
    told, ignored, there = F.col("chosen").isNotNull(), F.col("chosen") == "ignore", F.col("source").isNotNull()
    to = {
        "kind": F.coalesce("kind", F.lit("dir")), "category": F.when(ignored, F.coalesce("category", F.lit(""))).otherwise(F.col("chosen")), "confidence": F.when(ignored, F.coalesce("confidence", F.lit(0.0))).otherwise(1.0),
        "source": F.when(ignored, "ignored").otherwise("user"), "confirmed_at": F.when(~ignored | there, F.lit(now).cast("long")), "created_at": F.coalesce("created_at", F.lit(now).cast("long")),
    }
    return both.select(*[F.when(told, to[c]).otherwise(F.col(c)).alias(c) if c in to else F.col(c) for c in base.columns])


def languages_after(chunks: DataFrame, decided: DataFrame) -> DataFrame:
    """chunks with the language that was chosen for their file. Chunks written anew take the standing answer the same way."""
    said = decided.where("decision_type = 'language' AND chosen <> 'ignore'").groupBy(F.col("subject").alias("entry_path")).agg(F.max_by("chosen", "id").alias("__said"))
    return chunks.join(said, "entry_path", "left").select(*[F.coalesce("__said", c).alias(c) if c == "language" else F.col(c) for c in chunks.columns])


def summaries_after(summaries: DataFrame, decided: DataFrame) -> DataFrame:
    """summaries with the old text where it was to be restored; their vectors are of the rejected words and go."""
    said = decided.where("decision_type = 'summary_drift' AND chosen = 'restore_old'").groupBy(F.col("subject").alias("path")).agg(F.max_by("params", "id").alias("__p"))
    part = lambda name: F.get_json_object("__p", f"$.{name}")
    hit = part("old_summary").isNotNull()
    l0 = F.coalesce(part("old_l0"), text.abstract(part("old_summary")))
    to = {"summary": part("old_summary"), "summary_l0": l0, "model": F.coalesce(part("old_model"), F.col("model")), "embedding": F.lit(None)}
    return summaries.join(said, "path", "left").select(*[F.when(hit, to[c]).otherwise(F.col(c)).alias(c) if c in to else F.col(c) for c in summaries.columns])


def applied(ledger: DataFrame, done: DataFrame, now: int) -> DataFrame:
    """The ledger with a receipt (effects, effects_applied_at) for decisions (id) whose effects were written."""
    said, kind = F.col("chosen"), F.col("decision_type")
    none = F.lit(None).cast("string")
    pair = lambda name, value: F.to_json(F.struct(value.alias(name)), {"ignoreNullFields": "false"})
    effects = (
        F.when(kind == "classification", pair("classification", said)).when(kind == "duplicate", pair("canonical", F.when(said != "keep_all", said))).when(kind == "archive", pair("classification", F.when(said == "archive", said)))
        .when(kind == "language", pair("language", F.when(said != "ignore", said))).when(kind == "symbol_ambiguity", pair("authoritative", F.when(said != "all", said)))
        .when(kind == "summary_drift", pair("summary", F.when(said == "keep_new", "kept_new").when(said == "restore_old", "restored"))).otherwise(none)
    )
    rows = ledger.join(done.select("id", F.lit(True).alias("__done")).distinct(), "id", "left")
    hit = F.coalesce("__done", F.lit(False)) & (F.col("status") == "decided") & said.isNotNull()
    to = {"effects": effects, "effects_applied_at": F.lit(now).cast("long")}
    return rows.select(*[F.when(hit, to[c]).otherwise(F.col(c)).alias(c) if c in to else F.col(c) for c in ledger.columns])


def pinned(edges: DataFrame, ledger: DataFrame) -> DataFrame:
    """edges whose symbols with an answer are defined where it says alone; answers that name no definer change nothing."""
    said = state.current_decisions(ledger).where("decision_type = 'symbol_ambiguity' AND chosen <> 'all'").select(F.col("subject").alias("to_ref"), F.col("chosen").alias("__at"))
    defines = edges.where("kind = 'defines'")
    pins = said.join(defines.select("to_ref", F.col("from_path").alias("__at")), ["to_ref", "__at"], "left_semi")
    kept = defines.join(pins, "to_ref", "left").where("__at IS NULL OR from_path = __at").drop("__at").select(*edges.columns)
    return edges.where("kind IS DISTINCT FROM 'defines'").unionByName(kept)
