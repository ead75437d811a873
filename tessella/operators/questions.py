"""Questions to a user as texts, answers to many of them, and what is said beforehand about findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import paths
from tessella.operators import review, search
from tessella.schema import SCHEMAS

#: Categories of a classification.
CATEGORIES = ("work", "personal", "archive", "media", "code", "system", "other")
#: By type of decision, the answers that may be given to many at once.
BATCH_ANSWERS = {
    "classification": (*CATEGORIES, "ignore"),
    "duplicate": ("keep_all",),
    "archive": ("archive", "keep_active"),
    "summary_drift": ("keep_new", "restore_old"),
    "language": ("ignore",),
    "symbol_ambiguity": ("all",),
}
#: What an answer says, by type of decision and answer; None: of any type.
LABELS = (
    ("archive", "archive", "Archive (kept indexed, down-weighted in search)"),
    ("archive", "keep_active", "Keep active (ask again if it stays untouched)"),
    ("summary_drift", "keep_new", "Keep the new summary"),
    ("summary_drift", "restore_old", "Restore the previous summary (clears its stored embedding until the next re-summarize — dense search skips the file meanwhile)"),
    ("symbol_ambiguity", "all", "All (keep every definition)"),
    (None, "ignore", "Ignore (stop suggesting)"),
    (None, "keep_all", "Keep all (no canonical)"),
)


def _all(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _param(key: str, default: str = "?") -> Column:
    return F.coalesce(F.get_json_object("params", f"$.{key}"), F.lit(default))


def _percent(x: Column) -> Column:
    return F.bround(F.coalesce(x.cast("double"), F.lit(0.0)) * 100, 0).cast("long").cast("string")


def _long(key: str) -> Column:
    return F.coalesce(F.get_json_object("params", f"$.{key}").cast("long"), F.lit(0)).cast("string")


def _n_of(key: str, options: Column) -> Column:
    """How many there are: as counted, as listed, or by the options but for the one that means all."""
    listed = F.size(F.from_json(F.get_json_object("params", f"$.{key}"), "array<string>"))
    counted = F.get_json_object("params", "$.n").cast("int")
    return F.coalesce(F.when(listed >= 0, listed), counted, F.greatest(F.size(options) - 1, F.lit(0))).cast("string")


def rendered(ledger: DataFrame) -> DataFrame:
    """(id, decision_type, subject, title, detail, options, labels, priority, created_at) of decisions. What params lack is a question mark
    or zero; unreadable options are none; of an unknown type the title names type and subject."""
    options = F.coalesce(F.from_json(F.coalesce("options", F.lit("[]")), "array<string>"), F.array().cast("array<string>"))
    subject, auto = F.coalesce("subject", F.lit("")), F.col("auto_value")
    category = F.coalesce(auto, F.get_json_object("params", "$.category"), F.lit("?"))
    sure = _percent(F.coalesce(F.col("confidence"), F.get_json_object("params", "$.confidence").cast("double")))
    chosen, at = _param("prior.chosen"), F.get_json_object("params", "$.prior.decided_at").cast("long")
    day = F.when(at > 0, F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(at / 86400).cast("int")), "yyyy-MM-dd")).otherwise("an earlier date")
    again = F.when(F.get_json_object("params", "$.prior").isNotNull(), _all("You said ", chosen, " on ", day, "; it now looks like ", category, " — keep ", chosen, " or switch?"))
    exact = F.get_json_object("params", "$.exact") == "true"
    alike = F.when(exact, "Their content fingerprints are identical.").otherwise(_all("Their summaries are ~", _percent(F.get_json_object("params", "$.similarity")), "% similar."))
    language = F.coalesce(F.get_json_object("params", "$.language"), auto, F.lit("?"))
    # The words of each type's title and detail.
    texts = {
        "classification": (
            _all(subject, " looks like ", category, " (", sure, "%)"),
            F.coalesce(again, _all("Confirm to keep ", category, ", pick another category to correct it, or choose ignore to stop suggestions for this folder.")),
        ),
        "duplicate": (
            _all(_n_of("paths", options), " copies of ", paths.basename(subject), " — which is canonical?"),
            _all(alike, " Picking a canonical copy down-weights the others to 0 in search (reversible); keep_all leaves every copy searchable."),
        ),
        "archive": (
            _all(subject, " hasn't changed in ", _long("days"), " days — archive it?"),
            _all("It holds ", _long("files"), " file(s). Archiving keeps everything indexed and searchable but down-weights it in results (reversible); keeping it active changes nothing, and the question returns if the folder stays untouched."),
        ),
        "summary_drift": (
            _all(subject, " re-summarized — the new summary disagrees with the old"),
            _all("The content is unchanged, but the regenerated summary only ~", _percent(F.get_json_object("params", "$.cosine")), "% agrees with the previous one. Old (", _param("old_model"), "): “", _param("old_l0"), "” — New (", _param("new_model"), "): “", _param("new_l0"), "”. Keep the new wording or restore the old?"),
        ),
        "language": (
            _all(subject, " looks like ", language, " — confirm its language?"),
            _all("Its ", _long("chunks"), " chunk(s) carry no language tag (no grammar for this file type — the ", language, " guess comes from the extension). Confirming tags the chunks for filters and stats; ignore leaves them untagged."),
        ),
        "symbol_ambiguity": (
            _all("'", subject, "' is defined in ", _n_of("definers", options), " files — which definition is authoritative?"),
            _all("The call graph matches bare names, so ", _long("callers"), " calling file(s) can't be told apart between these definitions. Pick the file that owns '", subject, "' (graph lookups will prefer it), or choose all to keep every definition equally valid."),
        ),
    }
    kind = F.col("decision_type")
    title, detail = _all(F.coalesce(kind, F.lit("")), ": ", subject), F.lit("This question was recorded by a newer version — update to see it properly.")
    for name, (t, d) in texts.items():
        title, detail = F.when(kind == name, t).otherwise(title), F.when(kind == name, d).otherwise(detail)

    def label(value: Column) -> Column:
        said = reduce(lambda rest, x: F.when((value == x[1]) & (F.lit(True) if x[0] is None else F.coalesce(kind == x[0], F.lit(False))), x[2]).otherwise(rest), reversed(LABELS), value)
        return F.when(value == auto, F.concat(said, F.lit(" (suggested)"))).otherwise(said)

    return ledger.select("id", "decision_type", "subject", title.alias("title"), detail.alias("detail"), options.alias("options"), F.transform(options, label).alias("labels"), "priority", "created_at")


def batch_refusal(kind: Column, chosen: Column) -> Column:
    """Why an answer may not be given to all questions of a type, null where it may: which copy, file or language is meant is a
    question of each one."""
    fine = reduce(lambda rest, x: F.when(kind == x[0], chosen.isin(*x[1])).otherwise(rest), BATCH_ANSWERS.items(), F.lit(False))
    allowed = reduce(lambda rest, x: F.when(kind == x[0], ", ".join(x[1])).otherwise(rest), BATCH_ANSWERS.items(), F.lit(None).cast("string"))
    reason = F.when(allowed.isNull(), _all("no answers to many questions of type ", F.coalesce(kind, F.lit("?")))).otherwise(_all(kind, " questions accept at once: ", allowed))
    return F.when(F.coalesce(fine, F.lit(False)), F.lit(None).cast("string")).otherwise(reason)


def checked(ledger: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers (id, chosen) with why each is refused, null for those to take with ``state.answered``: unknown, not open, of an unknown
    type, without readable options, or none of the options."""
    known = ledger.select("id", F.col("status").alias("__status"), F.col("decision_type").alias("__type"), F.from_json("options", "array<string>").alias("__options"), F.lit(True).alias("__there"))
    rows = answers.join(known, "id", "left")
    options = F.coalesce("__options", F.array().cast("array<string>"))
    refusal = (
        F.when(F.col("__there").isNull(), _all("no decision ", F.coalesce(F.col("id").cast("string"), F.lit("?"))))
        .when(F.coalesce(F.col("__status") != "open", F.lit(True)), _all("decision is ", F.coalesce("__status", F.lit("?")), ", not open"))
        .when(~F.coalesce(F.col("__type").isin(*BATCH_ANSWERS), F.lit(False)), _all("unknown type ", F.coalesce("__type", F.lit("?"))))
        .when(F.size(options) == 0, "no readable options")
        .when(~F.coalesce(F.array_contains(options, F.col("chosen")), F.lit(False)), _all("not an option of: ", F.array_join(options, ", ")))
    )
    return rows.select(*answers.columns, refusal.alias("refusal"))


def predismissed(ledger: DataFrame, findings: DataFrame, now: int) -> DataFrame:
    """The ledger after a user says no to findings before they are asked: open decisions about their subjects are dismissed, and each
    finding is there as dismissed unless the same evidence was dismissed before. Of findings of one subject the first by evidence
    counts. New ids follow the last, in the order of a hash of the subject."""
    keys = ["decision_type", "subject"]
    one = findings.groupBy(*keys).agg(F.min_by(F.struct("evidence_hash", "params", "auto_value", "confidence", "priority"), "evidence_hash").alias("f")).select(*keys, "f.*")
    hit = ledger.join(one.select(*keys, F.lit(True).alias("__hit")), keys, "left")
    shut = F.coalesce(F.col("__hit"), F.lit(False)) & (F.col("status") == "open")
    old = hit.select(*[F.when(shut, v).otherwise(F.col(c)).alias(c) if (v := {"status": F.lit("dismissed"), "decided_at": F.lit(now).cast("long")}.get(c)) is not None else F.col(c) for c in ledger.columns])
    fresh = one.join(old.where("status = 'dismissed'").select(*keys, "evidence_hash").distinct(), [*keys, "evidence_hash"], "left_anti")
    last = ledger.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))
    fresh = search.numbered(fresh.withColumns({"flag": F.lit(0), "h": F.xxhash64("subject")}), ["flag", "h", *keys], "h")
    fresh = fresh.join(F.broadcast(last)).withColumn("id", F.col("__last") + 1 + F.col("place"))
    given = {"status": F.lit("dismissed"), "source": F.lit("user"), "created_at": F.lit(now), "decided_at": F.lit(now)}
    new = fresh.select(*[(given[f.name] if f.name in given else F.col(f.name) if f.name in fresh.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS["decisions"].fields])
    return old.unionByName(new.select(*ledger.columns))


def duplicates_of(clusters: DataFrame, said: DataFrame) -> DataFrame:
    """Findings of groups of copies (as ``review.duplicates`` takes them) of which two or more paths are among those said (path)."""
    findings, members = review.duplicates(clusters)
    keys = ["decision_type", "subject", "evidence_hash"]
    met = members.join(said.select("path").distinct(), "path", "left_semi").groupBy(*keys).agg(F.countDistinct("path").alias("n")).where("n >= 2")
    return findings.join(met.select(*keys), keys, "left_semi")


def backfilled(ledger: DataFrame, touched: DataFrame, classifications: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(decisions, decision_paths) with one decided row for each classification that a user confirmed or ignored, where there is no
    decision about a classification yet; else as they are. Ids follow the last, in the
    order of a hash of the path."""
    some = ledger.where("decision_type = 'classification'").limit(1).select(F.lit(1).alias("__some"))
    rows = classifications.where("source IN ('user', 'ignored')").join(F.broadcast(some), F.lit(True), "left_anti")
    chosen = F.when(F.col("source") == "ignored", "ignore").otherwise(F.col("category"))
    rows = rows.select("path", chosen.alias("chosen"), F.coalesce("confirmed_at", "created_at").alias("at"), F.lit(0).alias("flag"), F.xxhash64("path").alias("h"))
    rows = search.numbered(rows, ["flag", "h", "path"], "h")
    last = ledger.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))
    rows = rows.join(F.broadcast(last)).withColumn("id", F.col("__last") + 1 + F.col("place"))
    given = {
        "decision_type": F.lit("classification"), "subject": F.col("path"), "params": F.lit("{}"), "options": F.lit("[]"), "chosen": F.col("chosen"), "source": F.lit("user"), "status": F.lit("decided"), "evidence_hash": F.lit(""),
        "effects": F.to_json(F.struct(F.col("chosen").alias("classification"))), "effects_applied_at": F.lit(now), "created_at": F.col("at"), "decided_at": F.col("at"), "id": F.col("id"),
    }
    new = rows.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS["decisions"].fields])
    return ledger.unionByName(new.select(*ledger.columns)), touched.unionByName(rows.select(F.col("id").alias("decision_id"), "path"))
