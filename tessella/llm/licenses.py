"""License scans by ordered signature rules, in DataFrame functions only.

A cheap pattern of anchors picks the texts that can name a license at all. Those are brought to lower-case
words with one space between them, the rules are gated by their keywords, and what remains is searched.
Detections carry their rule's priority; one that lies inside a detection of the same or a higher priority is
suppressed, so "apache license version 2.0" gives apache-2.0 and not the shorter name within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import running, text_or_empty
from tessella.llm.license_rules import ANCHORS, KINDS, rules

#: The phrases that always count, with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPAN = "array<struct<start:int,end:int>>"
_FOUND = "array<struct<start:int,end:int,priority:int,label:string,weight:double>>"


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _spans(text: Column, pattern: Column) -> Column:
    """The words [start, end) of each match in a text that begins and ends with a space."""

    def summed(x: Column) -> Column:
        at = running(F.zip_with(F.slice(x["before"], 1, F.size(x["found"])), x["found"], lambda b, f: b + f), lambda a, b: a + b)
        return F.transform(at, lambda a, i: F.struct((a + x["before"][i] - 1).alias("start"), (a + x["before"][i] + x["found"][i]).alias("end"))).cast(_SPAN)

    pieces = F.array(F.struct(
        F.transform(F.split(text, pattern, -1), _spaces).alias("before"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), _spaces).alias("found"),
    ))
    return F.transform(pieces, lambda x: F.when(F.size(x["found"]) > 0, summed(x)).otherwise(F.array().cast(_SPAN)))[0]


def _detections(text: Column, table: Column) -> Column:
    gated = F.filter(table, lambda r: F.exists(r["keywords"], lambda k: F.contains(text, k)))
    return F.flatten(F.transform(gated, lambda r: F.transform(
        _spans(text, r["pattern"]),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), r["priority"].alias("priority"), r["label"].alias("label"), r["weight"].alias("weight")),
    ))).cast(_FOUND)


def _unsuppressed(found: Column) -> Column:
    """Of detections, those that lie in no other of the same or a higher priority: in order of start, then longest
    first, it is enough to know how far the detections of each priority have reached so far."""
    levels = [p for p, _ in KINDS.values()]
    order = F.sort_array(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("neg"), d["priority"].alias("priority"), d["label"].alias("label"), d["weight"].alias("weight"))))

    def step(a: Column, d: Column) -> Column:
        end = -d["neg"]
        inside = F.lit(False)
        for p in levels:
            inside = inside | ((F.lit(p) <= d["priority"]) & (a[f"m{p}"] >= end))
        one = F.struct(d["start"].alias("start"), end.alias("end"), d["priority"].alias("priority"), d["label"].alias("label"), d["weight"].alias("weight"))
        return F.struct(
            *[F.when(d["priority"] == p, F.greatest(a[f"m{p}"], end)).otherwise(a[f"m{p}"]).cast("int").alias(f"m{p}") for p in levels],
            F.when(inside, a["out"]).otherwise(F.concat(a["out"], F.array(one))).cast(_FOUND).alias("out"),
        )

    start = F.struct(*[F.lit(-1).alias(f"m{p}") for p in levels], F.array().cast(_FOUND).alias("out"))
    return F.aggregate(order, start, step, lambda a: a["out"])


def scan(docs: DataFrame) -> DataFrame:
    """docs' (doc_id, text) as (doc_id, n_words, base, detections): one row for each row.

    ``base``: (start, end, label) of the fixed phrases, in words from 0. ``detections``: (start, end, priority,
    label, weight) of the rules after suppression, by start. Only A-Z are lower-cased; words are runs of letters, digits
    and anything beyond ASCII. A null text counts as an empty one and has no words. Rows are independent: repeated rows and
    null doc_ids come back as they are. Other columns are ignored. Nothing is shuffled.
    """
    table = F.array(*[
        F.struct(F.lit(p).alias("priority"), F.lit(label).alias("label"), F.array(*map(F.lit, words)).alias("keywords"), F.lit(pattern).alias("pattern"), F.lit(w).alias("weight"))
        for p, label, words, pattern, w in rules()
    ])
    anchors = "(?i)" + "|".join(ANCHORS).replace("[S]", _SEPARATOR)
    t = F.col("text")
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(t, _UPPER, _LOWER), _SEPARATOR + "+", " ")), F.lit(" "))
    typed = "array<struct<start:int,end:int,label:string>>"

    def phrases(x: Column) -> Column:
        def of(phrase: str, label: str) -> Column:
            return F.transform(_spans(x, F.lit(f"(?<= ){phrase}(?= )")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(label).alias("label")))

        each = [of(p, label) for p, label in PHRASES.items()]
        return F.sort_array(F.concat(*each)).cast(typed)

    both = F.transform(F.array(plain), lambda x: F.struct(phrases(x).alias("base"), _unsuppressed(_detections(x, table)).alias("detections")))[0]
    none = F.struct(F.array().cast(typed).alias("base"), F.array().cast(_FOUND).alias("detections"))
    found = F.when(t.rlike(anchors), both).otherwise(none)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    out = out.select("doc_id", F.size(F.regexp_extract_all(t, F.lit(_WORD), F.lit(0))).cast("long").alias("n_words"), found.alias("found"))
    return out.select("doc_id", "n_words", "found.base", "found.detections")


def report(scanned: DataFrame) -> DataFrame:
    """scan's rows as counts, places and labels. The score is the largest weight of a detection; a fixed phrase has 0.8."""
    own = F.array_distinct(F.col("base.label"))
    starts = F.col("base.start")
    weights = F.concat(F.col("detections.weight"), F.when(F.size("base") > 0, F.array(F.lit(0.8))).otherwise(F.array().cast("array<double>")))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, F.col("detections.label"))), ",").alias("labels"),
        F.coalesce(F.array_max(weights), F.lit(0.0)).alias("score"),
    )
