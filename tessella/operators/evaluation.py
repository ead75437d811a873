"""Quality of rankings against expected items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-9


def path_matches(path: Column, expected: Column) -> Column:
    """Whether a path is meant: an absolute one by equality, a relative one as its tail of whole names."""
    return F.when(expected.startswith("/"), path == expected).otherwise((path == expected) | F.endswith(path, F.concat(F.lit("/"), expected)))


def containing(docs: DataFrame, passages: DataFrame, id_column: str, words: int = 5) -> DataFrame:
    """(question, id) where a text holds a passage. The two meet by an equality, so no text is compared with all passages: by
    the first ``words`` words of a passage that stand whole in it (its first and last word may be parts of longer ones in the
    text), by all of them where there are fewer, and where there is none by the passage's first three characters. An empty
    passage, or none, is held by no text."""

    def split(t: Column) -> Column:
        return F.filter(F.split(t, r"[^\p{L}\p{N}]+"), lambda w: w != "")

    inner = split(F.col("passage"))
    n = F.least(F.lit(words), F.size(inner) - 2)
    asked = passages.select("question", "passage").where("passage <> ''")
    asked = asked.withColumns({"n": F.greatest(n, F.lit(0)), "k": F.least(F.lit(3), F.length("passage"))})
    key = F.when(F.col("n") > 0, F.xxhash64("n", F.array_join(F.slice(inner, F.lit(2), F.col("n")), " "))).otherwise(F.xxhash64(-F.col("k"), F.substring("passage", 1, 3)))
    asked = asked.withColumn("h", key)

    def runs(m: int) -> Column:
        def of(w: Column) -> Column:
            last = F.size(w) - m
            return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(m), F.array_join(F.slice(w, i + 1, m), " ")))).otherwise(F.array().cast("array<bigint>"))

        # By way of an array of one, so that the words are split once and not for every run.
        return F.transform(F.array(split(F.col("text"))), of)[0]

    def grams(k: int) -> Column:
        return F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))), lambda g: F.xxhash64(F.lit(-k), g))

    # The kinds of keys that passages have: at most as many as there are words in a run, and three.
    kinds = [(r.n, r.k) for r in asked.select("n", F.when(F.col("n") > 0, 0).otherwise(F.col("k")).alias("k")).distinct().collect()]
    if not kinds:
        return docs.select(F.lit(None).alias("question"), id_column).where("false")
    keys = F.array_distinct(F.concat(*[runs(n) if n > 0 else grams(k) for n, k in kinds]))
    met = docs.where("text IS NOT NULL").select(id_column, F.explode(keys).alias("h")).join(asked.select("question", "passage", "h"), "h").select(id_column, "question", "passage").distinct()
    return met.join(docs.select(id_column, "text"), id_column).where(F.contains("text", "passage")).select("question", id_column)


def scores(ranking: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Per question of ranking (question, item, place from 0): hit, first_rank, rr, precision, recall and ndcg over the first k.
    The ideal order is that of the items that matched."""
    gold = expected.select("question", "item").distinct()
    rows = ranking.where(F.col("place") < k).join(gold.withColumn("rel", F.lit(True)), ["question", "item"], "left")
    rel = F.col("rel").isNotNull()
    s = rows.groupBy("question").agg(
        F.count("*").alias("n"), F.count_if(rel).alias("m"), (F.min(F.when(rel, F.col("place"))) + 1).cast("long").alias("first_rank"), F.coalesce(F.sum(F.when(rel, 1 / F.log2(F.col("place") + 2))), F.lit(0.0)).alias("dcg")
    )
    s = s.join(gold.groupBy("question").agg(F.count("*").alias("expected")), "question")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("m").cast("int"), F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return s.select(
        "question", (F.col("m") > 0).alias("hit"), "first_rank", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("rr"), (F.col("m") / F.col("n")).alias("precision"),
        (F.col("m") / F.col("expected")).alias("recall"), F.when(F.col("m") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"),
    )


def golden(ranking: DataFrame, expected: DataFrame, questions: DataFrame) -> DataFrame:
    """(question, k, retrieved, hit, first_rank, rr, precision, recall, ndcg) of each of questions (question, k): ranking (question, item,
    place from 0) against expected (question, expect), paths as ``path_matches`` has them. A path may be found by several of its
    chunks: precision counts them all, recall each expected path once. Zeros where nothing was found or expected."""
    gold = expected.select(F.col("question").cast("long").alias("question"), "expect").distinct()
    top = ranking.join(questions, "question").where(F.col("place") < F.col("k")).select("question", "item", "place")
    pairs = top.join(gold, "question").where(path_matches(F.col("item"), F.col("expect")))
    right = pairs.groupBy("question", "place").agg(F.lit(True).alias("rel"))
    covered = pairs.groupBy("question").agg(F.count_distinct("expect").alias("covered"))
    rows = top.join(right, ["question", "place"], "left").groupBy("question").agg(
        F.count("*").alias("retrieved"), F.count_if("rel").alias("m"), (F.min(F.when(F.col("rel"), F.col("place"))) + 1).cast("long").alias("first_rank"), F.sum(F.when(F.col("rel"), 1 / F.log2(F.col("place") + 2))).alias("dcg")
    )
    s = questions.join(rows, "question", "left").join(covered, "question", "left").join(gold.groupBy("question").agg(F.count("*").alias("expected")), "question", "left")
    share = lambda a, b: F.when(F.col(b) > 0, F.coalesce(F.col(a), F.lit(0)) / F.col(b)).otherwise(0.0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("m").cast("int"), F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return s.select(
        "question", "k", F.coalesce("retrieved", F.lit(0)).alias("retrieved"), F.coalesce(F.col("m") > 0, F.lit(False)).alias("hit"), "first_rank", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("rr"),
        share("m", "retrieved").alias("precision"), share("covered", "expected").alias("recall"), F.when(F.col("m") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"),
    )


def aggregate(scored: DataFrame) -> DataFrame:
    """Means over questions; zeros where there are none."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return scored.agg(F.count("*").alias("questions"), mean(F.col("hit").cast("double")).alias("hit_rate"), mean("rr").alias("mrr"), mean("recall").alias("recall"), mean("ndcg").alias("ndcg"), mean("precision").alias("precision"))


def regressions(now: DataFrame, before: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(metric, now, before, delta, regressed) of two aggregates."""
    a = now.drop("questions").unpivot([], [c for c in now.columns if c != "questions"], "metric", "now")
    b = before.drop("questions").unpivot([], [c for c in before.columns if c != "questions"], "metric", "before")
    delta = F.col("now") - F.col("before")
    return a.join(b, "metric").select("metric", "now", "before", delta.alias("delta"), (delta < -(tolerance + TOLERANCE)).alias("regressed"))
