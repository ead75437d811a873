"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Five statistics of a text are brought to scales on which ordinary texts spread about evenly. For each language
and source the minimum-covariance-determinant estimate is approached by concentration steps: start from
medians and median deviations, then again and again take the ``SUBSET`` of rows that are nearest in Mahalanobis
distance and estimate center and covariance from these. A covariance gets a floor on its diagonal, as a
statistic may be zero for all of the subset. Rows farther than ``CUTOFF`` from their group are rejected.

Only sums and quantile sketches of a group meet in one task, so a source may hold any share of the rows.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import text_or_empty, written

SUBSET = 0.75
STEPS = 3
#: Squared distance in the units of a chi-squared variable with five degrees of freedom, whose median is 4.351. Counts
#: have long tails, so it is far beyond that variable's quantiles: it is to reject junk, not the ends of ordinary texts.
CUTOFF = 150.0
MEDIAN = 4.351
#: Groups of fewer rows are judged with the other small groups of their language, and these with all others.
LEAST_ROWS = 100
#: Standard deviations that the statistics have at least: x1 to x5 of ``statistics``.
FLOOR = (0.35, 0.06, 0.5, 0.5, 0.5)

_WHITE = r"[\x20\x09-\x0D]+"
_N = len(FLOOR)
_X = [f"x{i}" for i in range(_N)]


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))

    def covered(at: Column) -> Column:
        step = lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x + 3 - a["end"])).alias("n"), (x + 3).alias("end"))
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"])

    def of(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        last = F.size(h) - 1
        several = _let(pairs, lambda z: F.filter(z, lambda s, j: ((j > 0) & (z[F.greatest(j - 1, F.lit(0))]["h"] == s["h"])) | ((j < last) & (z[F.least(j + 1, last)]["h"] == s["h"]))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(F.sort_array(F.transform(several, lambda s: s["i"]))))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(hashes, of))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), one row for each row."""
    t = F.col("text")
    cols = ["lang", "source"]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[(F.col(c) if c in docs.columns else F.lit("")).cast("string").alias(c) for c in cols], text_or_empty().alias("text"))
    words = F.filter(F.split(t, _WHITE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = _let(words, lambda w: F.struct(F.size(w).alias("n_words"), _repeated_words(w).alias("n_repeat_words")))
    out = docs.select(
        "doc_id", *cols, counted.alias("c"),
        F.length(F.regexp_replace(t, _WHITE, "")).alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
    )
    return out.select("doc_id", *cols, *[F.col(c).cast("long").alias(c.split(".")[-1]) for c in ("c.n_words", "word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words")])


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p("n_words"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log1p(100 * F.col("n_symbols") / n),
        F.log1p(100 * F.col("n_dup_lines") / n),
        F.log1p(100 * F.col("n_repeat_words") / n),
    ]


def _grouped(rows: DataFrame) -> DataFrame:
    """With ``grp``: language and source, or what a small group is joined with."""
    name = F.struct(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    rows = rows.withColumn("own", F.to_json(name))
    sizes = rows.groupBy("own").agg(F.first(F.coalesce("lang", F.lit(""))).alias("l"), F.count("*").alias("n"))
    small = sizes.where(F.col("n") < LEAST_ROWS).groupBy("l").agg(F.sum("n").alias("m"))
    where = sizes.join(small, "l", "left").select("own", F.when(F.col("n") >= LEAST_ROWS, F.col("own")).when(F.col("m") >= LEAST_ROWS, F.to_json(F.struct(F.col("l").alias("lang")))).otherwise("all").alias("grp"))
    return rows.join(where, "own").drop("own")


def _estimate(rows: DataFrame) -> DataFrame:
    """Per group its center m0... and the lower triangle l00, l10, l11... of its covariance's Cholesky factor."""
    pairs = [(i, j) for i in range(_N) for j in range(i + 1)]
    sums = rows.groupBy("grp").agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(_X)], *[F.covar_pop(_X[i], _X[j]).alias(f"c{i}{j}") for i, j in pairs])
    for i in range(_N):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") + (F.lit(FLOOR[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            sums = sums.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    return sums.select("grp", *[f"m{i}" for i in range(_N)], *[f"l{i}{j}" for i, j in pairs])


def _measured(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance: solves L y = x - m forwards."""
    joined = rows.join(estimate, "grp")
    for i in range(_N):
        rest = F.col(_X[i]) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"y{j}")
        joined = joined.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    return joined.select(*rows.columns, reduce(add, [F.col(f"y{i}") * F.col(f"y{i}") for i in range(_N)]).alias("d2"))


def _nearest(measured: DataFrame) -> DataFrame:
    limit = measured.groupBy("grp").agg(F.percentile_approx("d2", SUBSET, 1000).alias("limit"))
    return measured.join(limit, "grp").where(F.col("d2") <= F.col("limit"))


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """docs' (doc_id, text, lang, source) as (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, distance, kept), one row for each row.

    ``distance`` is squared, scaled so that half of a group's rows are within the median of a chi-squared variable. A null
    text counts as an empty one; it has fewer than 50 words and so fails. Null languages and sources count as empty
    strings, as do missing columns. Equal rows, and any with the same statistics, get the same verdict. Groups in which all rows are
    alike keep all that don't fail. Other columns are ignored. No rows give none.
    """
    rows = written(_grouped(statistics(docs)).select("*", *[x.cast("double").alias(n) for x, n in zip(_vector(), _X, strict=True)]), "statistics")
    half = [F.percentile_approx(x, 0.5, 1000).alias(f"m{i}") for i, x in enumerate(_X)]
    center = rows.groupBy("grp").agg(*half)
    apart = rows.join(center, "grp")
    spread = apart.groupBy("grp").agg(*[F.first(f"m{i}").alias(f"m{i}") for i in range(_N)], *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 1000).alias(f"s{i}") for i, x in enumerate(_X)])
    zero = [F.lit(0.0).alias(f"l{i}{j}") for i in range(_N) for j in range(i)]
    start = spread.select("grp", *[f"m{i}" for i in range(_N)], *[F.greatest(1.4826 * F.col(f"s{i}"), F.lit(FLOOR[i])).alias(f"l{i}{i}") for i in range(_N)], *zero)
    estimate = written(start, "estimate")
    for _ in range(STEPS):
        estimate = written(_estimate(_nearest(_measured(rows, estimate))), "estimate")
    scale = _measured(rows, estimate).groupBy("grp").agg(F.greatest(F.percentile_approx("d2", 0.5, 1000) / MEDIAN, F.lit(0.05)).alias("scale"))
    estimate = written(estimate.join(scale, "grp"), "estimate")
    judged = _measured(rows, estimate.drop("scale")).join(estimate.select("grp", "scale"), "grp")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far = F.col("d2") / F.col("scale")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), far.alias("distance"), (~failed & (far <= cutoff)).alias("kept"))
