"""Vectors of texts by hashed features, for where no model is at hand: near texts share words, parts of words and pairs of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import search_tokens

DIMENSION, MODEL = 256, "hashed-features-256"
#: Characters of a part of a word, and what parts and pairs count beside whole words.
PART, PART_WEIGHT, PAIR_WEIGHT = 4, 0.5, 0.7


def _features(words: Column) -> Column:
    """(feature, weight) of words: each with its parts, and each two in a row."""
    feature = lambda kind, value, weight: F.struct(F.xxhash64(F.lit(kind), value).alias("h"), F.lit(float(weight)).alias("w"))
    whole = F.transform(words, lambda w: feature(0, w, 1.0))
    marked = lambda w: F.concat(F.lit("^"), w, F.lit("$"))
    parts = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) + 3 - PART, F.lit(1))), lambda i: feature(1, F.substring(marked(w), i, F.lit(PART)), PART_WEIGHT))))
    none = F.slice(whole, 1, 0)
    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: feature(2, F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)), PAIR_WEIGHT))).otherwise(none)
    return F.concat(whole, parts, pairs)


def embed(chunks: DataFrame, id_column: str = "id", text: str = "text", dimension: int = DIMENSION) -> DataFrame:
    """chunks with ``embedding`` (unit length) and ``embed_model``; both null where a text is null or has no words.

    Each feature goes to one place with a sign, both by its hash; what a feature counts grows with the logarithm of its number. Counted
    by rows of (chunk, feature), so a long text is spread like a short one. Rows that share an id are taken for one text.
    """
    words = chunks.select(F.col(id_column).alias("__id"), search_tokens(F.col(text)).alias("words"))
    rows = words.select("__id", F.explode(_features(F.col("words"))).alias("f"))
    counted = rows.groupBy("__id", F.col("f.h").alias("h")).agg(F.sum("f.w").alias("w"))
    sign = F.when(F.col("h") < 0, -1.0).otherwise(1.0)
    placed = counted.groupBy("__id", F.pmod("h", F.lit(dimension)).cast("int").alias("place")).agg(F.sum(sign * F.log1p("w")).alias("x"))
    vectors = placed.groupBy("__id").agg(F.map_from_entries(F.collect_list(F.struct("place", "x"))).alias("held"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    value = lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0.0)) / F.col("norm")
    made = vectors.where("norm > 0").select("__id", F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), value).cast("array<float>").alias("embedding"))
    joined = chunks.drop("embedding", "embed_model").join(made, F.col(id_column) == F.col("__id"), "left").drop("__id")
    return joined.withColumn("embed_model", F.when(F.col("embedding").isNotNull(), f"hashed-features-{dimension}"))
