"""A corpus from raw documents to packed sequences, in stages that each take what the one before has kept.

1. toxicity: documents that the factorization machine rejects go.
2. ngram_join: of each component of near copies (five-word shingles, a Jaccard similarity of 0.8 or more) the document with the smallest id stays.
3. substring_dedup: words under a window of 50 words that an earlier document holds too go, and so do
   documents that have no other words.
4. secret_scan: every secret is replaced by a marker.
5. best_fit_packing: the ids of what is left, in sequences of 2048 tokens.

All but the last return the columns of documents, with n_chars brought up to date where the text changes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import ngram_join, packing, secrets, substring_dedup, toxicity
from tessella.llm.common import by_ids, delete_written, table, written

#: Near copies: so many hundredths of their shingles of so many words are common. op8's contract (4 and 85) binds only op8.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _whole(docs: DataFrame) -> Column:
    """A row's columns as one, so that none of them meets a column of an operator."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(_whole(docs), "text"), machine)
    return scored.where("predicted = 0").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = ngram_join.link(docs, percent=NEAR_PERCENT, length=NEAR_WORDS).where("component_id <> doc_id").select("doc_id").distinct()
    return by_ids(docs, gone, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup_substrings(docs, carry=True).where("n_removed = 0 OR n_removed < n_words")
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    text = F.col("kept").cast("string")
    chars = [F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("row.n_chars")).cast("long").alias("n_chars")] if "n_chars" in docs.columns else []
    out = kept.select("doc_id", text.alias("text"), *[F.col(f"row.`{c}`").alias(c) for c in rest], *chars)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.scan(docs.select(_whole(docs), "text")).withColumn("hit", F.size("spans") > 0)
    out = secrets.redacted(found)
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("hit"), F.length("text")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else None).cast("long")}
    return out.select(*[(changed[c] if c in changed else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack),
]

#: Neither the learned scores nor the packing can be said in SQL. On the smallest table a test holds near copies and repeated
#: passages against brute force, and toxicity and redaction against their operators' own output.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            delete_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
