"""Toxicity by a factorization machine over hashed terms.

A text is the set of its words' hashes. Terms that occur with toxic labels more or less often than by chance are
selected on a sample of labelled rows, and the most frequent ones besides, and on these a factorization machine of degree two is fitted: a weight and
a vector of ``FACTORS`` numbers for each term. The product of two terms' vectors is the weight of their meeting, so
an insult and the mention of a group may count for more, or less, than both do alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import text_or_empty, written

BUCKETS = 1 << 20
FACTORS = 8
#: Labelled rows that the model is fitted on at most (the least by a hash of doc_id), and terms that it has at most.
SAMPLE = 20_000
TERMS = 8192
#: Of these, the most frequent ones whatever they tell alone: a pair may tell what its halves don't.
COMMON = 256
LEAST_COUNT = 5
LEAST_Z = 3.5
EPOCHS = 20
#: Rows that are scored at a time: bounds what a worker holds.
SLICE = 1000
THRESHOLD = 0.3


def terms(text: Column) -> Column:
    """The distinct hashed words of a text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))


def held_out() -> Column:
    """Whether a row is kept from learning: crc32 of doc_id as text leaves 2 by 4. A null doc_id is not, but has no label."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Machine:
    """term: the selected buckets, ascending; weight and factors: one row for each; bias."""

    term: np.ndarray
    weight: np.ndarray
    factors: np.ndarray
    bias: float

    def sums(self, row: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Per row the raw score and the sum of its terms' vectors; ``at``: places of terms in ``term``."""
        v = self.factors[at]
        first = np.array([np.bincount(row, v[:, k], n) for k in range(v.shape[1])]).reshape(-1, n).T
        square = np.bincount(row, (v**2).sum(1), n)
        return self.bias + np.bincount(row, self.weight[at], n) + 0.5 * ((first**2).sum(1) - square), first

    def score(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.term, term), max(0, len(self.term) - 1))
        known = self.term[at] == term if len(self.term) else np.zeros(len(term), bool)
        raw = self.sums(row[known], at[known], n)[0]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fitted(term: np.ndarray, row: np.ndarray, at: np.ndarray, label: np.ndarray, seed: int = 7) -> Machine:
    """By mini-batches with steps that shrink with each parameter's own past (Adagrad). row: ascending."""
    rng = np.random.default_rng(seed)
    n, k = len(label), len(term)
    rate = float(np.clip(label.mean() if n else 0.0, 1e-3, 1 - 1e-3))
    m = Machine(term, np.zeros(k), rng.normal(0, 0.02, (k, FACTORS)), float(np.log(rate / (1 - rate))))
    past_w, past_v, past_b = np.full(k, 1e-2), np.full((k, FACTORS), 1e-2), 1e-2
    starts = np.searchsorted(row, np.arange(n + 1))
    for _ in range(EPOCHS if k else 0):
        order = rng.permutation(n)
        for i in range(0, n, 256):
            docs = order[i : i + 256]
            size = starts[docs + 1] - starts[docs]
            r = np.repeat(np.arange(len(docs)), size)
            a = at[np.repeat(starts[docs] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            raw, first = m.sums(r, a, len(docs))
            off = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[docs]) / len(docs)
            used, inv = np.unique(a, return_inverse=True)
            gw = np.bincount(inv, off[r], len(used)) + 1e-4 * m.weight[used]
            part = off[r][:, None] * (first[r] - m.factors[a])
            gv = np.array([np.bincount(inv, part[:, j], len(used)) for j in range(FACTORS)]).reshape(-1, len(used)).T + 1e-3 * m.factors[used]
            past_w[used] += gw**2
            past_v[used] += gv**2
            past_b += off.sum() ** 2
            m.weight[used] -= 0.3 * gw / np.sqrt(past_w[used])
            m.factors[used] -= 0.05 * gv / np.sqrt(past_v[used])
            m.bias -= 0.1 * off.sum() / np.sqrt(past_b)
    return m


def learn(docs: DataFrame, labels: DataFrame) -> Machine:
    """Fits on the labelled rows that aren't held out. Of labels with one doc_id the largest counts; null ones don't.

    What goes to the driver is bounded by SAMPLE and TERMS. Without labelled rows every text gets the same score.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL AND NOT " + "coalesce(crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2, false)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    sample = written(texts.join(F.broadcast(known), "doc_id").select("doc_id", "toxic", terms(F.col("text")).alias("terms")), "labelled")
    total = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n, toxic = total["n"], total["t"] or 0
    rate = toxic / n if n else 0.0
    each = sample.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("c"), F.sum("toxic").alias("t")).where(F.col("c") >= LEAST_COUNT)
    z = (F.col("t") - F.col("c") * rate) / F.sqrt(F.col("c") * rate * (1 - rate) + 1e-9)
    telling = each.select("term", F.abs(z).alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(TERMS - COMMON).collect()
    common = each.orderBy(F.desc("c"), "term").limit(COMMON).collect()
    term = np.array(sorted({r["term"] for r in telling + common}), np.int64)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.intersect1d(np.array(x, np.int64), term) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32()))], ["doc_id", "toxic", "terms"])

    got = sample.mapInArrow(kept, "doc_id long, toxic int, terms array<int>").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    column = got.column("terms").combine_chunks()
    size = np.array([len(x) for x in column], np.int64)
    at = np.searchsorted(term, np.concatenate([np.array(x.as_py(), np.int64) for x in column] or [np.empty(0, np.int64)]))
    return fitted(term, np.repeat(np.arange(len(size)), size), at, got.column("toxic").to_numpy().astype(np.float64))


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """docs with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on); columns of these names are replaced.

    A null text counts as an empty one, which gets the score of a text without any of the model's terms. Rows are independent,
    repeated ones included. Only the text is looked at.
    """
    rest = [c for c in docs.columns if c not in ("score", "predicted")]

    # Only the terms go to Python; the other columns stay where they are.
    @F.arrow_udf("double")
    def scores(lists: pa.Array) -> pa.Array:
        out = []
        for i in range(0, len(lists), SLICE):
            part = lists.slice(i, SLICE)
            size = part.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            out.append(machine.score(np.repeat(np.arange(len(part)), size), part.flatten().to_numpy(zero_copy_only=False), len(part)))
        return pa.array(np.concatenate(out) if out else np.empty(0))

    scored = docs.select(*[F.col(f"`{c}`") for c in rest], scores(terms(text_or_empty())).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
