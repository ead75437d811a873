"""An inverted index with places, asked by many questions at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import predicates
from tessella.functions.text import is_stub, search_tokens
from tessella.operators import search
from tessella.sources.shared import stored

FIELDS = ("text", "heading", "entry_path", "chunk_id")


@dataclass(frozen=True)
class Index:
    """postings: (term, id, tf, places); rows: (id, entry_path, stub, length). Places number the words of all fields, with a gap
    between two fields. Both are to be written once, as ``write`` does, and then serve any number of questions."""

    postings: DataFrame
    rows: DataFrame

    def write(self, path: str) -> Index:
        self.postings.repartition("term").sortWithinPartitions("term").write.parquet(f"{path}/postings")
        self.rows.write.parquet(f"{path}/rows")
        return read(self.postings.sparkSession, path)


def read(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/rows"))


def build(chunks: DataFrame, fields: tuple[str, ...] = FIELDS) -> Index:
    """The index of chunks (chunk_id, one row each; entry_path and the fields). Null fields have no words; a chunk without any is a row of length 0, and one without text counts as a stub."""
    words = [search_tokens(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields]
    gap = F.array(F.lit(None).cast("string"))
    spaced = [words[0]]
    for w in words[1:]:
        spaced += [gap, w]
    all_words = chunks.select(F.col("chunk_id").alias("id"), F.concat(*spaced).alias("w"))
    # A chunk's words are put in order within its row, so all places of a term stand together there and no word is shuffled.
    placed = F.filter(F.transform("w", lambda w, i: F.struct(w.alias("term"), i.alias("place"))), lambda s: s["term"].isNotNull())
    at = lambda i: F.get(F.col("s"), i)
    begins = F.filter(F.transform("s", lambda s, i: i), lambda i: (i == 0) | (at(i)["term"] != at(i - 1)["term"]))
    last = lambda k: F.coalesce(F.get(F.col("begins"), k + 1), F.size("s")) - 1
    runs = F.transform("begins", lambda b, k: F.struct(at(b)["term"].alias("term"), F.transform(F.sequence(b, last(k)), lambda i: at(i)["place"]).alias("places")))
    rows = all_words.select("id", F.sort_array(placed).alias("s")).withColumn("begins", begins).select("id", F.explode(runs).alias("r"))
    postings = rows.select("r.term", "id", F.size("r.places").cast("long").alias("tf"), "r.places")
    rows = chunks.select(F.col("chunk_id").alias("id"), "entry_path", F.coalesce(is_stub("text"), F.lit(True)).alias("stub"), sum((F.size(w) for w in words[1:]), F.size(words[0])).cast("long").alias("length"))
    return Index(postings, rows)


_ASKED = "question long, slot int, term string, n int, phrase boolean, code boolean, broad boolean"


def asked(questions: DataFrame, phrased: bool = True) -> DataFrame:
    """What questions (question, text) ask for, a row each: their terms (phrase false), and where they have several, or none but short
    and common words, all words in order (phrase true, n of them)."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for number, text in zip(b["question"], b["text"], strict=True):
                tokens, terms = search.query_terms(text or "")
                kind = predicates.is_code(text or ""), predicates.is_broad(text or "")
                out += [(number, i, t, 1, False, *kind) for i, t in enumerate(terms)]
                if not terms or (phrased and len(terms) > 1):
                    out += [(number, i, t, len(tokens), True, *kind) for i, t in enumerate(tokens)]
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in _ASKED.split(", ")])

    return questions.select(F.col("question").cast("long").alias("question"), "text").mapInPandas(split, _ASKED)


def sparse(index: Index, questions: DataFrame, admitted: Column | None = None, limit: int = search.ARM, phrased: bool = True) -> DataFrame:
    """(question, id, score, rank from 0) by BM25 for each question (question, text): its terms, and its words as a phrase, as
    ``retrieve.match`` counts them.

    ``admitted``, a condition on the index's rows, says what may be found; numbers of rows and mean lengths are those of all.
    All questions' words meet the postings in one join, and of the texts only those words' rows are read. A question without
    words, or null, finds nothing; ties go to the smaller id. Questions that share a word share its rows, so a word that
    all ask for is as many rows as questions times chunks that hold it.
    """
    # Written, so their size is known: few questions' words are sent to the postings, which then stay where they are.
    words = stored(asked(questions, phrased))
    met = words.join(index.postings, "term")
    once = met.where("NOT phrase").select("question", "term", "id", "tf")
    slots = met.where("phrase").groupBy("question", "id", "n").agg(F.collect_list(F.transform("places", lambda p: p - F.col("slot"))).alias("at"))
    begins = F.aggregate(F.slice("at", 2, F.size("at")), F.col("at")[0], lambda a, b: F.array_intersect(a, b))
    # No word holds a blank.
    said = slots.where(F.size("at") == F.col("n")).select("question", F.lit(" ").alias("term"), "id", F.size(begins).cast("long").alias("tf")).where("tf > 0")
    hits = once.unionByName(said)
    df = hits.groupBy("question", "term").agg(F.count("*").alias("df"))
    totals = index.rows.agg(F.count("*").alias("n_all"), F.avg("length").alias("mean"))
    rows = index.rows.where(admitted) if admitted is not None else index.rows
    found = hits.join(rows.select("id", "length"), "id").join(df, ["question", "term"]).join(F.broadcast(totals))
    idf = F.log((F.col("n_all") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = search.K1 * (1 - search.B + search.B * F.col("length") / F.col("mean"))
    part = F.when(idf > 0, idf).otherwise(1e-6) * F.col("tf") * (search.K1 + 1) / (F.col("tf") + norm)
    scored = found.groupBy("question", "id").agg(F.sum(part).alias("score"))
    return _first(scored, limit, 9)


def _first(scored: DataFrame, limit: int | Column, digits: int, key: str = "id") -> DataFrame:
    """The first rows of each question by score, ties to the smaller key, with rank from 0."""
    order = Window.partitionBy("question").orderBy(F.desc(F.round("score", digits)), key)
    return scored.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).where(F.col("rank") < limit)
