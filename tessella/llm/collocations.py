"""Phrases whose words stand together more often than their parts would: collocations by language.

All 1 to 4-grams become rows (language, words, phrase, number), counted within a batch of texts, then by Spark. A phrase is
only as frequent as its rarest part, so each round over the texts first asks a bitmap of the shorter frequent phrases whether
all parts of a phrase may be frequent. The bitmap lets some phrases through in vain and holds none back, and it is of bounded
size: a larger corpus fills it, which costs rows and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, delete_written, written

#: Phrases have at most so many words.
MAX_WORDS = 4
#: A bitmap has so many bits for each phrase, and altogether at most so many (a power of two; 32 MB).
BITS_EACH, MOST_BITS = 16, 1 << 28
#: Bits of one row of a bitmap on its way to the driver.
SEGMENT = 1 << 20
#: Bytes of text that a task holds as words at once; a longer text is held whole.
SLICE = 2_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0: part of a word, 1: between words, 2: between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(x) for x in ".,;:!?"]] = 2
_KIND[0x0A:0x0E] = 2


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and for each whether it stands right after the one before it in the same piece."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    if not len(data):
        return pa.array([], pa.large_string()), np.zeros(0, bool)
    kind = _KIND[data]
    inside, breaks = kind == 0, kind == 2
    first = offsets[:-1] - offsets[0]
    first = first[first < len(data)]
    breaks[first] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    letters = _LOWER[data[inside]]
    at = np.append(np.cumsum(inside, dtype=np.int64)[starts] - 1, len(letters))
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(letters)])
    piece = np.cumsum(breaks, dtype=np.int32)[starts]
    return words, np.append([False], piece[1:] == piece[:-1])[: len(starts)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def _of_phrase(lang: np.uint64, words: list[np.ndarray]) -> np.ndarray:
    """The hash of phrases by those of their words in order."""
    h = np.full(len(words[0]), lang)
    for w in words:
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + w)
    return h


def _may_hold(bitmap: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    if bitmap is None:
        return np.ones(len(hashes), bool)
    mask = np.uint64(len(bitmap) * 8 - 1)
    both = np.ones(len(hashes), bool)
    for h in (hashes, hashes >> np.uint64(32)):
        bit = (h & mask).astype(np.int64)
        both &= (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
    return both


def _grams(texts: pa.Array, lang: str, sizes: tuple[int, ...], words_map: np.ndarray | None, pairs_map: np.ndarray | None) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(n, phrases, number of each) of texts of one language. Phrases with a word or pair that a bitmap lacks are left out."""
    words, joined = _words(texts)
    if not len(words):
        return
    coded = words.dictionary_encode()
    known, ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if sizes == (1,):
        yield 1, known, np.bincount(ids, minlength=len(known))
        return
    hashes, of_lang = _hashes(known), np.uint64(xxhash.xxh64_intdigest(lang))
    alive = _may_hold(words_map, _of_phrase(of_lang, [hashes]))[ids]
    # Places where a phrase of n words starts; its key numbers the phrases of this slice.
    starts, keys = np.flatnonzero(alive), ids[alive]
    for n in range(2, max(sizes) + 1):
        held = starts + n - 1 < len(ids)
        starts, keys = starts[held], keys[held]
        held = joined[starts + n - 1] & alive[starts + n - 1]
        if n > 2 and pairs_map is not None:
            held &= paired[starts + n - 2]
        starts, keys = starts[held], keys[held]
        if not len(starts):
            return
        keys = keys * len(known) + ids[starts + n - 1]
        _, where, keys, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        at = [ids[starts[where] + k] for k in range(n)]
        if n == 2 and pairs_map is not None:
            good = _may_hold(pairs_map, _of_phrase(of_lang, [hashes[a] for a in at]))
            paired = np.zeros(len(ids), bool)
            paired[starts] = good[keys]
            starts, keys = starts[good[keys]], keys[good[keys]]
        if n in sizes:
            yield n, pc.binary_join_element_wise(*[known.take(pa.array(a)) for a in at], pa.scalar(" ", pa.large_string())), counts


_ROW = "lang string, words int, phrase string, f long"
_ARROW = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])


def _counted(texts: DataFrame, sizes: tuple[int, ...], words_map: Broadcast | None = None, pairs_map: Broadcast | None = None) -> DataFrame:
    """(lang, words, phrase, f) of phrases of so many words. texts: lang, text."""

    size = SLICE

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, p = (np.frombuffer(x.value, np.uint8) if x else None for x in (words_map, pairs_map))
        for b in cut(batches, 1, size):
            for lang in b.column(0).unique().to_pylist():
                own = b.column(1).filter(pc.equal(b.column(0), lang))
                for n, phrases, counts in _grams(own, lang, sizes, w, p):
                    m = len(phrases)
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), m), pa.repeat(pa.scalar(n, pa.int32()), m), phrases.cast(pa.string()), pa.array(counts, pa.int64())], schema=_ARROW)

    return texts.mapInArrow(explode, _ROW).groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))


def _bitmap(phrases: DataFrame) -> Broadcast:
    """Bits of phrases (lang, phrase), two each, on every executor."""
    spark = phrases.sparkSession
    bits = 1 << max(13, int(BITS_EACH * phrases.count()).bit_length())
    bits = min(bits, MOST_BITS)
    width = min(bits, SEGMENT)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(0).to_pylist()
            of_lang = {x: np.uint64(xxhash.xxh64_intdigest(x)) for x in set(langs)}
            parts = [[np.array([xxhash.xxh64_intdigest(w)], np.uint64) for w in t.split(" ")] for t in b.column(1).to_pylist()]
            h = np.array([_of_phrase(of_lang[x], p)[0] for x, p in zip(langs, parts, strict=True)], np.uint64)
            bit = np.concatenate([h, h >> np.uint64(32)]) & np.uint64(bits - 1)
            bit = np.unique(bit.astype(np.int64))
            for s in np.unique(bit // width):
                held = np.zeros(width, bool)
                held[bit[bit // width == s] - s * width] = True
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())], names=["s", "held"])

    def merged(table: pa.Table) -> pa.Table:
        held = np.zeros(width // 8, np.uint8)
        for x in table.column("held"):
            held |= np.frombuffer(x.as_buffer(), np.uint8)
        return pa.table({"s": table.column("s")[:1].combine_chunks(), "held": pa.array([held.tobytes()], pa.binary())})

    rows = phrases.select("lang", "phrase").mapInArrow(places, "s long, held binary").groupBy("s").applyInArrow(merged, "s long, held binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        out[r.s * width // 8 : (r.s + 1) * width // 8] = np.frombuffer(r.held, np.uint8)
    return spark.sparkContext.broadcast(out.tobytes())


def phrases(docs: DataFrame, least: int = 30, max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of all phrases that occur at least so often, and (lang, n) with the number of all words.

    docs has lang and text; other columns play no part. A null lang is ``und``, a null or empty text has no words; repeated
    rows count each. Very long texts are taken whole, each by itself. An empty table has no rows in either. Both are tables in the shared folder.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    words = written(_counted(texts, (1,)), "words")
    totals = written(words.groupBy("lang").agg(F.sum("f").cast("long").alias("n")), "words-total")
    frequent = words.where(F.col("f") >= least)
    words_map = _bitmap(frequent)
    pairs = written(_counted(texts, (2,), words_map).where(F.col("f") >= least), "pairs")
    parts = [frequent, pairs]
    if max_words > 2:
        pairs_map = _bitmap(pairs)
        parts.append(_counted(texts, tuple(range(3, max_words + 1)), words_map, pairs_map).where(F.col("f") >= least))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = written(out, "phrases")
    delete_written(words, pairs)
    return out, totals




def mine(docs: DataFrame, least: int = 30, absorbed: int = 80, top: int = 2000, max_words: int = MAX_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of 2 words or more.

    a is the number of the phrase, l and r those of the parts before and after its lowest-scoring cut (ties: the earlier
    one), n that of all words of the language, score floor(2000000 * a / (l + r)). A phrase inside a longer one that has at
    least ``absorbed`` hundredths of its number is left out; as the number of phrases in between lies between theirs, one
    more word tells. Ranks go by score and a, descending, then by the phrase's bytes, so there are no ties.

    Rows, nulls and empty tables: as in ``phrases``.
    """
    counts, totals = phrases(docs, least, max_words)
    some = counts.where("words > 1").withColumnRenamed("f", "a")
    cuts = some.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", F.expr("substring_index(phrase, ' ', k)").alias("head"), F.expr("substring_index(phrase, ' ', k - words)").alias("tail"))
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    # Numbers to 20 digits: times two million they pass 64 bits.
    score = F.expr("cast((cast(a AS decimal(20, 0)) * 2000000) div (cast(l AS decimal(20, 0)) + r) AS long)")
    lowest = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low"))
    # A word more: the same phrase without its first, and without its last word.
    longer = some.where("words > 2").select("lang", F.col("a").alias("longer"), F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)") < absorbed * F.col("a").cast("decimal(20,0)")))
    flat = kept.select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
