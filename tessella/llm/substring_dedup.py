"""Substring dedup by difference-cover anchors.

Two equal runs of ``window`` words need not start at like positions, so hashing every ``period``-th
run of words would miss them. A difference cover D modulo the period holds, for every distance, two
elements that far apart. Hence for positions i and j there is a shift below the period that puts both
i + shift and j + shift on the cover, and windows of ``window`` words that are equal share the
*aligned anchor* of ``window - period + 1`` words there. With 50 words, period 31 and the perfect
cover of 6 elements, a fifth of the positions are hashed.

1. Anchors: each document's anchors go to the task of their hash. Those in one document only go no further.
2. Extension: around every shared anchor the whole windows that hold it are hashed (96 bits) and
   dealt by that hash; every document but the smallest with a window loses the words under it.
3. The documents are joined with the places of those windows and written without the words.

A batch of documents sends one row for each hash, that of its smallest document; the others of the
batch are already known to be shared (step 1) or removed (step 2). So a passage that a third of all
documents hold costs its task one row a batch, whatever the number of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut, partitions, trimmed

WINDOW = 50

#: Bytes of text that a worker takes at a time.
ROWS_BYTES = 4_000_000

#: A perfect difference set modulo 31; every distance is a difference of two of its elements.
COVER_PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)

_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.base, np.uint64)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.inverse, np.uint64)], dtype=np.uint64)
        return self.up, self.down


_POWERS = tuple(_Powers(b) for b in _BASES)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def run_hashes(h: np.ndarray, length: int, starts: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``length`` words, by prefix sums of a polynomial."""
    up, down = _POWERS[which].upto(len(h) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum((_mix(h ^ np.uint64(0x5851F42D4C957F2D)) if which else h) * up[: len(h)], out=sums[1:])
        return _mix((sums[starts + length] - sums[starts]) * down[starts])


def cover_positions(n: int, length: int) -> np.ndarray:
    """The positions in a text of n words at which an anchor of so many words starts."""
    if n < length:
        return np.empty(0, np.int64)
    at = (np.arange(0, n - length + 1, COVER_PERIOD)[:, None] + np.array(COVER)).ravel()
    return at[at <= n - length]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _firsts(keys: list[np.ndarray]) -> np.ndarray:
    """Whether each row of sorted columns differs from the row before it."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def _combined(hashes: list[np.ndarray], doc: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (hash, document, tie), unsorted: the first row of each (hash, document, tie), whether it is of
    the hash's smallest document here, and whether the hash is in several documents here."""
    order = np.lexsort((tie, doc, *hashes[::-1]))
    hs, d, t = [h[order] for h in hashes], doc[order], tie[order]
    first = _firsts([*hs, d, t])
    order, hs, d = order[first], [h[first] for h in hs], d[first]
    group = np.cumsum(_firsts(hs)) - 1
    starts = np.flatnonzero(_firsts(hs)) if len(d) else np.empty(0, np.int64)
    smallest = d == d[starts][group] if len(d) else np.empty(0, bool)
    several = np.zeros(len(starts), bool)
    several[group[~smallest]] = True
    return order, smallest, several[group] if len(d) else smallest


_STATE = {"pending": 0, "known": 1, "both": 2}


def _anchors(window: int):
    length = window - COVER_PERIOD + 1
    out = pa.schema([("k", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, 1, ROWS_BYTES):
            hs, ds, ps = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = text.split() if text and doc is not None else ()
                if len(words) < window:
                    continue
                at = cover_positions(len(words), length)
                hs.append(run_hashes(word_hashes(words), length, at))
                ds.append(np.full(len(at), doc, np.int64))
                ps.append(at)
            if not hs:
                continue
            h, d, p = np.concatenate(hs), np.concatenate(ds), np.concatenate(ps)
            rows, smallest, several = _combined([h], d, np.zeros(len(d), np.int8))
            h, d, p = h[rows], d[rows], p[rows]
            state = np.where(smallest, np.where(several, _STATE["both"], _STATE["pending"]), _STATE["known"])
            key = np.where(smallest, h, _mix(d.view(np.uint64) * np.uint64(64) + (p % 64).view(np.uint64)))
            yield pa.RecordBatch.from_arrays([_signed(key), pa.array(d), pa.array(p * 4 + state)], schema=out)

    return of


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of a partition sorted by its first n_keys columns, in blocks that end where a key ends."""
    kept: list[list[np.ndarray]] = []
    for b in trimmed(batches):
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not b.num_rows:
            continue
        last = np.flatnonzero(_firsts(cols[:n_keys]))[-1]
        joined = kept and all(kept[-1][i][-1] == cols[i][0] for i in range(n_keys))
        if joined and last == 0:
            kept.append(cols)
            continue
        head = [*kept, [c[:last] for c in cols]]
        kept = [[c[last:] for c in cols]]
        if head and sum(len(x[0]) for x in head):
            yield [np.concatenate(x) for x in zip(*head, strict=True)]
    if kept:
        yield [np.concatenate(x) for x in zip(*kept, strict=True)]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, pos) of the anchors that more than one document holds."""
    out = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32())])
    for k, d, at in _groups(batches, 1):
        state, pos = at % 4, at // 4
        pending = state != _STATE["known"]
        kp, dp, sp, pp = k[pending], d[pending], state[pending], pos[pending]
        first = np.flatnonzero(_firsts([kp]))
        group = np.cumsum(_firsts([kp])) - 1
        many = np.zeros(len(first), bool)
        if len(kp):
            many[group[(dp != dp[first][group]) | (sp == _STATE["both"])]] = True
        keep = many[group]
        docs, places = np.r_[d[~pending], dp[keep]], np.r_[pos[~pending], pp[keep]]
        if len(docs):
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(places.astype(np.int32))], schema=out)


def _window_hashes(h: np.ndarray, window: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return run_hashes(h, window, starts, 0), run_hashes(h, window, starts, 1) & np.uint64(0xFFFFFFFF)


def _windows(window: int):
    length = window - COVER_PERIOD + 1
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, 2, ROWS_BYTES):
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for doc, th, text, places in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                words = text.split() if text else ()
                if len(words) < window:
                    continue
                h = word_hashes(words)
                at = cover_positions(len(words), length)
                anchors = run_hashes(h, length, at)
                places = np.intersect1d(np.array(places, np.int64), at)
                alive = at[np.isin(anchors, run_hashes(h, length, places))]
                last = len(words) - window
                change = np.zeros(last + 2, np.int64)
                low = np.maximum(alive - (window - length), 0)
                high = np.minimum(alive, last) + 1
                some = low < high
                np.add.at(change, low[some], 1)
                np.add.at(change, high[some], -1)
                starts = np.flatnonzero(np.cumsum(change)[:-1] > 0)
                if not len(starts):
                    continue
                a, b = _window_hashes(h, window, starts)
                for c, x in zip(cols, (a, b, np.full(len(a), doc, np.int64), np.full(len(a), th, np.int64), starts), strict=True):
                    c.append(x)
            if not cols[0]:
                continue
            a, b, d, th, p = (np.concatenate(c) for c in cols)
            rows, smallest, _ = _combined([a, b], d, th)
            a, b, d, th, p = a[rows], b[rows], d[rows], th[rows], p[rows]
            # Pending windows go by their hash; known ones, as runs of neighbours, anywhere.
            key, second, at = a[smallest], b[smallest].astype(np.int64), _place(th[smallest], p[smallest], _STATE["pending"])
            kd, kt, kp = _runs_first(d[~smallest], th[~smallest], p[~smallest])
            new = _firsts([kd, kt, kp - np.arange(len(kp))])
            run = np.diff(np.r_[np.flatnonzero(new), len(kp)])
            kd, kt, kp = kd[new], kt[new], kp[new]
            away = _mix(kd.view(np.uint64) * np.uint64(64) + (kp % 64).view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [_signed(np.r_[key, away]), pa.array(np.r_[second, run]), pa.array(np.r_[d[smallest], kd]), pa.array(np.r_[at, _place(kt, kp, _STATE["known"])])],
                schema=out,
            )

    return of


def _place(th: np.ndarray, pos: np.ndarray, state: int) -> np.ndarray:
    """A text's hash (32 bits), a position in it and a state in one number."""
    return (th << 32) | (pos * 4 + state)


def _runs_first(d: np.ndarray, th: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((p, th, d))
    return d[order], th[order], p[order]


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, pos, run): runs of windows that a smaller document holds too; rows are sorted by (a, b, doc_id)."""
    out = pa.schema([("doc_id", pa.int64()), ("th", pa.int32()), ("pos", pa.int32()), ("run", pa.int32())])
    for a, b, d, at in _groups(batches, 2):
        known = at % 4 == _STATE["known"]
        wait = ~known
        ap, bp, dp = a[wait], b[wait], d[wait]
        remove = known.copy()
        if len(ap):
            new = _firsts([ap, bp])
            remove[np.flatnonzero(wait)] = dp > dp[np.flatnonzero(new)][np.cumsum(new) - 1]
        if remove.any():
            run = np.where(known, b, 1)[remove].astype(np.int32)
            pos = ((at[remove] & 0xFFFFFFFF) // 4).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(d[remove]), pa.array((at[remove] >> 32).astype(np.int32)), pa.array(pos), pa.array(run)], schema=out)


def _kept(window: int, digest: bool, carry: bool):
    names = ["doc_id", "th", "n_words", "n_removed", "kept_sha256" if digest else "kept"]
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, 2, ROWS_BYTES):
            rows = []
            for doc, th, text, places in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                words = (text or b"").split()
                total, removed = len(words), 0
                at = [np.arange(x["pos"], x["pos"] + x["run"]) for x in places or () if x["th"] == th]
                at = np.concatenate(at) if at else ()
                if len(at):
                    h, starts = word_hashes(words), np.arange(total - window + 1)
                    a, b = _window_hashes(h, window, starts)
                    pairs = np.stack([a, b], 1).view([("a", np.uint64), ("b", np.uint64)]).ravel()
                    hit = np.flatnonzero(np.isin(pairs, pairs[at]))
                    change = np.zeros(total + 1, np.int64)
                    change[hit] += 1
                    change[hit + window] -= 1
                    gone = np.cumsum(change)[:-1] > 0
                    removed = int(gone.sum())
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = text if carry and not removed else b" ".join(words)
                rows.append((doc, th, total, removed, hashlib.sha256(kept).hexdigest() if digest else kept))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, *batch.columns[4:]], [*names, *["row"] * carry])

    return of


def dedup_substrings(docs: DataFrame, window: int = WINDOW, digest: bool = False, carry: bool = False) -> DataFrame:
    """docs' (doc_id, text) as (doc_id, th, n_words, n_removed, kept): without the words under a window of
    ``window`` words that a document with a smaller doc_id holds too; ``kept`` (binary) joins the rest by a
    space, and with ``digest`` is replaced by its SHA-256, ``kept_sha256``. With ``carry`` the other columns of
    docs come along as the struct ``row``, and ``kept`` is the text itself, null or not, where nothing is removed.

    One row for each row. Words are runs of anything but the six ASCII white-space characters, unchanged. A null
    text has no words; a text of fewer words than the window loses none. A row without doc_id keeps its words, and
    no other row loses any by it. Of rows with one doc_id (repeated rows too), none counts as smaller. A window
    repeated within one document is no ground to remove it. ``th`` is a hash of the text. Other columns are ignored.
    """
    if window < COVER_PERIOD:
        raise ValueError(f"window: at least {COVER_PERIOD} words")
    n = partitions(docs.sparkSession)
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("row")] if carry else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("th"), F.col("text").cast("binary").alias("text"), *row)
    row = ["row"] if carry else []
    anchors = docs.select("doc_id", "text").mapInArrow(_anchors(window), "k long, doc_id long, at long")
    shared = anchors.repartition(n, "k").sortWithinPartitions("k", "doc_id").mapInArrow(_shared, "doc_id long, pos int")
    shared = shared.groupBy("doc_id").agg(F.collect_set("pos").alias("places"))
    # Both joins are outer ones over the same columns, so that the documents are dealt by doc_id once.
    windows = (
        docs.join(shared, "doc_id", "left")
        .select("doc_id", "th", F.when(F.col("places").isNotNull(), F.col("text")).alias("text"), "places", *row)
        .mapInArrow(_windows(window), "a long, b long, doc_id long, at long")
    )
    repeated = windows.repartition(n, "a").sortWithinPartitions("a", "b", "doc_id").mapInArrow(_repeated, "doc_id long, th int, pos int, run int")
    repeated = repeated.groupBy("doc_id").agg(F.collect_set(F.struct("th", "pos", "run")).alias("places"))
    last = "kept_sha256 string" if digest else "kept binary"
    if carry:
        last += f", row {docs.schema['row'].dataType.simpleString()}"
    return (
        docs.join(repeated, "doc_id", "left")
        .select("doc_id", "th", "text", "places", *row)
        .mapInArrow(_kept(window, digest, carry), f"doc_id long, th int, n_words long, n_removed long, {last}")
    )
