"""Token-ID output as patched frame-of-reference blocks.

The ids of a segment (a run of documents) are cut into blocks of ``BLOCK``. A block stores its minimum, a
width in bits that covers a percentile of what the ids exceed the minimum by, that many low bits of every
id, and for the few that need more the place and the high bits in exception lists. An index has the start
of every block, so that one block can be read alone.

A segment's bytes: magic, then little-endian unsigned 32-bit numbers of documents, ids, and blocks; ids of
each document; start of each block in the part that follows, and one beyond the last. A block: minimum (4
bytes), width (1), number of exceptions (2), the packed low bits, the exceptions' places (2 each) and their
high bits (4 each).

Segments are the rows of a Parquet table: Spark's committer sees to it that every segment is there once
whatever executors are lost, and any store that Spark writes will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import cut, partitions, text_or_empty
from tessella.llm.token_ids import SLICE_BYTES, chunk_encoder

MAGIC = b"TSP1"
BLOCK = 1024
PERCENTILE = 97
SEGMENT_IDS = 1_000_000

SEGMENTS = "part int, seq int, ids_before long, n_docs int, n_ids long, doc_ids binary, payload binary"


def pack(ids: np.ndarray, lengths: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """A segment's bytes for ids (uint32) and the number of ids of each of its documents."""
    ids = np.ascontiguousarray(ids, "<u4")
    n = -(-len(ids) // BLOCK)
    if not n:
        return MAGIC + struct.pack("<3I", len(lengths), 0, 0) + lengths.astype("<u4").tobytes() + struct.pack("<I", 0)
    full = np.concatenate([ids, np.full(n * BLOCK - len(ids), ids[-1], "<u4")]).reshape(n, BLOCK)
    least = full.min(1)
    over = full - least[:, None]
    at = min(BLOCK - 1, int(BLOCK * percentile / 100))
    usual = np.partition(over, at, axis=1)[:, at]
    width = np.ceil(np.log2(usual.astype(np.float64) + 1)).astype(np.uint8)
    blocks: list[bytes] = [b""] * n
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        v = over[rows]
        kind = 16 if w <= 16 else 32
        bits = np.unpackbits(v.astype(f"<u{kind // 8}").view(np.uint8), bitorder="little").reshape(len(rows), BLOCK, kind)[:, :, :w]
        low = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
        high = v >> np.uint32(w) if w < 32 else np.zeros_like(v)
        for k, r in enumerate(rows.tolist()):
            places = np.flatnonzero(high[k])
            blocks[r] = struct.pack("<IBH", least[r], w, len(places)) + low[k].tobytes() + places.astype("<u2").tobytes() + high[k, places].astype("<u4").tobytes()
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u4")
    return MAGIC + struct.pack("<3I", len(lengths), len(ids), n) + lengths.astype("<u4").tobytes() + starts.tobytes() + b"".join(blocks)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the documents' lengths of a segment."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    docs, total, n = struct.unpack_from("<3I", data, 4)
    at = 16
    lengths = np.frombuffer(data, "<u4", docs, at)
    starts = np.frombuffer(data, "<u4", n + 1, at + 4 * docs)
    base = at + 4 * docs + 4 * (n + 1)
    out = np.empty((n, BLOCK), "<u4")
    heads = [struct.unpack_from("<IBH", data, base + s) for s in starts[:n].tolist()]
    width = np.array([h[1] for h in heads], np.int64)
    raw = np.frombuffer(data, np.uint8)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        size = BLOCK * w // 8
        low = raw[(base + starts[rows].astype(np.int64) + 7)[:, None] + np.arange(size)]
        kind = 16 if w <= 16 else 32
        bits = np.zeros((len(rows), BLOCK, kind), np.uint8)
        bits[:, :, :w] = np.unpackbits(low, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
        out[rows] = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little").view(f"<u{kind // 8}")
    for k, (least, w, exceptions) in enumerate(heads):
        if exceptions:
            p = base + int(starts[k]) + 7 + BLOCK * w // 8
            places = np.frombuffer(data, "<u2", exceptions, p)
            out[k, places] |= np.frombuffer(data, "<u4", exceptions, p + 2 * exceptions) << np.uint32(w)
        out[k] += np.uint32(least)
    return out.ravel()[:total], lengths


def read_block(data: bytes, k: int) -> np.ndarray:
    """The ids of block k of a segment alone, by the index."""
    docs, total, n = struct.unpack_from("<3I", data, 4)
    base = 16 + 4 * docs + 4 * (n + 1)
    start, end = struct.unpack_from("<2I", data, 16 + 4 * docs + 4 * k)
    one = MAGIC + struct.pack("<3I", 0, min(BLOCK, total - k * BLOCK), 1) + struct.pack("<2I", 0, end - start) + data[base + start : base + end]
    return unpack(one)[0]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Writes the ids of docs' (doc_id, text) to the table at ``path`` in ascending order of doc_id.

    Each document's ids end with ``end_id``; a null or empty text has that one alone. A null doc_id comes before
    all others; rows with one doc_id follow each other in the order of their texts. Documents are dealt by ranges of
    doc_id, so a task holds a run of them; a segment never spans two tasks. Other columns are ignored.
    """
    out = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("ids_before", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("payload", pa.binary())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = chunk_encoder(tokenizer), TaskContext.get().partitionId()
        seq = before = held = 0
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []

        def segment() -> pa.RecordBatch:
            nonlocal seq, before, held
            lengths = np.array([len(x) for x in ids], np.int64)
            flat = np.concatenate(ids)
            names = b"".join(struct.pack("<?q", d is not None, d or 0) for d in doc_ids)
            row = [part, seq, before, len(ids), len(flat), names, pack(flat, lengths)]
            seq, before, held = seq + 1, before + len(flat), 0
            ids.clear()
            doc_ids.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, out, strict=True)], schema=out)

        for b in cut(batches, 1, SLICE_BYTES):
            coded, bounds = own.encode(b.column(1).to_pylist(), end_id)
            bounds = bounds.tolist()
            for doc, first, last in zip(b.column(0).to_pylist(), bounds, bounds[1:], strict=False):
                ids.append(coded[first:last])
                doc_ids.append(doc)
                held += last - first
                if held >= SEGMENT_IDS:
                    yield segment()
        if ids:
            yield segment()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    dealt = docs.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(of, SEGMENTS).write.parquet(path)


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """The documents of a written table: (doc_id, start, n_tokens, ids), or with ``digest`` their CRC-32 as
    ``ids_crc32`` in place of the ids. ``start``: ids of all documents before it.

    What goes to the driver is one number for each task that wrote, whatever the number of documents.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    totals = {r["part"]: r["n"] for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    starts, at = {}, 0
    for part in sorted(totals):
        starts[part], at = at, at + totals[part]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, lengths = unpack(row["payload"])
                ends = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
                names = np.frombuffer(row["doc_ids"], np.dtype([("there", "?"), ("doc", "<i8")]))
                if digest:
                    view = memoryview(ids.tobytes())
                    last = pa.array([zlib.crc32(view[4 * i : 4 * j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                first = starts[row["part"]] + row["ids_before"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names["doc"], mask=~names["there"]), pa.array(first + ends[:-1]), pa.array(np.diff(ends)), last],
                    ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    last = "ids_crc32 long" if digest else "ids array<int>"
    return segments.select("part", "ids_before", "doc_ids", "payload").mapInArrow(of, f"doc_id long, start long, n_tokens long, {last}")
