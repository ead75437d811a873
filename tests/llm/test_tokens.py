"""Codec, token files and packing: exact round trips against the tokenizers library."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessella.llm import bpe_codec, packing, token_files, token_ids

BYTES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    pieces = [" ", "  ", "\n", "\t", "a", "b", "the", "'s", "'ll", "1", "23", "!", "é", "ß", "中", "文", "😀", "\x1c", "\x85", "\xa0", "<|endoftext|>", "İ", "Σ", "ς", " ", "-", "--", "Ａ", "́", "꟎", "The", "Été,", "word."]
    return ["", "a" * 40, "x" * 3000, "ab" * 2000, *["".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(800)], *["".join(rng.choices("abcdefghinorst ", k=rng.randint(1, 25))) for _ in range(800)]]


def test_codec_equals_library(texts):
    library, own = Tokenizer.from_file(BYTES), bpe_codec.codec(BYTES)
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        decimal, ids = own.encode(t)
        assert ids.tolist() == want and decimal == ",".join(map(str, want))
        assert own.decode(ids).decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


def test_codec_frames(spark, texts):
    rows = [*enumerate(texts[:50]), (None, None), (3, texts[3])]
    coded = bpe_codec.encode(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int"), BYTES)
    back = bpe_codec.decode(coded, BYTES).collect()
    assert collections.Counter((r.doc_id, r.text) for r in back) == collections.Counter((d, t or "") for d, t in rows)
    assert bpe_codec.round_trip_digests(spark.createDataFrame([], "doc_id long, text string"), BYTES).count() == 0


def test_chunk_encoder_equals_library(texts, monkeypatch):
    monkeypatch.setattr(token_ids, "CACHE_ENTRIES", 300)
    library, own = Tokenizer.from_file(WORDS), token_ids.ChunkEncoder(WORDS)
    for i in range(0, len(texts), 100):
        ids, bounds = own.encode(texts[i : i + 100])
        for t, k, n in zip(texts[i : i + 100], bounds[:-1], bounds[1:], strict=True):
            assert ids[k:n].tolist() == library.encode(t, add_special_tokens=False).ids
    assert [x.tolist() for x in own.encode([], 2)] == [[], [0]]


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
def test_blocks_round_trip(n):
    ids = np.random.default_rng(n).integers(0, 49408, n).astype(np.uint32)
    ids[::97] = 4_000_000_000
    ids[100:1500] = 5
    lengths = np.array([n // 2, n - n // 2])
    data = token_files.pack(ids, lengths)
    back, sizes = token_files.unpack(data)
    assert (back == ids).all() and (sizes == lengths).all()
    for k in range(-(-n // token_files.BLOCK)):
        assert (token_files.read_block(data, k) == ids[k * token_files.BLOCK : (k + 1) * token_files.BLOCK]).all()


def expected_ids(text, end):
    return [*Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids, end]


def test_token_files(spark, texts, tmp_path, monkeypatch):
    rows = [*enumerate(texts[:60]), (None, "last one"), (100, None), (3, texts[3])]
    path = f"file://{tmp_path}/out"
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), path, WORDS)
    got = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in order]
    at = 0
    for r, (_, t) in zip(got, order, strict=True):
        assert (r.start, r.n_tokens) == (at, len(r.ids)) and r.ids == expected_ids(t, 2)
        at += r.n_tokens
    assert {(r.start, r.ids_crc32) for r in token_files.read(spark, path, digest=True).collect()} == {(r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}


def test_token_files_empty(spark, tmp_path):
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/none", WORDS)
    assert token_files.read(spark, f"file://{tmp_path}/none").count() == 0


def check_packed(rows, texts, capacity):
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d, t in texts:
        ids = expected_ids(t, 0)
        pieces = sorted(by[d], key=lambda r: r.piece)
        assert [(p.piece, p.start, p.length) for p in pieces] == [(k, s, min(capacity, len(ids) - s)) for k, s in enumerate(range(0, len(ids), capacity))]
        assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in pieces)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(sequences)


def test_packing(spark, texts):
    rows = [*enumerate(texts[:300]), (400, None), (None, "one two")]
    got = packing.pack_documents(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, piece int"), WORDS, capacity=64).collect()
    n = check_packed(got, rows, 64)
    least = -(-sum(r.length for r in got) // 64)
    assert n <= least + max(2, least // 50)
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), WORDS).count() == 0


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 60, 200).tolist()
    order = list(range(200))
    one, other = packing._best_fit(sizes, 100, order), packing._best_fit(sizes, 100, order[::-1])
    child = packing.crossover(one, other, sizes, 100, rng)
    assert sorted(i for b in child for i in b) == order and all(sum(sizes[i] for i in b) <= 100 for b in child)
    best = packing.evolve(sizes, 100, 1, [one, other])
    assert len(best) <= min(len(one), len(other))


def test_codec_of_many_texts(texts, monkeypatch):
    monkeypatch.setattr(bpe_codec, "CACHE_ENTRIES", 300)
    library, own = Tokenizer.from_file(BYTES), bpe_codec.BytePairCodec(BYTES)
    rows = [*texts, " a", "a ", " ", "", "a b", "a b ", " été,\nété. été", "<|endoftext|> a", "a  b <|endoftext|>"]
    for i in range(0, len(rows), 100):
        ids, bounds = own.encode_all(rows[i : i + 100])
        for t, k, n in zip(rows[i : i + 100], bounds[:-1], bounds[1:], strict=True):
            assert ids[k:n].tolist() == library.encode(t, add_special_tokens=False).ids
    ids, bounds = own.encode_all([])
    assert (ids.tolist(), bounds.tolist()) == ([], [0])


def test_codec_encodes_a_word_once(monkeypatch):
    own, seen = bpe_codec.BytePairCodec(BYTES), collections.Counter()
    plain = own.encode_word
    monkeypatch.setattr(own, "encode_word", lambda w: seen.update([w]) or plain(w))
    for text in ("x therinsh, therinsh. therinsh", "y therinsh! (therinsh) therinsh\nz", "two  spaces therinsh?"):
        own.encode(text)
    assert seen["Ġtherinsh"] == 1
