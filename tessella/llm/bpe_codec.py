"""Byte-level BPE by backtracking over Aho-Corasick matches, and decoding by an offset table.

A sequence of tokens is what the merges would give exactly if every two neighbours are compatible: no
merge that comes before the ones inside them joins across their border. The encoder takes the longest
token that matches at a position (from one Aho-Corasick pass), falls back to shorter prefixes that are
tokens while the last pair isn't compatible, and drops the last token where none is left. A position
from which no encoding goes on is marked, so that each is tried once: the time is linear.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut, text_or_empty
from tessella.llm.token_ids import SLICE_BYTES, byte_letters

#: Entries of a generation that a worker keeps of chunks and of words, of each of which there are two, and the longest that it keeps.
CACHE_ENTRIES = 200_000
CACHE_CHARS = 48
#: Pairs of tokens whose compatibility a worker keeps.
CACHE_PAIRS = 800_000

# Unicode's White_Space, and the pattern of the byte-level pre-tokenizer.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PATTERN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
)
_TWO_WHITE = re.compile(f"[{_WHITE}]{{2}}")
_CHUNK = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
#: From here on the categories of characters depend on the version of Unicode, and the library splits.
_LATER = re.compile("[^\x00-\u024f\u2010-\u2027\u20ac]")


class BytePairCodec:
    """Encodes and decodes by a tokenizer file with a byte-level BPE model."""

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.library = ByteLevel(add_prefix_space=False, use_regex=True)
        letters = byte_letters()
        self.letters, back = letters, {c: b for b, c in letters.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            i, j = self.vocab[left], self.vocab[right]
            if (got := self.vocab[left + right]) not in self.rank:
                self.merged[i, j], self.rank[got], self.halves[got] = got, rank, (i, j)
        self.shorter: dict[int, int | None] = {}
        self.length = {i: len(s) for s, i in self.vocab.items()}
        self.automaton = ahocorasick.Automaton()
        for s, i in self.vocab.items():
            self.automaton.add_word(s, (i, len(s)))
            self.shorter[i] = next((self.vocab[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.vocab), None)
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        # What encode has made lately and before: the ids of chunks, without the space that stands before each, and of words.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        spelled = [b""] * size
        for s, i in self.vocab.items():
            spelled[i] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
        for s, i in self.special.items():
            spelled[i] = s.encode()
        # Tables by id, one run of bytes with each token's offset: what it spells, and its number before a comma.
        self.spelled = pa.array(spelled, pa.large_binary())
        self.numbers = pa.array([b"%d," % i for i in range(size)], pa.large_binary())

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their bytes are merged together.

        Undoes, again and again, the later of the merges that made the two tokens at the border, and asks whether
        the pair found then is merged before that one.
        """
        key = left, right
        if (kept := self.fits.get(key)) is not None:
            return kept
        rank, halves, never = self.rank, self.halves, 1 << 60
        until, answer = never, True
        while True:
            joined = self.merged.get((left, right))
            # Of merges at one rank the leftmost goes first, so the right token's own merge may be equal.
            if joined is not None and rank[joined] < until:
                answer = False
                break
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                break
            if a > b:
                until, left = a, halves[left][1]
            else:
                until, right = b + 1, halves[right][0]
        if len(self.fits) > CACHE_PAIRS:
            self.fits.clear()
        self.fits[key] = answer
        return answer

    def encode_word(self, word: str) -> list[int]:
        """The ids of one pre-token, spelled in byte letters."""
        n = len(word)
        longest: list[int | None] = [None] * n
        for end, (i, size) in self.automaton.iter(word):
            longest[end + 1 - size] = i  # ends only grow, so the longest is the last
        out: list[int] = []
        length, shorter, fits = self.length, self.shorter, self.fits
        dead = bytearray(n + 1)
        at, token = 0, longest[0] if n else None
        while at < n:
            while token is not None:
                to = at + length[token]
                if not dead[to]:
                    if not out:
                        break
                    if (fit := fits.get((out[-1], token))) is None:
                        fit = self.compatible(out[-1], token)
                    if fit:
                        break
                token = shorter[token]
            if token is None:
                if not out:
                    raise ValueError("a byte of the text isn't in the vocabulary")
                dead[at] = 1
                last = out.pop()
                at -= self.length[last]
                token = self.shorter[last]
            else:
                out.append(token)
                at = to
                token = longest[at] if at < n else None
        return out

    def _word(self, word: str) -> bytes:
        """The ids of one pre-token as it stands in the text."""
        if (ids := self.words.get(word)) is not None:
            return ids
        if (ids := self.older_words.get(word)) is None:
            letters = self.letters
            ids = array("I", self.encode_word("".join([letters[b] for b in word.encode()]))).tobytes()
        if len(word) <= CACHE_CHARS:
            self.words[word] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        if not chunk.isascii() and _LATER.search(chunk):
            ids = [i for p, _ in self.library.pre_tokenize_str(chunk) for i in self.encode_word(p)]
            return array("I", ids).tobytes()
        return b"".join(map(self._word, _PATTERN.findall(chunk)))

    def _after_space(self, chunk: str) -> bytes:
        """The ids of a chunk with the space that stands before it and isn't given."""
        if (ids := self.known.get(chunk)) is not None:
            return ids
        if (ids := self.older.get(chunk)) is None:
            ids = self._chunk(" " + chunk)
        if len(chunk) < CACHE_CHARS:
            self.known[chunk] = ids
        return ids

    def _strange(self, text: str) -> bytes:
        """The ids of a text with special tokens, or with white space beside white space."""
        out = []
        parts = self.at_special.split(text) if self.at_special else [text]
        for part in parts:
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
                continue
            # The ids of a chunk don't depend on what surrounds it: between two of them stand a character that isn't white space
            # and one that is.
            out += [self._after_space(c[1:]) if c[0] == " " else self._chunk(c) for c in _CHUNK.findall(part)]
        return b"".join(out)

    def _turn(self) -> None:
        """Lets what wasn't used for a generation go."""
        if len(self.known) > CACHE_ENTRIES:
            self.known, self.older = {}, self.known
        if len(self.words) > CACHE_ENTRIES:
            self.words, self.older_words = {}, self.words

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, unsigned 32-bit, and where each text's begin, and one beyond the last's.

        Texts are split at spaces by Arrow, and each distinct chunk of a call is looked up once. What stands before a text's first
        space has none before it, and texts that have white space beside white space or special tokens are split here.
        """
        self._turn()
        special = self.at_special
        plain = [not (_TWO_WHITE.search(t) or special and special.search(t)) for t in texts]
        chunks = pc.split_pattern(pa.array([t if p else "" for t, p in zip(texts, plain, strict=True)], pa.string()), " ")
        coded = chunks.flatten().dictionary_encode()
        first = chunks.offsets.to_numpy()
        heads = coded.take(pa.array(first[:-1])).to_pylist()
        ids = list(map(self._after_space, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        at = coded.indices.to_numpy().copy()
        at[first[:-1]] = np.arange(len(ids), len(ids) + len(texts))
        ids += [self._chunk(h) if p else self._strange(t) for h, t, p in zip(heads, texts, plain, strict=True)]
        found = pa.array(ids, pa.large_binary()).take(pa.array(at))
        return np.frombuffer(_bytes(found), "<u4"), _offsets(found)[first] // 4

    def encode(self, text: str) -> tuple[str, np.ndarray]:
        """The ids of a whole text, as decimal numbers joined by commas and as an array."""
        ids, _ = self.encode_all([text])
        return bytes(self.decimal(ids)[0][:-1]).decode(), ids

    def decimal(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The ids as decimal numbers, each with a comma behind it, and where each begins, and one beyond the last."""
        found = self.numbers.take(pa.array(ids))
        return _bytes(found), _offsets(found)

    def spell(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes that the ids spell, gathered from one table by each token's offset, and where each token's begin, and one beyond the last's."""
        found = self.spelled.take(pa.array(ids))
        return _bytes(found), _offsets(found)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids spell."""
        return bytes(self.spell(ids)[0])


def _offsets(values: pa.LargeBinaryArray) -> np.ndarray:
    """Where each value begins in an array that isn't a slice, and one beyond the last."""
    return np.frombuffer(values.buffers()[1], np.int64, len(values) + 1) if len(values) else np.zeros(1, np.int64)


def _bytes(values: pa.LargeBinaryArray) -> memoryview:
    """The values of an array that isn't a slice, one after the other."""
    data = values.buffers()[2]
    return memoryview(data or b"")[: int(_offsets(values)[-1])]


_CODECS: dict[str, BytePairCodec] = {}


def codec(path: str) -> BytePairCodec:
    if path not in _CODECS:
        _CODECS[path] = BytePairCodec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs' (doc_id, text) as (doc_id, n_tokens, ids): the ids of each whole text as array<int>.

    One row for each row, in any order; a null text counts as an empty one and has no ids. Strings of the
    vocabulary's special tokens in a text become their ids. Rows are independent: repeated rows and null doc_ids
    come back as they are. Other columns are ignored.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in cut(batches, 1, SLICE_BYTES):
            ids, ends = own.encode_all(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(of, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) as (doc_id, text); bytes that aren't UTF-8 become U+FFFD. Null ids give an empty text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            texts = [own.decode(np.array(x or (), np.int64)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(of, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """What encode and then decode give for each row, as digests: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in cut(batches, 1, SLICE_BYTES):
            ids, ends = own.encode_all(b.column(1).to_pylist())
            decimal, numbers = own.decimal(ids)
            back, tokens = own.spell(ids)
            bounds = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            ids_sha = [hashlib.sha256(decimal[numbers[i] : max(numbers[i], numbers[j] - 1)]).hexdigest() for i, j in bounds]
            text_sha = [hashlib.sha256(str(back[tokens[i] : tokens[j]], "utf-8", "replace").encode()).hexdigest() for i, j in bounds]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(ends)), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(of, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
