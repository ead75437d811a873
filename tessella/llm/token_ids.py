"""Token ids of whole texts by the tokenizers library, each distinct token of a worker encoded once."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of a generation that a worker keeps, of which there are two, and the longest token that it keeps: about 50 MB.
CACHE_ENTRIES = 120_000
CACHE_CHARS = 48

#: Bytes of text that a worker encodes at a time.
SLICE_BYTES = 2_500_000

#: Characters that lower-case one to one and have no marks to compose: printable ASCII, its white space and Latin-1 letters.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")

#: What the vocabulary's own pattern splits lower-case texts of these characters into.
_TOKENS = re.compile(r"[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\t-\r 0-9a-zß-öø-ÿ]+")

#: Punctuation that ends a chunk is a token of its own; parted from its word beforehand, it makes fewer distinct chunks.
_ENDING = r"([a-zß-öø-ÿ0-9])([.,;:!?]+)([\t-\r ]|$)"

#: str.split() also splits at these, which aren't white space to the library.
_SEPARATORS = re.compile("[\x1c-\x1f]")


class ChunkEncoder:
    """For tokenizers that lower-case, split by ``_TOKENS``'s pattern, drop white space and merge bytes within a token only.

    Plain texts are split at white space by Arrow, and each distinct chunk of a call is looked up once. Other texts are split
    here: their plain chunks go the same way, and the rest to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.letters, self.model = byte_letters(), self.tokenizer.model

    def _kept(self, text: str, ids: bytes) -> bytes:
        if len(text) <= CACHE_CHARS:
            self.known[text] = ids
        return ids

    def _token(self, token: str) -> bytes:
        """The ids of one token of a plain text: what normalizing and splitting leave as it is, so the model alone will do."""
        if (ids := self.known.get(token)) is not None:
            return ids
        if (ids := self.older.get(token)) is None:
            spelled = token if token.isascii() else "".join([self.letters[b] for b in token.encode()])
            ids = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return self._kept(token, ids)

    def _chunk(self, chunk: str) -> bytes:
        """The ids of a lower-case chunk of a plain text."""
        return b"".join(map(self._token, _TOKENS.findall(chunk)))

    def _strange(self, text: str) -> bytes:
        """The ids of a text that isn't plain."""
        out = []
        for c in [text] if _SEPARATORS.search(text) else text.split():
            if _plain(c):
                out.append(self._chunk(c.lower()))
                continue
            if (ids := self.known.get(c)) is None and (ids := self.older.get(c)) is None:
                ids = array("I", self.tokenizer.encode(c, add_special_tokens=False).ids).tobytes()
            out.append(self._kept(c, ids))
        return b"".join(out)

    def _looked_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain texts, and how many each has."""
        chunks = pc.ascii_split_whitespace(pc.replace_substring_regex(pa.array(texts, pa.string()), _ENDING, r"\1 \2\3"))
        coded = chunks.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, distinct))
        ids = [self._chunk(c) if x is None else x for c, x in zip(distinct, ids, strict=True)]
        flat = np.frombuffer(b"".join(ids), "<u4")
        each = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at = coded.indices.to_numpy()
        size = each[at]
        ends = np.cumsum(size)
        places = np.repeat((np.cumsum(each) - each)[at] - (ends - size), size)
        places += np.arange(len(places))
        bounds = np.concatenate([[0], ends])[chunks.offsets.to_numpy()]
        return flat[places], np.diff(bounds)

    def encode(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, unsigned 32-bit, and where each text's begin, and one beyond the last's. ``end_id`` follows each."""
        if len(self.known) > CACHE_ENTRIES:
            self.known, self.older = {}, self.known
        plain = list(map(_plain, texts))
        ids, size = self._looked_up([t.lower() for t, p in zip(texts, plain, strict=True) if p])
        if not all(plain):
            parts = iter(np.split(ids, np.cumsum(size)[:-1]) if len(size) else [])
            parts = [next(parts) if p else np.frombuffer(self._strange(t), "<u4") for t, p in zip(texts, plain, strict=True)]
            ids, size = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        bounds = np.concatenate([[0], np.cumsum(size)])
        if end_id is not None:
            ids, bounds = np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))
        return ids, bounds


def _plain(text: str) -> bool:
    """Whether a text has plain characters only, and nothing like a special token."""
    return _PLAIN.fullmatch(text) is not None and "<|" not in text


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_ENCODERS: dict[str, ChunkEncoder] = {}


def chunk_encoder(path: str) -> ChunkEncoder:
    """The worker's own encoder for a tokenizer file; it stays from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
