"""Word-level caching in front of the public tokenizer library.

The vocabulary with word ends drops white space and never merges across it, so a text's ids are those of its
white-space separated chunks in order. Chunks repeat, so a task keeps the ids of the first ones it meets; the
library encodes the rest. What a task keeps is bounded, some 100 MB. At its end all but the first and so mostly the
commonest is dropped, so that an idle worker holds some 40 MB beside the vocabulary. Texts holding a character that
Python but not the library takes as white space go to the library whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import islice
from struct import pack

import numpy as np

#: Chunks and words kept by a task; more are encoded again when they come again. Longer ones are never kept.
KEPT_CHUNKS, KEPT_WORDS, KEPT_CHARS = 300_000, 150_000, 32
#: Of each so many are left for the next task.
LEFT = 100_000
#: Code points that str.split() splits at and the library doesn't.
ODD_SPACES = ("\x1c", "\x1d", "\x1e", "\x1f")
#: The library's own pre-tokens for a chunk of printable ASCII in lower case.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
PRINTABLE = re.compile(r"[\x21-\x7e]+")
#: Stands between chunks that are encoded in one call; it is one token of its own.
MARK = "|"


class ChunkEncoder:
    """Texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.model = self.library.model
        self.mark = self._whole(MARK)
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def forget(self) -> None:
        self.chunks, self.words = (dict(islice(kept.items(), LEFT)) for kept in (self.chunks, self.words))

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        found = [t.id for t in self.model.tokenize(word)]
        ids = pack(f"<{len(found)}I", *found)
        if len(self.words) < KEPT_WORDS and len(word) <= KEPT_CHARS:
            self.words[word] = ids
        return ids

    def _ascii(self, chunk: str) -> bytes:
        words = self.words
        if chunk.isalpha():
            word = chunk.lower()
            return words.get(word) or self._word(word)
        return b"".join([words.get(w) or self._word(w) for w in ASCII_WORDS.findall(chunk.lower())])

    def _other(self, chunks: list[str]) -> list[bytes]:
        """Chunks without the mark, many in one call of the library."""
        ids = self.library.encode_batch_fast([f" {MARK} ".join(chunks) + f" {MARK}"], add_special_tokens=False)[0].ids
        ids = np.array(ids, "<u4")
        ends = np.flatnonzero(ids == np.frombuffer(self.mark, "<u4")[0]).tolist()
        raw, found, start = ids.tobytes(), [], 0
        for end in ends:
            found.append(raw[4 * start : 4 * end])
            start = end + 1
        if len(found) != len(chunks):
            raise ValueError("the mark is not a token of its own in this vocabulary")
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = {k for k, text in enumerate(texts) if any(c in text for c in ODD_SPACES)}
        split = [[] if k in whole else text.split() for k, text in enumerate(texts)]
        known = self.chunks
        missing = [c for c in set().union(*split) if c not in known] if split else []
        fresh: dict[str, bytes] = {}
        other: list[str] = []
        for chunk in missing:
            if PRINTABLE.fullmatch(chunk):
                fresh[chunk] = self._ascii(chunk)
            elif MARK in chunk or len(chunk) > 1000:
                fresh[chunk] = self._whole(chunk)
            else:
                other.append(chunk)
        for at in range(0, len(other), 4000):
            part = other[at : at + 4000]
            fresh.update(zip(part, self._other(part), strict=True))
        if len(known) < KEPT_CHUNKS:
            known.update((c, ids) for c, ids in fresh.items() if len(c) <= KEPT_CHARS)
        out = []
        for k, chunks in enumerate(split):
            if k in whole:
                out.append(self._whole(texts[k]))
            else:
                out.append(b"".join([known.get(c) or fresh.get(c, b"") for c in chunks]))
        return out


@lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    """One per worker process and vocabulary."""
    return ChunkEncoder(path)


def encoded_rows(batches, path: str, end_id: int, rows: int = 256):
    """(doc_id, ids with the end id) of each row of Arrow batches with columns doc_id and text, in order."""
    encoder = chunk_encoder(path)
    end = np.array([end_id], "<u4").tobytes()
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    yield doc_id, ids + end
    finally:
        encoder.forget()
