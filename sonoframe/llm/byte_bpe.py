"""Byte-level BPE in two tiers.

Whole pre-tokens that are in the vocabulary are found by a minimal perfect hash: one displacement per bucket sends
each of the n vocabulary entries to a slot of its own in a table of n, and the entry in the slot is compared. Other
pre-tokens start as linked bytes; a heap gives the adjacent pair of lowest rank, leftmost first, until none can merge.

Workers keep the ids of the first pre-token runs they meet. A run is what a single space or line feed starts, up to
the next; it splits into the same pre-tokens alone as in its text unless white space stands at its edges, and then
the text is split as a whole.

Defined results: a null or empty text has no ids; every string can be encoded, and decoding gives its bytes back;
texts and pre-tokens may be of any length (n log n); repeated rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs and pre-tokens, and merges, kept by a worker; longer texts are encoded each time.
KEPT_RUNS, KEPT_CHARS, KEPT_PAIRS = 500_000, 48, 300_000
KEYS_PER_BUCKET = 2


class PerfectHash:
    """Slots 0..n-1 for n distinct byte strings."""

    def __init__(self, keys: list[bytes]) -> None:
        n = len(keys)
        self.buckets = max(1, n // KEYS_PER_BUCKET)
        grouped: dict[int, list[bytes]] = {}
        for key in keys:
            grouped.setdefault(xxhash.xxh3_64_intdigest(key) % self.buckets, []).append(key)
        self.shift = [0] * self.buckets
        self.slots: list[bytes | None] = [None] * n
        order = sorted(grouped.items(), key=lambda b: (-len(b[1]), b[0]))
        free = None
        for bucket, members in order:
            if len(members) > 1:
                shift = 1
                while True:
                    at = {xxhash.xxh3_64_intdigest(k, shift) % n for k in members}
                    if len(at) == len(members) and all(self.slots[s] is None for s in at):
                        break
                    shift += 1
                self.shift[bucket] = shift
                for key in members:
                    self.slots[xxhash.xxh3_64_intdigest(key, shift) % n] = key
            else:
                # Buckets of one come last and take the slots that are left; their shift names the slot.
                free = free or iter([s for s, k in enumerate(self.slots) if k is None])
                slot = next(free)
                self.shift[bucket] = -slot - 1
                self.slots[slot] = members[0]

    def slot(self, key: bytes) -> int:
        """The key's slot, or -1."""
        if not self.slots:
            return -1
        shift = self.shift[xxhash.xxh3_64_intdigest(key) % self.buckets]
        at = -shift - 1 if shift < 0 else xxhash.xxh3_64_intdigest(key, shift) % len(self.slots)
        return at if self.slots[at] == key else -1


class ByteEncoder:
    def __init__(self, vocabulary: str, pattern: str) -> None:
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.split = regex.compile(pattern).findall
        self.hash = PerfectHash(list(ranks))
        self.rank_at = [ranks[key] for key in self.hash.slots]
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_rank = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        self.known: dict[str, bytes] = {}

    def rank(self, token: bytes) -> int:
        slot = self.hash.slot(token)
        return self.rank_at[slot] if slot >= 0 else -1

    def pair(self, left: int, right: int) -> int:
        """Id that two ids merge to, or -1."""
        key = left << 20 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.rank(self.tokens[left] + self.tokens[right])
        return found

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no vocabulary entry."""
        n, pair, pairs = len(piece), self.pair, self.pairs
        byte_rank = self.byte_rank
        ids = [byte_rank[b] for b in piece]
        # ends[i]: end of the part that starts at i, 0 once merged away; before[i]: start of the part to its left.
        ends = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            made = pairs.get(ids[i] << 20 | ids[i + 1])
            if made is None:
                made = pair(ids[i], ids[i + 1])
            if made >= 0:
                heap.append((made, i, i + 2))
        heapify(heap)
        while heap:
            best, left, end = heappop(heap)
            middle = ends[left]
            if not middle or middle >= n or ends[middle] != end:
                continue
            ends[left], ends[middle], ids[left] = end, 0, best
            if end < n:
                before[end] = left
                made = pairs.get(best << 20 | ids[end])
                if made is None:
                    made = pair(best, ids[end])
                if made >= 0:
                    heappush(heap, (made, left, ends[end]))
            if left:
                previous = before[left]
                made = pairs.get(ids[previous] << 20 | best)
                if made is None:
                    made = pair(ids[previous], best)
                if made >= 0:
                    heappush(heap, (made, previous, end))
        out, at = [], 0
        while at < n:
            out.append(ids[at])
            at = ends[at]
        return out

    def _ids(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.rank(raw)
        ids = np.array([whole] if whole >= 0 else self.merged(raw), "<u4").tobytes()
        return self._keep(piece, ids)

    def _keep(self, text: str, ids: bytes) -> bytes:
        if len(self.known) < KEPT_RUNS and len(text) <= KEPT_CHARS:
            self.known[text] = ids
        return ids

    def _pieces(self, text: str) -> bytes:
        known = self.known
        return b"".join([known.get(p) or self._ids(p) for p in self.split(text)])

    def _run(self, run: str) -> bytes:
        return self._keep(run, self._pieces(run))

    @staticmethod
    def runs(text: str) -> list[str] | None:
        """Runs that can be split alone, or None."""
        if "\0" in text:
            return None
        runs = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        inner = runs[1:] if not runs[0] else runs
        for run in inner:
            core = run[1:] if run[0] in " \n" else run
            if not core or core[0].isspace() or core[-1].isspace():
                return None
        return inner

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        known = self.known
        runs = self.runs(text)
        if runs is None:
            return self._pieces(text)
        return b"".join([known.get(r) or self._run(r) for r in runs])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def byte_encoder(vocabulary: str, pattern: str) -> ByteEncoder:
    """One per worker process."""
    return ByteEncoder(vocabulary, pattern)


def _batches(batches, work, schema: pa.Schema, rows: int = 256):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            made = list(zip(*map(work, part.column(1).to_pylist()), strict=True))
            columns = [part.column(0), *(pa.array(c, f.type) for c, f in zip(made, list(schema)[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, ids: little-endian unsigned 32-bit ids of each text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        encoder = byte_encoder(vocabulary, pattern)
        yield from _batches(batches, lambda text: (encoder.encode(text or ""),), schema)

    return _rows(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, decoded: the bytes that the ids stand for."""
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def run(batches):
        encoder = byte_encoder(vocabulary, pattern)
        yield from _batches(batches, lambda ids: (encoder.decode(np.frombuffer(ids, "<u4").tolist()),), schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded and its ids decoded in one pass."""
    names = ("n_tokens long", "ids_sha256 string", "decoded_sha256 string")
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        encoder = byte_encoder(vocabulary, pattern)
        decimal = [str(i) for i in range(len(encoder.tokens))]

        def work(text: str | None):
            ids = np.frombuffer(encoder.encode(text or ""), "<u4").tolist()
            said = " ".join(map(decimal.__getitem__, ids)).encode()
            return len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()

        yield from _batches(batches, work, schema)

    return _rows(docs).mapInArrow(run, ", ".join(("doc_id long", *names)))
