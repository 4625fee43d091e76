"""Fill-in-the-middle over texts kept as seekable compressed frames.

A text is stored as independent zstandard frames of a fixed number of units, a unit being a run of letters or one
other code point, with cumulative counts of units and code points. A cut is found in the counts; only the frame that it
falls into is decompressed, and its halves become frames of their own. All other frames of the output are those of
the store, moved as they are. Digests are taken by decompressing the output's frames in order, one at a time.

    plain  text
    psm    <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle

Cuts and form are drawn from a hash of the seed and the doc_id, so that a task that runs again writes the same rows. A
text that holds a mark stays plain, so the marks of an output are found again by searching it.

Every step is a map over rows; nothing is shuffled. A store row is as long as its text compressed, an open frame as
long as its units.

Defined results: a null or empty text has no units and stays plain; rows that share a doc_id get the same draws, each
over its own text; a null doc_id is drawn as the empty string; repeated rows are transformed each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNITS_PER_FRAME, LEVEL, ROWS = 4096, 3, 256
# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Order of the parts of an output by form.
LAYOUT = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}

STORE = "doc_id long, n long, marked boolean, unit_ends array<long>, char_ends array<long>, frames array<binary>"
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, frames array<binary>"
LISTS, BLOBS = pa.list_(pa.int64()), pa.list_(pa.binary())


@dataclass(frozen=True)
class Draws:
    """How cuts and forms are drawn; percentages of the documents."""

    seed: str = "1:"
    moved_percent: int = 90
    spm_percent: int = 20

    def of(self, doc_id: int | None, n: int, marked: bool) -> tuple[str, int, int]:
        """Form, and the units at which the prefix and the middle end."""
        digest = hashlib.sha256(f"{self.seed}{'' if doc_id is None else doc_id}".encode()).digest()
        first, second, moved, kind = (int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4))
        if not n or marked or moved % 100 >= self.moved_percent:
            return "plain", 0, 0
        ends = sorted((first % (n + 1), second % (n + 1)))
        return ("spm" if kind % 100 < self.spm_percent else "psm"), *ends


def unit_starts(text: str) -> np.ndarray:
    """Code-point positions at which units start."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if not len(points):
        return np.empty(0, np.int64)
    letter = (points | 32) - np.uint32(97) < 26
    begins = np.ones(len(points), bool)
    begins[1:] = ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins)


class Codec:
    """One compressor and decompressor for the frames of a task."""

    def __init__(self) -> None:
        self.compress = zstandard.ZstdCompressor(level=LEVEL).compress
        self.decompress = zstandard.ZstdDecompressor().decompress

    def split(self, text: str, units: int) -> tuple[int, list[int], list[int], list[bytes]]:
        """Number of units, units and code points up to each frame's end, frames."""
        starts = unit_starts(text)
        n = len(starts)
        edges = [*starts[::units].tolist(), len(text)]
        frames = [self.compress(text[a:b].encode()) for a, b in zip(edges, edges[1:], strict=False)]
        return n, [min(k, n) for k in range(units, n + units, units)], edges[1:], frames

    def cut(self, frame: bytes, units: int) -> tuple[int, bytes, bytes]:
        """A frame as two, the first with so many units; also the first's code points."""
        text = self.decompress(frame).decode()
        at = int(unit_starts(text)[units])
        return at, self.compress(text[:at].encode()), self.compress(text[at:].encode())


class Cutter:
    """Positions and parts of one stored text."""

    def __init__(self, codec: Codec, unit_ends: list[int], char_ends: list[int], frames: list[bytes]) -> None:
        self.codec = codec
        self.unit_ends, self.char_ends, self.frames = list(unit_ends), list(char_ends), list(frames)

    def before(self, unit: int) -> int:
        """How many frames lie before a unit, after cutting the frame that it falls into."""
        at = int(np.searchsorted(self.unit_ends, unit))
        if unit == 0 or self.unit_ends[at] == unit:
            return at + (unit > 0)
        units, chars = (self.unit_ends[at - 1], self.char_ends[at - 1]) if at else (0, 0)
        size, left, right = self.codec.cut(self.frames[at], unit - units)
        self.frames[at : at + 1] = [left, right]
        self.unit_ends.insert(at, unit)
        self.char_ends.insert(at, chars + size)
        return at + 1

    def chars(self, frames: int) -> int:
        return self.char_ends[frames - 1] if frames else 0


def _batch(columns: list, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names
    )


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def write_frames(docs: DataFrame, units: int = UNITS_PER_FRAME) -> DataFrame:
    """doc_id, n units, whether a mark is in the text, cumulative units and code points, frames."""
    types = [pa.int64(), pa.int64(), pa.bool_(), LISTS, LISTS, BLOBS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = []
                for text in part.column(1).to_pylist():
                    n, unit_ends, char_ends, frames = codec.split(text or "", units)
                    rows.append((n, any(m in (text or "") for m in MARKS), unit_ends, char_ends, frames))
                yield _batch([part.column(0), *zip(*rows, strict=True)], _names(STORE), types)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, STORE)


def fill_in_middle(store: DataFrame, draws: Draws = Draws()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the output's frames in order, marks in frames of their own."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), BLOBS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec()
        mark = {m: codec.compress(m.encode()) for m in MARKS}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = []
                for row in batch.slice(at, ROWS).to_pylist():
                    form, first, second = draws.of(row["doc_id"], row["n"], row["marked"])
                    if form == "plain":
                        rows.append((row["doc_id"], row["n"], form, None, None, row["frames"]))
                        continue
                    text = Cutter(codec, row["unit_ends"], row["char_ends"], row["frames"])
                    # The later cut leaves the frames before the earlier one in place.
                    end = text.before(second)
                    frames = len(text.frames)
                    start = text.before(first)
                    end += len(text.frames) - frames
                    part = {PREFIX: text.frames[:start], MIDDLE: text.frames[start:end], SUFFIX: text.frames[end:]}
                    out = [f for name in LAYOUT[form] for f in (mark[name], *part[name])]
                    prefix = text.chars(start)
                    rows.append((row["doc_id"], row["n"], form, prefix, text.chars(end) - prefix, out))
                if rows:
                    yield _batch(list(zip(*rows, strict=True)), _names(OUTPUT), types)

    return store.select(*_names(STORE)).mapInArrow(run, OUTPUT)


class Reader:
    """An output's bytes, decompressed frame by frame."""

    def __init__(self, codec: Codec, frames: list[bytes]) -> None:
        self.codec, self.frames = codec, frames
        self.ends: list[int] = []

    def scan(self, marks: tuple[str, ...], update: Callable[[bytes], None]) -> list[int]:
        """Feeds all bytes in order to `update`; returns where each mark starts, the marks standing in this order."""
        found, wanted, tail, total = [], [m.encode() for m in marks], b"", 0
        for frame in self.frames:
            piece = self.codec.decompress(frame)
            update(piece)
            window, base, at = tail + piece, total - len(tail), 0
            while len(found) < len(wanted) and (here := window.find(wanted[len(found)], at)) >= 0:
                found.append(base + here)
                at = here + len(wanted[len(found) - 1])
            # What a mark across two frames could begin with.
            tail = window[max(at, len(window) - 2) :]
            total += len(piece)
            self.ends.append(total)
        return found

    def read(self, start: int, end: int) -> Iterator[bytes]:
        """Bytes [start, end) after a scan, from the frames that hold them."""
        at = int(np.searchsorted(self.ends, start, "right"))
        while start < end:
            base = self.ends[at - 1] if at else 0
            piece = self.codec.decompress(self.frames[at])[start - base : end - base]
            yield piece
            start, at = start + len(piece), at + 1


def restore(reader: Reader, form: str, update: Callable[[bytes], None]) -> Iterator[bytes]:
    """The original text from an output and its form, in pieces; the output's bytes go to `update` first."""
    order = LAYOUT.get(form, ())
    starts = reader.scan(order, update)
    total = reader.ends[-1] if reader.ends else 0
    if not order:
        yield from reader.read(0, total)
        return
    ends = [*starts[1:], total]
    place = {m: (s + len(m), e) for m, s, e in zip(order, starts, ends, strict=True)}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from reader.read(*place[mark])


def digests(outputs: DataFrame) -> DataFrame:
    """The outputs without frames but with output_sha256 and, rebuilt from output and form alone, restored_sha256."""
    kept = [c for c in outputs.columns if c != "frames"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in outputs.schema if f.name != "frames")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sums = []
                for form, frames in zip(part.column("form").to_pylist(), part.column("frames").to_pylist(), strict=True):
                    whole, again = hashlib.sha256(), hashlib.sha256()
                    for piece in restore(Reader(codec, frames), form, whole.update):
                        again.update(piece)
                    sums.append((whole.hexdigest(), again.hexdigest()))
                columns = [part.column(c) for c in kept]
                added = [pa.array(c, pa.string()) for c in zip(*sums, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, *added], [*kept, "output_sha256", "restored_sha256"])

    return outputs.mapInArrow(run, schema + ", output_sha256 string, restored_sha256 string")


def output_texts(outputs: DataFrame) -> DataFrame:
    """The outputs with their text in place of the frames."""
    kept = [c for c in outputs.columns if c != "frames"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in outputs.schema if f.name != "frames")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [b"".join(map(codec.decompress, f)).decode() for f in part.column("frames").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "text"])

    return outputs.mapInArrow(run, schema + ", text string")
