"""Transcript error rates of whole recordings and of windows, on texts of any length.

A text is never one value: its tokens are numbered along the recording and packed in tiles of a fixed number. The edit
table of two texts is cut into tiles of tiles. Neighbouring cells of it differ by at most one, so an edge of a tile is two
bits a cell and a column is computed by a few operations on whole bit rows. A pair of one tile is done at once. For longer
ones, all tiles on one anti-diagonal, of all recordings and windows, are one job that hands its lower and right edges on to
the next; then the way back from the last cell is followed through the tiles that it meets. The longest pair decides how
many rounds there are, and its tiles lie at most once in each.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.functions.text import error_rate, mixed_tokens
from sonoframe.operators.scan import Layout, running, running_sum
from sonoframe.session import cut, spread

MEDIA, WINDOW = "media_id", "_window"
#: Tokens of one side of a tile.
TILE = 8192
#: Stands for the whole recording among the window starts, which are not negative.
OVERALL = -1.0
#: Bits of the cells that are one more, or one less, than the cell before them along the edge.
EDGES = ("bottom_more", "bottom_less", "right_more", "right_less")
#: Columns whose bits are kept on the way back through a tile; the others are computed again from every such column.
KEPT = 512


def windowed(segments: DataFrame, windows: DataFrame) -> DataFrame:
    """Every segment once for each window (media_id, window_start, window_end) that it overlaps, whole.

    A window without bounds takes every segment.
    """
    met = (F.col("end") > F.col("window_start")) & (F.col("start") < F.col("window_end"))
    bounds = windows.select(MEDIA, "window_start", "window_end").withColumn(WINDOW, F.coalesce("window_start", F.lit(OVERALL)))
    joined = segments.join(bounds, MEDIA).where(met | F.col("window_start").isNull())
    return joined.drop("window_start", "window_end")


def _tokens(segments: DataFrame) -> DataFrame:
    return segments.withColumn("_tokens", mixed_tokens(F.coalesce("text", F.lit("")))).drop("text")


def token_tiles(segments: DataFrame, keys: Sequence[str], order: Sequence[str], layout: Layout, tile: int = TILE) -> DataFrame:
    """(keys, tile, tokens) of the texts of each key in order, joined by spaces, at most ``tile`` tokens a row."""
    return _tiles_of_tokens(_tokens(segments), keys, order, layout, tile)


def _tiles_of_tokens(segments: DataFrame, keys: Sequence[str], order: Sequence[str], layout: Layout, tile: int) -> DataFrame:
    """A segment's tokens go in one slice to each tile that they reach."""
    tokens = segments.select(*keys, *order, "_tokens")
    counted = tokens.withColumn("_n", F.size("_tokens").cast("bigint"))
    # Empty segments are left out only here: a filter below the ordered scan would take the tokens a second time.
    placed = running(counted, keys, order, layout, _at=running_sum(F.col("_n"), inclusive=False)).where("_n > 0")
    first, last = F.floor(F.col("_at") / tile).cast("bigint"), F.floor((F.col("_at") + F.col("_n") - 1) / tile).cast("bigint")
    each = placed.withColumn("tile", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.lit(0), F.col("tile") * tile - F.col("_at"))
    size = F.least(F.col("_n"), (F.col("tile") + 1) * tile - F.col("_at")) - begin
    piece = F.slice("_tokens", (begin + 1).cast("int"), size.cast("int"))
    item = F.struct((F.col("_at") + begin).alias("at"), piece.alias("tokens"))
    packed = each.select(*keys, "tile", item.alias("_item")).groupBy(*keys, "tile").agg(F.sort_array(F.collect_list("_item")).alias("_items"))
    return packed.select(*keys, "tile", F.flatten("_items.tokens").alias("tokens"))


class Tile:
    """The part of an edit table that belongs to two runs of tokens, given the differences along its upper and left edge.

    Equal tokens take the diagonal; otherwise the cheapest of deletion, insertion, substitution in that order. Bit i of a
    column stands for row i + 1. Without edges the tile is the first of its table, where every step costs one.
    """

    def __init__(self, reference: list[str], hypothesis: list[str], top: tuple | None = None, left: tuple | None = None):
        self.n, self.m = len(reference), len(hypothesis)
        self.reference, self.hypothesis = reference, hypothesis
        self.full = (1 << self.n) - 1
        self.top = self._steps(top)
        self.left = (self.full, 0) if left is None else tuple(int.from_bytes(side, "little") for side in left)
        self.places: dict[str, int] = {}
        wanted = set(hypothesis)
        for at, token in enumerate(reference):
            if token in wanted:
                self.places[token] = self.places.get(token, 0) | 1 << at

    def _steps(self, top: tuple | None) -> list[int]:
        if top is None:
            return [1] * self.m
        more, less = (np.unpackbits(np.frombuffer(side, np.uint8), count=self.m, bitorder="little") for side in top)
        return (more.astype(np.int8) - less.astype(np.int8)).tolist()

    def columns(self, first: int, last: int, more: int, less: int):
        """For each column: steps down it (one more, one less) and steps to it from the one before, by row."""
        full, places, steps = self.full, self.places, self.top
        for j in range(first, last):
            equal, step = places.get(self.hypothesis[j], 0), steps[j]
            vertical = equal | less
            if step < 0:
                equal |= 1
            across = ((((equal & more) + more) ^ more) | equal) & full
            up, down = less | (full ^ (across | more)), more & across
            shifted = up << 1 & full
            lowered = down << 1 & full
            if step > 0:
                shifted |= 1
            elif step < 0:
                lowered |= 1
            more, less = lowered | (full ^ ((vertical | shifted) & full)), shifted & vertical
            yield more, less, up, down

    def edges(self) -> tuple[bytes, bytes, bytes, bytes]:
        """Differences along the lower and the right edge, as in ``EDGES``."""
        more, less = self.left
        last, rising, falling = self.n - 1, np.zeros(self.m, np.uint8), np.zeros(self.m, np.uint8)
        for j, (more, less, up, down) in enumerate(self.columns(0, self.m, more, less)):
            rising[j], falling[j] = up >> last, down >> last
        across = (np.packbits(side, bitorder="little").tobytes() for side in (rising, falling))
        return *across, *(side.to_bytes((self.n + 7) // 8, "little") for side in (more, less))

    def way_back(self, i: int, j: int) -> tuple[int, int, int, int]:
        """The cell on the upper or left edge that the way to cell (i, j) comes from, with the way's edits and deletions."""
        starts, (more, less) = [self.left], self.left
        for k, (more, less, _, _) in enumerate(self.columns(0, (j - 1) // KEPT * KEPT, more, less), 1):
            if k % KEPT == 0:
                starts.append((more, less))
        edits = deletions = 0
        while i and j:
            block = (j - 1) // KEPT
            low = block * KEPT
            kept = [(more, up) for more, _, up, _ in self.columns(low, j, *starts[block])]
            while i and j > low:
                token = self.hypothesis[j - 1]
                more, up = kept[j - 1 - low]
                if self.reference[i - 1] == token:
                    i, j = i - 1, j - 1
                    continue
                edits += 1
                if more >> i - 1 & 1:
                    deletions += 1
                    i -= 1
                elif up >> i - 1 & 1:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
        return i, j, edits, deletions


def _tiles_of(batch: pa.RecordBatch):
    """Each row of an Arrow batch with its tile; a row is made into Python values alone."""
    for at in range(batch.num_rows):
        row = batch.slice(at, 1).to_pylist()[0]
        top, left = (None if row.get(f"{side}_more") is None else (row[f"{side}_more"], row[f"{side}_less"]) for side in ("top", "left"))
        yield row, Tile(row["_ref"], row["_hyp"], top, left)


def _edge_worker(keys: Sequence[str]):
    kept = (*keys, "i", "j")

    def run(batches):
        for batch in batches:
            found = [tile.edges() for _, tile in _tiles_of(batch)]
            edges = [pa.array([edge[k] for edge in found], pa.binary()) for k in range(len(EDGES))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *edges], [*kept, *EDGES])

    return run


#: How far a way back has come: tile, cell in it, edits and deletions so far.
WAY = ("i", "j", "row", "column", "distance", "deletions")


def _way_worker(keys: Sequence[str], tile: int):
    def back(row: dict, part: Tile) -> tuple[int, ...]:
        up, left, edits, deletions = part.way_back(row["row"], row["column"])
        i, j = row["i"], row["j"]
        # What is left when the table's own edge is met is all deletions or all insertions.
        if (i == 0 and up == 0) or (j == 0 and left == 0):
            rows, columns = i * tile + up, j * tile + left
            return -1, -1, 0, 0, row["distance"] + edits + rows + columns, row["deletions"] + deletions + rows
        if up == 0:
            i, up = i - 1, tile
        if left == 0:
            j, left = j - 1, tile
        return i, j, up, left, row["distance"] + edits, row["deletions"] + deletions

    def run(batches):
        for batch in batches:
            ways = [back(*each) for each in _tiles_of(batch)]
            values = [pa.array([way[k] for way in ways], pa.int64()) for k in range(len(WAY))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *values], [*keys, *WAY])

    return run


def aligned(reference: DataFrame, hypothesis: DataFrame, every: DataFrame, keys: Sequence[str], tile: int = TILE) -> DataFrame:
    """Token and edit counts for each of ``every`` key, from the ``token_tiles`` of both sides."""
    keys = list(keys)
    reference, hypothesis = cut(reference), cut(hypothesis)

    def sizes(tiles: DataFrame, name: str) -> DataFrame:
        return tiles.groupBy(*keys).agg(
            F.sum(F.size("tokens")).cast("bigint").alias(name), F.count(F.lit(1)).alias(f"_{name}_tiles")
        )

    names = ["reference_tokens", "hypothesis_tokens"]
    plan = every.join(sizes(reference, names[0]), keys, "left").join(sizes(hypothesis, names[1]), keys, "left")
    plan = cut(plan.na.fill(0, [*names, *(f"_{n}_tiles" for n in names)]))
    rows, columns = F.col("_reference_tokens_tiles"), F.col("_hypothesis_tokens_tiles")
    both = plan.where((rows > 0) & (columns > 0))
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plan.select(*keys).schema)
    edge_schema = f"{key_schema}, i bigint, j bigint, " + ", ".join(f"{name} binary" for name in EDGES)
    way_schema = f"{key_schema}, " + ", ".join(f"{name} bigint" for name in WAY)

    def with_tokens(places: DataFrame) -> DataFrame:
        met = places.join(reference.select(*keys, F.col("tile").alias("i"), F.col("tokens").alias("_ref")), [*keys, "i"])
        return met.join(hypothesis.select(*keys, F.col("tile").alias("j"), F.col("tokens").alias("_hyp")), [*keys, "j"])

    def with_edges(cells: DataFrame, edges: DataFrame | None) -> DataFrame:
        if edges is None:
            return cells
        for side, source, down, across in (("top", "bottom", 1, 0), ("left", "right", 0, 1)):
            handed = edges.select(
                *keys,
                (F.col("i") + down).alias("i"),
                (F.col("j") + across).alias("j"),
                *[F.col(f"{source}_{c}").alias(f"{side}_{c}") for c in ("more", "less")],
            )
            cells = cells.join(handed, [*keys, "i", "j"], "left")
        return cells

    def followed(ways: DataFrame, edges: DataFrame | None) -> DataFrame:
        cells = with_edges(with_tokens(ways), edges)
        return cut(spread(cells, *keys).mapInArrow(_way_worker(keys, tile), way_schema))

    last = both.select(
        *keys,
        (rows - 1).alias("i"),
        (columns - 1).alias("j"),
        (F.col(names[0]) - (rows - 1) * tile).alias("row"),
        (F.col(names[1]) - (columns - 1) * tile).alias("column"),
        F.lit(0).cast("bigint").alias("distance"),
        F.lit(0).cast("bigint").alias("deletions"),
    )
    done = [followed(last.where("i = 0 AND j = 0"), None)]
    long = both.where((rows > 1) | (columns > 1))
    rounds = long.agg(F.max(rows + columns - 1)).first()[0] or 0
    edges, found = None, None
    # The last tile of a pair hands nothing on.
    for d in range(rounds - 1):
        place = F.explode(F.sequence(F.greatest(F.lit(0), F.lit(d + 1) - columns), F.least(F.lit(d), rows - 1)))
        tiles = long.where(rows + columns - 2 > d).select(*keys, place.alias("i")).withColumn("j", F.lit(d).cast("bigint") - F.col("i"))
        cells = with_edges(with_tokens(tiles), edges)
        edges = cut(spread(cells, *keys, "i", "j").mapInArrow(_edge_worker(keys), edge_schema))
        found = edges if found is None else found.unionByName(edges)
    ways = last.where("i > 0 OR j > 0")
    for _ in range(rounds):
        ways = followed(ways, found)
        done.append(ways.where("i < 0"))
        ways = ways.where("i >= 0")
        if ways.isEmpty():
            break
    scored = done[0]
    for part in done[1:]:
        scored = scored.unionByName(part)
    plan = plan.join(scored.select(*keys, "distance", "deletions"), keys, "left")
    n, m = F.col(names[0]), F.col(names[1])
    # With one side empty there is nothing to align.
    filled = plan.withColumns({"distance": F.coalesce("distance", F.greatest(n, m)), "deletions": F.coalesce("deletions", n)})
    insertions: Column = F.col("deletions") + m - n
    return filled.select(
        *keys,
        *names,
        "distance",
        "deletions",
        insertions.alias("insertions"),
        (F.col("distance") - F.col("deletions") - insertions).alias("substitutions"),
        error_rate(F.col("distance"), n).alias("mixed_error_rate"),
    )


def transcript_report(
    reference: DataFrame,
    hypothesis: DataFrame,
    windows: DataFrame,
    order: Sequence[str],
    layout: Layout,
    complete: DataFrame | None = None,
    tile: int = TILE,
) -> DataFrame:
    """Scores of each recording of ``windows`` over all its text (null window) and over each window.

    ``reference`` and ``hypothesis`` are segments (media_id, start, end, text) with the columns of ``order``, whose first
    is numeric. A window takes the whole text of every segment that overlaps it. ``complete`` is the reference's own full
    text as further segments; without it the overall score joins the segments.
    """
    keys = [MEDIA, WINDOW]
    bounds = windows.select(MEDIA, F.col("window_start").alias(WINDOW), "window_start", "window_end")
    whole = windows.select(MEDIA).distinct().withColumn(WINDOW, F.lit(OVERALL))
    every = bounds.unionByName(whole, allowMissingColumns=True)

    def tiles(segments: DataFrame, full: DataFrame | None) -> DataFrame:
        columns = [MEDIA, WINDOW, *order, "_tokens"]
        # Tokens are taken once for all windows.
        met = windowed(_tokens(segments), every if full is None else bounds).select(*columns)
        if full is not None:
            met = met.unionByName(_tokens(full).withColumn(WINDOW, F.lit(OVERALL)).select(*columns))
        return _tiles_of_tokens(met, keys, order, layout, tile)

    scores = aligned(tiles(reference, complete), tiles(hypothesis, None), every.select(*keys), keys, tile)
    return scores.join(every, keys).drop(WINDOW)
