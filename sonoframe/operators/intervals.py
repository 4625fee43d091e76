"""Filters, relations and orderings of interval tables."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, groupby, islice, takewhile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.operators.rangejoin import overlapping_pairs
from sonoframe.operators.scan import Layout, as_of, islands, lag, lead, row_index, running, running_max, running_sum, settle
from sonoframe.session import spread

MEDIA = "media_id"


def contained_in_clip(segments: DataFrame, clip_start, clip_end) -> DataFrame:
    """Only intervals wholly inside the clip, rebased to its origin, with their source bounds kept."""
    return (
        segments.where((F.col("start") >= clip_start) & (F.col("end") <= clip_end))
        .withColumns({"source_start": F.col("start"), "source_end": F.col("end")})
        .withColumns({"start": F.col("start") - clip_start, "end": F.col("end") - clip_start})
    )


def clamped_to_window(segments: DataFrame, window_start, window_end) -> DataFrame:
    """Intervals that meet the window, clamped to it and rebased."""
    s, e = F.lit(window_start), F.lit(window_end)
    return segments.where((F.col("start") < e) & (F.col("end") > s)).withColumns(
        {
            "start": F.greatest(F.col("start"), s) - s,
            "end": F.least(F.col("end"), e) - s,
        }
    )


def repeat_counts(segments: DataFrame, recordings: DataFrame, period: int, repeats: int = 2) -> DataFrame:
    """Intervals that meet each of ``repeats`` repeats of ``period``, for every one of ``recordings``."""
    numbers = F.sequence(F.lit(0), F.lit(repeats - 1))
    first = F.greatest(F.lit(0), F.floor(F.col("start") / period))
    # Only the repeats that an interval reaches are listed; one that ends where a repeat begins does not meet it.
    last = F.least(F.lit(repeats - 1), F.ceil(F.col("end") / period) - 1)
    reached = segments.withColumns({"_first": first.cast("int"), "_last": last.cast("int")}).where("_last >= _first")
    met = (
        reached.select(MEDIA, "start", "end", F.explode(F.sequence("_first", "_last")).alias("half"))
        .where((F.col("start") < (F.col("half") + 1) * F.lit(period)) & (F.col("end") > F.col("half") * F.lit(period)))
        .groupBy(MEDIA, "half")
        .agg(F.count("*").alias("intervals"))
    )
    every = recordings.select(MEDIA, F.explode(numbers).alias("half"))
    return every.join(met, [MEDIA, "half"], "left").fillna(0, ["intervals"])


def crossing(segments: DataFrame, boundaries: Sequence[int]) -> DataFrame:
    """Intervals that strictly straddle a boundary, one row per (interval, boundary)."""
    cuts = F.array(*[F.lit(b).cast("bigint") for b in boundaries])
    return segments.withColumn("boundary", F.explode(cuts)).where(
        (F.col("start") < F.col("boundary")) & (F.col("boundary") < F.col("end"))
    )


CONTROL_LABEL = r"^\s*\[[^\]]+\]\s*$"


def without_control_labels(segments: DataFrame) -> DataFrame:
    return segments.where(~F.col("text").rlike(CONTROL_LABEL))


def ordered_text(
    segments: DataFrame, keys: Sequence[str], order: Sequence[str], separator: str, layout: Layout
) -> DataFrame:
    """Text of each key in order. Chunks are joined first so that no task sorts a whole hot key."""

    def pieces(df: DataFrame, by: list[str], sort: list[str]) -> DataFrame:
        packed = F.array_sort(F.collect_list(F.struct(*sort, "text")))
        return df.groupBy(*by).agg(F.array_join(F.transform(packed, lambda x: x["text"]), separator).alias("text"))

    if layout.span is None:
        return pieces(segments, list(keys), list(order))
    chunked = segments.withColumn("_chunk", layout.chunk(F.col(order[0])))
    return pieces(pieces(chunked, [*keys, "_chunk"], list(order)), list(keys), ["_chunk"])


def tier_join(tiers: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Line up tiers on exact keys in one aggregation: ``<name>_value``, ``<name>_count`` and status.

    Input rows are ``(keys..., tier, value)``. Copies collapse before the shuffle and are reported as
    duplicates instead of multiplying.
    """
    aggregates = []
    for name in names:
        mine = F.col("tier") == name
        aggregates.append(F.min(F.when(mine, F.col("value"))).alias(f"{name}_value"))
        aggregates.append(F.count(F.when(mine, F.lit(1))).alias(f"{name}_count"))
    counts = [F.col(f"{name}_count") for name in names]
    return (
        tiers.groupBy(*keys)
        .agg(*aggregates)
        .withColumn(
            "status",
            F.when(F.least(*counts) == 0, "missing_tier")
            .when(F.greatest(*counts) > 1, "duplicate_interval")
            .otherwise("ok"),
        )
    )


def resolve_slots(annotations: DataFrame, slots: DataFrame, file_key: str | None = None) -> DataFrame:
    """Look up both time slots of every annotation; ``resolved`` is false when either is unknown."""
    on = [file_key] if file_key else []
    out = annotations
    for side in ("start", "end"):
        named = slots.select(*on, F.col("slot").alias(f"{side}_ref"), F.col("time").alias(side))
        out = out.join(named, [*on, f"{side}_ref"], "left")
    return out.withColumn("resolved", F.col("start").isNotNull() & F.col("end").isNotNull())


def cluster_bounds(regions: DataFrame, clusters: DataFrame, layout: Layout, key: str) -> DataFrame:
    """First start and last end of the disjoint clusters overlapping each region (null when none).

    Clusters do not overlap one another, so the two extremes are two nearest-row lookups; no
    region x cluster pairs are formed.
    """
    packed = clusters.select(MEDIA, F.col("start").alias("c_start"), F.col("end").alias("c_end")).withColumn(
        "c", F.struct("c_start", "c_end")
    )
    first = as_of(
        regions, packed, [MEDIA], "start", layout,
        event_at="c_end", value="c", alias="_first", tie_break=[key], forward=True, include_equal=False,
    )
    both = as_of(
        settle(first, layout), packed, [MEDIA], "end", layout,
        event_at="c_start", value="c", alias="_last", tie_break=[key], include_equal=False,
    )
    hit_first = F.col("_first.c_start") < F.col("end")
    hit_last = F.col("_last.c_end") > F.col("start")
    return both.withColumns(
        {
            "first_start": F.when(hit_first, F.col("_first.c_start")),
            "last_end": F.when(hit_last, F.col("_last.c_end")),
        }
    ).drop("_first", "_last")


def neighbour_bounds(regions: DataFrame, others: DataFrame, layout: Layout, key: str) -> DataFrame:
    """Latest other end at or before each start, earliest other start at or after each end."""
    events = others.select(MEDIA, F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    before = as_of(
        regions, events, [MEDIA], "start", layout,
        event_at="o_end", value="o_end", alias="preceding_end", tie_break=[key],
    )
    return as_of(
        settle(before, layout), events, [MEDIA], "end", layout,
        event_at="o_start", value="o_start", alias="following_start", tie_break=[key], forward=True,
    )


def outside_collars(points: DataFrame, boundaries: DataFrame, collar, layout: Layout) -> DataFrame:
    """Points at least ``collar`` away from every boundary (``media_id, boundary``)."""
    before = as_of(
        points, boundaries, [MEDIA], "at", layout,
        event_at="boundary", value="boundary", alias="_b", tie_break=[],
    )
    both = as_of(
        settle(before, layout), boundaries, [MEDIA], "at", layout,
        event_at="boundary", value="boundary", alias="_f", tie_break=[], forward=True,
    )
    near = (F.col("at") - F.col("_b") < collar) | (F.col("_f") - F.col("at") < collar)
    return both.where(~F.coalesce(near, F.lit(False))).drop("_b", "_f")


def cross_speaker_overlaps(segments: DataFrame, width: int) -> DataFrame:
    """Overlapping pairs of different speakers, first in time order on the left."""
    left = segments.select(
        MEDIA,
        F.col("seg_idx").alias("left_id"),
        F.col("start").alias("ls"),
        F.col("end").alias("le"),
        F.col("speaker").alias("left_speaker"),
    )
    right = segments.select(
        MEDIA,
        F.col("seg_idx").alias("right_id"),
        F.col("start").alias("rs"),
        F.col("end").alias("re"),
        F.col("speaker").alias("right_speaker"),
    )
    pairs = overlapping_pairs(left, right, [MEDIA], ("ls", "le"), ("rs", "re"), width)
    earlier = F.struct("ls", "le", "left_speaker", "left_id") < F.struct(
        "rs", "re", "right_speaker", "right_id"
    )
    start, end = F.greatest("ls", "rs"), F.least("le", "re")
    return pairs.where(earlier & (F.col("left_speaker") != F.col("right_speaker"))).select(
        MEDIA,
        "left_id",
        "right_id",
        start.alias("start"),
        end.alias("end"),
        (end - start).alias("duration"),
        F.array_sort(F.array("left_speaker", "right_speaker")).alias("speakers"),
    )


def change_boundaries(segments: DataFrame, layout: Layout) -> DataFrame:
    """Starts of segments whose speaker differs from the previous one in (start, end) order."""
    order = ["start", "end", "seg_idx"]
    seen = running(segments, [MEDIA], order, layout, _previous=lag(F.col("speaker")))
    return seen.where(F.col("_previous").isNotNull() & (F.col("_previous") != F.col("speaker"))).select(
        MEDIA, F.col("start").alias("boundary")
    )


def zip_by_index(left: DataFrame, right: DataFrame, order: Sequence[str], layout: Layout) -> DataFrame:
    """Pair the i-th row of each side, up to the shorter side. Right columns get a ``_r`` suffix."""
    a = running(left, [MEDIA], order, layout, idx=row_index())
    b = running(right, [MEDIA], order, layout, idx=row_index())
    b = b.withColumnsRenamed({c: f"{c}_r" for c in right.columns if c != MEDIA})
    return a.join(b, [MEDIA, "idx"])


def monotonic_flags(segments: DataFrame, duration: Column, tolerance, layout: Layout) -> DataFrame:
    """Per recording: starts and ends never go back, ends follow starts, everything in range."""
    order = ["seg_idx"]
    seen = running(
        segments, [MEDIA], order, layout, _prev=lag(F.struct("start", "end"))
    )
    no_prev = F.col("_prev").isNull()
    return seen.groupBy(MEDIA).agg(
        F.bool_and(no_prev | (F.col("start") >= F.col("_prev.start"))).alias("starts_nondecreasing"),
        F.bool_and(no_prev | (F.col("end") >= F.col("_prev.end"))).alias("ends_nondecreasing"),
        F.bool_and(F.col("end") >= F.col("start")).alias("ends_after_starts"),
        F.bool_and((F.col("start") >= 0) & (F.col("end") <= duration + tolerance)).alias("inside_signal"),
    )


def overlap_counts(segments: DataFrame, layout: Layout) -> DataFrame:
    """Per recording: segments, overlapping pairs and the time they share.

    Between two neighbouring bounds with n active segments, n (n - 1) / 2 pairs share the time; a segment that starts
    while n others are active adds n pairs. Ends come before starts, so touching segments don't overlap.
    """
    bounds = segments.select(
        MEDIA,
        F.inline(
            F.array(
                F.struct(F.col("start").alias("at"), F.lit(1).alias("step")),
                F.struct(F.col("end").alias("at"), F.lit(-1).alias("step")),
            )
        ),
    )
    # Equal bounds are one row, so copies cost nothing in the ordered pass.
    steps = bounds.groupBy(MEDIA, "at").agg(
        F.sum(F.when(F.col("step") > 0, 1).otherwise(0)).alias("opened"), F.sum(F.when(F.col("step") < 0, 1).otherwise(0)).alias("closed")
    )
    swept = running(
        steps, [MEDIA], ["at"], layout, active=running_sum(F.col("opened") - F.col("closed")), _next=lead(F.col("at"))
    )
    n, opened = F.col("active"), F.col("opened")
    before = n - opened
    return swept.groupBy(MEDIA).agg(
        F.sum("opened").alias("segments"),
        F.sum(opened * before + (opened * (opened - 1) / 2).cast("bigint")).alias("overlap_pairs"),
        F.coalesce(F.sum((n * (n - 1) / 2).cast("bigint") * (F.col("_next") - F.col("at"))), F.lit(0)).alias("overlap_us"),
    )


def overlap_violations(windows: DataFrame, layout: Layout) -> DataFrame:
    """Windows that begin before an earlier one ended; an accepted plan has none."""
    seen = running(
        windows, [MEDIA], ["start"], layout, _reach=running_max(F.col("end"), inclusive=False)
    )
    return seen.where(F.col("_reach") > F.col("start")).drop("_reach")


def _sorted_groups(
    batches: Iterator[pd.DataFrame], key: Sequence[str], values: Sequence[str]
) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Consecutive rows with equal keys from sorted batches; a group's rows are read as they come."""
    width = len(key)
    rows = chain.from_iterable(zip(*[batch[c].tolist() for c in (*key, *values)]) for batch in batches)
    for at, group in groupby(rows, key=lambda row: row[:width]):
        yield at, (row[width:] for row in group)


def _framed(rows: Iterator[tuple], columns: Sequence[str], size: int = 10_000) -> Iterator[pd.DataFrame]:
    while block := list(islice(rows, size)):
        yield pd.DataFrame(block, columns=columns)


def _greedy(rows: Iterable[tuple], tolerance: float) -> Iterator[tuple[float, int]]:
    """Each hypothesis boundary, in order, takes the nearest free reference boundary within reach.

    Rows are distinct (position, references, hypotheses), sorted. A hypothesis is decided when the rows have gone beyond
    its reach, so only positions within twice the tolerance are held. Gives (error, matches) pairs.
    """
    held: deque[list] = deque()
    waiting: deque[tuple] = deque()

    def decide(before: float) -> Iterator[tuple[float, int]]:
        while waiting and waiting[0][0] + tolerance < before:
            at, wanted = waiting.popleft()
            while held and at - held[0][0] > tolerance:
                held.popleft()
            near = takewhile(lambda h: h[0] - at <= tolerance, held)
            for error, place in sorted(((abs(h[0] - at), h) for h in near if h[1]), key=lambda e: (e[0], e[1][0])):
                taken = min(wanted, place[1])
                place[1] -= taken
                wanted -= taken
                yield error, taken
                if not wanted:
                    break
        if not waiting:
            while held and before - held[0][0] > tolerance:
                held.popleft()

    for at, references, wanted in rows:
        yield from decide(at)
        if references:
            held.append([at, references])
        if wanted:
            waiting.append((at, wanted))
    yield from decide(float("inf"))


def match_boundaries(
    reference: DataFrame, hypothesis: DataFrame, tolerance: int, layout: Layout
) -> DataFrame:
    """Greedy one-to-one matches ``(media_id, error, matches)`` of two boundary sets.

    Equal positions collapse to counts. A gap wider than the tolerance cannot be bridged by any match,
    so each recording falls apart into independent stretches and only a stretch is matched in order.
    """
    both = (
        reference.select(MEDIA, F.col("boundary").alias("at"), F.lit(1).alias("r"), F.lit(0).alias("h"))
        .unionByName(
            hypothesis.select(MEDIA, F.col("boundary").alias("at"), F.lit(0).alias("r"), F.lit(1).alias("h"))
        )
        .groupBy(MEDIA, "at")
        .agg(F.sum("r").alias("refs"), F.sum("h").alias("hyps"))
    )
    seen = running(both, [MEDIA], ["at"], layout, _previous=lag(F.col("at")))
    new = F.col("_previous").isNull() | (F.col("at") - F.col("_previous") > tolerance)
    stretches = islands(seen, [MEDIA], ["at"], layout, new, "stretch")
    # A stretch that lacks one side cannot match anything and never reaches Python.
    useful = (
        stretches.groupBy(MEDIA, "stretch")
        .agg(F.sum("refs").alias("_r"), F.sum("hyps").alias("_h"))
        .where("_r > 0 AND _h > 0")
        .select(MEDIA, "stretch")
    )
    grouped = stretches.join(useful, [MEDIA, "stretch"], "left_semi").select(
        MEDIA, "stretch", "at", "refs", "hyps"
    )

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups = _sorted_groups(batches, [MEDIA, "stretch"], ["at", "refs", "hyps"])
        found = ((key[0], *match) for key, rows in groups for match in _greedy(rows, tolerance))
        yield from _framed(found, [MEDIA, "error", "matches"])

    schema = f"{MEDIA} bigint, error bigint, matches bigint"
    return (
        spread(grouped, MEDIA, "stretch")
        .sortWithinPartitions(MEDIA, "stretch", "at")
        .mapInPandas(match, schema)
    )


def _greedy_intervals(rows: Iterable[tuple], tolerance: float) -> int:
    """References in order take the free hypothesis with the smallest summed bound error.

    Rows are (side, start, end), sorted by start, side 0 being the reference. Hypotheses are held while a reference can
    reach them.
    """
    held: deque[list] = deque()
    waiting: deque[tuple] = deque()
    matched = 0

    def decide(before: float) -> int:
        found = 0
        while waiting and waiting[0][0] + tolerance < before:
            start, end = waiting.popleft()
            while held and start - held[0][0] > tolerance:
                held.popleft()
            near = takewhile(lambda h: h[0] - start <= tolerance, held)
            fits = [h for h in near if h[2] and abs(h[1] - end) <= tolerance]
            if fits:
                min(fits, key=lambda h: abs(h[0] - start) + abs(h[1] - end))[2] = False
                found += 1
        if not waiting:
            while held and before - held[0][0] > tolerance:
                held.popleft()
        return found

    for side, start, end in rows:
        matched += decide(start)
        if side:
            held.append([start, end, True])
        else:
            waiting.append((start, end))
    return matched + decide(float("inf"))


def match_intervals(
    reference: DataFrame, hypothesis: DataFrame, tolerances: Sequence[int], layout: Layout
) -> DataFrame:
    """Matched same-label interval pairs of every recording per tolerance: ``(media_id, tolerance, matched)``.

    Stretches of starts closer than the tolerance are independent, as for boundaries.
    """
    columns = [MEDIA, "speaker", "start", "end", "seg_idx"]
    both = reference.select(*columns, F.lit(0).alias("side")).unionByName(
        hypothesis.select(*columns, F.lit(1).alias("side"))
    )
    ladder = F.explode(F.array(*[F.lit(t).cast("bigint") for t in tolerances]))
    laddered = both.withColumn("tolerance", ladder)
    keys = [MEDIA, "speaker", "tolerance"]
    order = ["start", "end", "side", "seg_idx"]
    seen = running(laddered, keys, order, layout, _previous=lag(F.col("start")))
    new = F.col("_previous").isNull() | (F.col("start") - F.col("_previous") > F.col("tolerance"))
    stretches = islands(seen, keys, order, layout, new, "stretch").drop("_previous")
    useful = (
        stretches.groupBy(*keys, "stretch")
        .agg(F.min("side").alias("_a"), F.max("side").alias("_b"))
        .where("_a <> _b")
        .drop("_a", "_b")
    )

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = [MEDIA, "speaker", "tolerance", "stretch"]
        groups = _sorted_groups(batches, group, ["side", "start", "end"])
        counts = ((key[0], key[2], _greedy_intervals(rows, key[2])) for key, rows in groups)
        yield from _framed(counts, [MEDIA, "tolerance", "matched"])

    matched = (
        spread(stretches.join(useful, [*keys, "stretch"], "left_semi"), *keys, "stretch")
        .sortWithinPartitions(*keys, "stretch", *order)
        .mapInPandas(match, f"{MEDIA} bigint, tolerance bigint, matched bigint")
    )
    every = both.select(MEDIA).distinct().withColumn("tolerance", ladder)
    counted = matched.groupBy(MEDIA, "tolerance").agg(F.sum("matched").alias("matched"))
    return every.join(counted, [MEDIA, "tolerance"], "left").fillna(0, ["matched"])
