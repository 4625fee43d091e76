"""Sweep-line timelines: who is active in every elementary span of a recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.operators.scan import (
    Layout,
    islands,
    lag,
    lead,
    running,
    running_sum,
    settle,
)
from sonoframe.session import cut

MEDIA = "media_id"
WORD_BITS = 62


def label_ranks(segments: DataFrame) -> DataFrame:
    """Zero-based rank of every label in each (recording, layer), in label order."""
    by_label = Window.partitionBy(MEDIA, "layer").orderBy("label")
    return (
        segments.select(MEDIA, "layer", "label")
        .distinct()
        .withColumn("rank", F.row_number().over(by_label) - 1)
    )


def word_count(ranks: DataFrame) -> int:
    """How many 62-bit words the widest label set needs; one number read back."""
    widest = ranks.agg(F.max("rank")).first()[0]
    return 1 if widest is None else int(widest) // WORD_BITS + 1


def label_stretches(segments: DataFrame, layout: Layout) -> DataFrame:
    """Switch events ``(media_id, layer, label, at, step)``: +1 where a label becomes active, -1 where
    it stops. Overlapping or touching segments of one label collapse."""
    keys = [MEDIA, "layer", "label"]
    edges = segments.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("start").alias("at"), F.lit(1).cast("bigint").alias("delta")),
                F.struct(F.col("end").alias("at"), F.lit(-1).cast("bigint").alias("delta")),
            )
        ),
    )
    summed = edges.groupBy(*keys, "at").agg(F.sum("delta").alias("delta")).where("delta <> 0")
    net = settle(summed, layout)
    counted = running(net, keys, ["at"], layout, depth=running_sum(F.col("delta")))
    before = F.col("depth") - F.col("delta")
    step = F.when((before == 0) & (F.col("depth") > 0), 1).when(
        (before > 0) & (F.col("depth") == 0), -1
    )
    return counted.select(*keys, "at", step.cast("bigint").alias("step")).where("step is not null")


def mask_column(layer: str, word: int) -> str:
    return f"{layer}_mask_{word}"


def sweep(
    segments: DataFrame,
    layers: list[str],
    layout: Layout,
    ranks: DataFrame | None = None,
    words: int | None = None,
    anchors: DataFrame | None = None,
) -> DataFrame:
    """Maximal spans with constant label sets: ``(media_id, start, end, <layer>_mask_<word>...)``.

    Sets are bit masks over the label ranks. Each label contributes its own bit once, so a running sum
    of signed bits is the set itself, and any non-zero net step is a real change: spans come out
    coalesced. ``anchors (media_id, at)`` adds cut points that hold no change (signal start and end).
    ``end`` is null for the open stretch after the last event.
    """
    ranks = label_ranks(segments) if ranks is None else ranks
    words = word_count(ranks) if words is None else words
    switches = label_stretches(segments, layout).join(ranks, [MEDIA, "layer", "label"])
    names = [(layer, word) for layer in layers for word in range(words)]

    def signed_bit(layer: str, word: int) -> Column:
        mine = (F.col("layer") == layer) & (F.floor(F.col("rank") / WORD_BITS) == word)
        bit = F.expr(f"shiftleft(1L, cast(rank % {WORD_BITS} as int))")
        return F.sum(F.when(mine, F.col("step") * bit).otherwise(F.lit(0).cast("bigint")))

    steps = switches.groupBy(MEDIA, "at").agg(
        *[signed_bit(layer, word).alias(mask_column(layer, word)) for layer, word in names]
    )
    if anchors is not None:
        zero = anchors.select(
            MEDIA, "at", *[F.lit(0).cast("bigint").alias(mask_column(*n)) for n in names]
        )
        steps = (
            steps.unionByName(zero)
            .groupBy(MEDIA, "at")
            .agg(*[F.sum(mask_column(*n)).alias(mask_column(*n)) for n in names])
        )
    else:
        changed = F.lit(False)
        for n in names:
            changed = changed | (F.col(mask_column(*n)) != 0)
        steps = steps.where(changed)
    renamed = settle(
        steps.withColumnsRenamed({mask_column(*n): f"_step_{mask_column(*n)}" for n in names}), layout
    )
    swept = running(
        renamed,
        [MEDIA],
        ["at"],
        layout,
        end=lead(F.col("at")),
        **{mask_column(*n): running_sum(F.col(f"_step_{mask_column(*n)}")) for n in names},
    )
    return swept.select(
        MEDIA, F.col("at").alias("start"), "end", *[mask_column(*n) for n in names]
    )


def set_size(layer: str, words: int) -> Column:
    size = F.lit(0)
    for word in range(words):
        size = size + F.bit_count(mask_column(layer, word))
    return size


def label_array(layer: str, words: int, labels: str = "labels") -> Column:
    """Decode the masks of a layer to a sorted label array, given the ranked ``labels`` array."""
    pieces = [
        F.expr(
            f"filter(transform({labels}, (x, i) -> CASE WHEN i div {WORD_BITS} = {word} AND "
            f"(shiftright({mask_column(layer, word)}, cast(i % {WORD_BITS} as int)) & 1L) = 1L "
            f"THEN x END), x -> x IS NOT NULL)"
        )
        for word in range(words)
    ]
    return F.concat(*pieces) if len(pieces) > 1 else pieces[0]


def ranked_labels(ranks: DataFrame, layer: str, alias: str = "labels") -> DataFrame:
    """Label array in rank order per recording: as long as the recording has distinct labels."""
    return (
        ranks.where(F.col("layer") == layer)
        .groupBy(MEDIA)
        .agg(F.sort_array(F.collect_list(F.struct("rank", "label"))).alias("_pairs"))
        .select(MEDIA, F.col("_pairs.label").alias(alias))
    )


def atomic_timeline(kept: DataFrame, filtered: DataFrame, totals: DataFrame, layout: Layout) -> DataFrame:
    """Exact partition of ``[0, total)`` into spans of constant speaker set and fragment flag.

    ``kept``/``filtered``: ``(media_id, start, end, speaker)`` in integer units inside the signal.
    ``totals``: ``(media_id, total)``.
    """
    layered = kept.select(
        MEDIA, F.lit("speaker").alias("layer"), F.col("speaker").alias("label"), "start", "end"
    ).unionByName(
        filtered.select(
            MEDIA, F.lit("fragment").alias("layer"), F.lit("").alias("label"), "start", "end"
        )
    )
    ranks = cut(label_ranks(layered))
    words = word_count(ranks)
    edges = totals.select(
        MEDIA, F.explode(F.array(F.lit(0).cast("bigint"), F.col("total"))).alias("at")
    )
    spans = sweep(layered, ["speaker", "fragment"], layout, ranks, words, edges).where(
        F.col("end").isNotNull()
    )
    decoded = spans.join(ranked_labels(ranks, "speaker"), MEDIA, "left")
    speakers = F.coalesce(label_array("speaker", words), F.array().cast("array<string>"))
    size = set_size("speaker", words)
    fragment = F.col(mask_column("fragment", 0)) > 0
    kind = (
        F.when(size > 1, "overlap")
        .when(size == 1, "single_speaker")
        .when(fragment, "raw_fragment_abstain")
        .otherwise("gap")
    )
    return decoded.select(
        MEDIA,
        "start",
        "end",
        speakers.alias("speakers"),
        fragment.alias("filtered_active"),
        kind.alias("kind"),
    )


def build_turns(spans: DataFrame, merge_gap: int, layout: Layout) -> DataFrame:
    """Merge one speaker's single spans across a lone short gap; never across anything else."""
    seen = running(
        spans, [MEDIA], ["start"], layout, prev=lag(F.struct("kind", (F.col("end") - F.col("start")).alias("len")))
    )
    singles = settle(seen, layout).where("kind = 'single_speaker'").select(
        MEDIA, "start", "end", F.col("speakers")[0].alias("speaker"), "prev"
    )
    paired = running(singles, [MEDIA], ["start"], layout, before=lag(F.struct("end", "speaker")))
    joins = F.coalesce(
        (F.col("prev.kind") == "gap")
        & (F.col("prev.len") <= merge_gap)
        & (F.col("before.end") == F.col("start") - F.col("prev.len"))
        & (F.col("before.speaker") == F.col("speaker")),
        F.lit(False),
    )
    marked = paired.withColumn("bridge", F.when(joins, F.col("prev.len")).otherwise(F.lit(0)))
    turns = (
        islands(marked.withColumn("_joins", joins), [MEDIA], ["start"], layout, ~F.col("_joins"), "turn")
        .groupBy(MEDIA, "turn")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.min("speaker").alias("speaker"),
            F.sum(F.col("end") - F.col("start")).alias("active_samples"),
            F.sum("bridge").cast("bigint").alias("bridge_gap_samples"),
        )
    )
    return turns.select(
        MEDIA,
        (F.col("turn") - 1).alias("turn_index"),
        "start",
        "end",
        "speaker",
        "active_samples",
        "bridge_gap_samples",
    )


def coverage_ledger(spans: DataFrame, turns: DataFrame, totals: DataFrame, min_turn: int) -> DataFrame:
    """Disjoint coverage categories per recording, in the units of the spans."""
    length = F.col("end") - F.col("start")

    def of_kind(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, length)), F.lit(0))

    by_span = spans.groupBy(MEDIA).agg(
        of_kind("overlap").alias("overlap"),
        of_kind("raw_fragment_abstain").alias("fragment_only"),
        of_kind("gap").alias("gap"),
    )
    accepted = length >= min_turn

    def over(flag: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(flag, value)), F.lit(0))

    by_turn = turns.groupBy(MEDIA).agg(
        over(accepted, F.col("active_samples")).alias("accepted_active"),
        over(accepted, F.col("bridge_gap_samples")).alias("accepted_bridge"),
        over(~accepted, F.col("active_samples")).alias("short_turn"),
        over(accepted, F.lit(1).cast("bigint")).alias("accepted_turns"),
    )
    zero = {c: 0 for c in ("accepted_active", "accepted_bridge", "short_turn", "accepted_turns")}
    joined = totals.join(by_span, MEDIA).join(by_turn, MEDIA, "left").na.fill(zero)
    unclaimed = F.col("gap") - F.col("accepted_bridge")
    parts = (
        F.col("accepted_active")
        + F.col("accepted_bridge")
        + F.col("short_turn")
        + F.col("overlap")
        + F.col("fragment_only")
        + unclaimed
    )
    return joined.select(
        MEDIA,
        "total",
        "accepted_turns",
        "accepted_active",
        "accepted_bridge",
        "short_turn",
        "overlap",
        "fragment_only",
        unclaimed.alias("unclaimed_gap"),
        parts.alias("partition_sum"),
        ((parts == F.col("total")) & (unclaimed >= 0)).alias("is_exact"),
    )


def normalize_intervals(raw: DataFrame, sample_rate: int) -> DataFrame:
    """Seconds as text or number to clamped sample bounds, with a reject ``reason`` (null when kept).

    Expects ``(media_id, seg_idx, start_s, end_s, speaker, total)``; bounds may be strings.
    """
    start = F.expr("try_cast(start_s AS double)")
    end = F.expr("try_cast(end_s AS double)")

    def bound(seconds: Column) -> Column:
        # Compare as doubles so that a huge finite bound clamps instead of overflowing.
        rounded = F.bround(seconds * sample_rate)
        return F.greatest(F.lit(0.0), F.least(F.col("total").cast("double"), rounded)).cast("bigint")

    def finite(x: Column) -> Column:
        return ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))

    parsed = raw.withColumns({"_s": start, "_e": end})
    invalid = F.col("_s").isNull() | F.col("_e").isNull() | F.col("speaker").isNull()
    ok = ~invalid & finite(F.col("_s")) & finite(F.col("_e"))
    return (
        parsed.withColumns(
            {
                "start": F.when(ok, bound(F.col("_s"))),
                "end": F.when(ok, bound(F.col("_e"))),
            }
        )
        .withColumn(
            "reason",
            F.when(invalid, "invalid_fields")
            .when(~ok, "nonfinite_bounds")
            .when(F.col("end") <= F.col("start"), "empty_after_crop"),
        )
        .drop("_s", "_e")
    )


def split_by_length(intervals: DataFrame, minimum: int) -> DataFrame:
    length = F.col("end") - F.col("start")
    return intervals.withColumn("grain", F.when(length >= minimum, "kept").otherwise("filtered"))


def abstentions(
    spans: DataFrame, turns: DataFrame, filtered: DataFrame, invalid: DataFrame, min_turn: int
) -> DataFrame:
    """Everything withheld from transcription, with its reason."""
    none = F.array().cast("array<string>")

    def rows(df: DataFrame, reason, speakers) -> DataFrame:
        return df.select(
            MEDIA,
            (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
            F.col("start").cast("bigint").alias("start"),
            F.col("end").cast("bigint").alias("end"),
            (F.col("end") - F.col("start")).cast("bigint").alias("duration"),
            speakers.alias("speakers"),
        )

    short = turns.where(F.col("end") - F.col("start") < min_turn)
    return (
        rows(spans.where("kind = 'overlap'"), "multiple_anonymous_speakers_active", F.col("speakers"))
        .unionByName(
            rows(
                filtered,
                "raw_diarizer_fragment_below_predeclared_minimum",
                F.array("speaker"),
            )
        )
        .unionByName(
            rows(
                spans.where("kind = 'raw_fragment_abstain'"),
                "only_filtered_raw_fragments_active",
                none,
            )
        )
        .unionByName(rows(short, "final_turn_below_asr_minimum", F.array("speaker")))
        .unionByName(rows(invalid, F.col("reason"), F.array("speaker")))
    )


def centres_before(position: Column, total_frames: Column, frame: int, duration: Column) -> Column:
    """How many frame centres lie before ``position``, the last centre held inside the signal."""
    centred = F.floor((2 * position + F.lit(frame - 1)) / F.lit(2 * frame)).cast("bigint")
    return F.when(position > duration, total_frames).otherwise(F.least(total_frames, centred))


def frame_total(duration: Column, frame: int) -> Column:
    return F.ceil(duration / F.lit(frame)).cast("bigint")
