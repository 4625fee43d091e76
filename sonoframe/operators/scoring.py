"""Agreement scoring: activity, diarization error, single-speaker overlap, transcripts.

Frames are never exploded. Segments become spans of constant label sets, a span knows by arithmetic how
many frame centres it holds, and spans collapse to distinct set patterns before anything is compared.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.functions.text import edit_counts, error_rate
from sonoframe.operators.assignment import apply_mapping, best_mapping
from sonoframe.operators.scan import Layout
from sonoframe.operators.timeline import (
    WORD_BITS,
    centres_before,
    frame_total,
    label_ranks,
    mask_column,
    ranked_labels,
    sweep,
    word_count,
)
from sonoframe.session import cut, spread

MEDIA = "media_id"


def layered(segments: DataFrame, layer: str, label: Column | None = None) -> DataFrame:
    return segments.select(
        MEDIA,
        F.lit(layer).alias("layer"),
        (F.col("speaker") if label is None else label).alias("label"),
        "start",
        "end",
    )


def collar_segments(reference: DataFrame, collar: int) -> DataFrame:
    """Positions closer than ``collar`` to a reference bound, as half-open integer intervals."""
    bounds = reference.select(MEDIA, F.explode(F.array("start", "end")).alias("b")).distinct()
    return bounds.select(
        MEDIA,
        F.lit("collar").alias("layer"),
        F.lit("").alias("label"),
        (F.col("b") - collar + 1).alias("start"),
        (F.col("b") + collar).alias("end"),
    )


def layer_patterns(
    parts: DataFrame, layers: Sequence[str], durations: DataFrame, frame: int, layout: Layout
) -> tuple[DataFrame, DataFrame, int]:
    """Frame counts per distinct combination of label sets over the layers.

    Frame ``i`` stands for its centre ``min(duration, (i + 0.5) * frame)``. Returns the patterns
    ``(media_id, <layer>_mask_<word>..., frames)``, the label ranks and the word count.
    """
    ranks = cut(label_ranks(parts))
    words = word_count(ranks)
    origin = durations.select(MEDIA, F.lit(0).cast("bigint").alias("at"))
    spans = sweep(parts, list(layers), layout, ranks, words, origin)
    total = frame_total(F.col("duration"), frame)

    def before(bound: str) -> Column:
        return centres_before(F.col(bound), total, frame, F.col("duration"))

    opened = F.greatest(F.lit(0), before("start"))
    closed = F.when(F.col("end").isNull(), total).otherwise(before("end"))
    masks = [mask_column(layer, word) for layer in layers for word in range(words)]
    held = spans.join(durations, MEDIA).select(
        MEDIA, *masks, (closed - opened).alias("frames")
    )
    patterns = held.where("frames > 0").groupBy(MEDIA, *masks).agg(F.sum("frames").alias("frames"))
    return patterns, ranks, words


def frame_patterns(
    reference: DataFrame,
    hypothesis: DataFrame,
    durations: DataFrame,
    frame: int,
    layout: Layout,
    collar: int | None = None,
) -> tuple[DataFrame, DataFrame, int]:
    """Patterns of reference and hypothesis sets, with ``in_collar`` near reference bounds."""
    parts = layered(reference, "ref").unionByName(layered(hypothesis, "hyp"))
    layers = ["ref", "hyp"]
    if collar:
        parts = parts.unionByName(collar_segments(reference, collar))
        layers.append("collar")
    patterns, ranks, words = layer_patterns(parts, layers, durations, frame, layout)
    in_collar = (F.col(mask_column("collar", 0)) > 0) if collar else F.lit(False)
    return patterns.withColumn("in_collar", in_collar), ranks, words


def _packed(patterns: DataFrame, keys: list[str], masks: list[str]) -> DataFrame:
    """Patterns of each key as aligned arrays, one per mask word plus the frame counts."""
    gathered = patterns.groupBy(*keys).agg(F.collect_list(F.struct(*masks, "frames")).alias("_all"))
    return gathered.select(*keys, *[F.col("_all")[c].alias(c) for c in [*masks, "frames"]])


def _bit_matrix(words: Sequence, width: int) -> np.ndarray:
    """0/1 matrix, one row per pattern and one column per label rank, from aligned word arrays."""
    if words[0] is None:
        return np.zeros((0, width), dtype=np.int64)
    shifts = np.arange(WORD_BITS)
    bits = [(np.asarray(w, dtype=np.int64)[:, None] >> shifts) & 1 for w in words]
    return np.concatenate(bits, axis=1)[:, :width]


SETTINGS = (
    ("exclusive_no_collar", False, False),
    ("exclusive_with_collar", True, False),
    ("overlap_included_no_collar", False, True),
)


def diarization_error(
    patterns: DataFrame, ranks: DataFrame, words: int, durations: DataFrame, frame: int
) -> DataFrame:
    """Missed, false-alarm and confused frames per setting under the best label mapping.

    Only distinct patterns reach Python: one row per (recording, setting) whose array holds each
    combination of label sets once, however long the recording is.
    """
    settings = F.array(
        *[
            F.struct(F.lit(n).alias("setting"), F.lit(c).alias("_collar"), F.lit(o).alias("_overlap"))
            for n, c, o in SETTINGS
        ]
    )
    ref_size = F.lit(0)
    for word in range(words):
        ref_size = ref_size + F.bit_count(mask_column("ref", word))
    labels = ranked_labels(ranks, "ref", "ref_labels").join(
        ranked_labels(ranks, "hyp", "hyp_labels"), MEDIA, "full"
    )
    empty = F.array().cast("array<string>")
    headed = durations.select(MEDIA).join(labels, MEDIA, "left").select(
        MEDIA,
        F.coalesce("ref_labels", empty).alias("ref_labels"),
        F.coalesce("hyp_labels", empty).alias("hyp_labels"),
    )
    scored = (
        patterns.withColumn("_ref_size", ref_size)
        .select("*", F.inline(settings))
        .where((~F.col("_collar") | ~F.col("in_collar")) & (F.col("_overlap") | (F.col("_ref_size") <= 1)))
    )
    masks = [mask_column(layer, word) for layer in ("ref", "hyp") for word in range(words)]
    merged = scored.groupBy(MEDIA, "setting", *masks).agg(F.sum("frames").alias("frames"))
    packed = _packed(merged, [MEDIA, "setting"], masks)
    # Keep recordings whose every frame was excluded: they report zero evaluated frames.
    wanted = headed.select("*", F.inline(settings)).drop("_collar", "_overlap")
    grouped = spread(wanted.join(packed, [MEDIA, "setting"], "left"), MEDIA, "setting")
    names = [
        MEDIA, "setting", "evaluated_frames", "reference_frames",
        "missed_frames", "false_alarm_frames", "confusion_frames", "mapping",
    ]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            columns = [MEDIA, "setting", "ref_labels", "hyp_labels", "frames", *masks]
            for media, setting, refs, hyps, frames, *columns_of in zip(*[batch[c] for c in columns]):
                ref = _bit_matrix(columns_of[:words], len(refs))
                hyp = _bit_matrix(columns_of[words:], len(hyps))
                weight = np.asarray([] if frames is None else frames, dtype=np.int64)
                mapping, errors = best_mapping(ref, hyp, weight)
                text = ",".join(f"{h}={'' if t is None else refs[t]}" for h, t in zip(hyps, mapping))
                speaker = int((ref.sum(axis=1) * weight).sum())
                rows.append((media, setting, int(weight.sum()), speaker, *errors, text))
            yield pd.DataFrame(rows, columns=names)

    schema = f"{MEDIA} bigint, setting string, mapping string, " + ", ".join(
        f"{n} bigint" for n in names[2:-1]
    )
    out = grouped.mapInPandas(score, schema)
    errors = F.col("missed_frames") + F.col("false_alarm_frames") + F.col("confusion_frames")
    total = frame_total(F.col("duration"), frame)
    return out.join(durations, MEDIA).select(
        *out.columns,
        (F.col("evaluated_frames") / F.nullif(total, F.lit(0))).alias("evaluated_fraction"),
        error_rate(errors, F.col("reference_frames")).alias("diarization_error_rate"),
    )


def precision_recall(tp: Column, fp: Column, fn: Column, strict: bool = False) -> list[Column]:
    """Null-safe precision, recall and F1. ``strict`` leaves F1 null when either one is zero."""
    zero = F.lit(0)
    precision = tp / F.nullif(tp + fp, zero)
    recall = tp / F.nullif(tp + fn, zero)
    f1 = 2 * precision * recall / F.nullif(precision + recall, F.lit(0.0))
    if strict:
        f1 = F.when((precision > 0) & (recall > 0), f1)
    return [precision.alias("precision"), recall.alias("recall"), f1.alias("f1")]


def activity_scores(
    first: DataFrame, second: DataFrame, durations: DataFrame, frame: int, layout: Layout, strict: bool = False
) -> DataFrame:
    """Frames active in both, only the first, only the second, with precision, recall and F1."""
    parts = layered(first, "ref", F.lit("")).unionByName(layered(second, "hyp", F.lit("")))
    patterns, _, _ = layer_patterns(parts, ["ref", "hyp"], durations, frame, layout)
    a, b = F.col(mask_column("ref", 0)) > 0, F.col(mask_column("hyp", 0)) > 0
    return _activity(patterns, [MEDIA], a, b, strict)


def _activity(patterns: DataFrame, keys: list[str], a: Column, b: Column, strict: bool) -> DataFrame:
    def frames(flag: Column) -> Column:
        return F.coalesce(F.sum(F.when(flag, F.col("frames"))), F.lit(0))

    counts = patterns.groupBy(*keys).agg(
        frames(a & b).alias("both_active"),
        frames(a & ~b).alias("first_only"),
        frames(~a & b).alias("second_only"),
    )
    return counts.select(
        "*", *precision_recall(F.col("both_active"), F.col("second_only"), F.col("first_only"), strict)
    )


def agreement_between(
    sources: dict[str, DataFrame], pairs: Sequence[tuple[str, str]], durations: DataFrame, frame: int, layout: Layout
) -> DataFrame:
    """Score several pairs of activity sources on one grid, from one sweep over all sources."""
    parts = None
    for name, source in sources.items():
        rows = layered(source, name, F.lit(""))
        parts = rows if parts is None else parts.unionByName(rows)
    patterns, _, _ = layer_patterns(parts, list(sources), durations, frame, layout)
    sides = F.array(
        *[
            F.struct(
                F.lit(f"{a}-{b}").alias("pair"),
                (F.col(mask_column(a, 0)) > 0).alias("_a"),
                (F.col(mask_column(b, 0)) > 0).alias("_b"),
            )
            for a, b in pairs
        ]
    )
    paired = patterns.select(MEDIA, "frames", F.inline(sides))
    return _activity(paired, [MEDIA, "pair"], F.col("_a"), F.col("_b"), strict=True)


def single_speaker_scores(
    reference: DataFrame, hypothesis: DataFrame, durations: DataFrame, frame: int, layout: Layout
) -> DataFrame:
    """Each hypothesis label against the union of one reference speaker; the best is flagged.

    A missing or zero F1 ranks as -1 and the first label wins ties.
    """
    one = reference.withColumn("speaker", F.lit(""))
    patterns, ranks, words = frame_patterns(one, hypothesis, durations, frame, layout)
    bits = ranks.where("layer = 'hyp'").select(MEDIA, "rank", F.col("label").alias("speaker"))
    ref_total = patterns.groupBy(MEDIA).agg(
        F.coalesce(F.sum(F.when(F.col("ref_mask_0") > 0, F.col("frames"))), F.lit(0)).alias("_ref")
    )
    # One row per (pattern, label in it): labels absent from a pattern contribute nothing but FN,
    # which is the reference total minus TP.
    active = F.array(
        *[
            F.struct(F.lit(word).alias("word"), F.col(mask_column("hyp", word)).alias("mask"))
            for word in range(words)
        ]
    )
    member = patterns.select(MEDIA, "ref_mask_0", "frames", F.inline(active)).where("mask <> 0").select(
        MEDIA,
        "ref_mask_0",
        "frames",
        F.expr(
            f"explode(filter(transform(sequence(0, {WORD_BITS - 1}), i -> CASE WHEN "
            f"(shiftright(mask, i) & 1L) = 1L THEN word * {WORD_BITS} + i END), x -> x IS NOT NULL))"
        ).alias("rank"),
    )
    counted = member.groupBy(MEDIA, "rank").agg(
        F.sum(F.when(F.col("ref_mask_0") > 0, F.col("frames")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("ref_mask_0") == 0, F.col("frames")).otherwise(0)).alias("fp"),
    )
    scored = (
        bits.join(counted, [MEDIA, "rank"], "left")
        .join(ref_total, MEDIA, "left")
        .na.fill({"tp": 0, "fp": 0, "_ref": 0})
        .withColumn("fn", F.col("_ref") - F.col("tp"))
    )
    rated = scored.select(
        MEDIA, "speaker", "tp", "fp", "fn", *precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))
    )
    ranked = Window.partitionBy(MEDIA).orderBy(
        F.coalesce(F.nullif("f1", F.lit(0.0)), F.lit(-1.0)).desc(), "speaker"
    )
    return rated.withColumn("is_best", F.row_number().over(ranked) == 1)


def repeat_agreement(
    first: DataFrame, second: DataFrame, durations: DataFrame, frame: int, layout: Layout
) -> DataFrame:
    """Symmetric-difference agreement of two repeat windows under the best label bijection.

    Frames here belong to ``ceil(bound/frame - 0.5)`` ranges without the last-centre clamp; windows
    are whole frames long, where both definitions agree. Unequal label counts give a status, not rows
    of numbers.
    """
    patterns, ranks, words = frame_patterns(first, second, durations, frame, layout)
    # Labels count only when they are active in at least one frame.
    labels = ranked_labels(ranks, "ref", "ref_labels").join(
        ranked_labels(ranks, "hyp", "hyp_labels"), MEDIA, "full"
    )
    masks = [mask_column(layer, word) for layer in ("ref", "hyp") for word in range(words)]
    packed = _packed(patterns, [MEDIA], masks)
    grouped = spread(durations.select(MEDIA).join(labels, MEDIA).join(packed, MEDIA, "left"), MEDIA)
    names = [
        MEDIA, "status", "mapping", "total_frames", "error_frames", "reference_frames",
        "exact_frames", "voiced_frames", "voiced_exact_frames", "speech_agree_frames",
    ]

    def compare(media, ref_all, hyp_all, frames, *columns_of) -> tuple:
        def present(side, labels) -> tuple[np.ndarray, list[str]]:
            names = [] if labels is None else list(labels)
            bits = _bit_matrix(side, len(names))
            kept = [i for i in range(len(names)) if bits[:, i].any()]
            return bits[:, kept], [names[i] for i in kept]

        weight = np.asarray([] if frames is None else frames, dtype=np.int64)
        left, refs = present(columns_of[:words], ref_all)
        hyp, hyps = present(columns_of[words:], hyp_all)
        if len(refs) != len(hyps):
            return (media, "different_label_counts", None, int(weight.sum()), *[None] * 6)
        # A bijection fixes both set sizes, so the symmetric difference is smallest where the frame
        # error is: both are constants minus the shared labels.
        mapping, _ = best_mapping(left, hyp, weight)
        right = apply_mapping(hyp, mapping, len(refs))
        differing = (left != right).sum(axis=1)
        some_left, some_right = left.any(axis=1), right.any(axis=1)
        same, voiced = differing == 0, some_left | some_right
        sums = [differing, left.sum(axis=1), same, voiced, same & voiced, some_left == some_right]
        text = ",".join(f"{h}={refs[t]}" for h, t in zip(hyps, mapping))
        return (media, "ok", text, int(weight.sum()), *[int((x * weight).sum()) for x in sums])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            columns = [MEDIA, "ref_labels", "hyp_labels", "frames", *masks]
            rows = zip(*[batch[c] for c in columns])
            yield pd.DataFrame([compare(*row) for row in rows], columns=names)

    schema = f"{MEDIA} bigint, status string, mapping string, " + ", ".join(
        f"{n} bigint" for n in names[3:]
    )
    zero = F.lit(0)
    return grouped.mapInPandas(score, schema).select(
        "*",
        (F.col("error_frames") / F.nullif("reference_frames", zero)).alias("frame_error_rate"),
        (F.col("exact_frames") / F.nullif("total_frames", zero)).alias("exact_fraction"),
        (F.col("voiced_exact_frames") / F.nullif("voiced_frames", zero)).alias("voiced_exact_fraction"),
        (F.col("speech_agree_frames") / F.nullif("total_frames", zero)).alias("speech_agreement"),
    )


def boundary_scores(
    matches: DataFrame, reference: DataFrame, hypothesis: DataFrame, layout: Layout
) -> DataFrame:
    """Precision, recall and F1 of matched boundaries with median and p95 error."""
    from sonoframe.operators.statistics import order_statistics

    ref = reference.groupBy(MEDIA).agg(F.count("*").alias("reference_count"))
    hyp = hypothesis.groupBy(MEDIA).agg(F.count("*").alias("hypothesis_count"))
    picks = {"median_error": "median", "p95_error": "nearest_0.95"}
    stats = order_statistics(matches, [MEDIA], "error", layout, picks, "matched", weight="matches")
    joined = ref.join(hyp, MEDIA, "full").join(stats, MEDIA, "left").na.fill(
        {"reference_count": 0, "hypothesis_count": 0, "matched": 0}
    )
    tp = F.col("matched")
    return joined.select(
        "*",
        *precision_recall(tp, F.col("hypothesis_count") - tp, F.col("reference_count") - tp),
    )


def scoring_windows(durations: DataFrame, window: float) -> DataFrame:
    """First, middle and last window of each recording, once each when it is short."""
    width = F.least(F.lit(window), F.col("duration"))
    late = F.greatest(F.lit(0.0), F.col("duration") - width)
    starts = F.array_distinct(F.array(F.lit(0.0), late / 2, late))
    return durations.withColumn("window_start", F.explode(starts)).withColumn(
        "window_end", F.col("window_start") + width
    )


def transcript_scores(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edit counts of token arrays ``reference_tokens`` and ``hypothesis_tokens`` per row."""
    spaced = spread(pairs.select(*keys, "reference_tokens", "hypothesis_tokens"), *keys)
    counted = spaced.withColumn("_edits", edit_counts("reference_tokens", "hypothesis_tokens"))
    n = F.size("reference_tokens").cast("bigint")
    return counted.select(
        *keys,
        n.alias("reference_count"),
        F.size("hypothesis_tokens").cast("bigint").alias("hypothesis_count"),
        "_edits.distance",
        "_edits.deletions",
        "_edits.insertions",
        "_edits.substitutions",
    ).withColumn("error_rate", error_rate(F.col("distance"), F.col("reference_count")))


def rolled_up_errors(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals per key and overall (null key), rates from summed counts."""
    names = ["reference_count", "hypothesis_count", "distance", "deletions", "insertions", "substitutions"]
    return (
        scores.rollup(*keys)
        .agg(*[F.sum(n).alias(n) for n in names])
        .withColumn("error_rate", error_rate(F.col("distance"), F.col("reference_count")))
    )
