"""Run-to-run comparisons: token and segment sequences, metric differences, evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.functions.text import stripped_key
from sonoframe.operators.digests import sequence_digests
from sonoframe.operators.intervals import zip_by_index
from sonoframe.operators.scan import Layout
from sonoframe.operators.statistics import delta_summary
from sonoframe.session import cut

MEDIA = "media_id"


def token_sequences(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Identical, differing and unequal-length token sequences, and broken punctuation invariants.

    ``pairs``: ``words``, ``other_words`` arrays and the first side's ``text``.
    """
    same = F.col("words").eqNullSafe(F.col("other_words"))

    def times(flag: Column) -> Column:
        return F.count(F.when(flag, F.lit(1)))

    broken = stripped_key(F.array_join("other_words", "")) != stripped_key(F.col("text"))
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("paired"),
        times(same).alias("identical"),
        times(~same).alias("differing"),
        times(F.size("words") != F.size("other_words")).alias("count_mismatch"),
        times(broken).alias("invariant_violations"),
    )


def _wide(summaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The summaries of start and end deltas as columns of one row per key."""
    names = ("count", "mean", "median", "p95", "max")
    picked = [
        F.max(F.when(F.col("bound") == bound, F.col(name))).alias(f"{bound}_{name}") for bound in ("start", "end") for name in names
    ]
    return summaries.groupBy(*keys).agg(*picked)


def word_bound_deltas(pairs: DataFrame, keys: Sequence[str], layout: Layout) -> DataFrame:
    """Summaries of the bound deltas of words in the same place, over pairs with equally many words.

    ``pairs``: ``starts``, ``ends`` and ``other_starts``, ``other_ends``, arrays with one element a word. A delta whose
    other bound is null is left out; keys without deltas have no row.
    """
    sides = F.array(
        *[
            F.struct(F.lit(b).alias("bound"), F.arrays_zip(F.col(f"{b}s").alias("a"), F.col(f"other_{b}s").alias("b")).alias("zipped"))
            for b in ("start", "end")
        ]
    )
    paired = pairs.where(F.size("starts") == F.size("other_starts")).select(*keys, F.inline(sides))
    each = paired.select(*keys, "bound", F.explode("zipped").alias("w"))
    deltas = each.select(*keys, "bound", F.abs(F.col("w.a") - F.col("w.b")).alias("delta")).where("delta IS NOT NULL")
    return _wide(delta_summary(deltas, [*keys, "bound"], "delta", layout), keys)


def segment_texts(left: DataFrame, right: DataFrame, layout: Layout, order: Sequence[str] = ("start", "end", "seg_idx")) -> DataFrame:
    """Digests, texts and labels of two segmentations in order, and summaries of their bound deltas by position.

    Deltas say little unless the counts match. A recording that only one side has is left out.
    """
    item = {"sha256": F.to_json(F.struct("end", "speaker", "start", "text"))}

    def digested(df: DataFrame, side: str) -> DataFrame:
        found = sequence_digests(df, [MEDIA], order, item, layout)
        return found.select(MEDIA, F.col("items").alias(f"{side}_segments"), F.col("sha256").alias(f"{side}_sha256"))

    paired = cut(zip_by_index(left, right, list(order), layout))
    same_text = F.col("text").eqNullSafe(F.col("text_r"))
    met = paired.groupBy(MEDIA).agg(
        F.count("*").alias("paired"),
        F.count(F.when(same_text, F.lit(1))).alias("identical_text"),
        F.count(F.when(F.col("speaker") == F.col("speaker_r"), F.lit(1))).alias("identical_speaker"),
    )
    bounds = F.array(
        *[F.struct(F.lit(b).alias("bound"), F.abs(F.col(b) - F.col(f"{b}_r")).alias("delta")) for b in ("start", "end")]
    )
    deltas = paired.select(MEDIA, F.inline(bounds)).where("delta IS NOT NULL")
    counts_match = F.col("left_segments") == F.col("right_segments")
    return (
        digested(left, "left")
        .join(digested(right, "right"), MEDIA)
        .join(met, MEDIA)
        .join(_wide(delta_summary(deltas, [MEDIA, "bound"], "delta", layout), [MEDIA]), MEDIA, "left")
        .withColumns(
            {
                "segment_count_matches": counts_match,
                "digest_matches": F.col("left_sha256") == F.col("right_sha256"),
                "text_sequences_identical": counts_match & (F.col("identical_text") == F.col("paired")),
            }
        )
    )


def segment_sequences(
    left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, durations: DataFrame, layout: Layout
) -> DataFrame:
    """Counts, labels, coverage ends and positional bound deltas of two segmentations; ``durations``: (media_id, duration)."""
    order = ["start", "end", "seg_idx"]
    paired = zip_by_index(left, right, order, layout)
    zipped = paired.groupBy(MEDIA).agg(
        F.count("*").alias("paired"),
        F.count(F.when(left_key == right_key, F.lit(1))).alias("same_speaker"),
        F.max(F.abs(F.col("start") - F.col("start_r"))).alias("max_start_delta"),
        F.max(F.abs(F.col("end") - F.col("end_r"))).alias("max_end_delta"),
    )

    def summary(df: DataFrame, side: str) -> DataFrame:
        ends = df.groupBy(MEDIA).agg(
            F.count("*").alias(f"{side}_segments"),
            F.array_sort(F.collect_set("speaker")).alias(f"{side}_labels"),
            F.max("end").alias("_end"),
        )
        ratio = F.round(F.col("_end") / F.col("duration"), 4).alias(f"{side}_last_end_ratio")
        return ends.join(durations, MEDIA).select(MEDIA, f"{side}_segments", f"{side}_labels", ratio)

    return (
        summary(left, "left")
        .join(summary(right, "right"), MEDIA)
        .withColumn("segment_count_matches", F.col("left_segments") == F.col("right_segments"))
        .join(zipped, MEDIA)
    )


def run_differences(
    runs: DataFrame, keys: Sequence[str], run: str, off: str, on: str, metrics: Sequence[str], digest: str
) -> DataFrame:
    """Absolute and percent change per metric between two runs, and whether their output is equal."""

    def side(name: str, prefix: str) -> DataFrame:
        return runs.where(F.col(run) == name).select(
            *keys, *[F.col(c).alias(f"{prefix}_{c}") for c in [*metrics, digest]]
        )

    both = side(off, "off").join(side(on, "on"), list(keys))
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"), F.col(f"off_{m}").alias("off_value"), F.col(f"on_{m}").alias("on_value")
            )
            for m in metrics
        ]
    )
    delta = F.col("on_value") - F.col("off_value")
    return both.select(
        *keys, (F.col(f"off_{digest}") == F.col(f"on_{digest}")).alias("same_output"), F.inline(rows)
    ).withColumns({"delta": delta, "percent": 100 * delta / F.nullif("off_value", F.lit(0))})


def evidence_ledger(expected: DataFrame, inventory: DataFrame) -> DataFrame:
    """Every expected path with presence, digest and size."""
    return expected.join(inventory, "path", "left").select(
        "path", F.col("sha256").isNotNull().alias("present"), "sha256", "bytes"
    )


def target_ratios(runs: DataFrame, target: float) -> DataFrame:
    """Real-time factor per run and whether it meets the target."""
    rtf = F.col("wall") / F.nullif("duration", F.lit(0.0))
    return runs.withColumn("rtf", rtf).withColumn("meets_target", F.col("rtf") <= target)
