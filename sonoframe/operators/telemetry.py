"""Resource telemetry and timing of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.operators.scan import Layout, lag, running


def peak_rollup(telemetry: DataFrame) -> DataFrame:
    """Peak per phase and overall (null phase); stages do not overlap, so maxima and never sums."""
    return telemetry.rollup("run_id", "phase").agg(
        F.max("rss_bytes").alias("peak_rss_bytes"),
        F.min("available_bytes").alias("minimum_available_bytes"),
        F.count("*").alias("samples"),
    ).where(F.col("run_id").isNotNull())


def sampling_gaps(telemetry: DataFrame, layout: Layout) -> DataFrame:
    """Longest time between consecutive samples of a run, and its non-negative swap growth."""
    order = ["elapsed_s", "sample_idx"]
    seen = running(telemetry, ["run_id"], order, layout, _previous=lag(F.col("elapsed_s")))
    first = F.min_by("swap_bytes", F.struct(*order))
    return seen.groupBy("run_id").agg(
        F.max(F.col("elapsed_s") - F.col("_previous")).alias("longest_gap_s"),
        F.greatest(F.lit(0), F.max("swap_bytes") - first).alias("swap_growth_bytes"),
    )


def stage_timing(runs: DataFrame, stages: DataFrame) -> DataFrame:
    """Real-time factor, stage time and calls, and framework overhead per run.

    ``runs(run_id, wall, duration)``; ``stages(run_id, stage, wall)``.
    """
    totals = stages.groupBy("run_id").agg(
        F.sum("wall").alias("stage_wall"), F.count("*").alias("stage_calls")
    )
    return runs.join(totals, "run_id", "left").na.fill({"stage_wall": 0.0, "stage_calls": 0}).withColumns(
        {
            "rtf": F.col("wall") / F.nullif("duration", F.lit(0.0)),
            "overhead": F.greatest(F.lit(0.0), F.col("wall") - F.col("stage_wall")),
        }
    )


def stability_flags(runs: DataFrame, segments: DataFrame, tolerance: float, layout: Layout) -> DataFrame:
    """Per run: bounds finite, in range and monotonic; coverage; whether generation hit its cap.

    ``runs(run_id, duration, generated, cap, end_seen)``; ``segments(run_id, seg_idx, start_s, end_s)``.
    The cap flag is null when either fact is unknown.
    """
    seen = running(
        segments, ["run_id"], ["seg_idx"], layout, _previous=lag(F.struct("start_s", "end_s"))
    ).join(runs.select("run_id", "duration"), "run_id")

    def finite(name: str):
        return F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) != F.lit(float("inf")))

    ordered = F.col("_previous").isNull() | (
        (F.col("start_s") >= F.col("_previous.start_s")) & (F.col("end_s") >= F.col("_previous.end_s"))
    )
    inside = (F.col("start_s") >= 0) & (F.col("end_s") >= F.col("start_s")) & (
        F.col("end_s") <= F.col("duration") + tolerance
    )
    valid = F.coalesce(finite("start_s") & finite("end_s") & ordered & inside, F.lit(False))
    checked = seen.groupBy("run_id").agg(
        F.bool_and(valid).alias("bounds_valid"),
        F.count("*").alias("segment_count"),
        F.min_by("start_s", "seg_idx").alias("first_start_s"),
        F.max_by("end_s", "seg_idx").alias("last_end_s"),
    )
    capped = (F.col("generated") == F.col("cap")) & ~F.col("end_seen")
    known = F.col("generated").isNotNull() & F.col("end_seen").isNotNull()
    return (
        runs.join(checked, "run_id", "left")
        .na.fill({"segment_count": 0})
        .withColumns(
            {
                "last_end_ratio": F.col("last_end_s") / F.nullif("duration", F.lit(0.0)),
                "hit_generation_cap": F.when(known, capped),
            }
        )
    )
