"""Recordings, segments, scores and signals derived from the driver tables, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.operators import scan
from sonoframe.operators.scan import Layout, measure_layout, row_index, running, tightened  # noqa: F401

HOUR = 3_600_000_000
#: Recordings last a whole number of blocks, so that frame grids end where they do.
BLOCK = 6 * HOUR


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


EPOCH = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"


def events_us(spark: SparkSession, sf: str) -> DataFrame:
    """Events with an integer microsecond position, independent of the session time zone."""
    return table(spark, sf, "events").withColumn(
        "us", F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, cast(ts as timestamp_ntz))")
    )


def events_layout(spark: SparkSession, sf: str) -> Layout:
    return measure_layout(events_us(spark, sf), ["user_id"], F.col("us"), HOUR)


def frames_layout(layout: Layout) -> Layout:
    """Frame numbers are dense, so chunks of a fixed number of frames are exact."""
    return layout if layout.span is None else Layout(scan.TARGET_ROWS)


def scores(spark: SparkSession, sf: str, layout: Layout) -> DataFrame:
    ranked = running(
        events_us(spark, sf).select("user_id", "us", "event_id", "value"),
        ["user_id"],
        ["us", "event_id"],
        layout,
        frame_idx=row_index(),
    )
    return ranked.select(
        F.col("user_id").alias("media_id"),
        "frame_idx",
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("prob"),
    )


SCORES = """v_scores AS (
  SELECT user_id AS media_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
         least(value / 1e2, 1.0::DOUBLE) AS prob
  FROM events)"""


def segments(spark: SparkSession, sf: str) -> DataFrame:
    return events_us(spark, sf).select(
        F.col("user_id").alias("media_id"),
        F.col("event_id").alias("seg_idx"),
        F.col("us").alias("start"),
        (F.col("us") + F.floor(F.col("value") * 600000).cast("bigint") * 1000).alias("end"),
        F.col("event_type").alias("speaker"),
        "value",
    )


SEGMENTS = """v_seg AS (
  SELECT user_id AS media_id, event_id AS seg_idx,
         epoch_us(ts) - 1704067200000000 AS "start",
         epoch_us(ts) - 1704067200000000 + CAST(floor(value * 600000) AS BIGINT) * 1000 AS "end",
         event_type AS speaker, value
  FROM events)"""


def hypothesis(spark: SparkSession, sf: str) -> DataFrame:
    """A perturbed second opinion: some segments missing, starts shifted, labels renamed."""
    minute = 60_000_000
    return (
        segments(spark, sf)
        .where(F.col("seg_idx") % 11 != 0)
        .select(
            "media_id",
            "seg_idx",
            F.greatest(F.lit(0), F.col("start") + (F.col("seg_idx") % 7 - 3) * minute).alias("start"),
            "end",
            F.concat(F.lit("h_"), F.substring("speaker", 1, 2)).alias("speaker"),
        )
        .where(F.col("end") > F.col("start"))
    )


HYPOTHESIS = """v_hyp AS (
  SELECT * FROM (
    SELECT media_id, seg_idx,
           greatest(0, "start" + (seg_idx % 7 - 3) * 60000000) AS "start", "end",
           'h_' || substr(speaker, 1, 2) AS speaker
    FROM v_seg WHERE seg_idx % 11 <> 0)
  WHERE "end" > "start")"""


def valid_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments that are not empty, as long as they are."""
    return segments(spark, sf).select("media_id", "seg_idx", "start", "end", "speaker").where(F.col("end") > F.col("start"))


VALID = f"""v_val AS (SELECT media_id, seg_idx, "start", "end", speaker FROM v_seg WHERE "end" > "start"),
 v_tot AS (SELECT media_id, (max(greatest("start", "end")) // {BLOCK} + 1) * {BLOCK} AS total FROM v_seg GROUP BY 1)"""


def totals(spark: SparkSession, sf: str) -> DataFrame:
    """Length of each recording: whole blocks up to the last start or end of its own rows."""
    last = F.max(F.greatest("start", "end"))
    return segments(spark, sf).groupBy("media_id").agg(((F.floor(last / BLOCK) + 1) * BLOCK).cast("bigint").alias("total"))
