"""Streaming queries replayed over the event table, and the extension points."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonoframe.functions.udtf import frame_grid, grid_frames
from sonoframe.operators import levels as M
from sonoframe.operators import regions as R
from sonoframe.operators import scorers
from sonoframe.plans import signals as G
from sonoframe.plans import views as V
from sonoframe.plans.queries_regions import PADDED, POLICY, RAW_REGIONS
from sonoframe.plans.queries_signal import signal_layout
from sonoframe.plans.registry import query
from sonoframe.streaming.regions import stream_regions, use_rocksdb
from sonoframe.streaming.replay import drain_whole, read_growing
from sonoframe.streaming.windows import session_turns, window_peaks

GAP = 3_600_000_000
#: The row that closes a stream at its end: a key that no recording has, later than any gap or delay reaches.
NO_KEY, FAR_FUTURE = f"{-(2**62)}L", "timestamp'2261-01-01 00:00:00'"


def event_stream(spark, sf):
    schema = V.table(spark, sf, "events").schema
    raw = read_growing(spark, sf, "events.parquet", schema)
    us = F.expr(f"timestampdiff(MICROSECOND, {V.EPOCH}, cast(ts as timestamp_ntz))")
    return raw.withColumn("us", us).withColumn("ts", F.timestamp_micros(us))


def whole_peaks(spark, sf, width, slide=None):
    """Peaks of all windows, those that are open at the end of the input included."""
    rows = event_stream(spark, sf).select("ts", "event_type", "value")
    closing = spark.sql(f"SELECT {FAR_FUTURE} AS ts, '' AS event_type, 0D AS value")
    return drain_whole(rows, lambda r: window_peaks(r, F.col("value"), "event_type", width, "1 hour", slide=slide), closing)


@query(
    "stream_session_turns",
    "STR-2",
    f"""WITH {V.SEGMENTS}, g AS (SELECT media_id, speaker, "start", greatest("end", "start") AS e, value FROM v_seg),
 m AS (SELECT *, CASE WHEN "start" <= max(e + {GAP}) OVER (PARTITION BY media_id, speaker ORDER BY "start", e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM g),
 i AS (SELECT *, sum(n) OVER (PARTITION BY media_id, speaker ORDER BY "start", e) AS k FROM m)
 SELECT media_id, speaker, min("start") AS start_us, max(e) AS end_us, count(*) AS segments, CAST(sum(e - "start") AS BIGINT) AS active_us FROM i GROUP BY media_id, speaker, k""",
)
def stream_session_turns(spark, sf):
    segments = event_stream(spark, sf).select(
        F.col("user_id").alias("media_id"),
        F.col("event_type").alias("speaker"),
        "ts",
        F.greatest(F.lit(0), F.floor(F.col("value") * 600000).cast("bigint") * 1000).alias("length_us"),
    )
    closing = spark.sql(f"SELECT {NO_KEY} AS media_id, '' AS speaker, {FAR_FUTURE} AS ts, 0L AS length_us")
    return drain_whole(segments, lambda s: session_turns(s, GAP, "1 hour"), closing)


@query(
    "stream_window_peaks",
    "STR-3",
    """WITH e AS (SELECT *, epoch_us(ts) - 1704067200000000 AS us FROM events)
 SELECT us // 21600000000 * 21600000000 AS window_us, event_type, max(value) AS peak, count(*) AS samples FROM e GROUP BY 1, 2""",
)
def stream_window_peaks(spark, sf):
    return whole_peaks(spark, sf, "6 hours")


@query(
    "stream_sliding_peaks",
    "STR-3",
    """WITH e AS (SELECT *, epoch_us(ts) - 1704067200000000 AS us FROM events), w AS (SELECT (us // 21600000000 - k) * 21600000000 AS window_us, event_type, value FROM e, (SELECT unnest([0, 1, 2, 3]) AS k))
 SELECT window_us, event_type, max(value) AS peak, count(*) AS samples FROM w GROUP BY 1, 2""",
)
def stream_sliding_peaks(spark, sf):
    return whole_peaks(spark, sf, "24 hours", "6 hours")


#: Several scores at one minute are taken in their order; what is open at the end closes after its recording's last minute.
STREAMED = (
    RAW_REGIONS.removeprefix(V.SCORES)
    .replace("ORDER BY frame_idx)", "ORDER BY frame_idx, prob ROWS UNBOUNDED PRECEDING)")
    .replace("count(*) * 512 AS total", "(max(frame_idx) + 1) * 512 AS total")
)


@query(
    "stream_regions",
    "STR-1",
    f"""WITH v_scores AS (SELECT user_id AS media_id, (epoch_us(ts) - 1704067200000000) // 60000000 AS frame_idx, least(value / 1e2, 1.0::DOUBLE) AS prob FROM events){STREAMED}
 SELECT media_id, CAST(s AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end" FROM v_raw""",
)
def stream_region_builder(spark, sf):
    """Events as frames: the frame number is the event's minute; events of one minute are all taken."""
    use_rocksdb(spark)
    frames = event_stream(spark, sf).select(
        F.col("user_id").alias("media_id"),
        F.floor(F.col("us") / 60_000_000).cast("bigint").alias("frame_idx"),
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("prob"),
        "ts",
    )
    closing = spark.sql(f"SELECT {NO_KEY} AS media_id, 0L AS frame_idx, 0D AS prob, {FAR_FUTURE} AS ts")
    return drain_whole(frames, lambda f: stream_regions(f, POLICY, "1 hour", 6 * 3_600_000), closing)


@query(
    "pluggable_scorer",
    "UD-01",
    f"""WITH {G.SAMPLES}, f AS (SELECT media_id, i // 8 AS frame_idx, 20 * log10(sqrt(avg(m * m) + 1e-12)) AS lv FROM v_s GROUP BY 1, 2)
 SELECT media_id, frame_idx, round(1 / (1 + exp(-(lv + 18) / 2)), 5) AS prob FROM f""",
)
def pluggable_scorer(spark, sf):
    scorer = scorers.energy_scorer(frame=8, centre_db=-18.0, slope_db=2.0)
    frames = scorers.score_frames(G.samples(spark, sf), scorer, 8)
    return frames.withColumn("prob", F.round("prob", 5))


SCORED = PADDED.removeprefix(V.SCORES).replace("512", "8").replace("4800", "24").replace("1600", "8").replace("1920", "4")


@query(
    "scored_regions",
    "UD-01 RG-01 RG-03",
    f"""WITH {G.SAMPLES}, f AS (SELECT media_id, i // 8 AS frame_idx, 20 * log10(sqrt(avg(m * m) + 1e-12)) AS lv FROM v_s GROUP BY 1, 2),
 v_scores AS (SELECT media_id, frame_idx, 1 / (1 + exp(-(lv + 18) / 2)) AS prob FROM f){SCORED} SELECT media_id, CAST(s AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end" FROM v_pad""",
)
def scored_regions(spark, sf):
    samples = G.samples(spark, sf)
    frames = scorers.score_frames(samples, scorers.energy_scorer(8, -18.0, 2.0), 8)
    policy = R.RegionPolicy(frame=8, min_speech=8, min_silence=24, pad=4, sample_rate=G.RATE)
    dense = V.tightened(signal_layout(samples), 8)
    return R.speech_regions(frames, policy, dense, M.signal_sizes(samples)).select("media_id", "start", "end")


@query(
    "frame_grid",
    "UD-06",
    """WITH d AS (SELECT conv_id AS media_id, CAST(max(turn) + 1 AS DOUBLE) AS dur FROM conversations GROUP BY 1)
 SELECT media_id, f AS frame_idx, least(dur, (f + 0.5) * 0.75) AS centre FROM d, LATERAL (SELECT unnest(range(CAST(ceil(dur / 0.75) AS BIGINT))) AS f)""",
)
def frame_grid_rows(spark, sf):
    lengths = V.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("media_id")).agg(
        (F.max("turn") + 1).cast("double").alias("duration")
    )
    return grid_frames(lengths, 0.75).select("media_id", "frame_idx", "centre")


@query(
    "frame_grid_udtf",
    "UD-06",
    """WITH d AS (SELECT conv_id AS media_id, CAST(max(turn) + 1 AS DOUBLE) AS dur FROM conversations GROUP BY 1)
 SELECT media_id, f AS frame_idx, least(dur, (f + 0.5) * 0.75) AS centre FROM d, LATERAL (SELECT unnest(range(CAST(ceil(dur / 0.75) AS BIGINT))) AS f)""",
)
def frame_grid_udtf(spark, sf):
    lengths = V.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("media_id")).agg(
        (F.max("turn") + 1).cast("double").alias("duration")
    )
    return frame_grid(spark, lengths, 0.75)
