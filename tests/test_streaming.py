import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from sonoframe.operators import regions as R
from sonoframe.operators.scan import SINGLE
from sonoframe.streaming.regions import stream_regions, use_rocksdb
from sonoframe.plans import ENTRIES
from sonoframe.plans import views as V
from sonoframe.plans.queries_regions import POLICY
from sonoframe.streaming.replay import drain, drain_whole
from sonoframe.streaming.windows import session_turns, window_peaks


def test_streamed_regions_equal_batch(spark, tmp_path):
    """Frames replayed file by file; a closing marker far ahead moves the watermark past every idle timer."""
    use_rocksdb(spark)
    rng, start = random.Random(8), datetime(2024, 1, 1, tzinfo=timezone.utc)
    policy = R.RegionPolicy(min_silence=512 * 4, min_speech=512 * 2, pad=0)
    schema = "media_id long, frame_idx long, prob double, ts timestamp"
    rows = []
    for media in range(6):
        level = 0.1
        for i in range(90):
            if rng.random() < 0.25:
                level = rng.choice([0.1, 0.4, 0.9])
            rows.append((media, i, level, start + timedelta(seconds=i)))
    rows.append((99, 0, 0.0, start + timedelta(hours=5)))
    folder = str(tmp_path / "frames")
    for part in range(3):
        piece = [r for r in rows if r[0] != 99 and r[1] // 30 == part]
        spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([rows[-1]], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = drain(stream_regions(stream, policy, "1 minute", 60_000))
    got = sorted((r.media_id, r.start, r.end) for r in out.collect())
    frames = spark.createDataFrame([r[:3] for r in rows[:-1]], "media_id long, frame_idx long, prob double")
    batch = R.hysteresis_regions(frames, R.signal_lengths(frames, 512), policy, SINGLE)
    assert got == sorted((r.media_id, r.start, r.end) for r in batch.collect()) and got


START, HOUR = datetime(2024, 1, 1, tzinfo=timezone.utc), 3_600_000_000


def in_files(spark, folder, rows, schema):
    for part in range(3):
        spark.createDataFrame(rows[part::3], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


def test_regions_open_at_the_end_are_closed(spark, tmp_path):
    use_rocksdb(spark)
    policy = R.RegionPolicy(min_silence=512 * 4, min_speech=512 * 2, pad=0)
    schema = "media_id long, frame_idx long, prob double, ts timestamp"
    rows = [(m, i, 0.9 if i >= 10 * m else 0.1, START + timedelta(seconds=i)) for i in range(90) for m in range(3)]
    stream = in_files(spark, str(tmp_path / "frames"), rows, schema)
    closing = spark.createDataFrame([(-1, 0, 0.0, datetime(2261, 1, 1, tzinfo=timezone.utc))], schema)
    out = drain_whole(stream, lambda f: stream_regions(f, policy, "1 minute", 60_000), closing)
    assert sorted(tuple(r) for r in out.collect()) == [(m, 10 * m * 512, 90 * 512) for m in range(3)]


def test_windows_and_sessions_open_at_the_end_are_closed(spark, tmp_path):
    schema = "media_id long, speaker string, ts timestamp, length_us long"
    rows = [(k % 2, "ab"[k % 3 > 0], START + timedelta(minutes=17 * k), 60_000_000) for k in range(200)]
    closing = spark.createDataFrame([(-1, "", datetime(2261, 1, 1, tzinfo=timezone.utc), 0)], schema)
    stream = in_files(spark, str(tmp_path / "rows"), rows, schema)
    peaks = drain_whole(stream, lambda f: window_peaks(f, F.col("length_us"), "speaker", "24 hours", "1 hour", slide="6 hours"), closing)
    assert peaks.agg(F.sum("samples")).first()[0] == 4 * len(rows)
    turns = drain_whole(stream, lambda f: session_turns(f, HOUR, "1 hour"), closing)
    assert turns.agg(F.sum("segments")).first()[0] == len(rows)


def test_registered_regions_reach_the_end(spark):
    sf = "/root/testdata/sf0.001"
    last = F.max(F.struct("ts", F.floor(F.expr(f"timestampdiff(MICROSECOND, {V.EPOCH}, cast(ts as timestamp_ntz))") / 60_000_000).alias("frame"), "value"))
    ends = V.table(spark, sf, "events").groupBy("user_id").agg(last.alias("last")).where("last.value >= 100").select("user_id", "last.frame")
    found = ENTRIES["stream_regions"].run(spark, sf)
    wanted = {(r[0], r[1]) for r in ends.collect()}
    assert wanted <= {(r["media_id"], r["end"] // POLICY.frame - 1) for r in found.collect()} and wanted
