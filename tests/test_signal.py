import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoframe.functions import levels as L
from sonoframe.operators import enhance, filters, levels, loudness, rules, spectrum
from sonoframe.operators.scan import SINGLE, Layout
from sonoframe.sources.profiles import profile, profile_table

SCHEMA = "media_id long, chunk_id long, start_sample long, ch0 array<float>, ch1 array<float>"


def table(spark, signals, chunk):
    rows = []
    for media, (left, right) in enumerate(signals):
        for start in range(0, len(left), chunk):
            part = [None if c is None else [float(x) for x in c[start : start + chunk]] for c in (left, right)]
            rows.append((media, start // chunk, start, *part))
    return spark.createDataFrame(rows, SCHEMA)


def joined(df, media=0, channel="ch0"):
    rows = df.where(F.col("media_id") == media).orderBy("chunk_id").collect()
    return np.concatenate([np.asarray(r[channel]) for r in rows])


def direct(x, sections):
    x = np.asarray(x, dtype=np.float64)
    for b, a in sections:
        y, s1, s2 = [], 0.0, 0.0
        for v in x:
            out = b[0] * v + s1
            s1, s2 = b[1] * v - a[0] * out + s2, b[2] * v - a[1] * out
            y.append(out)
        x = np.array(y)
    return x


def test_filters_match_the_direct_recurrence_across_chunks(spark):
    rng = np.random.default_rng(0)
    signals = [(rng.normal(0, 0.1, 1000), rng.normal(0, 0.1, 1000)), (rng.normal(0, 0.1, 333), None)]
    sections = [filters.highpass(70, 8000), filters.notch(60, 8000), filters.peaking(3, 1000, 0.9, 8000)]
    out = filters.filter_signal(table(spark, signals, 150), sections)
    assert np.allclose(joined(out), direct(np.float32(signals[0][0]), sections), atol=1e-6)
    assert np.allclose(joined(out, channel="ch1"), direct(np.float32(signals[0][1]), sections), atol=1e-6)
    assert np.allclose(joined(out, media=1), direct(np.float32(signals[1][0]), sections), atol=1e-6)
    # The same through a prefix of several levels: no task sees more than two chunks of a recording.
    small = filters.filter_signal(table(spark, signals, 40), sections, fan=2)
    assert np.allclose(joined(small), direct(np.float32(signals[0][0]), sections), atol=1e-6)
    assert np.allclose(joined(small, media=1), direct(np.float32(signals[1][0]), sections), atol=1e-6)


def weights(spark, intervals, length, fade, outside=False):
    df = spark.range(length).select(F.col("id").alias("i"))
    expressions = [
        L.fade_outside(F.col("i"), F.lit(s), F.lit(e), fade, F.lit(length)) if outside
        else L.fade_inside(F.col("i"), F.lit(s), F.lit(e), fade)
        for s, e in intervals
    ]
    out = df.select("i", (F.greatest(*expressions) if len(expressions) > 1 else expressions[0]).alias("m"))
    return [r.m for r in out.orderBy("i").collect()]


def test_fade_masks(spark):
    m = weights(spark, [(100, 800)], 1000, 40)
    assert m[100] == 0 and 0 < m[120] < 1 and m[300] == m[470] == 1 and m[799] == 0
    m = weights(spark, [(200, 600)], 1000, 40, outside=True)
    assert m[159] == 0 and 0 < m[180] < 1 and set(m[200:600]) == {1.0} and 0 < m[620] < 1 and m[640] == 0
    assert max(abs(a - b) for a, b in zip(m, m[1:])) <= 4 / 40
    assert weights(spark, [(5, 6)], 10, 4) == [0.0] * 10


def test_gains_compose_inside_fades(spark):
    df = table(spark, [(np.ones(100), None), (np.ones(100), None)], 30)
    gains = spark.createDataFrame([(0, 20, 80, -6.0), (0, 50, 70, 6.0)], "media_id long, start long, end long, gain_db double")
    out = levels.apply_gains(df, gains, 4, 30)
    got, g = joined(out), 10 ** (-6 / 20)
    assert got[10] == 1 and got[40] == pytest.approx(g) and got[60] == pytest.approx(1, abs=1e-6)
    assert 1 > got[22] > g and np.all(joined(out, media=1) == 1)


def test_compressor_matches_interpolation(spark):
    rng = np.random.default_rng(2)
    rate, x = 1000, rng.normal(0, 0.3, 530)
    out = levels.compress(table(spark, [(x, None)], 110), rate, -24.0, 2.5, 110)
    frame, x32 = 20, np.float32(x).astype(float)
    count = -(-len(x) // frame)
    padded = np.pad(x32, (0, count * frame - len(x))).reshape(count, frame)
    level = 20 * np.log10(np.sqrt((padded**2).mean(axis=1) + 1e-12))
    over = np.maximum(level + 24, 0)
    centres = np.minimum(np.arange(count) * frame + frame // 2, len(x) - 1)
    db = np.interp(np.arange(len(x)), centres, -(over - over / 2.5))
    assert np.allclose(joined(out), x32 * 10 ** (db / 20), atol=1e-6)


def test_spectrum_matches_direct_average(spark):
    rng = np.random.default_rng(3)
    rate, x = 1000, rng.normal(0, 0.2, 1500) + 0.3 * np.sin(2 * np.pi * 60 * np.arange(1500) / 1000)
    speech = spark.createDataFrame([(0, 100, 700), (0, 650, 900), (0, 1000, 1401)], "media_id long, start long, end long")
    df = table(spark, [(x, None)], 128)
    picked = np.concatenate([np.float32(x)[100:900], np.float32(x)[1000:1401]]).astype(float)
    for span in (None, 300):
        pieces = spectrum.selected_pieces(df, speech, 128, Layout(span))
        rows = spectrum.averaged_spectrum(pieces, rate, 256, 100).orderBy("frequency").collect()
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256)
        windows = [picked[s : s + 256] for s in range(0, len(picked) - 255, 128)]
        power = np.mean([np.abs(np.fft.rfft((w - w.mean()) * hann)) ** 2 for w in windows], axis=0) / (rate * (hann**2).sum())
        power[1:-1] *= 2
        assert np.allclose([r.power for r in rows], power, rtol=1e-6)
    metrics = spectrum.speech_spectrum(df, speech, rate, 128, SINGLE, 256, 100).first()
    assert metrics.hum_excess_db > 9 and metrics.dc_offset == pytest.approx(picked.mean(), abs=1e-9)
    short = spectrum.speech_spectrum(df, speech, rate, 128, SINGLE, 256, 5000).first()
    assert (short.subbass_ratio, short.hum_excess_db) == (0.0, 0.0)


def test_loudness_of_a_reference_tone(spark):
    rate = 8000
    tone = np.sin(2 * np.pi * 997 * np.arange(5 * rate) / rate) * 10 ** (-20 / 20)
    out = loudness.program_loudness(table(spark, [(tone, tone), (tone[:2000], None), (np.zeros(8000), None)], rate), rate, SINGLE)
    rows = {r.media_id: r for r in out.collect()}
    # A full-scale 997 Hz sine in one channel reads -3.01; two channels add 3.01 dB.
    assert rows[0].integrated_lufs == pytest.approx(-20.0, abs=0.15)
    assert rows[0].loudness_range == pytest.approx(0, abs=0.1) and rows[0].true_peak == pytest.approx(-20, abs=0.1)
    assert rows[1].integrated_lufs is None and rows[1].true_peak is not None
    assert rows[2].integrated_lufs is None and rows[2].true_peak is None


def burst_signal(rate=1000):
    rng = np.random.default_rng(5)
    t = np.arange(5 * rate) / rate
    x = rng.normal(0, 1e-4, len(t))
    x[(t >= 0.5) & (t < 1.5)] += 0.12 * np.sin(2 * np.pi * 200 * t[(t >= 0.5) & (t < 1.5)])
    voice = (t >= 2.0) & (t < 4.4)
    x[voice] += 0.008 * np.sin(2 * np.pi * 150 * t[voice])
    return x


def test_machine_region_is_found_balanced_and_compensated(spark):
    rate = 1000
    df = table(spark, [(burst_signal(), None)], 1000)
    speech = spark.createDataFrame([(0, "speech_001", 2000, 4400)], "media_id long, region_id string, start long, end long")
    found = levels.machine_regions(df, speech, rate, 1000, SINGLE)
    row = found.first()
    assert found.count() == 1 and row.region_id == "machine_audio_001" and not row.overlaps_speech
    assert row.difference_db > 20 and row.start == 460 and row.end == 1540
    out, totals = enhance.compensate(df, speech, found, "product-demo", rate, 1000, SINGLE)
    after = levels.regional_measurements(out, speech, found, 1000, SINGLE).first()
    assert -4.5 <= after.difference_db <= -1.5 and totals.first().gain_db < -15


def test_overlapping_machine_region_is_never_touched(spark):
    df = table(spark, [(burst_signal(), None)], 1000)
    speech = spark.createDataFrame([(0, "speech_001", 1520, 4400)], "media_id long, region_id string, start long, end long")
    found = levels.machine_regions(df, speech, 1000, 1000, SINGLE)
    assert found.first().overlaps_speech
    out, totals = enhance.compensate(df, speech, found, "product-demo", 1000, 1000, SINGLE)
    assert totals.first().gain_db == 0 and np.array_equal(joined(out), joined(df))


def test_treatment_grows_to_the_whole_sound(spark):
    rate, t = 1000, np.arange(3000) / 1000
    x = np.random.default_rng(1).normal(0, 1e-4, 3000)
    x[(t >= 0.60) & (t < 0.76) | (t >= 0.90) & (t < 1.2)] += 0.1
    df = table(spark, [(x, None)], 500)
    speech = spark.createDataFrame([(0, "speech_001", 1000, 1200)], "media_id long, region_id string, start long, end long")
    measures = spark.createDataFrame([(0, -80.0, -20.0)], "media_id long, noise_floor_dbfs double, speech_rms_dbfs double")
    for span in (None, 700):
        r = levels.treatment_intervals(
            df, speech, speech.where("false"), measures, profile("product-demo"), rate, Layout(span)
        ).first()
        assert r.treatment_start <= 0.52 and (r.region_start - r.treatment_start) * 1000 >= 480
        machine = spark.createDataFrame([(0, 100, 560)], "media_id long, start long, end long")
        r = levels.treatment_intervals(df, speech, machine, measures, profile("product-demo"), rate, Layout(span)).first()
        assert r.treatment_start == pytest.approx(0.6) and r.treatment_end == pytest.approx(1.28)


def test_channel_balance_decision(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.1, 400)
    stereo = table(spark, [(2 * x, x), (x, rng.normal(0, 0.3, 400)), (x, None), (x, x)], 100)
    measures = levels.whole_measures(stereo).withColumn("profile", F.struct(*[F.lit(v).alias(k) for k, v in profile("transcription").items()]))
    out = {r.media_id: r for r in rules.channel_balance(measures).collect()}
    assert [out[i].status for i in range(4)] == ["applied", "abstained", "no_op", "no_op"]
    balanced = enhance.scale(stereo, rules.channel_balance(measures).select("media_id", "left_gain_db", "right_gain_db"))
    assert abs({r.media_id: r for r in levels.whole_measures(balanced).collect()}[0].channel_difference_db) < 0.05


def test_empty_and_floor_levels(spark):
    one = spark.range(1).select(
        L.rms_db(F.lit(None).cast("double"), F.lit(0)).alias("a"), L.pcm_db(F.lit(0), F.lit(8)).alias("b"),
        L.amplitude_to_db(F.lit(0.0)).alias("c"), L.finite_or_null(F.lit(float("nan"))).alias("d"),
        L.finite_or_null(F.lit(2.0005), 3).alias("e"),
    ).first()
    assert (one.a, one.b, one.c, one.d) == (-240.0, -120.0, pytest.approx(-240.0), None)
    assert profile_table(spark).count() == 2
    with pytest.raises(ValueError, match="product-demo, transcription"):
        profile("loud")


@pytest.mark.parametrize("length", [1332160, 48000, 48001, 12345, 99999, 1, 512])
def test_timeline_bound_stays_in_the_source(spark, length):
    bound = spark.range(1).select(L.timeline_bound(F.lit(1e9), F.lit(length), F.lit(48_000)).alias("b")).first().b
    assert bound <= length / 48_000 and length / 48_000 - bound < 1 / 16_000 + 1e-12
    assert math.isclose(bound * 16_000, round(bound * 16_000))
