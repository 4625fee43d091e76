"""Level, region and correction queries over the derived signal table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonoframe.functions import levels as L
from sonoframe.operators import levels as M
from sonoframe.operators import rules
from sonoframe.operators.scan import SINGLE, measure_layout
from sonoframe.plans import signals as G
from sonoframe.plans import views as V
from sonoframe.plans.registry import query
from sonoframe.sources.profiles import PROFILES, profile, profile_table, with_profiles

FRAME = 8


def signal_layout(samples):
    """Chunk rows per recording times samples per chunk bounds every derived row count."""
    return measure_layout(samples, ["media_id"], F.col("start_sample"), 64 * G.CHUNK, G.CHUNK)


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def db(sq, n):
    return f"20 * log10(greatest(sqrt({sq} / {n} + 1e-12), 1e-12))"


@query(
    "frame_levels",
    "AG-03 SC-01",
    f"""WITH {G.SAMPLES} SELECT media_id, i // 8 AS frame_idx, round(20 * log10(sqrt(sum(m * m) / 8 + 1e-12)), 6) AS level_dbfs FROM v_s GROUP BY 1, 2""",
)
def frame_levels(spark, sf):
    return r6(M.frame_levels(G.samples(spark, sf), FRAME), "level_dbfs")


PCM = f"""{G.SAMPLES}, v_p AS (SELECT media_id, i // 8 AS frame_idx, sum(round(l * 32768) ** 2) AS a, sum(round(r * 32768) ** 2) AS b FROM v_s GROUP BY 1, 2),
 v_f AS (SELECT media_id, frame_idx, CASE WHEN a <= 0 THEN -120.0::DOUBLE ELSE greatest(-120, 20 * log10(sqrt(a / 8) / 32768)) END AS left_dbfs,
  CASE WHEN b <= 0 THEN -120.0::DOUBLE ELSE greatest(-120, 20 * log10(sqrt(b / 8) / 32768)) END AS right_dbfs FROM v_p)"""


@query(
    "pcm_channel_levels",
    "AG-04",
    f"WITH {PCM} SELECT media_id, frame_idx, round(left_dbfs, 6) AS left_dbfs, round(right_dbfs, 6) AS right_dbfs, round(left_dbfs - right_dbfs, 6) AS left_minus_right_db FROM v_f",
)
def pcm_channel_levels(spark, sf):
    out = M.pcm_channel_levels(G.samples(spark, sf), FRAME)
    return r6(out, "left_dbfs", "right_dbfs", "left_minus_right_db")


@query(
    "whole_measures",
    "AG-01 AG-02 AG-05 AG-06 AG-07",
    f"""WITH {G.SAMPLES} SELECT media_id, count(*) AS total_samples, 2 AS channels, round({db("sum(l * l + r * r)", "(2 * count(*))")}, 6) AS rms_dbfs,
 round(20 * log10(greatest(max(greatest(abs(l), abs(r))), 1e-12)), 6) AS peak_dbfs, round({db("sum(l * l)", "count(*)")}, 6) AS left_rms_dbfs,
 round({db("sum(r * r)", "count(*)")}, 6) AS right_rms_dbfs, round({db("sum(l * l)", "count(*)")} - {db("sum(r * r)", "count(*)")}, 6) AS channel_difference_db,
 round(corr(l, r), 6) AS channel_correlation, round(sum(l * r) / sqrt(sum(l * l) * sum(r * r)), 6) AS uncentered_correlation, round(avg(m), 6) AS dc_offset
 FROM v_s GROUP BY 1""",
)
def whole_measures(spark, sf):
    out = M.whole_measures(G.samples(spark, sf))
    names = [c for c in out.columns if c not in ("media_id", "total_samples", "channels")]
    return r6(out, *names)


FLOOR = f"{G.SAMPLES}, v_fl AS (SELECT media_id, i // 8 AS f, 20 * log10(sqrt(sum(m * m) / 8 + 1e-12)) AS lv FROM v_s GROUP BY 1, 2), v_nf AS (SELECT media_id, quantile_cont(lv, 0.2) AS nf FROM v_fl GROUP BY 1)"


@query("noise_floor", "AG-07 ST-01", f"WITH {FLOOR} SELECT media_id, round(nf, 6) AS noise_floor_dbfs FROM v_nf")
def noise_floor(spark, sf):
    frames = M.frame_levels(G.samples(spark, sf), FRAME)
    return r6(M.noise_floor(frames, SINGLE), "noise_floor_dbfs")


SPEECH_LEVEL = f"{G.SPEECH}, v_sl AS (SELECT s.media_id, {db('sum(l * l + r * r)', '(2 * count(*))')} AS sl FROM v_s s JOIN v_sp ON v_sp.media_id = s.media_id AND i >= v_sp.s AND i < v_sp.e GROUP BY 1)"


@query("speech_level", "AG-08", f"WITH {G.SAMPLES}, {SPEECH_LEVEL} SELECT media_id, round(sl, 6) AS speech_rms_dbfs FROM v_sl")
def speech_level(spark, sf):
    samples = G.samples(spark, sf)
    out = M.speech_levels(samples, G.speech(spark, sf), G.CHUNK, signal_layout(samples))
    return r6(out, "speech_rms_dbfs")


MACHINE = f"""{FLOOR}, {SPEECH_LEVEL},
 v_th AS (SELECT v_nf.media_id, nf, sl, greatest(nf + 15, sl + 3, -55) - 20 AS th FROM v_nf JOIN v_sl ON v_sl.media_id = v_nf.media_id),
 v_c AS (SELECT v_fl.media_id, f FROM v_fl JOIN v_th ON v_th.media_id = v_fl.media_id AND lv >= th + 20
   WHERE NOT EXISTS (SELECT 1 FROM v_sp WHERE v_sp.media_id = v_fl.media_id AND f * 8 + 4 >= s AND f * 8 + 4 < e)),
 v_g AS (SELECT *, CASE WHEN f - lag(f) OVER (PARTITION BY media_id ORDER BY f) <= 3 THEN 0 ELSE 1 END AS n FROM v_c),
 v_i AS (SELECT *, sum(n) OVER (PARTITION BY media_id ORDER BY f) AS g FROM v_g),
 v_b AS (SELECT media_id, greatest(0, min(f) * 8 - 3) AS s, least(256, (max(f) + 1) * 8 + 3) AS e FROM v_i GROUP BY media_id, g),
 v_bl AS (SELECT b.media_id, b.s, b.e, {db("sum(l * l + r * r)", "(2 * count(*))")} AS lv FROM v_b b JOIN v_s x ON x.media_id = b.media_id AND x.i >= b.s AND x.i < b.e
   WHERE b.e - b.s >= 10 GROUP BY 1, 2, 3),
 v_m AS (SELECT k.media_id, 'machine_audio_' || lpad(CAST(row_number() OVER (PARTITION BY k.media_id ORDER BY s) AS VARCHAR), 3, '0') AS region_id, s, e, lv,
   lv - sl AS difference_db, EXISTS (SELECT 1 FROM v_sp q WHERE q.media_id = k.media_id AND k.s < q.e AND k.e > q.s) AS overlaps_speech
   FROM v_bl k JOIN v_th t ON t.media_id = k.media_id AND lv >= nf + 8)"""


def loud_signal(spark, sf):
    """The signal with one loud burst per recording outside its speech, so programme regions exist."""
    lift = F.when((F.col("chunk_id") == 1) & (F.col("media_id") % 3 == 0), 12.0).otherwise(1.0)
    base = G.samples(spark, sf)

    def louder(name):
        return F.transform(name, lambda x: (x * lift).cast("float"))

    return base.withColumns({"ch0": louder("ch0"), "ch1": louder("ch1")})


LOUD = """v_vec AS (SELECT vec_id // 8 AS media_id, (vec_id % 8) // 2 AS chunk_id, vec_id % 2 AS ch,
   list_transform(embedding, lambda x: CAST(x * CASE WHEN (vec_id % 8) // 2 = 1 AND (vec_id // 8) % 3 = 0 THEN 12.0::DOUBLE ELSE 1.0::DOUBLE END AS FLOAT)) AS embedding FROM embeddings)"""
LOUD_MACHINE = MACHINE.replace(
    "v_vec AS (SELECT vec_id // 8 AS media_id, (vec_id % 8) // 2 AS chunk_id, vec_id % 2 AS ch, embedding FROM embeddings)", LOUD
)


def loud_regions(spark, sf):
    samples = loud_signal(spark, sf)
    layout = signal_layout(samples)
    return samples, layout, M.machine_regions(samples, G.speech(spark, sf), G.RATE, G.CHUNK, layout)


@query(
    "machine_regions",
    "RG-06 AG-09",
    f"""WITH {LOUD_MACHINE} SELECT media_id, region_id, CAST(s AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end", round(lv, 5) AS level_dbfs,
 round(difference_db, 5) AS difference_db, overlaps_speech FROM v_m""",
)
def machine_regions(spark, sf):
    *_, regions = loud_regions(spark, sf)
    return regions.withColumns({n: F.round(n, 5) for n in ("level_dbfs", "difference_db")})


@query(
    "source_balance",
    "RU-07 SC-13",
    f"""WITH {LOUD_MACHINE} SELECT media_id, region_id, CASE WHEN overlaps_speech THEN 'abstained' WHEN difference_db BETWEEN -4 AND -2 THEN 'inside_target' ELSE 'gain' END AS decision,
 CASE WHEN NOT overlaps_speech AND NOT difference_db BETWEEN -4 AND -2 THEN round(greatest(-30, least(12, -3 - difference_db)), 4) END AS resolved_gain_db FROM v_m""",
)
def source_balance(spark, sf):
    *_, regions = loud_regions(spark, sf)
    planned = rules.source_balance(with_profiles(regions)).where("profile.name = 'product-demo'")
    return planned.select("media_id", "region_id", "decision", F.round("resolved_gain_db", 4).alias("resolved_gain_db"))


@query(
    "regional_measurements",
    "AG-09",
    f"""WITH {LOUD_MACHINE}, pk AS (SELECT media_id, max(greatest(abs(l), abs(r))) AS p FROM v_s GROUP BY 1)
 SELECT v_m.media_id, region_id, round(lv, 5) AS measured_dbfs, round(difference_db, 5) AS difference_db, round(sl, 5) AS speech_rms_dbfs,
 round(20 * log10(p), 5) AS sample_peak_dbfs FROM v_m JOIN pk ON pk.media_id = v_m.media_id JOIN v_sl ON v_sl.media_id = v_m.media_id""",
)
def regional_measurements(spark, sf):
    samples, layout, regions = loud_regions(spark, sf)
    out = M.regional_measurements(samples, G.speech(spark, sf), regions, G.CHUNK, layout)
    names = ("measured_dbfs", "difference_db", "speech_rms_dbfs", "sample_peak_dbfs")
    return out.withColumns({n: F.round(n, 5) for n in names})


@query(
    "treatment_intervals",
    "RG-07 JN-04 JN-07",
    f"""WITH {LOUD_MACHINE}, tz AS (SELECT media_id, max(i) + 1 AS n FROM v_s GROUP BY 1),
 f2 AS (SELECT media_id, i // 2 AS f, 20 * log10(sqrt(sum(m * m) / 2 + 1e-12)) AS lv FROM v_s GROUP BY 1, 2),
 ac AS (SELECT media_id, f FROM f2 JOIN v_th USING (media_id) WHERE f2.lv >= greatest(nf + 6, sl - 12)),
 cg AS (SELECT *, CASE WHEN f - lag(f) OVER (PARTITION BY media_id ORDER BY f) - 1 <= 20 THEN 0 ELSE 1 END AS n FROM ac),
 ci AS (SELECT media_id, f, sum(n) OVER (PARTITION BY media_id ORDER BY f) AS g FROM cg),
 cl AS (SELECT media_id, min(f) * 2 AS s, least(any_value(n), (max(f) + 1) * 2) AS e FROM ci JOIN tz USING (media_id) GROUP BY media_id, g),
 rg AS (SELECT media_id, region_id, s, e, n, (SELECT min(cl.s) FROM cl WHERE cl.media_id = r.media_id AND cl.s < r.e AND cl.e > r.s) AS fs,
   (SELECT max(cl.e) FROM cl WHERE cl.media_id = r.media_id AND cl.s < r.e AND cl.e > r.s) AS le, (SELECT max(v_m.e) FROM v_m WHERE v_m.media_id = r.media_id AND v_m.e <= r.s) AS pe,
   (SELECT min(v_m.s) FROM v_m WHERE v_m.media_id = r.media_id AND v_m.s >= r.e) AS ns FROM v_sp r JOIN tz USING (media_id)),
 gr AS (SELECT *, CASE WHEN fs IS NULL THEN s / 80 ELSE greatest(s / 80 - 2, fs / 80) END AS a, CASE WHEN fs IS NULL THEN e / 80 ELSE least(e / 80 + 2, le / 80) END AS b FROM rg),
 gd AS (SELECT *, CASE WHEN fs IS NULL THEN s / 80 ELSE least(s / 80, a - 0.08) END AS ts, CASE WHEN fs IS NULL THEN e / 80 ELSE greatest(e / 80, b + 0.08) END AS te FROM gr)
 SELECT media_id, region_id, round(s / 80, 6) AS region_start, round(e / 80, 6) AS region_end, round(a, 6) AS acoustic_start, round(b, 6) AS acoustic_end,
  round(greatest(0, least(greatest(ts, pe / 80 + 0.04), s / 80)), 6) AS treatment_start, round(least(n / 80, greatest(least(te, ns / 80 - 0.04), e / 80)), 6) AS treatment_end FROM gd""",
)
def treatment_intervals(spark, sf):
    samples, layout, regions = loud_regions(spark, sf)
    speech = G.speech(spark, sf)
    measures = M.noise_floor(M.frame_levels(samples, FRAME), layout).join(
        M.speech_levels(samples, speech, G.CHUNK, layout), "media_id"
    )
    found = M.treatment_intervals(
        samples, speech, regions.select("media_id", "start", "end"), measures, profile("product-demo"), G.RATE, layout
    )
    return r6(found, *(c for c in found.columns if c not in ("media_id", "region_id")))


@query(
    "channel_dominance",
    "RG-09 RG-10",
    f"""WITH {PCM}, d AS (SELECT unnest([0.0::DOUBLE, 3.0, 6.0]) AS dominance_db),
 lb AS (SELECT media_id, frame_idx, dominance_db, unnest(CASE WHEN greatest(left_dbfs, right_dbfs) < -20 THEN []::VARCHAR[] WHEN left_dbfs - right_dbfs > dominance_db THEN ['channel_left']
   WHEN left_dbfs - right_dbfs < -dominance_db THEN ['channel_right'] ELSE ['channel_left', 'channel_right'] END) AS label FROM v_f, d),
 g AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY media_id, dominance_db, label ORDER BY frame_idx) AS k FROM lb)
 SELECT media_id, dominance_db, label, min(frame_idx) AS first_frame, max(frame_idx) + 1 AS stop_frame FROM g GROUP BY media_id, dominance_db, label, k""",
)
def channel_dominance(spark, sf):
    labelled = M.channel_labels(M.pcm_channel_levels(G.samples(spark, sf), FRAME), -20.0, [0.0, 3.0, 6.0])
    long = labelled.select("media_id", "dominance_db", "frame_idx", F.explode("labels").alias("label"))
    # Each ladder step is its own labelling: fold it into the label, then take it apart again.
    tagged = long.withColumn("label", F.concat_ws("|", "label", "dominance_db"))
    parts = F.split("label", r"\|")
    return M.label_segments(tagged, SINGLE).select(
        "media_id",
        parts[1].cast("double").alias("dominance_db"),
        parts[0].alias("label"),
        "first_frame",
        "stop_frame",
    )


@query(
    "exclusive_dominance",
    "AG-11 ST-03 ST-06",
    f"""WITH {PCM}, x AS (SELECT media_id, CASE WHEN frame_idx % 3 = 0 THEN 'a' ELSE 'b' END AS speaker, left_dbfs - right_dbfs AS v FROM v_f WHERE frame_idx % 5 <> 0),
 o AS (SELECT *, row_number() OVER (PARTITION BY media_id, speaker ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY media_id, speaker) AS n FROM x)
 SELECT media_id, speaker, n AS exclusive_frames, round(median(v), 5) AS median_db, round(max(v) FILTER (WHERE k = CAST(round_even((n - 1) * 0.1::DOUBLE, 0) AS BIGINT)), 5) AS p10_db,
  round(max(v) FILTER (WHERE k = CAST(round_even((n - 1) * 0.9::DOUBLE, 0) AS BIGINT)), 5) AS p90_db, round(avg(CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS left_louder_fraction,
  round(avg(CASE WHEN v < 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS right_louder_fraction,
  CASE WHEN median(v) > 0 THEN 'channel_left' WHEN median(v) < 0 THEN 'channel_right' END AS dominant_channel FROM o GROUP BY 1, 2, 3""",
)
def exclusive_dominance(spark, sf):
    frames = M.pcm_channel_levels(G.samples(spark, sf), FRAME).where("frame_idx % 5 <> 0").select(
        "media_id",
        F.when(F.col("frame_idx") % 3 == 0, "a").otherwise("b").alias("speaker"),
        F.col("left_minus_right_db").alias("value"),
    )
    out = M.exclusive_dominance(frames, SINGLE)
    names = ("median_db", "p10_db", "p90_db")
    out = out.withColumns({n: F.round(n, 5) for n in names})
    return r6(out, "left_louder_fraction", "right_louder_fraction")


@query(
    "channel_balance",
    "RU-03 JN-12",
    f"""WITH {G.SAMPLES}, w AS (SELECT media_id, {db("sum(l * l)", "count(*)")} - {db("sum(r * r)", "count(*)")} AS d, corr(l, r) AS c FROM v_s GROUP BY 1),
 p AS (SELECT unnest(['transcription', 'product-demo']) AS profile_name)
 SELECT media_id, profile_name, CASE WHEN abs(d) <= 0.15 THEN 'no_op' WHEN c < -0.1 THEN 'abstained' ELSE 'applied' END AS status,
  CASE WHEN abs(d) > 0.15 AND c >= -0.1 THEN round(-greatest(-0.6, least(0.6, d / 2)), 6) END AS left_gain_db FROM w, p""",
)
def channel_balance(spark, sf):
    tuned = M.whole_measures(G.samples(spark, sf))
    scaled = with_profiles(tuned)
    narrow = F.col("profile").withField("channel_no_op_db", F.col("profile.channel_no_op_db") / 10)
    narrow = narrow.withField("channel_max_correction_db", F.col("profile.channel_max_correction_db") / 10)
    narrow = narrow.withField("channel_correlation_minimum", F.lit(-0.1))
    out = rules.channel_balance(scaled.withColumn("profile", narrow))
    return out.select(
        "media_id", F.col("profile.name").alias("profile_name"), "status", F.round("left_gain_db", 6).alias("left_gain_db")
    )


def measured_media(spark, sf):
    """Per-order figures standing in for whole-recording measurements."""
    orders = V.table(spark, sf, "orders")
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return with_profiles(
        orders.select(
            key.alias("media_id"),
            (price / 1e7).alias("subbass_ratio"),
            (key % 13).cast("double").alias("hum_excess_db"),
            F.when(key % 7 == 0, 0.001).otherwise(0.0).alias("dc_offset"),
            (-20.0 - key % 31).alias("speech_rms_dbfs"),
            (-40.0 - key % 17).alias("noise_floor_dbfs"),
            (key % 5).alias("speech_regions"),
            (key % 9 - 6).cast("double").alias("difference_db"),
            (key % 4 == 0).alias("overlaps_speech"),
            F.when(key % 6 == 0, 12.0).otherwise((key % 3).cast("double")).alias("gain_db"),
            F.when(key % 11 == 0, F.lit(None)).otherwise(-14.0 - key % 12).cast("double").alias("integrated_lufs"),
            (key % 14).cast("double").alias("loudness_range"),
            F.when(key % 22 == 0, F.lit(float("-inf"))).otherwise(-0.5 - key % 4).cast("double").alias("true_peak"),
            (price / 1000).alias("source_duration"),
            (price / 1000 + (key % 8 - 3) * 0.02).alias("output_duration"),
        )
    )


PLAN = """pf AS (SELECT 'transcription' AS profile_name, 0.025::DOUBLE AS sb, 9.0::DOUBLE AS hum, -28.0::DOUBLE AS vt, 20.0::DOUBLE AS vg, 0.0::DOUBLE AS mb, 0.0::DOUBLE AS ma, -23.0::DOUBLE AS tl, 7.0::DOUBLE AS lra, -3.0::DOUBLE AS tp, false AS sbe
  UNION ALL SELECT 'product-demo', 0.02, 8.0, -30.0, 24.0, 12.0, 30.0, -16.0, 11.0, -1.5, true),
 md AS (SELECT o_orderkey AS media_id, o_totalprice / 1e7 AS sbr, o_orderkey % 13 AS h, CASE WHEN o_orderkey % 7 = 0 THEN 0.001 ELSE 0 END AS dc, -20 - o_orderkey % 31 AS sl, -40 - o_orderkey % 17 AS nf,
  o_orderkey % 5 AS sr, o_orderkey % 9 - 6 AS df, o_orderkey % 4 = 0 AS ov, CASE WHEN o_orderkey % 6 = 0 THEN 12 ELSE o_orderkey % 3 END AS g,
  CASE WHEN o_orderkey % 11 <> 0 THEN -14 - o_orderkey % 12 END AS lu, o_orderkey % 14 AS lr, CASE WHEN o_orderkey % 22 = 0 THEN '-inf'::DOUBLE ELSE -0.5::DOUBLE - o_orderkey % 4 END AS pk,
  (o_orderkey % 8 - 3) * 20.0::DOUBLE AS dd FROM orders), mp AS (SELECT * FROM md, pf)"""


@query(
    "environment_cleanup",
    "RU-04",
    f"""WITH {PLAN}, d AS (SELECT *, sbr >= sb OR abs(dc) > 1e-4 AS hp, h >= hum AS dh, sl < -45 AS q, nf <= sl - 20 AS cl FROM mp)
 SELECT media_id, profile_name, CASE WHEN sr = 0 THEN 'abstained' WHEN hp OR dh THEN 'applied' WHEN q OR NOT cl THEN 'abstained' ELSE 'no_op' END AS status,
 CASE WHEN sr = 0 THEN 'no_speech_detected' WHEN hp OR dh THEN 'eligible_environmental_cleanup_resolved' WHEN q THEN 'input_speech_too_quiet_for_reliable_noise_estimate'
  WHEN NOT cl THEN 'conservative_v1_has_no_reliable_stationary_noise_profile' ELSE 'environmental_components_below_threshold' END AS reason,
 CASE WHEN sr = 0 THEN '' ELSE concat_ws(',', CASE WHEN hp THEN 'minimum-phase-highpass' END, CASE WHEN dh THEN 'minimum-phase-dehum' END) END AS operations FROM d""",
)
def environment_cleanup(spark, sf):
    out = rules.environment_cleanup(measured_media(spark, sf))
    return out.select(
        "media_id", F.col("profile.name").alias("profile_name"), "status", "reason", F.array_join("operations", ",").alias("operations")
    )


@query(
    "voice_gain",
    "RU-05 SC-13",
    f"""WITH {PLAN} SELECT media_id, profile_name, CASE WHEN sr = 0 THEN 'abstained' ELSE 'applied' END AS status,
 CASE WHEN sr <> 0 THEN greatest(-4.0::DOUBLE, least(vg, vt - sl)) END AS resolved_gain_db FROM mp""",
)
def voice_gain(spark, sf):
    out = rules.voice_gain(measured_media(spark, sf))
    return out.select("media_id", F.col("profile.name").alias("profile_name"), "status", "resolved_gain_db")


@query(
    "profile_evaluation",
    "RU-01 RU-02 JN-12",
    f"""WITH {PLAN} SELECT media_id, 'channel_001' AS observation_id, profile_name || '.channel-level-difference' AS rule, round_even(df::DOUBLE, 3) AS observed_db,
  CASE WHEN abs(df) <= 1.5 THEN 'inside_target' ELSE 'outside_target' END AS status FROM mp
 UNION ALL SELECT media_id, 'program_001', profile_name || '.program-loudness', lu::DOUBLE, CASE WHEN abs(coalesce(lu, -240) - tl) <= 0.5 THEN 'inside_target' ELSE 'outside_target' END FROM mp
 UNION ALL SELECT media_id, 'level_001', profile_name || '.machine-audio-relative-level', df::DOUBLE, CASE WHEN df BETWEEN -4 AND -2 THEN 'inside_target' ELSE 'outside_target' END FROM mp""",
)
def profile_evaluation(spark, sf):
    rows = F.array(
        F.struct(F.lit("channel_001").alias("observation_id"), F.lit("channel").alias("type"), F.col("difference_db").alias("observed")),
        F.struct(F.lit("program_001").alias("observation_id"), F.lit("program").alias("type"), F.col("integrated_lufs").alias("observed")),
        F.struct(F.lit("level_001").alias("observation_id"), F.lit("region").alias("type"), F.col("difference_db").alias("observed")),
    )
    return rules.evaluate_measures(measured_media(spark, sf).select("media_id", "profile", F.inline(rows)))


@query(
    "loudness_plan",
    "RU-11",
    f"""WITH {PLAN}, d AS (SELECT *, lu IS NOT NULL AND isfinite(pk) AS ok, abs(lu - tl) > 0.5 OR pk > tp AS need FROM mp)
 SELECT media_id, profile_name, CASE WHEN NOT ok THEN 'unmeasurable' WHEN need THEN 'applied' ELSE 'no_op' END AS status,
 CASE WHEN NOT ok AND isfinite(pk) THEN 'too_short_to_measure' WHEN NOT ok THEN 'silent' WHEN need THEN 'program_outside_profile_target' ELSE 'program_inside_target' END AS reason,
 CASE WHEN ok AND need THEN tl - lu END AS gain_db, CASE WHEN ok AND need THEN CASE WHEN lr <= lra THEN 'no_op' ELSE 'abstained' END END AS range_status FROM d""",
)
def loudness_plan(spark, sf):
    out = rules.loudness_plan(measured_media(spark, sf))
    return out.select("media_id", F.col("profile.name").alias("profile_name"), "status", "reason", "gain_db", "range_status")


@query(
    "compensation_step",
    "RU-12",
    f"""WITH {PLAN}, d AS (SELECT *, greatest(-ma, least(mb, g - 3 - df)) AS t FROM mp), e AS (SELECT *, NOT ov AND NOT df BETWEEN -4 AND -2 AND abs(t - g) >= 0.05 AS mv FROM d)
 SELECT media_id, profile_name, CAST(CASE WHEN mv THEN t - g ELSE 0 END AS DOUBLE) AS delta_db, CAST(CASE WHEN mv THEN t ELSE g END AS DOUBLE) AS gain_db FROM e""",
)
def compensation_step(spark, sf):
    out = rules.compensation_step(measured_media(spark, sf))
    return out.select("media_id", F.col("profile.name").alias("profile_name"), "delta_db", "gain_db")


@query(
    "final_region_status",
    "RU-13",
    f"""WITH {PLAN} SELECT media_id, profile_name, CASE WHEN ov THEN 'abstained_overlap' WHEN df BETWEEN -4.25 AND -1.75 THEN 'inside_target'
 WHEN abs(g - mb) <= 0.05 OR abs(g + ma) <= 0.05 THEN 'bounded_outside_target' ELSE 'outside_target' END AS status FROM mp""",
)
def final_region_status(spark, sf):
    out = rules.final_region_status(measured_media(spark, sf))
    return out.select("media_id", F.col("profile.name").alias("profile_name"), "status")


@query(
    "conformance",
    "RU-14",
    f"""WITH {PLAN}, d AS (SELECT *, CASE WHEN media_id % 10 = 0 THEN 'skipped' ELSE 'evaluate' END AS gate FROM mp),
 c AS (SELECT *, abs(dd) <= 50 AS t_ok, gate <> 'evaluate' OR abs(lu - tl) <= 0.6 AS l_ok, pk <= CASE WHEN gate = 'skipped' THEN -0.1 ELSE tp END AS p_ok FROM d)
 SELECT media_id, profile_name, t_ok AS timeline_ok, l_ok AS loudness_ok, p_ok AS peak_ok, t_ok AND l_ok AND p_ok AS conforms FROM c""",
)
def conformance(spark, sf):
    renders = measured_media(spark, sf).withColumns(
        {
            "loudness_gate": F.when(F.col("media_id") % 10 == 0, "skipped").otherwise("evaluate"),
            "after_lufs": F.col("integrated_lufs"),
            "after_true_peak": F.col("true_peak"),
        }
    )
    out = rules.conformance(renders)
    return out.select("media_id", F.col("profile.name").alias("profile_name"), "timeline_ok", "loudness_ok", "peak_ok", "conforms")


STAGES = "['channel-balance','environment-denoise','voice-enhance','source-balance','program-loudness']"


@query(
    "stage_report",
    "FLT-10 RU-15",
    f"""WITH {PLAN}, s AS (SELECT media_id, profile_name, unnest({STAGES}) AS stage, unnest([0,1,2,3,4]) AS o, sbe FROM mp),
 g AS (SELECT *, CASE WHEN (media_id % 4 = 1 AND stage = 'voice-enhance') THEN 'skipped' WHEN stage = 'source-balance' AND NOT sbe THEN 'disabled' ELSE 'evaluate' END AS gate FROM s)
 SELECT media_id, profile_name, string_agg(stage || '=' || gate, ',' ORDER BY o) AS stages FROM g GROUP BY 1, 2""",
)
def stage_report(spark, sf):
    skipped = F.when(F.col("media_id") % 4 == 1, F.array(F.lit("voice-enhance"))).otherwise(
        F.array().cast("array<string>")
    )
    gates = rules.stage_gates(measured_media(spark, sf).select("media_id", "profile"), skipped)
    named = gates.withColumns(
        {"profile_name": F.col("profile.name"), "status": F.col("gate"), "reason": F.lit("")}
    )
    report = rules.stage_report(named, ["media_id", "profile_name"])
    joined = F.array_join(F.transform("stages", lambda s: F.concat(s["stage"], F.lit("="), s["status"])), ",")
    return report.select("media_id", "profile_name", joined.alias("stages"))


@query(
    "skip_lists",
    "FLT-09",
    f"""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN ' voice-enhance , source-balance' WHEN 2 THEN 'voice-enhance,,source-balance'
  WHEN 3 THEN 'denoise,voice-enhance,eq' WHEN 4 THEN 'voice-enhance,voice-enhance' ELSE '  ' END AS raw FROM orders),
 l AS (SELECT *, list_transform(string_split(raw, ','), lambda x: trim(x)) AS items FROM t),
 u AS (SELECT *, list_sort(list_distinct(list_filter(items, lambda x: NOT list_contains({STAGES}, x)))) AS unk FROM l),
 e AS (SELECT *, CASE WHEN raw IS NULL OR trim(raw) = '' THEN NULL WHEN list_contains(items, '') THEN 'empty_item' WHEN len(unk) > 0 THEN 'unknown:' || array_to_string(unk, '|')
  WHEN len(list_distinct(items)) < len(items) THEN 'duplicate' END AS error FROM u)
 SELECT o_orderkey, error, CASE WHEN raw IS NULL OR trim(raw) = '' OR error IS NOT NULL THEN '' ELSE array_to_string(items, ',') END AS stages FROM e""",
)
def skip_lists(spark, sf):
    k = F.col("o_orderkey") % 6
    raw = (
        F.when(k == 1, " voice-enhance , source-balance")
        .when(k == 2, "voice-enhance,,source-balance")
        .when(k == 3, "denoise,voice-enhance,eq")
        .when(k == 4, "voice-enhance,voice-enhance")
        .when(k == 5, "  ")
    )
    parsed = V.table(spark, sf, "orders").select("o_orderkey", rules.skip_list(raw).alias("p"))
    return parsed.select("o_orderkey", "p.error", F.array_join("p.stages", ",").alias("stages"))


@query(
    "profile_dimension",
    "SRC-10",
    """WITH pf AS (SELECT 'transcription' AS name, 70.0::DOUBLE AS highpass_hz, -23.0::DOUBLE AS target_lufs, false AS source_balance_enabled UNION ALL SELECT 'product-demo', 75.0, -16.0, true)
 SELECT name, highpass_hz, target_lufs, source_balance_enabled, count(*) AS recordings FROM pf, orders
 WHERE CASE WHEN o_orderkey % 2 = 0 THEN 'transcription' ELSE 'product-demo' END = name GROUP BY 1, 2, 3, 4""",
)
def profile_dimension(spark, sf):
    chosen = V.table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 2 == 0, "transcription").otherwise("product-demo").alias("name")
    )
    counted = chosen.groupBy("name").agg(F.count("*").alias("recordings"))
    dimension = profile_table(spark).select("name", "highpass_hz", "target_lufs", "source_balance_enabled")
    # The dimension has len(PROFILES) rows by construction.
    assert len(PROFILES) == 2
    return counted.join(F.broadcast(dimension), "name")


@query(
    "gain_arithmetic",
    "SC-01 SC-13 SC-14 SC-17 SC-18 RU-10",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(20 * log10(greatest(abs(l_discount), 1e-12)), 6) AS amplitude_db, round(pow(10, -l_quantity / 20), 6) AS amplitude,
 greatest(-4.0::DOUBLE, least(20, -28 + l_quantity)) AS bounded, least(l_extendedprice, floor(l_partkey * 16000 / 48000) / 16000.0::DOUBLE) AS bound,
 round(sqrt(l_quantity * (l_quantity + 10)), 6) AS centre_hz, round(greatest(0.25, sqrt(l_quantity * (l_quantity + 10)) / 10), 6) AS quality,
 round((1 + sin(2 * pi() * 30 / 48000) / 1.8 * pow(10, l_tax)) / (1 + sin(2 * pi() * 30 / 48000) / 1.8 / pow(10, l_tax)), 9) AS b0,
 round(l_quantity * (1 - l_discount) + l_tax * l_discount, 6) AS blended FROM lineitem""",
)
def gain_arithmetic(spark, sf):
    q = F.col("l_quantity")
    coefficients = L.peaking_coefficients(F.col("l_tax") * 40.0, F.lit(30.0), F.lit(0.9), F.lit(48_000.0))
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.round(L.amplitude_to_db(F.col("l_discount")), 6).alias("amplitude_db"),
        F.round(L.db_to_amplitude(-q), 6).alias("amplitude"),
        L.bounded_gain(F.lit(-28.0), -q, F.lit(4.0), F.lit(20.0)).alias("bounded"),
        L.timeline_bound(F.col("l_extendedprice"), F.col("l_partkey"), F.lit(48_000)).alias("bound"),
        F.round(L.band_centre(q, q + 10), 6).alias("centre_hz"),
        F.round(L.band_quality(q, q + 10), 6).alias("quality"),
        F.round(coefficients["b0"], 9).alias("b0"),
        F.round(L.blend(q, F.col("l_tax"), F.col("l_discount")), 6).alias("blended"),
    )


def gain_table(spark, sf):
    media = G.samples(spark, sf).select("media_id").distinct()
    k = F.col("media_id") % 7
    return media.select(
        "media_id",
        F.inline(
            F.array(
                F.struct((10 + k).alias("start"), (90 + 3 * k).alias("end"), F.lit(-6.0).alias("gain_db")),
                F.struct((70 + k).alias("start"), (200 + k).alias("end"), F.lit(4.0).alias("gain_db")),
            )
        ),
    )


FADE_SQL = """CASE WHEN i < s OR i >= e THEN 0.0::DOUBLE WHEN e - 1 - i < w THEN pow(sin(pi() / 2 * (e - 1 - i) / w), 2) WHEN i - s < w THEN pow(sin(pi() / 2 * (i - s) / w), 2) ELSE 1 END"""


@query(
    "faded_gains",
    "RU-08 SC-12",
    f"""WITH {G.SAMPLES}, gn AS (SELECT media_id, 10 + media_id % 7 AS s, 90 + 3 * (media_id % 7) AS e, -6.0::DOUBLE AS g FROM (SELECT DISTINCT media_id FROM v_pair)
   UNION ALL SELECT media_id, 70 + media_id % 7, 200 + media_id % 7, 4.0 FROM (SELECT DISTINCT media_id FROM v_pair)),
 w AS (SELECT *, least(5, greatest(1, (e - s) // 2)) AS w FROM gn),
 m AS (SELECT v_s.media_id, i, l, g, {FADE_SQL} AS m FROM v_s JOIN w ON w.media_id = v_s.media_id),
 f AS (SELECT media_id, i, any_value(l) AS l, product(1 - m + m * pow(10, g / 20)) AS k FROM m GROUP BY 1, 2)
 SELECT media_id, round(20 * log10(sqrt(sum((l * k) * (l * k)) / count(*) + 1e-12)), 4) AS left_dbfs, round(max(abs(l * k)), 5) AS left_peak FROM f GROUP BY 1""",
)
def faded_gains(spark, sf):
    out = M.apply_gains(G.samples(spark, sf), gain_table(spark, sf), 5, G.CHUNK)
    long = M.samples_long(out)
    return long.groupBy("media_id").agg(
        F.round(L.rms_db(F.sum(F.col("l") * F.col("l")), F.count("*")), 4).alias("left_dbfs"),
        F.round(F.max(F.abs("l")), 5).alias("left_peak"),
    )


@query(
    "outside_fade_weights",
    "SC-12",
    f"""WITH {G.SAMPLES}, {G.SPEECH}, x AS (SELECT v_s.media_id, i, s, e, greatest(0, s - 5) AS lo, least(256, e + 5) AS hi FROM v_s JOIN v_sp ON v_sp.media_id = v_s.media_id),
 m AS (SELECT media_id, i, max(CASE WHEN i >= s AND i < e THEN 1.0::DOUBLE WHEN i >= lo AND i < s THEN pow(sin(pi() / 2 * (i - lo) / (s - lo)), 2)
   WHEN i >= e AND i < hi THEN pow(sin(pi() / 2 * (hi - i) / (hi - e)), 2) ELSE 0 END) AS m FROM x GROUP BY 1, 2)
 SELECT media_id, round(sum(m), 6) AS total_weight, count(*) FILTER (WHERE m = 1) AS full_samples FROM m GROUP BY 1""",
)
def outside_fade_weights(spark, sf):
    fade = 5
    reach = G.speech(spark, sf).select(
        "media_id",
        "region_id",
        F.col("start").alias("s"),
        F.col("end").alias("e"),
        F.greatest(F.lit(0), F.col("start") - fade).alias("start"),
        (F.col("end") + fade).alias("end"),
    )
    touched = M.interval_slices(G.samples(spark, sf), reach, G.CHUNK, "s", "e")
    total = F.lit(4 * G.CHUNK)
    weight = L.fade_outside(F.col("i"), F.col("s"), F.col("e"), fade, total)
    per_sample = M.samples_long(touched, "s", "e").groupBy("media_id", "i").agg(F.max(weight).alias("m"))
    return per_sample.groupBy("media_id").agg(
        F.round(F.sum("m"), 6).alias("total_weight"),
        F.count(F.when(F.col("m") == 1, F.lit(1))).alias("full_samples"),
    )


COMPRESSED = f"""{G.SAMPLES}, cf AS (SELECT media_id, i // 2 AS f, least((i // 2) * 2 + 1, 255) AS c, 20 * log10(sqrt(sum(l * l + r * r) / 4 + 1e-12)) AS lv FROM v_s GROUP BY 1, 2, 3),
 cr AS (SELECT *, -(greatest(lv + 24, 0) - greatest(lv + 24, 0) / 2) AS rd FROM cf),
 cn AS (SELECT *, lead(c) OVER w AS c2, lead(rd) OVER w AS rd2, row_number() OVER w AS o FROM cr WINDOW w AS (PARTITION BY media_id ORDER BY f)),
 cs AS (SELECT v_s.media_id, i, l, r, CASE WHEN i < c THEN rd ELSE rd + coalesce((rd2 - rd) * (i - c) / (c2 - c), 0) END AS d FROM v_s JOIN cn ON cn.media_id = v_s.media_id
   AND ((i >= c AND (c2 IS NULL OR i < c2)) OR (o = 1 AND i < c)))"""


@query(
    "compressor",
    "RU-06",
    f"""WITH {COMPRESSED} SELECT media_id, round(20 * log10(sqrt(avg(pow(l * pow(10, d / 20), 2)) + 1e-12)), 4) AS left_dbfs, round(min(d), 4) AS largest_reduction_db FROM cs GROUP BY 1""",
)
def compressor(spark, sf):
    samples = G.samples(spark, sf)
    out = M.samples_long(M.compress(samples, G.RATE, -24.0, 2.0, G.CHUNK))
    curve = M.compressor_curve(samples, G.RATE, -24.0, 2.0)
    levels = out.groupBy("media_id").agg(
        F.round(L.rms_db(F.sum(F.col("l") * F.col("l")), F.count("*")), 4).alias("left_dbfs")
    )
    return levels.join(
        curve.groupBy("media_id").agg(F.round(F.min("reduction_db"), 4).alias("largest_reduction_db")), "media_id"
    )
