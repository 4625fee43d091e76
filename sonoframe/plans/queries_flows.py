"""End-to-end flows: inspection, enhancement, compensation, partial results."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonoframe.functions import text as X
from sonoframe.operators import enhance, filters, loudness, partial
from sonoframe.operators import levels as M
from sonoframe.plans import inspection
from sonoframe.plans import signals as G
from sonoframe.plans import views as V
from sonoframe.plans.queries_signal import LOUD_MACHINE, db, loud_regions, loud_signal, r6, signal_layout
from sonoframe.plans.queries_spectrum import blended_sql
from sonoframe.plans.registry import query
from sonoframe.session import cut
from sonoframe.sources.profiles import profile


def analysed(spark, sf):
    samples = loud_signal(spark, sf)
    layout = signal_layout(samples)
    speech = G.speech(spark, sf)
    measures, regions = inspection.analyse(samples, speech, G.RATE, G.CHUNK, layout, segment=32, minimum=48)
    return measures, regions, cut(loudness.program_loudness(samples, G.RATE, layout))


@query("inspect_recordings", "RU-01 RU-02")
def inspect_recordings(spark, sf):
    return inspection.evaluations(*analysed(spark, sf))


@query(
    "inspection_observations",
    "RU-01 AG-01 AG-08 AG-27 AG-28",
    f"""WITH RECURSIVE {LOUD_MACHINE}, {G.spectrum_sql(G.RATE, 32, 48)}, {G.loudness_sql(filters.weighting(G.RATE), 8)},
 v_wm AS (SELECT media_id, {db("sum(l * l)", "count(*)")} AS lr, {db("sum(r * r)", "count(*)")} AS rr, corr(l, r) AS co FROM v_s GROUP BY 1),
 v_du AS (SELECT media_id, count(*) AS c, sum(e - s) / {G.RATE} AS d FROM v_sp GROUP BY 1)
 SELECT media_id, 'channel_001' AS observation_id, 'channel_level_difference' AS type, round(lr, 3) AS left_rms_dbfs, round(rr, 3) AS right_rms_dbfs, round(lr - rr, 3) AS difference_db,
  round(co, 6) AS correlation FROM v_wm
 UNION ALL BY NAME SELECT media_id, 'environment_001' AS observation_id, 'speech_environment_spectrum' AS type, round(subbass_ratio, 6) AS subbass_power_ratio,
  round(hum_excess_db, 3) AS maximum_hum_excess_db, round(dc_offset, 9) AS dc_offset, round(nf, 3) AS estimated_noise_floor_dbfs FROM v_en JOIN v_th USING (media_id)
 UNION ALL BY NAME SELECT media_id, 'speech_001' AS observation_id, 'speech_program_level' AS type, 'speech_program' AS region_id, round(sl, 3) AS measured_rms_dbfs,
  round(greatest(nf + 15, sl + 3, -55), 3) AS non_speech_program_detection_threshold_dbfs, c AS detected_region_count, round(d, 6) AS detected_duration_seconds FROM v_th JOIN v_du USING (media_id)
 UNION ALL BY NAME SELECT media_id, 'program_001' AS observation_id, 'program_loudness' AS type, round(integrated_lufs, 3) AS integrated_loudness_lufs, round(loudness_range, 3) AS loudness_range_lu,
  round(true_peak, 3) AS true_peak_dbtp FROM v_ld
 UNION ALL BY NAME SELECT media_id, 'level_' || substr(region_id, 15) AS observation_id, 'regional_level_difference' AS type, region_id, round(s / {G.RATE}, 6) AS "start", round(e / {G.RATE}, 6) AS "end",
  round(lv, 3) AS measured_rms_dbfs, round(difference_db, 3) AS difference_db, overlaps_speech AS overlaps_reference FROM v_m""",
)
def inspection_observations(spark, sf):
    measures, regions, programme = analysed(spark, sf)
    return inspection.observation_rows(measures, regions, G.speech(spark, sf), programme, G.RATE)


@query("inspection_reports", "RU-01 SC-15 SNK-01")
def inspection_reports(spark, sf):
    measures, regions, programme = analysed(spark, sf)
    reports = inspection.inspection_reports(measures, regions, G.speech(spark, sf), programme, G.RATE)
    return reports.select("media_id", "sha256", F.size("report.observations").alias("observations"), F.size("report.regions").alias("regions"))


@query("stage_decisions", "RU-03 RU-04 RU-05 RU-07 RU-11 RU-15 FLT-10")
def stage_decisions(spark, sf):
    return inspection.stage_decisions(*analysed(spark, sf))


@query("voice_enhancement", "RU-05 RU-06 SC-12 UD-02")
def voice_enhancement(spark, sf):
    samples = G.samples(spark, sf)
    layout = signal_layout(samples)
    speech = G.speech(spark, sf)
    out, decided = enhance.enhance_voice(
        samples, speech, speech.select("media_id", "start", "end"), profile("transcription"), G.RATE, G.CHUNK, layout
    )
    after = M.speech_levels(out, speech, G.CHUNK, layout).withColumnRenamed("speech_rms_dbfs", "after_rms_dbfs")
    return decided.join(after, "media_id")


@query(
    "band_adjustment",
    "RU-09 SC-18",
    f"""{blended_sql([filters.peaking(-6.0, 600.0**0.5, 600.0**0.5 / 10.0, G.RATE)], "SELECT media_id, s, e FROM v_sp", 3).replace(G.SAMPLES, f"{G.SAMPLES}, {G.SPEECH}", 1)}
 SELECT media_id, round({db("sum(l * l + r * r)", "(2 * count(*))")}, 6) AS rms_dbfs, round(20 * log10(greatest(max(greatest(abs(l), abs(r))), 1e-12)), 6) AS peak_dbfs FROM v_b GROUP BY 1""",
)
def band_adjustment(spark, sf):
    samples = G.samples(spark, sf)
    intervals = G.speech(spark, sf).select("media_id", "start", "end")
    out = enhance.adjust_band(samples, intervals, -6.0, 20.0, 30.0, G.RATE, G.CHUNK, 3)
    return r6(M.whole_measures(out).select("media_id", "rms_dbfs", "peak_dbfs"), "rms_dbfs", "peak_dbfs")


@query("compensation_loop", "RU-12")
def compensation_loop(spark, sf):
    samples, layout, regions = loud_regions(spark, sf)
    _, totals = enhance.compensate(
        samples, G.speech(spark, sf), cut(regions), "product-demo", G.RATE, G.CHUNK, layout
    )
    return totals.select("media_id", "region_id", "gain_db")


@query(
    "partial_coverage",
    "SP-01 TL-04",
    f"""WITH {V.SEGMENTS}, {V.VALID}, p AS (SELECT media_id, "start" AS b FROM v_val UNION SELECT media_id, "end" FROM v_val UNION SELECT media_id, 0 FROM v_tot UNION SELECT media_id, total FROM v_tot),
 q AS (SELECT media_id, b AS s, lead(b) OVER (PARTITION BY media_id ORDER BY b) AS e FROM p),
 m AS (SELECT media_id, s, e, EXISTS (SELECT 1 FROM v_val v WHERE v.media_id = q.media_id AND v."start" < e AND v."end" > s) AS c FROM q WHERE e IS NOT NULL)
 SELECT media_id, coalesce(min(s) FILTER (WHERE NOT c), any_value(total)) AS watermark, CAST(coalesce(sum(e - s) FILTER (WHERE c), 0) AS BIGINT) AS covered FROM m JOIN v_tot USING (media_id) GROUP BY 1""",
)
def partial_coverage(spark, sf):
    layout = V.events_layout(spark, sf)
    totals = V.totals(spark, sf)
    missing = partial.missing_coverage(V.valid_segments(spark, sf), totals, layout)
    return partial.coverage_watermarks(missing, totals)


@query(
    "merged_results",
    "SP-02 RG-13",
    f"""WITH {V.SEGMENTS}, {V.VALID}, {V.HYPOTHESIS}, u AS (SELECT media_id, seg_idx, "start", "end", speaker FROM v_val UNION ALL SELECT media_id, seg_idx, "start", "end", speaker FROM v_hyp)
 SELECT media_id, seg_idx, speaker, 'seg-' || lpad(CAST(row_number() OVER (PARTITION BY media_id ORDER BY "start", "end", speaker, seg_idx) AS VARCHAR), 4, '0') AS region_id FROM u""",
)
def merged_results(spark, sf):
    layout = V.events_layout(spark, sf)
    out = partial.merge_results([V.valid_segments(spark, sf), V.hypothesis(spark, sf)], layout)
    return out.select("media_id", "seg_idx", "speaker", "region_id")


@query(
    "sentence_partition",
    "SP-03",
    r"""WITH w AS (SELECT conv_id, turn, unnest(regexp_split_to_array(trim(text), '\s+')) AS word, unnest(range(len(regexp_split_to_array(trim(text), '\s+')))) AS k FROM conversations)
 SELECT conv_id AS media_id, turn * 100000 + k AS word_idx, turn AS sentence_idx FROM w WHERE length(lower(regexp_replace(word, '[\p{P}\s]', '', 'g'))) > 0""",
)
def sentence_partition(spark, sf):
    """Each turn is a sentence; the words of a conversation form one stream without turn marks."""
    turns = V.table(spark, sf, "conversations")
    sentences = turns.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("sentence_idx"), "text")
    words = turns.select(
        F.col("conv_id").alias("media_id"), "turn", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("k", "text")
    ).select("media_id", (F.col("turn") * 100_000 + F.col("k")).alias("word_idx"), "text")
    layout = V.measure_layout(words, ["media_id"], F.col("word_idx"), 100_000)
    placed = partial.words_to_sentences(words, sentences, layout)
    return placed.where(F.length(X.stripped_key(F.col("text"))) > 0).select("media_id", "word_idx", "sentence_idx")
