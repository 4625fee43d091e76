"""Spectrum, loudness and recursive-filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonoframe.operators import filters as B
from sonoframe.operators import levels as M
from sonoframe.operators import loudness as P
from sonoframe.operators import spectrum as S
from sonoframe.operators.scan import SINGLE
from sonoframe.plans import signals as G
from sonoframe.plans.queries_signal import FADE_SQL, db, gain_table, r6, signal_layout
from sonoframe.plans.registry import query

RATE = 400


@query(
    "speech_spectrum",
    "AG-27",
    f"""WITH {G.SAMPLES}, {G.SPEECH}, {G.spectrum_sql(RATE, 40, 48)}
 SELECT media_id, round(subbass_ratio, 6) AS subbass_ratio, round(hum_excess_db, 6) AS hum_excess_db, round(dc_offset, 6) AS dc_offset FROM v_en""",
)
def speech_spectrum(spark, sf):
    samples = G.samples(spark, sf)
    layout = signal_layout(samples)
    found = S.speech_spectrum(samples, G.speech(spark, sf), RATE, G.CHUNK, layout, segment=40, minimum=48)
    return r6(found, "subbass_ratio", "hum_excess_db", "dc_offset")


@query(
    "spectrum_bands",
    "AG-27",
    """WITH p AS (SELECT vec_id // 8 AS media_id, k * 2.0::DOUBLE AS f, avg(embedding[k + 1]::DOUBLE * embedding[k + 1]::DOUBLE) AS p FROM embeddings, (SELECT unnest(range(64)) AS k) GROUP BY 1, 2),
 h AS (SELECT media_id, c, max(p) FILTER (WHERE abs(f - c) <= 1.5) AS pk, median(p) FILTER (WHERE abs(f - c) BETWEEN 4 AND 12) AS ar FROM p, (SELECT unnest([60.0::DOUBLE, 120.0]) AS c) GROUP BY 1, 2),
 e AS (SELECT media_id, max(10 * log10((pk + 1e-12) / (ar + 1e-12))) AS x FROM h GROUP BY 1)
 SELECT p.media_id, round(sum(p) FILTER (WHERE f >= 20 AND f < 70) / (sum(p) FILTER (WHERE f >= 20 AND f <= 199) + 1e-12), 6) AS subbass_ratio, round(coalesce(max(x), 0), 6) AS hum_excess_db
 FROM p JOIN e ON e.media_id = p.media_id GROUP BY 1""",
)
def spectrum_bands(spark, sf):
    vectors = G.table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 8).alias("media_id"), F.posexplode("embedding").alias("k", "x")
    )
    spectrum = vectors.groupBy("media_id", (F.col("k") * 2.0).alias("frequency")).agg(
        F.avg(F.col("x").cast("double") * F.col("x").cast("double")).alias("power")
    )
    return r6(S.band_metrics(spectrum, RATE), "subbass_ratio", "hum_excess_db")


BLOCKS = f"""{G.SAMPLES}, fp AS (SELECT media_id, i // 8 AS f, sum(l * l + r * r) AS q FROM v_s GROUP BY 1, 2),
 bl AS (SELECT a.media_id, a.f AS block, sum(b.q) / 32 AS p FROM fp a JOIN fp b ON b.media_id = a.media_id AND b.f BETWEEN a.f AND a.f + 3 GROUP BY 1, 2 HAVING count(*) = 4),
 lo AS (SELECT *, -0.691::DOUBLE + 10 * log10(p) AS lk FROM bl WHERE -0.691::DOUBLE + 10 * log10(p) > -70),
 gt AS (SELECT media_id, -0.691::DOUBLE + 10 * log10(avg(p)) - 10 AS g FROM lo GROUP BY 1)"""


@query(
    "gated_loudness",
    "AG-28",
    f"""WITH {BLOCKS} SELECT lo.media_id, round(-0.691::DOUBLE + 10 * log10(avg(p)), 6) AS integrated_lufs, round(max(g), 6) AS threshold_lufs
 FROM lo JOIN gt ON gt.media_id = lo.media_id AND lk > g GROUP BY 1""",
)
def gated_loudness(spark, sf):
    frames = P.frame_power(G.samples(spark, sf), 8)
    return r6(P.integrated(P.block_power(frames, 8, 4)), "integrated_lufs", "threshold_lufs")


@query(
    "program_loudness",
    "AG-28",
    f"""WITH RECURSIVE {G.SAMPLES}, {G.loudness_sql(B.weighting(G.RATE), 8)} SELECT media_id, round(integrated_lufs, 5) AS integrated_lufs, round(threshold_lufs, 5) AS threshold_lufs,
 round(loudness_range, 5) AS loudness_range, round(true_peak, 5) AS true_peak FROM v_ld""",
)
def program_loudness(spark, sf):
    samples = G.samples(spark, sf)
    found = P.program_loudness(samples, G.RATE, signal_layout(samples))
    return found.withColumns({c: F.round(c, 5) for c in found.columns if c != "media_id"})


SECTIONS = [B.highpass(2.0, G.RATE), B.notch(12.0, G.RATE), B.peaking(3.0, 20.0, 0.9, G.RATE)]


def blended_sql(sections, intervals: str, fade: int) -> str:
    """v_b: the filtered signal inside faded intervals (media_id, s, e), the original elsewhere."""
    return f"""WITH RECURSIVE {G.SAMPLES}, {G.filtered_sql(sections)}, gi AS ({intervals}),
 gw AS (SELECT *, least({fade}, greatest(1, (e - s) // 2)) AS w FROM gi),
 gm AS (SELECT v_s.media_id, i, max({FADE_SQL}) AS m FROM v_s JOIN gw AS w ON w.media_id = v_s.media_id GROUP BY 1, 2),
 v_b AS (SELECT media_id, i, (l * (1 - gm.m) + fl * gm.m)::FLOAT::DOUBLE AS l, (r * (1 - gm.m) + fr * gm.m)::FLOAT::DOUBLE AS r FROM v_s JOIN gm USING (media_id, i) JOIN v_f USING (media_id, i))"""


@query(
    "recursive_filter",
    "UD-02 RU-09",
    f"""{blended_sql(SECTIONS, "SELECT DISTINCT media_id, 70 + media_id % 7 AS s, 200 + media_id % 7 AS e FROM v_pair", 5)}
 SELECT media_id, round({db("sum(l * l + r * r)", "(2 * count(*))")}, 6) AS rms_dbfs, round(20 * log10(greatest(max(greatest(abs(l), abs(r))), 1e-12)), 6) AS peak_dbfs,
  round(avg((l + r) / 2), 6) AS dc_offset FROM v_b GROUP BY 1""",
)
def recursive_filter(spark, sf):
    samples = G.samples(spark, sf)
    filtered = B.filter_signal(samples, SECTIONS)
    treated = gain_table(spark, sf).where("gain_db > 0").select("media_id", "start", "end")
    mixed = B.blend_signals(samples, filtered, treated, 5, G.CHUNK)
    return r6(M.whole_measures(mixed).select("media_id", "rms_dbfs", "peak_dbfs", "dc_offset"), "rms_dbfs", "peak_dbfs", "dc_offset")
