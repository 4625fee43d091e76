"""A small stereo signal table derived from the embedding vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.plans.views import table

# Eight vectors make one recording: four chunks of 64 samples, even vectors left, odd vectors right.
CHUNK = 64
RATE = 80


def samples(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    media = F.floor(F.col("vec_id") / 8).cast("bigint")
    chunk = F.floor((F.col("vec_id") % 8) / 2).cast("bigint")
    even = F.col("vec_id") % 2 == 0
    return (
        vectors.groupBy(media.alias("media_id"), chunk.alias("chunk_id"))
        .agg(
            F.max(F.when(even, F.col("embedding"))).alias("ch0"),
            F.max(F.when(~even, F.col("embedding"))).alias("ch1"),
        )
        .where("ch0 IS NOT NULL AND ch1 IS NOT NULL")
        .select("media_id", "chunk_id", (F.col("chunk_id") * CHUNK).alias("start_sample"), "ch0", "ch1")
    )


SAMPLES = """v_vec AS (SELECT vec_id // 8 AS media_id, (vec_id % 8) // 2 AS chunk_id, vec_id % 2 AS ch, embedding FROM embeddings),
 v_pair AS (SELECT a.media_id, a.chunk_id, a.embedding AS x, b.embedding AS y FROM v_vec a JOIN v_vec b
   ON a.media_id = b.media_id AND a.chunk_id = b.chunk_id AND a.ch = 0 AND b.ch = 1),
 v_s AS (SELECT media_id, chunk_id * 64 + k - 1 AS i, x[k]::DOUBLE AS l, y[k]::DOUBLE AS r, (x[k]::DOUBLE + y[k]::DOUBLE) / 2 AS m
   FROM v_pair, (SELECT unnest(range(1, 65)) AS k))"""


def speech(spark: SparkSession, sf: str) -> DataFrame:
    """Two speech regions per recording, placed by its number."""
    media = samples(spark, sf).select("media_id").distinct()
    shift = F.col("media_id") % 5
    return media.select(
        "media_id",
        F.inline(
            F.array(
                F.struct(
                    F.lit("speech_001").alias("region_id"),
                    (20 + 4 * shift).alias("start"),
                    (60 + 4 * shift).alias("end"),
                ),
                F.struct(
                    F.lit("speech_002").alias("region_id"),
                    (120 + 3 * shift).alias("start"),
                    (170 + 6 * shift).alias("end"),
                ),
            )
        ),
    )


SPEECH = """v_sp AS (SELECT media_id, 'speech_001' AS region_id, 20 + 4 * (media_id % 5) AS s, 60 + 4 * (media_id % 5) AS e FROM (SELECT DISTINCT media_id FROM v_pair)
  UNION ALL SELECT media_id, 'speech_002', 120 + 3 * (media_id % 5), 170 + 6 * (media_id % 5) FROM (SELECT DISTINCT media_id FROM v_pair))"""


def filtered_sql(sections) -> str:
    """v_f: both channels through recursive sections, one sample of every recording at a time, in single precision."""
    steps = "SELECT z.*, c.i AS here, c.v AS u0 FROM z JOIN v_ch c ON c.media_id = z.media_id AND c.ch = z.ch AND c.i = z.i + 1"
    names, zeros, moved = [], [], []
    for k, ((b0, b1, b2), (a1, a2)) in enumerate(sections, 1):
        steps = f"SELECT *, {b0!r}::DOUBLE * u{k - 1} + p{k} AS u{k} FROM ({steps})"
        names += [f"p{k}", f"q{k}"]
        zeros += ["0.0::DOUBLE"] * 2
        moved += [f"{b1!r}::DOUBLE * u{k - 1} - {a1!r}::DOUBLE * u{k} + q{k}", f"{b2!r}::DOUBLE * u{k - 1} - {a2!r}::DOUBLE * u{k}"]
    return f"""v_ch AS MATERIALIZED (SELECT media_id, 0 AS ch, i, l AS v FROM v_s UNION ALL SELECT media_id, 1, i, r FROM v_s),
 z AS (SELECT DISTINCT media_id, ch, -1::BIGINT AS i, 0.0::DOUBLE AS y, {", ".join(f"{z} AS {n}" for z, n in zip(zeros, names))} FROM v_ch
  UNION ALL SELECT media_id, ch, here, u{len(sections)}, {", ".join(moved)} FROM ({steps})),
 v_f AS (SELECT media_id, i, max(y) FILTER (WHERE ch = 0)::FLOAT::DOUBLE AS fl, max(y) FILTER (WHERE ch = 1)::FLOAT::DOUBLE AS fr FROM z WHERE i >= 0 GROUP BY 1, 2)"""


def spectrum_sql(rate: float, segment: int, minimum: int) -> str:
    """v_en: sub-bass share, hum excess and offset of the speech v_sp of v_s, the periodograms by explicit sums."""
    hop = segment - segment // 2
    peaks = ", ".join(
        f"10 * log10((max(p) FILTER (WHERE abs(f - {c}) <= 1.5) + 1e-12) / (median(p) FILTER (WHERE abs(f - {c}) BETWEEN 4 AND 12) + 1e-12))"
        for c in (60.0, 120.0, 180.0)
    )
    return f"""v_sx AS (SELECT media_id, m, row_number() OVER (PARTITION BY media_id ORDER BY i) - 1 AS o FROM v_s
  WHERE EXISTS (SELECT 1 FROM v_sp WHERE v_sp.media_id = v_s.media_id AND i >= s AND i < e)),
 v_sz AS (SELECT media_id, count(*) AS n FROM v_sx GROUP BY 1 HAVING count(*) >= {max(minimum, segment)}),
 v_sw AS (SELECT media_id, w, o - w * {hop} AS k, m FROM v_sx JOIN (SELECT media_id, unnest(range((n - {segment - hop}) // {hop})) AS w FROM v_sz) USING (media_id)
  WHERE o BETWEEN w * {hop} AND w * {hop} + {segment - 1}),
 v_sh AS (SELECT media_id, w, k, (m - avg(m) OVER (PARTITION BY media_id, w)) * (0.5 - 0.5 * cos(2 * pi() * k / {segment})) AS v FROM v_sw),
 v_sq AS (SELECT media_id, w, b, sum(v * cos(2 * pi() * b * k / {segment})) AS re, sum(v * sin(2 * pi() * b * k / {segment})) AS im
  FROM v_sh, (SELECT unnest(range({segment // 2 + 1})) AS b) GROUP BY 1, 2, 3),
 v_sd AS (SELECT media_id, b * {float(rate)}::DOUBLE / {segment} AS f, avg((re * re + im * im) / ({rate} * {segment} * 0.375)
   * CASE WHEN b BETWEEN 1 AND {(segment + 1) // 2 - 1} THEN 2 ELSE 1 END) AS p FROM v_sq GROUP BY 1, 2),
 v_sb AS (SELECT media_id, coalesce(sum(p) FILTER (WHERE f >= 20 AND f < 70), 0) / (coalesce(sum(p) FILTER (WHERE f >= 20 AND f <= {min(8000.0, rate / 2 - 1)}), 0) + 1e-12) AS sub,
   coalesce(greatest({peaks}), 0) AS hum FROM v_sd GROUP BY 1),
 v_en AS (SELECT media_id, coalesce(sub, 0) AS subbass_ratio, coalesce(hum, 0) AS hum_excess_db, coalesce(dc, 0) AS dc_offset FROM (SELECT DISTINCT media_id FROM v_s)
  LEFT JOIN v_sb USING (media_id) LEFT JOIN (SELECT media_id, avg(m) AS dc FROM v_sx GROUP BY 1) USING (media_id))"""


def loudness_sql(sections, frame: int) -> str:
    """v_ld: integrated loudness, gate, range and oversampled peak of v_s, weighted one sample at a time."""
    lufs = lambda p: f"(-0.691 + 10 * log10({p}))"

    def blocks(name: str, length: int, gate: int) -> str:
        return f"""{name}b AS (SELECT a.media_id, a.f, sum(c.q) / {length * frame} AS p FROM v_fp a JOIN v_fp c ON c.media_id = a.media_id AND c.f BETWEEN a.f AND a.f + {length - 1} GROUP BY 1, 2 HAVING count(*) = {length}),
 {name}l AS (SELECT * FROM {name}b WHERE p > 0 AND {lufs("nullif(p, 0)")} > -70),
 {name}g AS (SELECT media_id, {lufs("avg(p)")} - {gate} AS g FROM {name}l GROUP BY 1),
 {name} AS (SELECT {name}l.media_id, p, g FROM {name}l JOIN {name}g USING (media_id) WHERE {lufs("p")} > g)"""

    return f"""{filtered_sql(sections)},
 v_fp AS (SELECT media_id, i // {frame} AS f, sum(fl * fl + fr * fr) AS q FROM v_f GROUP BY 1, 2),
 {blocks("v_k4", 4, 10)}, {blocks("v_k30", 30, 20)},
 v_in AS (SELECT media_id, {lufs("avg(p)")} AS integrated_lufs, max(g) AS threshold_lufs FROM v_k4 GROUP BY 1),
 v_lr AS (SELECT media_id, quantile_cont({lufs("p")}, 0.95) - quantile_cont({lufs("p")}, 0.1) AS loudness_range FROM v_k30 GROUP BY 1),
 v_os AS (SELECT c.media_id, ch, n, sum(v * CASE WHEN n = 4 * i THEN 1 ELSE sin(pi() * (n - 4 * i) / 4) / (pi() * (n - 4 * i) / 4) END * (0.5 - 0.5 * cos(2 * pi() * (n - 4 * i + 49) / 98))) AS y
   FROM v_ch c JOIN (SELECT media_id, unnest(range(4 * (max(i) + 1))) AS n FROM v_s GROUP BY media_id) g ON g.media_id = c.media_id AND n BETWEEN 4 * i - 48 AND 4 * i + 48 GROUP BY 1, 2, 3),
 v_tp AS (SELECT media_id, 20 * log10(nullif(max(abs(y)), 0)) AS true_peak FROM v_os GROUP BY 1),
 v_ld AS (SELECT media_id, integrated_lufs, threshold_lufs, loudness_range, true_peak FROM (SELECT DISTINCT media_id FROM v_s)
  LEFT JOIN v_in USING (media_id) LEFT JOIN v_lr USING (media_id) LEFT JOIN v_tp USING (media_id))"""
