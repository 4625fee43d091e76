"""Region, island and timeline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonoframe.operators import regions as R
from sonoframe.operators import timeline as T
from sonoframe.plans import views as V
from sonoframe.plans.registry import query
from sonoframe.session import cut

POLICY = R.RegionPolicy()

# An iterative state machine is the oracle's natural form; in SQL it needs anchors and groups.
RAW_REGIONS = (
    V.SCORES
    + """,
 v_marks AS (SELECT media_id, frame_idx, prob,
    sum(CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY frame_idx) AS grp
  FROM v_scores),
 v_len AS (SELECT media_id, count(*) * 512 AS total FROM v_scores GROUP BY 1),
 v_groups AS (SELECT media_id, grp, min(frame_idx) AS anchor,
    min(frame_idx) FILTER (WHERE prob < 0.35) AS fl, max(frame_idx) FILTER (WHERE prob < 0.35) AS ll
  FROM v_marks WHERE grp > 0 GROUP BY 1, 2),
 v_brk AS (SELECT *, coalesce((ll - fl) * 512 >= 4800, false) AS brk FROM v_groups),
 v_rid AS (SELECT *, coalesce(sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER
    (PARTITION BY media_id ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rid
  FROM v_brk),
 v_raw AS (SELECT r.media_id, rid, min(anchor) * 512 AS s,
    coalesce(max(CASE WHEN brk THEN fl END) * 512, max(total)) AS e, max(total) AS total
  FROM v_rid r JOIN v_len USING (media_id) GROUP BY r.media_id, rid
  HAVING coalesce(max(CASE WHEN brk THEN fl END) * 512, max(total)) - min(anchor) * 512 >= 1600)"""
)

PADDED = (
    RAW_REGIONS
    + """,
 v_sides AS (SELECT *, greatest(0, s - 1920) AS l, least(total, e + 1920) AS r FROM v_raw),
 v_nb AS (SELECT *, lag(r) OVER w AS pr, lead(l) OVER w AS nl FROM v_sides
   WINDOW w AS (PARTITION BY media_id ORDER BY s)),
 v_pad AS (SELECT media_id, CASE WHEN l < pr THEN (pr + l) // 2 ELSE l END AS s,
   CASE WHEN nl < r THEN (r + nl) // 2 ELSE r END AS e, total FROM v_nb)"""
)


@query(
    "region_hysteresis",
    "RG-01",
    f'WITH {RAW_REGIONS} SELECT media_id, CAST(s AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end" FROM v_raw',
)
def region_hysteresis(spark, sf):
    layout = V.events_layout(spark, sf)
    frames = V.scores(spark, sf, layout)
    fl = V.frames_layout(layout)
    lengths = R.signal_lengths(frames, POLICY.frame)
    return R.hysteresis_regions(frames, lengths, POLICY, fl).select("media_id", "start", "end")


@query(
    "region_pad_split",
    "RG-03",
    f'WITH {PADDED} SELECT media_id, CAST(s AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end" FROM v_pad',
)
def region_pad_split(spark, sf):
    layout = V.events_layout(spark, sf)
    frames = V.scores(spark, sf, layout)
    return R.speech_regions(frames, POLICY, V.frames_layout(layout)).drop("total_samples")


STATS = (
    PADDED
    + """,
 v_stat AS (SELECT p.media_id, p.s, p.e, avg(prob) AS mean_p, max(prob) AS peak_p
  FROM v_pad p JOIN v_scores f ON f.media_id = p.media_id
   AND f.frame_idx >= p.s // 512 AND f.frame_idx < (p.e + 511) // 512
  GROUP BY 1, 2, 3)"""
)


@query(
    "speech_regions",
    "RG-01 RG-03 RG-13 AG-10",
    f"""WITH {STATS}
 SELECT media_id, 'speech_' || lpad(CAST(row_number() OVER (PARTITION BY media_id ORDER BY s) AS VARCHAR), 3, '0') AS region_id,
   CAST(s AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end",
   round(mean_p, 6) AS mean_probability, round(peak_p, 6) AS peak_probability FROM v_stat""",
)
def speech_regions(spark, sf):
    layout = V.events_layout(spark, sf)
    fl = V.frames_layout(layout)
    frames = V.scores(spark, sf, layout)
    found = R.speech_regions(frames, POLICY, fl)
    stats = R.region_statistics(found, frames, POLICY)
    return R.region_ids(stats, "speech_", 3, fl).select(
        "media_id",
        "region_id",
        "start",
        "end",
        F.round("mean_probability", 6).alias("mean_probability"),
        F.round("peak_probability", 6).alias("peak_probability"),
    )


@query(
    "region_pad_then_merge",
    "RG-04",
    f"""WITH {PADDED},
 g AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY media_id ORDER BY s) <= 4800 THEN 0 ELSE 1 END AS n FROM v_pad),
 k AS (SELECT *, sum(n) OVER (PARTITION BY media_id ORDER BY s) AS i FROM g)
 SELECT media_id, CAST(min(s) AS BIGINT) AS "start", CAST(max(e) AS BIGINT) AS "end" FROM k GROUP BY media_id, i""",
)
def region_pad_then_merge(spark, sf):
    layout = V.events_layout(spark, sf)
    frames = V.scores(spark, sf, layout)
    out = R.speech_regions(frames, POLICY, V.frames_layout(layout), pad_first=True)
    return out.select("media_id", "start", "end")


@query(
    "region_bridge_gaps",
    "RG-02",
    f"""WITH {V.SCORES}, c AS (SELECT media_id, frame_idx * 512 AS s, frame_idx * 512 + 512 AS e FROM v_scores WHERE prob >= 0.4),
 g AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY media_id ORDER BY s) <= 2048 THEN 0 ELSE 1 END AS n FROM c),
 k AS (SELECT *, sum(n) OVER (PARTITION BY media_id ORDER BY s) AS i FROM g)
 SELECT media_id, CAST(min(s) AS BIGINT) AS "start", CAST(max(e) AS BIGINT) AS "end" FROM k GROUP BY media_id, i""",
)
def region_bridge_gaps(spark, sf):
    layout = V.events_layout(spark, sf)
    frames = V.scores(spark, sf, layout).where("prob >= 0.4")
    raw = frames.select(
        "media_id",
        (F.col("frame_idx") * 512).alias("start"),
        (F.col("frame_idx") * 512 + 512).alias("end"),
        F.lit(0).cast("bigint").alias("total_samples"),
    )
    wide = V.Layout(512 * V.frames_layout(layout).span) if layout.span else layout
    return R.bridge_gaps(raw, 2048, wide).select("media_id", "start", "end")


@query(
    "activity_clusters",
    "RG-05",
    f"""WITH {V.SCORES}, g AS (SELECT media_id, frame_idx,
   CASE WHEN frame_idx - lag(frame_idx) OVER (PARTITION BY media_id ORDER BY frame_idx) - 1 <= 2 THEN 0 ELSE 1 END AS n
   FROM v_scores WHERE prob >= 0.45),
 k AS (SELECT *, sum(n) OVER (PARTITION BY media_id ORDER BY frame_idx) AS i FROM g)
 SELECT media_id, CAST(min(frame_idx) AS BIGINT) AS first_frame, CAST(max(frame_idx) + 1 AS BIGINT) AS stop_frame
 FROM k GROUP BY media_id, i""",
)
def activity_clusters(spark, sf):
    layout = V.events_layout(spark, sf)
    active = V.scores(spark, sf, layout).where("prob >= 0.45")
    return R.activity_clusters(active, 2, V.frames_layout(layout))


@query(
    "merge_intervals",
    "RG-08",
    f"""WITH {V.SEGMENTS}, {V.VALID},
 g AS (SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY media_id, speaker ORDER BY "start", "end", seg_idx
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM v_val),
 k AS (SELECT *, sum(n) OVER (PARTITION BY media_id, speaker ORDER BY "start", "end", seg_idx) AS i FROM g)
 SELECT media_id, speaker, min("start") AS "start", max("end") AS "end" FROM k GROUP BY media_id, speaker, i""",
)
def merge_intervals(spark, sf):
    layout = V.events_layout(spark, sf)
    return R.merge_intervals(V.valid_segments(spark, sf), ["media_id", "speaker"], layout)


@query(
    "interval_gaps",
    "TL-04",
    f"""WITH {V.SEGMENTS}, {V.VALID},
 z AS (SELECT media_id, "start", "end" FROM v_val UNION ALL SELECT DISTINCT user_id, 0, 0 FROM events),
 r AS (SELECT media_id, "start", max("end") OVER (PARTITION BY media_id ORDER BY "start"
   RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reach FROM z),
 d AS (SELECT media_id, "start", max(reach) AS reach FROM r GROUP BY 1, 2),
 n AS (SELECT d.*, coalesce(lead("start") OVER (PARTITION BY media_id ORDER BY "start"), total) AS nx FROM d JOIN v_tot USING (media_id))
 SELECT media_id, reach AS gap_start, nx AS gap_end FROM n WHERE nx > reach""",
)
def interval_gaps(spark, sf):
    layout = V.events_layout(spark, sf)
    segs = V.valid_segments(spark, sf).select("media_id", "start", "end")
    return R.complement(segs, V.totals(spark, sf), ["media_id"], layout)


FRAGMENT, TURN_GAP, TURN_MIN = 600_000_000, 3_600_000_000, 1_800_000_000

SPANS = f"""{V.SEGMENTS}, {V.VALID},
 kept AS (SELECT * FROM v_val WHERE "end" - "start" >= {FRAGMENT}),
 frag AS (SELECT * FROM v_val WHERE "end" - "start" < {FRAGMENT}),
 pts AS (SELECT media_id, "start" AS b FROM v_val UNION SELECT media_id, "end" FROM v_val
   UNION SELECT media_id, 0 FROM v_tot UNION SELECT media_id, total FROM v_tot),
 pieces AS (SELECT media_id, b AS s, lead(b) OVER (PARTITION BY media_id ORDER BY b) AS e FROM pts),
 act AS (SELECT p.media_id, p.s, p.e,
   coalesce(string_agg(DISTINCT k.speaker, ',' ORDER BY k.speaker), '') AS speakers, count(DISTINCT k.speaker) AS n
   FROM pieces p LEFT JOIN kept k ON k.media_id = p.media_id AND k."start" < p.e AND k."end" > p.s
   WHERE p.e IS NOT NULL GROUP BY 1, 2, 3),
 act2 AS (SELECT a.*, EXISTS (SELECT 1 FROM frag f WHERE f.media_id = a.media_id AND f."start" < a.e AND f."end" > a.s) AS fragment FROM act a),
 chg AS (SELECT *, CASE WHEN speakers = lag(speakers) OVER w AND fragment = lag(fragment) OVER w THEN 0 ELSE 1 END AS n1
   FROM act2 WINDOW w AS (PARTITION BY media_id ORDER BY s)),
 grp AS (SELECT *, sum(n1) OVER (PARTITION BY media_id ORDER BY s) AS i FROM chg),
 spans AS (SELECT media_id, min(s) AS s, max(e) AS e, min(speakers) AS speakers, bool_or(fragment) AS fragment,
   CASE WHEN max(n) > 1 THEN 'overlap' WHEN max(n) = 1 THEN 'single_speaker'
        WHEN bool_or(fragment) THEN 'raw_fragment_abstain' ELSE 'gap' END AS kind
   FROM grp GROUP BY media_id, i)"""

TURNS = (
    SPANS
    + f""",
 nb AS (SELECT *, lag(kind) OVER w AS k1, lag(e - s) OVER w AS l1, lag(kind, 2) OVER w AS k2, lag(speakers, 2) OVER w AS sp2
   FROM spans WINDOW w AS (PARTITION BY media_id ORDER BY s)),
 sg AS (SELECT *, coalesce(k1 = 'gap' AND l1 <= {TURN_GAP} AND k2 = 'single_speaker' AND sp2 = speakers, false) AS j
   FROM nb WHERE kind = 'single_speaker'),
 ti AS (SELECT *, sum(CASE WHEN j THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY s) AS t FROM sg),
 turns AS (SELECT media_id, t - 1 AS turn_index, min(s) AS s, max(e) AS e, min(speakers) AS speaker,
   sum(e - s) AS active, sum(CASE WHEN j THEN l1 ELSE 0 END) AS bridge FROM ti GROUP BY media_id, t)"""
)


def plan_parts(spark, sf):
    layout = V.events_layout(spark, sf)
    graded = T.split_by_length(V.valid_segments(spark, sf), FRAGMENT)
    kept = graded.where("grain = 'kept'").drop("grain")
    filtered = graded.where("grain = 'filtered'").drop("grain")
    totals = V.totals(spark, sf)
    return layout, kept, filtered, totals, T.atomic_timeline(kept, filtered, totals, layout)


@query(
    "atomic_timeline",
    "TL-01",
    f"""WITH {SPANS} SELECT media_id, s AS "start", e AS "end", speakers, fragment AS filtered_active, kind FROM spans""",
)
def atomic_timeline(spark, sf):
    *_, spans = plan_parts(spark, sf)
    return spans.withColumn("speakers", F.array_join("speakers", ","))


@query(
    "speaker_turns",
    "TL-02",
    f"""WITH {TURNS} SELECT media_id, CAST(turn_index AS BIGINT) AS turn_index, s AS "start", e AS "end", speaker,
 CAST(active AS BIGINT) AS active_samples, CAST(bridge AS BIGINT) AS bridge_gap_samples FROM turns""",
)
def speaker_turns(spark, sf):
    layout, *_, spans = plan_parts(spark, sf)
    return T.build_turns(spans, TURN_GAP, layout)


LEDGER = (
    TURNS
    + f""",
 lt AS (SELECT media_id, sum(active) FILTER (WHERE e - s >= {TURN_MIN}) AS aa, sum(bridge) FILTER (WHERE e - s >= {TURN_MIN}) AS ab,
   sum(active) FILTER (WHERE e - s < {TURN_MIN}) AS st, count(*) FILTER (WHERE e - s >= {TURN_MIN}) AS n FROM turns GROUP BY 1),
 ls AS (SELECT media_id, sum(e - s) FILTER (WHERE kind = 'overlap') AS ov, sum(e - s) FILTER (WHERE kind = 'raw_fragment_abstain') AS fr,
   sum(e - s) FILTER (WHERE kind = 'gap') AS gp FROM spans GROUP BY 1),
 ledger AS (SELECT ls.media_id, coalesce(n, 0) AS n, coalesce(aa, 0) AS aa, coalesce(ab, 0) AS ab, coalesce(st, 0) AS st,
   coalesce(ov, 0) AS ov, coalesce(fr, 0) AS fr, coalesce(gp, 0) - coalesce(ab, 0) AS ug FROM ls LEFT JOIN lt ON ls.media_id = lt.media_id)"""
)


@query(
    "coverage_ledger",
    "AG-19 DQ-04",
    f"""WITH {LEDGER} SELECT media_id, CAST(total AS BIGINT) AS total, CAST(n AS BIGINT) AS accepted_turns,
 CAST(aa AS BIGINT) AS accepted_active, CAST(ab AS BIGINT) AS accepted_bridge, CAST(st AS BIGINT) AS short_turn,
 CAST(ov AS BIGINT) AS overlap, CAST(fr AS BIGINT) AS fragment_only, CAST(ug AS BIGINT) AS unclaimed_gap,
 CAST(aa + ab + st + ov + fr + ug AS BIGINT) AS partition_sum,
 (aa + ab + st + ov + fr + ug = total AND ug >= 0) AS is_exact FROM ledger JOIN v_tot USING (media_id)""",
)
def coverage_ledger(spark, sf):
    layout, _, _, totals, spans = plan_parts(spark, sf)
    spans = cut(spans)
    turns = T.build_turns(spans, TURN_GAP, layout)
    return T.coverage_ledger(spans, turns, totals, TURN_MIN)
