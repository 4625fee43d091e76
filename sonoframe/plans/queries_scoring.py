"""Agreement, transcript, repeat and order-statistic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonoframe.functions import text as X
from sonoframe.operators import comparison as C
from sonoframe.operators import intervals as I
from sonoframe.operators import repeats, scoring, transcripts
from sonoframe.operators import statistics as S
from sonoframe.plans import views as V
from sonoframe.plans.queries_intervals import GREEDY
from sonoframe.plans.registry import query
from sonoframe.plans.views import HOUR

FRAME = HOUR
HALF = 360 * HOUR
SEG = f"{V.SEGMENTS}, {V.VALID}, {V.HYPOTHESIS}"


def durations(spark, sf):
    return V.totals(spark, sf).withColumnRenamed("total", "duration")


GRID = f"""grid AS (SELECT media_id, total FROM v_tot),
 fr AS (SELECT media_id, f, f * {FRAME} + {FRAME // 2} AS t FROM (SELECT media_id, unnest(range(total // {FRAME})) AS f FROM grid))"""

PATTERNS = f"""{GRID},
 fa AS (SELECT fr.media_id, f, t, list_sort(list_distinct(list(s.speaker) FILTER (WHERE s.speaker IS NOT NULL))) AS r
   FROM fr LEFT JOIN v_val s ON s.media_id = fr.media_id AND s."start" <= t AND t < s."end" GROUP BY 1, 2, 3),
 fb AS (SELECT fr.media_id, f, list_sort(list_distinct(list(s.speaker) FILTER (WHERE s.speaker IS NOT NULL))) AS h
   FROM fr LEFT JOIN v_hyp s ON s.media_id = fr.media_id AND s."start" <= t AND t < s."end" GROUP BY 1, 2),
 col AS (SELECT DISTINCT fr.media_id, f FROM fr JOIN v_val s ON s.media_id = fr.media_id
   AND (abs(t - s."start") < 900000000 OR abs(t - s."end") < 900000000)),
 frames AS (SELECT fa.media_id, fa.f, coalesce(r, []) AS r, coalesce(h, []) AS h, col.f IS NOT NULL AS c
   FROM fa JOIN fb USING (media_id, f) LEFT JOIN col USING (media_id, f))"""

DER = f"""WITH RECURSIVE {SEG}, {PATTERNS},
 st AS (SELECT 'exclusive_no_collar' AS setting, false AS uc, false AS ov UNION ALL SELECT 'exclusive_with_collar', true, false
   UNION ALL SELECT 'overlap_included_no_collar', false, true),
 pat AS (SELECT media_id, setting, r, h, count(*) AS n FROM frames, st WHERE NOT (uc AND c) AND (ov OR len(r) <= 1) GROUP BY 1, 2, 3, 4),
 rl AS (SELECT DISTINCT media_id, speaker FROM v_val), hl AS (SELECT media_id, speaker, row_number() OVER (PARTITION BY media_id ORDER BY speaker) AS k
   FROM (SELECT DISTINCT media_id, speaker FROM v_hyp)),
 nn AS (SELECT g.media_id, (SELECT count(*) FROM rl WHERE rl.media_id = g.media_id) AS nr, (SELECT count(*) FROM hl WHERE hl.media_id = g.media_id) AS nh FROM grid g),
 tg AS (SELECT media_id, speaker AS target FROM rl UNION ALL SELECT media_id, '~' FROM nn WHERE nh > nr),
 cand AS (SELECT media_id, 0 AS k, []::VARCHAR[] AS m, 0 AS nul FROM nn
   UNION ALL SELECT c.media_id, c.k + 1, list_append(c.m, tg.target), c.nul + CASE WHEN tg.target = '~' THEN 1 ELSE 0 END
   FROM cand c JOIN nn ON nn.media_id = c.media_id AND c.k < nn.nh JOIN tg ON tg.media_id = c.media_id
    AND ((tg.target <> '~' AND NOT list_contains(c.m, tg.target)) OR (tg.target = '~' AND c.nul < nn.nh - nn.nr))),
 full_m AS (SELECT cand.media_id, m, (SELECT list(hl.speaker ORDER BY hl.k) FROM hl WHERE hl.media_id = cand.media_id) AS hs FROM cand JOIN nn ON nn.media_id = cand.media_id AND k = nh),
 mp AS (SELECT p.media_id, setting, m, hs, n, len(r) AS rn, list_filter(list_transform(h, lambda x: m[list_position(hs, x)]), lambda y: y <> '~') AS g, r
   FROM pat p JOIN full_m f ON f.media_id = p.media_id),
 er AS (SELECT media_id, setting, m, any_value(hs) AS hs, sum(n) AS ev, sum(n * rn) AS rf, sum(n * greatest(0, rn - len(g))) AS mi,
   sum(n * greatest(0, len(g) - rn)) AS fa, sum(n * (least(rn, len(g)) - len(list_intersect(r, g)))) AS co FROM mp GROUP BY 1, 2, 3),
 bs AS (SELECT *, row_number() OVER (PARTITION BY media_id, setting ORDER BY mi + fa + co, m) AS o FROM er)
 SELECT media_id, setting, CAST(ev AS BIGINT) AS evaluated_frames, CAST(rf AS BIGINT) AS reference_frames, CAST(mi AS BIGINT) AS missed_frames,
  CAST(fa AS BIGINT) AS false_alarm_frames, CAST(co AS BIGINT) AS confusion_frames,
  array_to_string(list_transform(hs, lambda x, i: x || '=' || replace(m[i], '~', '')), ',') AS mapping,
  round(ev / (total // {FRAME}), 6) AS evaluated_fraction, round((mi + fa + co) / nullif(rf, 0), 6) AS diarization_error_rate FROM bs JOIN v_tot USING (media_id) WHERE o = 1"""


@query("diarization_error", "AG-14 JN-14 TL-03 SO-02", DER)
def diarization_error(spark, sf):
    layout = V.events_layout(spark, sf)
    lengths = durations(spark, sf)
    patterns, ranks, words = scoring.frame_patterns(
        V.valid_segments(spark, sf), V.hypothesis(spark, sf), lengths, FRAME, layout, collar=900_000_000
    )
    out = scoring.diarization_error(patterns, ranks, words, lengths, FRAME)
    return out.withColumns(
        {c: F.round(c, 6) for c in ("evaluated_fraction", "diarization_error_rate")}
    )


def rates(tp, fp, fn):
    p, r = f"({tp} / nullif({tp} + {fp}, 0))", f"({tp} / nullif({tp} + {fn}, 0))"
    f1 = f"(2 * {p} * {r} / nullif({p} + {r}, 0))"
    return f"round({p}, 6) AS precision, round({r}, 6) AS recall, round({f1}, 6) AS f1"


RATES = ("precision", "recall", "f1")


def rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in RATES})


@query(
    "activity_confusion",
    "AG-12",
    f"""WITH {SEG}, {PATTERNS}, k AS (SELECT media_id, count(*) FILTER (WHERE len(r) > 0 AND len(h) > 0) AS both_active,
  count(*) FILTER (WHERE len(r) > 0 AND len(h) = 0) AS first_only, count(*) FILTER (WHERE len(r) = 0 AND len(h) > 0) AS second_only
  FROM frames GROUP BY 1) SELECT *, {rates("both_active", "second_only", "first_only")} FROM k""",
)
def activity_confusion(spark, sf):
    layout = V.events_layout(spark, sf)
    return rounded(
        scoring.activity_scores(
            V.valid_segments(spark, sf), V.hypothesis(spark, sf), durations(spark, sf), FRAME, layout
        )
    )


@query(
    "three_way_agreement",
    "AG-29",
    f"""WITH {SEG}, {GRID},
 x AS (SELECT 'reference' AS src, media_id, "start" AS s, "end" AS e FROM v_val UNION ALL SELECT 'second', media_id, "start", "end" FROM v_hyp
   UNION ALL SELECT 'third', media_id, "start", "end" FROM v_hyp WHERE seg_idx % 2 = 0),
 ac AS (SELECT DISTINCT fr.media_id, f, src FROM fr JOIN x ON x.media_id = fr.media_id AND s <= t AND t < e),
 pr AS (SELECT 'reference' AS a, 'second' AS b UNION ALL SELECT 'reference', 'third' UNION ALL SELECT 'second', 'third'),
 j AS (SELECT fr.media_id, a || '-' || b AS pair, EXISTS (SELECT 1 FROM ac WHERE ac.media_id = fr.media_id AND ac.f = fr.f AND src = a) AS u,
   EXISTS (SELECT 1 FROM ac WHERE ac.media_id = fr.media_id AND ac.f = fr.f AND src = b) AS v FROM fr, pr),
 k AS (SELECT media_id, pair, count(*) FILTER (WHERE u AND v) AS both_active, count(*) FILTER (WHERE u AND NOT v) AS first_only,
   count(*) FILTER (WHERE v AND NOT u) AS second_only FROM j GROUP BY 1, 2)
 SELECT media_id, pair, both_active, first_only, second_only, precision, recall, CASE WHEN precision > 0 AND recall > 0 THEN f1 END AS f1
 FROM (SELECT *, {rates("both_active", "second_only", "first_only")} FROM k)""",
)
def three_way_agreement(spark, sf):
    layout = V.events_layout(spark, sf)
    found = V.hypothesis(spark, sf)
    sources = {
        "reference": V.valid_segments(spark, sf),
        "second": found,
        "third": found.where("seg_idx % 2 = 0"),
    }
    pairs = [("reference", "second"), ("reference", "third"), ("second", "third")]
    return rounded(scoring.agreement_between(sources, pairs, durations(spark, sf), FRAME, layout))


@query(
    "single_speaker_best_label",
    "AG-13",
    f"""WITH {SEG}, {GRID},
 ra AS (SELECT DISTINCT fr.media_id, f FROM fr JOIN v_val s ON s.media_id = fr.media_id AND s.speaker = 'click' AND s."start" <= t AND t < s."end"),
 ha AS (SELECT DISTINCT fr.media_id, f, speaker FROM fr JOIN v_hyp s ON s.media_id = fr.media_id AND s."start" <= t AND t < s."end"),
 lb AS (SELECT DISTINCT media_id, speaker FROM v_hyp), nr AS (SELECT media_id, count(*) AS n FROM ra GROUP BY 1),
 k AS (SELECT lb.media_id, lb.speaker, count(ra.f) AS tp, count(ha.f) - count(ra.f) AS fp FROM lb
   LEFT JOIN ha ON ha.media_id = lb.media_id AND ha.speaker = lb.speaker LEFT JOIN ra ON ra.media_id = ha.media_id AND ra.f = ha.f GROUP BY 1, 2),
 q AS (SELECT k.*, coalesce(n, 0) - tp AS fn FROM k LEFT JOIN nr ON nr.media_id = k.media_id), z AS (SELECT *, {rates("tp", "fp", "fn")} FROM q)
 SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY coalesce(nullif(2 * tp / nullif(2 * tp + fp + fn, 0), 0), -1) DESC, speaker) = 1 AS is_best FROM z""",
)
def single_speaker_best_label(spark, sf):
    layout = V.events_layout(spark, sf)
    reference = V.valid_segments(spark, sf).where("speaker = 'click'")
    return rounded(
        scoring.single_speaker_scores(
            reference, V.hypothesis(spark, sf), durations(spark, sf), FRAME, layout
        )
    )


@query(
    "boundary_scores",
    "JN-09 ST-02 ST-06",
    f"""{GREEDY}, er AS (SELECT media_id, err, row_number() OVER (PARTITION BY media_id ORDER BY err) - 1 AS r, count(*) OVER (PARTITION BY media_id) AS n FROM gs WHERE err IS NOT NULL),
 st AS (SELECT media_id, any_value(n) AS matched, median(err) AS median_error, max(err) FILTER (WHERE r = CAST(ceil(n * 0.95::DOUBLE) AS BIGINT) - 1) AS p95_error FROM er GROUP BY 1),
 nr AS (SELECT media_id, count(*) AS reference_count FROM br GROUP BY 1), nh AS (SELECT media_id, count(*) AS hypothesis_count FROM bh GROUP BY 1),
 cn AS (SELECT media_id, coalesce(reference_count, 0) AS reference_count, coalesce(hypothesis_count, 0) AS hypothesis_count, coalesce(matched, 0) AS matched, median_error, p95_error
  FROM nr FULL JOIN nh USING (media_id) LEFT JOIN st USING (media_id))
 SELECT *, {rates("matched", "(hypothesis_count - matched)", "(reference_count - matched)")} FROM cn""",
)
def boundary_scores(spark, sf):
    layout = V.events_layout(spark, sf)
    reference = I.change_boundaries(V.valid_segments(spark, sf), layout)
    found = I.change_boundaries(V.hypothesis(spark, sf), layout)
    matches = I.match_boundaries(reference, found, 120_000_000, layout)
    return rounded(scoring.boundary_scores(matches, reference, found, layout))


def repeat_halves(spark, sf):
    half = HALF
    segs = V.valid_segments(spark, sf)
    first = I.clamped_to_window(segs, 0, half)
    second = I.clamped_to_window(segs, half, 2 * half).withColumn("speaker", F.concat(F.lit("x"), "speaker"))
    lengths = durations(spark, sf).withColumn("duration", F.lit(half).cast("bigint"))
    return first, second, lengths


#: Every bijection of the labels heard in both halves, on distinct pairs of label sets.
AGREEMENT = f"""WITH RECURSIVE {V.SEGMENTS}, {V.VALID},
 ha AS (SELECT media_id, speaker, greatest("start", 0) AS s, least("end", {HALF}) AS e FROM v_val WHERE "start" < {HALF} AND "end" > 0),
 hb AS (SELECT media_id, 'x' || speaker AS speaker, greatest("start", {HALF}) - {HALF} AS s, least("end", {2 * HALF}) - {HALF} AS e FROM v_val WHERE "start" < {2 * HALF} AND "end" > {HALF}),
 md AS (SELECT media_id FROM ha UNION SELECT media_id FROM hb),
 fr AS (SELECT media_id, f, f * {FRAME} + {FRAME // 2} AS t FROM md, (SELECT unnest(range({HALF // FRAME})) AS f)),
 fa AS (SELECT fr.media_id, f, list_sort(list_distinct(list(speaker) FILTER (WHERE speaker IS NOT NULL))) AS r FROM fr LEFT JOIN ha ON ha.media_id = fr.media_id AND s <= t AND t < e GROUP BY 1, 2),
 fb AS (SELECT fr.media_id, f, list_sort(list_distinct(list(speaker) FILTER (WHERE speaker IS NOT NULL))) AS h FROM fr LEFT JOIN hb ON hb.media_id = fr.media_id AND s <= t AND t < e GROUP BY 1, 2),
 pt AS (SELECT media_id, coalesce(r, []) AS r, coalesce(h, []) AS h, count(*) AS n FROM fa JOIN fb USING (media_id, f) GROUP BY 1, 2, 3),
 rl AS (SELECT DISTINCT media_id, unnest(r) AS l FROM pt), hl AS (SELECT media_id, list(l ORDER BY l) AS hs FROM (SELECT DISTINCT media_id, unnest(h) AS l FROM pt) GROUP BY 1),
 nn AS (SELECT media_id, (SELECT count(*) FROM rl WHERE rl.media_id = md.media_id) AS nr, coalesce(hs, []) AS hs FROM md LEFT JOIN hl USING (media_id)),
 cand AS (SELECT media_id, []::VARCHAR[] AS m FROM nn WHERE nr = len(hs)
  UNION ALL SELECT c.media_id, list_append(c.m, rl.l) FROM cand c JOIN nn ON nn.media_id = c.media_id AND len(c.m) < nn.nr JOIN rl ON rl.media_id = c.media_id AND NOT list_contains(c.m, rl.l)),
 mp AS (SELECT p.media_id, m, hs, n, r, list_transform(h, lambda x: m[list_position(hs, x)]) AS g FROM pt p JOIN cand c ON c.media_id = p.media_id JOIN nn ON nn.media_id = c.media_id AND len(m) = nr),
 dn AS (SELECT *, len(r) + len(g) - 2 * len(list_intersect(r, g)) AS d FROM mp),
 er AS (SELECT media_id, m, any_value(hs) AS hs, sum(n) AS tf, sum(n * d) AS ef, sum(n * len(r)) AS rf, sum(n) FILTER (WHERE d = 0) AS xf, sum(n) FILTER (WHERE len(r) + len(g) > 0) AS vf,
   sum(n) FILTER (WHERE d = 0 AND len(r) > 0) AS vx, sum(n) FILTER (WHERE (len(r) > 0) = (len(g) > 0)) AS sa FROM dn GROUP BY 1, 2),
 bs AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY ef, m) AS o FROM er)
 SELECT media_id, 'ok' AS status, array_to_string(list_transform(hs, lambda x, i: x || '=' || m[i]), ',') AS mapping, CAST(tf AS BIGINT) AS total_frames, CAST(ef AS BIGINT) AS error_frames,
  CAST(rf AS BIGINT) AS reference_frames, CAST(coalesce(xf, 0) AS BIGINT) AS exact_frames, CAST(coalesce(vf, 0) AS BIGINT) AS voiced_frames, CAST(coalesce(vx, 0) AS BIGINT) AS voiced_exact_frames,
  CAST(coalesce(sa, 0) AS BIGINT) AS speech_agree_frames, round(ef / nullif(rf, 0), 6) AS frame_error_rate, round(coalesce(xf, 0) / tf, 6) AS exact_fraction,
  round(coalesce(vx, 0) / nullif(coalesce(vf, 0), 0), 6) AS voiced_exact_fraction, round(coalesce(sa, 0) / tf, 6) AS speech_agreement FROM bs WHERE o = 1
 UNION ALL BY NAME SELECT media_id, 'different_label_counts' AS status, {HALF // FRAME}::BIGINT AS total_frames FROM nn WHERE nr <> len(hs)"""


@query("repeat_agreement", "AG-15", AGREEMENT)
def repeat_agreement(spark, sf):
    layout = V.events_layout(spark, sf)
    found = scoring.repeat_agreement(*repeat_halves(spark, sf), FRAME, layout)
    rates = ("frame_error_rate", "exact_fraction", "voiced_exact_fraction", "speech_agreement")
    return found.withColumns({c: F.round(c, 6) for c in rates})


def turn_pairs(spark, sf):
    """Each turn scored against the next one of its conversation, on whole texts."""
    turns = V.table(spark, sf, "conversations")
    tokens = turns.select("conv_id", "turn", X.mixed_tokens(F.col("text")).alias("reference_tokens"))
    following = tokens.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("reference_tokens").alias("hypothesis_tokens")
    )
    return tokens.join(following, ["conv_id", "turn"])


@query("transcript_errors", "AG-16 SC-05 UD-04")
def transcript_errors(spark, sf):
    scored = scoring.transcript_scores(turn_pairs(spark, sf), ["conv_id", "turn"])
    return scoring.rolled_up_errors(scored, ["conv_id"])


def _sql_tokens(text: str) -> str:
    plain = f"regexp_replace(regexp_replace({text}, '@[A-Za-z]+(\\b)', '\\1', 'g'), '(?i)\\bxxx\\b', '', 'g')"
    return f"regexp_extract_all(lower({plain}), '[a-z0-9]+(?:[''’-][a-z0-9]+)*')"


#: A second reading of each turn: words left out, doubled and spelt otherwise, a quarter of a turn late.
SECOND = "replace(replace(replace(text, ' and ', ' '), ' of ', ' of of '), 'th', 't')"

#: One anti-diagonal of all edit tables at a time: a is the distance and x the deletions of a cell, b and y those one diagonal before.
REPORT = f"""WITH RECURSIVE d AS (SELECT conv_id AS media_id, CAST(max(turn) + 1 AS DOUBLE) AS dur FROM conversations GROUP BY 1),
 w AS (SELECT DISTINCT media_id, s, s + win AS e FROM (SELECT media_id, least(3.0::DOUBLE, dur) AS win,
    unnest([0.0::DOUBLE, greatest(0, (dur - least(3.0::DOUBLE, dur)) / 2), greatest(0, dur - least(3.0::DOUBLE, dur))]) AS s FROM d)
  UNION ALL SELECT media_id, -1.0::DOUBLE, NULL FROM d),
 rs AS (SELECT w.media_id, s, flatten(list({_sql_tokens("text")} ORDER BY turn)) AS k FROM w JOIN conversations c ON conv_id = media_id
  AND (s < 0 OR (turn + 1 > s AND turn < e)) GROUP BY 1, 2),
 hs AS (SELECT w.media_id, s, flatten(list({_sql_tokens(SECOND)} ORDER BY turn)) AS k FROM w JOIN conversations c ON conv_id = media_id
  AND (s < 0 OR (turn + 1.25 > s AND turn + 0.25 < e)) GROUP BY 1, 2),
 v AS (SELECT media_id, t, row_number() OVER (PARTITION BY media_id) AS c FROM (SELECT DISTINCT media_id, unnest(k) AS t FROM (FROM rs UNION ALL FROM hs))),
 q AS (SELECT x.media_id, x.s, string_agg(chr(19968 + CAST(c AS INT)), '' ORDER BY i) AS k FROM (SELECT media_id, s, unnest(k) AS t, unnest(range(1, len(k) + 1)) AS i FROM rs) x JOIN v USING (media_id, t) GROUP BY 1, 2),
 p AS (SELECT x.media_id, x.s, string_agg(chr(19968 + CAST(c AS INT)), '' ORDER BY i) AS k FROM (SELECT media_id, s, unnest(k) AS t, unnest(range(1, len(k) + 1)) AS i FROM hs) x JOIN v USING (media_id, t) GROUP BY 1, 2),
 g AS MATERIALIZED (SELECT media_id, s, e, coalesce(q.k, '') AS r, coalesce(p.k, '') AS h, length(coalesce(q.k, '')) AS n, length(coalesce(p.k, '')) AS m
  FROM w LEFT JOIN q USING (media_id, s) LEFT JOIN p USING (media_id, s)),
 dp AS (SELECT media_id, s, 0::BIGINT AS d, 0::BIGINT AS i, 0::BIGINT AS a, 0::BIGINT AS x, NULL::BIGINT AS b, NULL::BIGINT AS y FROM g
  UNION ALL
  SELECT media_id, s, d, i, CASE WHEN i = 0 THEN d WHEN i = d THEN d WHEN same THEN ca ELSE least(ua, la, ca) + 1 END,
   CASE WHEN i = 0 THEN 0 WHEN i = d THEN d WHEN same THEN cx WHEN ua <= la AND ua <= ca THEN ux + 1 WHEN la <= ca THEN lx ELSE cx END, la, lx
  FROM (SELECT c.*, substr(r, CAST(i AS INT), 1) = substr(h, CAST(d - i AS INT), 1) AS same FROM (
    SELECT media_id, s, d + 1 AS d, i + o AS i, max(CASE WHEN o = 1 THEN a END) AS ua, max(CASE WHEN o = 1 THEN x END) AS ux,
     max(CASE WHEN o = 0 THEN a END) AS la, max(CASE WHEN o = 0 THEN x END) AS lx, max(CASE WHEN o = 1 THEN b END) AS ca, max(CASE WHEN o = 1 THEN y END) AS cx
    FROM dp, (SELECT unnest([0, 1]) AS o) GROUP BY media_id, s, dp.d, i + o) c JOIN g USING (media_id, s)
   WHERE i <= n AND d - i <= m))
 SELECT media_id, CASE WHEN s >= 0 THEN s END AS window_start, e AS window_end, n AS reference_tokens, m AS hypothesis_tokens, a AS distance, x AS deletions,
  x + m - n AS insertions, a - 2 * x - m + n AS substitutions, round(a / nullif(n, 0), 6) AS mixed_error_rate
 FROM dp JOIN g USING (media_id, s) WHERE d = n + m AND i = n"""


@query("transcript_windows", "AG-16 RG-14 FLT-03", REPORT)
def transcript_windows(spark, sf):
    """Two readings of each conversation, a turn being a segment of length 1: over all turns and over three windows."""
    turns = V.table(spark, sf, "conversations").select(F.col("conv_id").alias("media_id"), "turn", "text")
    lengths = turns.groupBy("media_id").agg((F.max("turn") + 1).cast("double").alias("duration"))
    at = F.col("turn").cast("double")
    first = turns.withColumns({"start": at, "end": at + 1})
    second = turns.withColumns({"start": at + 0.25, "end": at + 1.25, "text": F.expr(SECOND)})
    layout = V.measure_layout(turns, ["media_id"], F.col("turn"), 1000)
    report = transcripts.transcript_report(first, second, scoring.scoring_windows(lengths, 3.0), ["turn"], layout)
    return report.withColumn("mixed_error_rate", F.round("mixed_error_rate", 6))


@query(
    "edit_distance_names",
    "SC-05 SC-06",
    """SELECT a.p_partkey, levenshtein(a.p_name, b.p_name) AS distance, length(a.p_name) AS reference_count,
 round(levenshtein(a.p_name, b.p_name) / length(a.p_name), 6) AS error_rate FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""",
)
def edit_distance_names(spark, sf):
    names = V.table(spark, sf, "part").select("p_partkey", F.regexp_extract_all("p_name", F.lit("."), F.lit(0)).alias("reference_tokens"))
    following = names.select(
        (F.col("p_partkey") - 1).alias("p_partkey"), F.col("reference_tokens").alias("hypothesis_tokens")
    )
    scored = scoring.transcript_scores(names.join(following, "p_partkey"), ["p_partkey"])
    return scored.select(
        "p_partkey", "distance", "reference_count", F.round("error_rate", 6).alias("error_rate")
    )


@query(
    "mixed_tokens",
    "SC-02 UD-03",
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(regexp_replace(regexp_replace(text, '@[A-Za-z]+(\b)', '\1', 'g'),
   '(?i)\bxxx\b', '', 'g'), '[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)*') AS k FROM documents)
 SELECT doc_id, len(k) AS tokens, md5(lower(array_to_string(k, ' '))) AS digest FROM t""",
)
def mixed_tokens(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", X.mixed_tokens(F.col("text")).alias("k"))
    return docs.select(
        "doc_id", F.size("k").cast("bigint").alias("tokens"), F.md5(F.array_join("k", " ")).alias("digest")
    )


@query(
    "character_key",
    "SC-03 UD-03",
    r"""SELECT doc_id, md5(replace(lower(regexp_replace(regexp_replace(text, '&[A-Za-z]+[0-9]+', '', 'g'), '[\p{P}\s\x{0b}\x{85}\x{a0}#]', '', 'g')), 'ß', 'ss')) AS digest FROM documents""",
)
def character_key(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.md5(X.character_key(F.col("text"))).alias("digest"))


@query(
    "stripped_key",
    "SC-04",
    r"""SELECT conv_id, turn, md5(lower(regexp_replace(text, '[\p{P}\s\x{0b}\x{85}\x{a0}]', '', 'g'))) AS digest FROM conversations""",
)
def stripped_key(spark, sf):
    return V.table(spark, sf, "conversations").select("conv_id", "turn", F.md5(X.stripped_key(F.col("text"))).alias("digest"))


@query(
    "scalar_text_rules",
    "SC-07 SC-10 SC-19",
    r"""SELECT page_id, CASE WHEN regexp_matches(html, '[\x{4E00}-\x{9FFF}]') THEN 'Chinese' ELSE 'English' END AS language,
 coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9_.-]+', '-', 'g'), '-.'), ''), 'benchmark') AS utterance_id,
 nullif(CASE WHEN page_id % 3 = 0 THEN 'N/A' ELSE 's' || page_id % 3 END, 'N/A') AS speaker FROM pages""",
)
def scalar_text_rules(spark, sf):
    i = F.col("page_id")
    speaker = F.when(i % 3 == 0, "N/A").otherwise(F.concat(F.lit("s"), i % 3))
    return V.table(spark, sf, "pages").select(
        "page_id",
        X.script_language(F.col("html")).alias("language"),
        X.sanitized_id(F.col("url")).alias("utterance_id"),
        X.speaker_or_null(speaker).alias("speaker"),
    )


@query(
    "filler_counts",
    "SC-08 AG-24",
    r"""WITH t AS (SELECT conv_id, regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+') AS w, text FROM conversations),
 f AS (SELECT unnest(['um','uh','er','erm','hmm','like']) AS token)
 SELECT conv_id, token, CAST(sum(len(list_filter(w, lambda x: x = token))) AS BIGINT) AS occurrences FROM t, f GROUP BY 1, 2
 UNION ALL SELECT conv_id, token, CAST(sum((length(text) - length(replace(text, token, ''))) // length(token)) AS BIGINT)
 FROM t, (SELECT unnest(['呃','嗯','啊','那个','那個','就是','这个','這個']) AS token) GROUP BY 1, 2
 UNION ALL SELECT conv_id, 'you know', CAST(sum(len(regexp_extract_all(lower(text), '\byou know\b'))) AS BIGINT) FROM t GROUP BY 1, 2""",
)
def filler_counts(spark, sf):
    tokens = [t for group in X.FILLERS.values() for t in group]
    counts = F.array(
        *[F.struct(F.lit(t).alias("token"), X.filler_count(F.col("text"), t).alias("c")) for t in tokens]
    )
    return (
        V.table(spark, sf, "conversations")
        .select("conv_id", F.inline(counts))
        .groupBy("conv_id", "token")
        .agg(F.sum("c").alias("occurrences"))
    )


#: Neighbouring words that are equal but for case, with one to three separators between; of a longer run every second pair.
REPEATED = r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{M}\p{N}_'']+') AS w, regexp_split_to_array(text, '[\p{L}\p{M}\p{N}_'']+') AS s FROM documents),
 p AS (SELECT doc_id, i, w[i] AS x, w[i + 1] AS y, s[i + 1] AS g FROM (SELECT doc_id, w, s, unnest(range(1, len(w))) AS i FROM t)),
 k AS (SELECT doc_id, i, x || g || y AS span, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM p
  WHERE lower(x) = lower(y) AND regexp_full_match(x, '[a-zA-Z'']+') AND regexp_full_match(g, '[\s\x{0b}\x{85}\x{a0},.’‘-]{1,3}')),
 m AS (SELECT doc_id, span, i - min(i) OVER (PARTITION BY doc_id, run) AS o FROM k)
 SELECT doc_id, count(*) AS repetitions, min(span) AS first_span FROM m WHERE o % 2 = 0 GROUP BY 1"""


@query("repetitions", "SC-09 AG-24", REPEATED)
def repetitions(spark, sf):
    spans = F.explode(X.repetitions(F.col("text"))).alias("span")
    return V.table(spark, sf, "documents").select("doc_id", spans).groupBy("doc_id").agg(
        F.count("*").alias("repetitions"), F.min("span").alias("first_span")
    )


STATS = """WITH o AS (SELECT l_returnflag, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS r,
   count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
 SELECT l_returnflag, n, round(quantile_cont(x, 0.2), 6) AS linear_p20, max(x) FILTER (WHERE r = CAST(ceil(n * 0.95::DOUBLE) AS BIGINT) - 1) AS nearest_p95,
  max(x) FILTER (WHERE r = CAST(round_even((n - 1) * 0.1::DOUBLE, 0) AS BIGINT)) AS rounded_p10,
  max(x) FILTER (WHERE r = least(n - 1, CAST(round_even((n - 1) * 0.95::DOUBLE, 0) AS BIGINT))) AS rounded_p95,
  max(x) FILTER (WHERE r = n // 2) AS upper_median, round(median(x), 6) AS averaging_median FROM o GROUP BY 1, 2"""


@query("order_statistics", "ST-01 ST-02 ST-03 ST-04 ST-05 ST-06", STATS)
def order_statistics(spark, sf):
    lines = V.table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    layout = V.measure_layout(lines, ["l_returnflag"], F.col("l_extendedprice"), 100)
    picks = {
        "linear_p20": "linear_0.2",
        "nearest_p95": "nearest_0.95",
        "rounded_p10": "rounded_0.1",
        "rounded_p95": "rounded_0.95",
        "upper_median": "upper_median",
        "averaging_median": "median",
    }
    out = S.order_statistics(lines, ["l_returnflag"], "l_extendedprice", layout, picks)
    return out.withColumns({c: F.round(c, 6) for c in ("linear_p20", "averaging_median")})


@query(
    "delta_summary",
    "AG-20",
    """WITH d AS (SELECT l_linestatus, abs(l_quantity * 1.25::DOUBLE - l_linenumber) AS x FROM lineitem),
 o AS (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY l_linestatus) AS n FROM d)
 SELECT l_linestatus, n AS count, round_even(avg(x), 4) AS mean, round_even(max(x) FILTER (WHERE r = n // 2), 4) AS median,
  round_even(max(x) FILTER (WHERE r = least(n - 1, CAST(round_even((n - 1) * 0.95::DOUBLE, 0) AS BIGINT))), 4) AS p95, round_even(max(x), 4) AS max
 FROM o GROUP BY 1, 2""",
)
def delta_summary(spark, sf):
    deltas = V.table(spark, sf, "lineitem").select(
        "l_linestatus", F.abs(F.col("l_quantity") * 1.25 - F.col("l_linenumber")).alias("x")
    )
    layout = V.measure_layout(deltas, ["l_linestatus"], F.col("x"), 1)
    return S.delta_summary(deltas, ["l_linestatus"], "x", layout)


def repeated_runs(spark, sf):
    """Events as two repeat windows: the second copies the first, with every 37th bound moved."""
    i = F.col("seg_idx")
    base = V.valid_segments(spark, sf).where(F.col("end") <= 720 * HOUR - 1).withColumn("text", F.col("speaker"))
    moved = base.select(
        "media_id",
        (i + 100_000_000_000).alias("seg_idx"),
        (F.col("start") + 720 * HOUR).alias("start"),
        (F.col("end") + 720 * HOUR - F.when(i % 37 == 0, 1000).otherwise(0)).alias("end"),
        "speaker",
        F.when((F.col("media_id") % 5 == 0) & (i % 101 == 0), "changed").otherwise(F.col("text")).alias("text"),
    ).where(F.col("end") > F.col("start"))
    return repeats.repeat_windows(base.unionByName(moved), 720 * HOUR, 2)


REPEATS = f"""WITH {V.SEGMENTS}, {V.VALID},
 b AS (SELECT media_id, seg_idx, "start" AS s, "end" AS e, speaker, speaker AS text FROM v_val WHERE "end" <= {720 * HOUR - 1}),
 m AS (SELECT media_id, seg_idx, s, e - CASE WHEN seg_idx % 37 = 0 THEN 1000 ELSE 0 END AS e, speaker,
   CASE WHEN media_id % 5 = 0 AND seg_idx % 101 = 0 THEN 'changed' ELSE text END AS text FROM b),
 w AS (SELECT 0 AS k, * FROM b UNION ALL SELECT 1, * FROM m WHERE e > s),
 i AS (SELECT *, row_number() OVER (PARTITION BY media_id, k ORDER BY s, e, seg_idx) - 1 AS idx, count(*) OVER (PARTITION BY media_id, k) AS n FROM w)"""


@query(
    "repeat_drift",
    "CP-02",
    f"""{REPEATS}, j AS (SELECT y.media_id, y.n AS n1, x.n AS n0, x.s AS s0, y.s AS s1, x.e AS e0, y.e AS e1,
   coalesce(x.text = y.text AND x.speaker = y.speaker, false) AS same FROM (SELECT * FROM i WHERE k = 1) y
   LEFT JOIN (SELECT * FROM i WHERE k = 0) x ON x.media_id = y.media_id AND x.idx = y.idx),
 v AS (SELECT media_id, bool_and(same) AND max(n1) = (SELECT max(n) FROM i q WHERE q.media_id = j.media_id AND q.k = 0) AS pairable FROM j GROUP BY 1),
 d AS (SELECT j.media_id, unnest([abs(s0 - s1), abs(e0 - e1)]) AS x FROM j JOIN v ON v.media_id = j.media_id AND pairable),
 o AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY media_id) AS n FROM d)
 SELECT v.media_id, 1 AS window_idx, pairable, count(o.x) AS timestamps, median(o.x) AS median_drift,
  CAST(max(o.x) FILTER (WHERE r = CAST(ceil(o.n * 0.95::DOUBLE) AS BIGINT) - 1) AS DOUBLE) AS p95_drift, CAST(max(o.x) AS DOUBLE) AS maximum_drift,
  coalesce(max(o.x) <= 2000, false) AS within_tolerance FROM v LEFT JOIN o ON o.media_id = v.media_id GROUP BY 1, 2, 3""",
)
def repeat_drift(spark, sf):
    layout = V.events_layout(spark, sf)
    out = repeats.paired_drift(repeated_runs(spark, sf), 2000, layout)
    return out.withColumns(
        {c: F.col(c).cast("double") for c in ("median_drift", "p95_drift", "maximum_drift")}
    )


@query(
    "repeat_fingerprints_equal",
    "CP-01 SC-15",
    f"""{REPEATS}, l AS (SELECT media_id, k, string_agg(s || '/' || e || '/' || speaker || '/' || text, ',' ORDER BY s, e, seg_idx) AS f,
   string_agg(text, ',' ORDER BY s, e, seg_idx) AS t FROM i GROUP BY 1, 2)
 SELECT media_id, count(DISTINCT f) = 1 AS all_segments_equal, count(DISTINCT t) = 1 AS all_texts_equal FROM l GROUP BY 1""",
)
def repeat_fingerprints_equal(spark, sf):
    layout = V.events_layout(spark, sf)
    return repeats.fingerprints_agree(repeats.window_fingerprints(repeated_runs(spark, sf), layout))


@query(
    "ordered_transcripts",
    "AG-18",
    """SELECT conv_id AS media_id, role AS speaker, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1, 2
 UNION ALL SELECT conv_id, NULL, string_agg(text, ' ' ORDER BY turn) FROM conversations GROUP BY 1""",
)
def ordered_transcripts(spark, sf):
    turns = V.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("media_id"), F.col("role").alias("speaker"), "turn", "text"
    )
    layout = V.measure_layout(turns, ["media_id"], F.col("turn"), 1000)
    # The chronological text and the per-speaker texts are the two levels of one grouping set.
    levels = turns.withColumn("speaker", F.explode(F.array(F.col("speaker"), F.lit(None).cast("string"))))
    return I.ordered_text(levels, ["media_id", "speaker"], ["turn"], " ", layout)


@query(
    "token_sequence_comparison",
    "CP-03",
    r"""WITH a AS (SELECT conv_id, turn, regexp_split_to_array(text, '\s+') AS w, text FROM conversations),
 b AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN list_transform(w, lambda x: x || '!') ELSE w END AS w FROM a WHERE turn % 5 <> 4)
 SELECT a.conv_id, count(*) AS paired, count(*) FILTER (WHERE a.w = b.w) AS identical, count(*) FILTER (WHERE a.w <> b.w) AS differing,
  count(*) FILTER (WHERE len(a.w) <> len(b.w)) AS count_mismatch,
  count(*) FILTER (WHERE lower(regexp_replace(array_to_string(b.w, ''), '[\p{P}\s]', '', 'g')) <> lower(regexp_replace(a.text, '[\p{P}\s]', '', 'g'))) AS invariant_violations
 FROM a JOIN b USING (conv_id, turn) GROUP BY 1""",
)
def token_sequence_comparison(spark, sf):
    turns = V.table(spark, sf, "conversations").select(
        F.col("conv_id"), "turn", F.split("text", r"\s+").alias("words"), "text"
    )
    punctuated = F.when(F.col("turn") % 3 == 0, F.transform("words", lambda x: F.concat(x, F.lit("!")))).otherwise(F.col("words"))
    other = turns.where("turn % 5 <> 4").select("conv_id", "turn", punctuated.alias("other_words"))
    return C.token_sequences(turns.join(other, ["conv_id", "turn"]), ["conv_id"])


def delta_sql(bound: str) -> str:
    """count, mean, upper median, capped rounded p95 and maximum of a column x ranked by r among n."""
    pick = lambda rank: f"round_even(max(x) FILTER (WHERE bound = '{bound}' AND r = {rank}), 4)"
    return f"""max(n) FILTER (WHERE bound = '{bound}') AS {bound}_count, round_even(avg(x) FILTER (WHERE bound = '{bound}'), 4) AS {bound}_mean,
   {pick("n // 2")} AS {bound}_median, {pick("least(n - 1, CAST(round_even((n - 1) * 0.95::DOUBLE, 0) AS BIGINT))")} AS {bound}_p95,
   round_even(max(x) FILTER (WHERE bound = '{bound}'), 4) AS {bound}_max"""


@query(
    "word_bound_deltas",
    "CP-03 AG-20",
    rf"""WITH w AS (SELECT conv_id, turn, len(regexp_split_to_array(text, '\s+')) AS n FROM conversations),
 p AS (SELECT conv_id, turn, unnest(range(n)) AS k FROM w WHERE turn % 4 <> 3),
 d AS (SELECT conv_id, 'start' AS bound, (k * (turn + 2)) % 37 * 10 AS x FROM p UNION ALL SELECT conv_id, 'end', (k * (turn + 2)) % 37 * 10 + 5 * (k % 3) FROM p),
 o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, bound ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY conv_id, bound) AS n FROM d)
 SELECT conv_id, {delta_sql("start")}, {delta_sql("end")} FROM o GROUP BY 1""",
)
def word_bound_deltas(spark, sf):
    """Words of each turn, and a second alignment of them that is late; of every fourth turn it lacks a word."""
    turns = V.table(spark, sf, "conversations")
    places = F.sequence(F.lit(0).cast("bigint"), F.size(F.split("text", r"\s+")).cast("bigint") - 1)
    late = lambda k: (k * (F.col("turn") + 2)) % 37 * 10
    pairs = turns.select("conv_id", "turn", places.alias("k")).select(
        "conv_id",
        F.transform("k", lambda k: k * 400).alias("starts"),
        F.transform("k", lambda k: k * 400 + 300).alias("ends"),
        F.transform("k", lambda k: k * 400 + late(k)).alias("s"),
        F.transform("k", lambda k: k * 400 + 300 + late(k) + 5 * (k % 3)).alias("e"),
        (F.col("turn") % 4 == 3).alias("short"),
    )
    less = lambda c: F.when(F.col("short"), F.slice(c, 2, F.size(c))).otherwise(F.col(c))
    both = pairs.select("conv_id", "starts", "ends", less("s").alias("other_starts"), less("e").alias("other_ends"))
    layout = V.measure_layout(turns, ["conv_id"], F.col("turn"), 1)
    return C.word_bound_deltas(both, ["conv_id"], layout)


@query(
    "segment_text_comparison",
    "CP-04 SC-15 AG-20",
    f"""WITH a AS (SELECT conv_id AS media_id, turn AS seg_idx, turn * 1000 AS "start", turn * 1000 + 900 AS "end", role AS speaker, text FROM conversations),
 b AS (SELECT media_id, seg_idx, "start" + CASE WHEN media_id % 2 = 0 THEN seg_idx % 4 * 10 ELSE 0 END AS "start", "end" + CASE WHEN media_id % 2 = 0 THEN seg_idx % 3 * 20 ELSE 0 END AS "end",
   speaker, CASE WHEN media_id % 3 = 0 AND seg_idx % 3 = 1 THEN text || '.' ELSE text END AS text FROM a WHERE media_id % 5 <> 4 OR seg_idx <> 2),
 x AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY "start", "end", seg_idx) AS i, sha256(to_json({{'end': "end", 'speaker': speaker, 'start': "start", 'text': text}})) AS h FROM a),
 y AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY "start", "end", seg_idx) AS i, sha256(to_json({{'end': "end", 'speaker': speaker, 'start': "start", 'text': text}})) AS h FROM b),
 xs AS (SELECT media_id, count(*) AS left_segments, sha256(string_agg(h, '' ORDER BY i)) AS left_sha256 FROM x GROUP BY 1),
 ys AS (SELECT media_id, count(*) AS right_segments, sha256(string_agg(h, '' ORDER BY i)) AS right_sha256 FROM y GROUP BY 1),
 z AS (SELECT x.media_id, abs(x."start" - y."start") AS s, abs(x."end" - y."end") AS e, x.text = y.text AS t, x.speaker = y.speaker AS k FROM x JOIN y USING (media_id, i)),
 m AS (SELECT media_id, count(*) AS paired, count(*) FILTER (WHERE t) AS identical_text, count(*) FILTER (WHERE k) AS identical_speaker FROM z GROUP BY 1),
 d AS (SELECT media_id, 'start' AS bound, s AS x FROM z UNION ALL SELECT media_id, 'end', e FROM z),
 o AS (SELECT *, row_number() OVER (PARTITION BY media_id, bound ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY media_id, bound) AS n FROM d),
 q AS (SELECT media_id, {delta_sql("start")}, {delta_sql("end")} FROM o GROUP BY 1)
 SELECT *, left_segments = right_segments AS segment_count_matches, left_sha256 = right_sha256 AS digest_matches,
  left_segments = right_segments AND identical_text = paired AS text_sequences_identical FROM xs JOIN ys USING (media_id) JOIN m USING (media_id) JOIN q USING (media_id)""",
)
def segment_text_comparison(spark, sf):
    """Conversations as segmentations, and a second one of each: every second one late, some with other texts, some short."""
    media, k = F.col("media_id"), F.col("seg_idx")
    turns = V.table(spark, sf, "conversations")
    first = turns.select(
        F.col("conv_id").alias("media_id"),
        F.col("turn").alias("seg_idx"),
        (F.col("turn") * 1000).alias("start"),
        (F.col("turn") * 1000 + 900).alias("end"),
        F.col("role").alias("speaker"),
        "text",
    )
    late = media % 2 == 0
    second = first.where((media % 5 != 4) | (k != 2)).withColumns(
        {
            "start": F.col("start") + F.when(late, k % 4 * 10).otherwise(0),
            "end": F.col("end") + F.when(late, k % 3 * 20).otherwise(0),
            "text": F.when((media % 3 == 0) & (k % 3 == 1), F.concat("text", F.lit("."))).otherwise(F.col("text")),
        }
    )
    layout = V.measure_layout(first, ["media_id"], F.col("start"), 100_000)
    return C.segment_texts(first, second, layout)


@query(
    "segment_sequence_comparison",
    "CP-04 AG-26",
    f"""WITH {SEG}, a AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY "start", "end", seg_idx) - 1 AS idx FROM v_val),
 b AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY "start", "end", seg_idx) - 1 AS idx FROM v_hyp),
 z AS (SELECT a.media_id, count(*) AS paired, count(*) FILTER (WHERE substr(a.speaker, 1, 2) = substr(b.speaker, 3, 2)) AS same_speaker,
   max(abs(a."start" - b."start")) AS max_start_delta, max(abs(a."end" - b."end")) AS max_end_delta FROM a JOIN b USING (media_id, idx) GROUP BY 1),
 l AS (SELECT media_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT speaker)), ',') AS labels, max("end") AS last_end FROM v_val GROUP BY 1),
 r AS (SELECT media_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT speaker)), ',') AS labels, max("end") AS last_end FROM v_hyp GROUP BY 1)
 SELECT l.media_id, l.n AS left_segments, r.n AS right_segments, l.n = r.n AS segment_count_matches, paired, same_speaker, max_start_delta, max_end_delta,
  l.labels AS left_labels, r.labels AS right_labels, round(l.last_end / total, 4) AS left_last_end_ratio, round(r.last_end / total, 4) AS right_last_end_ratio
 FROM l JOIN r USING (media_id) JOIN z USING (media_id) JOIN v_tot USING (media_id)""",
)
def segment_sequence_comparison(spark, sf):
    layout = V.events_layout(spark, sf)
    left = V.valid_segments(spark, sf)
    right = V.hypothesis(spark, sf)
    out = C.segment_sequences(left, right, F.substring("speaker", 1, 2), F.substring("speaker_r", 3, 2), durations(spark, sf), layout)
    return out.withColumns({c: F.array_join(c, ",") for c in ("left_labels", "right_labels")})


@query(
    "run_differences",
    "CP-05",
    """WITH r AS (SELECT conv_id, role, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS turns, max(text) AS latest FROM conversations GROUP BY 1, 2)
 SELECT a.conv_id, m.metric, m.x AS off_value, m.y AS on_value, m.y - m.x AS delta, round(100 * (m.y - m.x) / nullif(m.x, 0), 6) AS percent, a.latest = b.latest AS same_output
 FROM r a JOIN r b ON a.conv_id = b.conv_id AND a.role = 'user' AND b.role = 'assistant',
 LATERAL (SELECT 'chars' AS metric, a.chars AS x, b.chars AS y UNION ALL SELECT 'turns', a.turns, b.turns) m""",
)
def run_differences(spark, sf):
    runs = V.table(spark, sf, "conversations").groupBy("conv_id", F.col("role").alias("run")).agg(
        F.sum(F.length("text")).alias("chars"), F.count("*").alias("turns"), F.sha2(F.max("text"), 256).alias("digest")
    )
    out = C.run_differences(runs, ["conv_id"], "run", "user", "assistant", ["chars", "turns"], "digest")
    return out.withColumn("percent", F.round("percent", 6))
