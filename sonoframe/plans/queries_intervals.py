"""Filters, joins, sets and orderings over the derived interval tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonoframe.operators import intervals as I
from sonoframe.operators import quality, repeats, scheduling, scoring
from sonoframe.operators import regions as R
from sonoframe.operators import timeline as T
from sonoframe.operators.scan import lag, running
from sonoframe.plans import views as V
from sonoframe.plans.queries_regions import TURN_GAP, TURN_MIN, TURNS, plan_parts
from sonoframe.plans.registry import query
from sonoframe.plans.views import HOUR
from sonoframe.session import cut

CLIP = (100 * HOUR, 400 * HOUR)
SEG = f"WITH {V.SEGMENTS}, {V.VALID}"


@query(
    "clip_contained",
    "FLT-01",
    f"""{SEG} SELECT media_id, seg_idx, "start" - {CLIP[0]} AS "start", "end" - {CLIP[0]} AS "end", speaker,
 "start" AS source_start, "end" AS source_end FROM v_val WHERE "start" >= {CLIP[0]} AND "end" <= {CLIP[1]}""",
)
def clip_contained(spark, sf):
    return I.contained_in_clip(V.valid_segments(spark, sf), *CLIP)


@query(
    "window_clamped",
    "FLT-02",
    f"""{SEG} SELECT media_id, seg_idx, greatest("start", {CLIP[0]}) - {CLIP[0]} AS "start",
 least("end", {CLIP[1]}) - {CLIP[0]} AS "end", speaker FROM v_val WHERE "start" < {CLIP[1]} AND "end" > {CLIP[0]}""",
)
def window_clamped(spark, sf):
    return I.clamped_to_window(V.valid_segments(spark, sf), *CLIP)


PERIOD = 240 * HOUR


@query(
    "repeat_interval_counts",
    "CP-07 FLT-02",
    f"""{SEG} SELECT t.media_id, w AS half, count(v.seg_idx) AS intervals FROM v_tot t CROSS JOIN (SELECT unnest([0, 1]) AS w)
 LEFT JOIN v_val v ON v.media_id = t.media_id AND v."start" < (w + 1) * {PERIOD} AND v."end" > w * {PERIOD} GROUP BY 1, 2""",
)
def repeat_interval_counts(spark, sf):
    """Intervals that meet each half of a repeated recording; a half without any has a row too."""
    return I.repeat_counts(V.valid_segments(spark, sf), V.totals(spark, sf), PERIOD)


@query(
    "text_in_window",
    "FLT-03",
    """SELECT conv_id AS media_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations
 WHERE turn < 4 AND turn + 1 > 1 GROUP BY conv_id""",
)
def text_in_window(spark, sf):
    turns = V.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("media_id"), F.col("turn").alias("start"), (F.col("turn") + 1).alias("end"), "text"
    )
    layout = V.measure_layout(turns, ["media_id"], F.col("start"), 1000)
    inside = turns.where((F.col("end") > 1) & (F.col("start") < 4))
    return I.ordered_text(inside, ["media_id"], ["start"], " ", layout)


@query(
    "boundary_crossing",
    "FLT-04",
    f"""{SEG} SELECT media_id, seg_idx, b.boundary, speaker FROM v_val JOIN
 (SELECT unnest([{CLIP[0]}, {CLIP[1]}]) AS boundary) b ON "start" < b.boundary AND b.boundary < "end" """,
)
def boundary_crossing(spark, sf):
    return I.crossing(V.valid_segments(spark, sf), CLIP).select("media_id", "seg_idx", "boundary", "speaker")


@query(
    "single_label",
    "FLT-05",
    f"""{SEG} SELECT media_id, seg_idx, "start", "end" FROM v_val WHERE speaker = 'click'""",
)
def single_label(spark, sf):
    return V.valid_segments(spark, sf).where("speaker = 'click'").drop("speaker")


@query(
    "control_labels_dropped",
    "FLT-06 FLT-11",
    r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ' [' || source || '] ' WHEN doc_id % 7 = 0 THEN '  ' ELSE text END AS text FROM documents)
 SELECT doc_id, length(text) AS chars FROM t WHERE NOT regexp_matches(text, '^\s*\[[^\]]+\]\s*$') AND length(trim(text)) > 0""",
)
def control_labels_dropped(spark, sf):
    docs = V.table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" ["), "source", F.lit("] ")))
        .when(F.col("doc_id") % 7 == 0, "  ")
        .otherwise(F.col("text"))
        .alias("text"),
    )
    return I.without_control_labels(docs).where("length(trim(text)) > 0").select(
        "doc_id", F.length("text").cast("bigint").alias("chars")
    )


@query(
    "minimum_length_split",
    "FLT-07",
    f"""{SEG} SELECT media_id, CASE WHEN "end" - "start" >= 600000000 THEN 'kept' ELSE 'filtered' END AS grain,
 count(*) AS n, CAST(sum("end" - "start") AS BIGINT) AS total FROM v_val GROUP BY 1, 2""",
)
def minimum_length_split(spark, sf):
    graded = T.split_by_length(V.valid_segments(spark, sf), 600_000_000)
    return graded.groupBy("media_id", "grain").agg(
        F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("total")
    )


RAW_BOUNDS = """v_raw AS (SELECT user_id AS media_id, event_id AS seg_idx,
 CASE WHEN event_id % 13 = 0 THEN 'oops' WHEN event_id % 17 = 0 THEN 'NaN' WHEN event_id % 19 = 0 THEN 'Infinity'
   ELSE CAST(value AS VARCHAR) END AS start_s,
 CAST(value + event_id % 23 - 2 AS VARCHAR) AS end_s,
 CASE WHEN event_id % 29 = 0 THEN NULL ELSE event_type END AS speaker, 60 * 16000 AS total FROM events)"""


@query(
    "interval_normalisation",
    "FLT-08",
    f"""WITH {RAW_BOUNDS}, p AS (SELECT *, try_cast(start_s AS DOUBLE) AS s, try_cast(end_s AS DOUBLE) AS e FROM v_raw),
 q AS (SELECT *, s IS NULL OR e IS NULL OR speaker IS NULL AS bad, coalesce(isfinite(s) AND isfinite(e), false) AS fin FROM p),
 b AS (SELECT *, CASE WHEN NOT bad AND fin THEN CAST(greatest(0, least(total, round_even(s * 16000, 0))) AS BIGINT) END AS st,
   CASE WHEN NOT bad AND fin THEN CAST(greatest(0, least(total, round_even(e * 16000, 0))) AS BIGINT) END AS en FROM q)
 SELECT media_id, seg_idx, st AS "start", en AS "end", speaker,
  CASE WHEN bad THEN 'invalid_fields' WHEN NOT fin THEN 'nonfinite_bounds' WHEN en <= st THEN 'empty_after_crop' END AS reason FROM b""",
)
def interval_normalisation(spark, sf):
    i = F.col("event_id")
    raw = V.table(spark, sf, "events").select(
        F.col("user_id").alias("media_id"),
        i.alias("seg_idx"),
        F.when(i % 13 == 0, "oops")
        .when(i % 17 == 0, "NaN")
        .when(i % 19 == 0, "Infinity")
        .otherwise(F.col("value").cast("string"))
        .alias("start_s"),
        (F.col("value") + i % 23 - 2).cast("string").alias("end_s"),
        F.when(i % 29 != 0, F.col("event_type")).alias("speaker"),
        F.lit(60 * 16000).cast("bigint").alias("total"),
    )
    return T.normalize_intervals(raw, 16000).select(
        "media_id", "seg_idx", "start", "end", "speaker", "reason"
    )


@query(
    "tier_join",
    "JN-01 SE-04",
    """WITH t AS (SELECT user_id AS media_id, event_id // 2 AS interval_id, 'characters' AS tier, event_type AS value FROM events WHERE event_id % 2 = 0
  UNION ALL SELECT user_id, event_id // 2, 'words', event_type FROM events WHERE event_id % 2 = 0 AND event_id % 20 <> 4
  UNION ALL SELECT user_id, event_id // 2, 'words', event_type FROM events WHERE event_id % 50 = 10
  UNION ALL SELECT user_id, event_id // 2, 'romanised', event_type FROM events WHERE event_id % 2 = 0 AND event_id % 30 <> 8)
 SELECT media_id, interval_id, max(value) FILTER (WHERE tier = 'characters') AS characters_value,
  max(value) FILTER (WHERE tier = 'words') AS words_value, max(value) FILTER (WHERE tier = 'romanised') AS romanised_value,
  CASE WHEN count(DISTINCT tier) < 3 THEN 'missing_tier' WHEN count(*) > 3 THEN 'duplicate_interval' ELSE 'ok' END AS status
 FROM t GROUP BY 1, 2""",
)
def tier_join(spark, sf):
    events = V.table(spark, sf, "events").select(
        F.col("user_id").alias("media_id"),
        F.floor(F.col("event_id") / 2).cast("bigint").alias("interval_id"),
        F.col("event_type").alias("value"),
        F.col("event_id").alias("e"),
    )
    even = F.col("e") % 2 == 0
    placed = F.array(
        F.when(even, F.lit("characters")),
        F.when(even & (F.col("e") % 20 != 4), F.lit("words")),
        F.when(F.col("e") % 50 == 10, F.lit("words")),
        F.when(even & (F.col("e") % 30 != 8), F.lit("romanised")),
    )
    tiers = events.select("media_id", "interval_id", "value", F.explode(F.array_compact(placed)).alias("tier"))
    names = ["characters", "words", "romanised"]
    joined = I.tier_join(tiers, ["media_id", "interval_id"], names)
    return joined.drop(*[f"{n}_count" for n in names])


@query(
    "slot_lookup",
    "JN-02",
    """SELECT l_orderkey, l_linenumber, l_suppkey, a.p_size AS start_time, b.p_size AS end_time,
  a.p_size IS NOT NULL AND b.p_size IS NOT NULL AS resolved
 FROM lineitem LEFT JOIN part a ON a.p_partkey = l_partkey
 LEFT JOIN part b ON b.p_partkey = l_partkey + CAST(l_quantity AS BIGINT)""",
)
def slot_lookup(spark, sf):
    slots = V.table(spark, sf, "part").select(F.col("p_partkey").alias("slot"), F.col("p_size").alias("time"))
    notes = V.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        F.col("l_partkey").alias("start_ref"),
        (F.col("l_partkey") + F.col("l_quantity").cast("bigint")).alias("end_ref"),
    )
    return I.resolve_slots(notes, slots).select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        F.col("start").alias("start_time"),
        F.col("end").alias("end_time"),
        "resolved",
    )


GRID = 6 * HOUR
FRAME_SETS = f"""{SEG}, fr AS (SELECT media_id, f AS frame_idx, f * {GRID} + {GRID // 2} AS t FROM (SELECT media_id, unnest(range(total // {GRID})) AS f FROM v_tot))
 SELECT fr.media_id, frame_idx, coalesce(string_agg(DISTINCT speaker, ',' ORDER BY speaker), '') AS speakers
 FROM fr LEFT JOIN v_val s ON s.media_id = fr.media_id AND s."start" <= t AND t < s."end" GROUP BY 1, 2"""


@query("frame_label_sets", "JN-03 TL-03", FRAME_SETS)
def frame_label_sets(spark, sf):
    layout = V.events_layout(spark, sf)
    segs = V.valid_segments(spark, sf)
    totals = V.totals(spark, sf)
    layered = segs.select(
        "media_id", F.lit("speaker").alias("layer"), F.col("speaker").alias("label"), "start", "end"
    )
    ranks = T.label_ranks(layered)
    words = T.word_count(ranks)
    edges = totals.select("media_id", F.explode(F.array(F.lit(0).cast("bigint"), "total")).alias("at"))
    spans = T.sweep(layered, ["speaker"], layout, ranks, words, edges).where("end IS NOT NULL")
    last = F.floor(F.col("total") / GRID) - 1

    def before(x):
        return F.floor((2 * F.col(x) + F.lit(GRID - 1)) / F.lit(2 * GRID)).cast("bigint")

    framed = (
        spans.join(totals, "media_id")
        .withColumns({"_a": before("start"), "_b": F.least(before("end") - 1, last)})
        .where("_b >= _a")
        .withColumn("frame_idx", F.explode(F.sequence("_a", "_b")))
    )
    labels = T.ranked_labels(ranks, "speaker")
    return framed.join(labels, "media_id", "left").select(
        "media_id",
        "frame_idx",
        F.coalesce(F.array_join(T.label_array("speaker", words), ","), F.lit("")).alias("speakers"),
    )


CLUSTERS = """cl AS (SELECT media_id, min("start") AS s, max("end") AS e FROM (
  SELECT *, sum(n) OVER (PARTITION BY media_id ORDER BY "start", "end", seg_idx) AS i FROM (
   SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY media_id ORDER BY "start", "end", seg_idx
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM v_val WHERE seg_idx % 3 = 0)) GROUP BY media_id, i)"""


def clusters_of(spark, sf, layout):
    third = V.valid_segments(spark, sf).where("seg_idx % 3 = 0").select("media_id", "start", "end")
    return R.merge_intervals(third, ["media_id"], layout)


@query(
    "cluster_bounds",
    "JN-04",
    f"""{SEG}, {V.HYPOTHESIS}, {CLUSTERS} SELECT h.media_id, h.seg_idx, min(s) AS first_start, max(e) AS last_end
 FROM v_hyp h LEFT JOIN cl ON cl.media_id = h.media_id AND cl.s < h."end" AND cl.e > h."start" GROUP BY 1, 2""",
)
def cluster_bounds(spark, sf):
    layout = V.events_layout(spark, sf)
    out = I.cluster_bounds(V.hypothesis(spark, sf), clusters_of(spark, sf, layout), layout, "seg_idx")
    return out.select("media_id", "seg_idx", "first_start", "last_end")


@query(
    "overlap_flag",
    "JN-05",
    f"""{SEG}, {V.HYPOTHESIS} SELECT media_id, seg_idx, EXISTS (SELECT 1 FROM v_val v WHERE v.media_id = h.media_id
 AND v.seg_idx % 3 = 0 AND v."start" < h."end" AND v."end" > h."start") AS overlaps FROM v_hyp h""",
)
def overlap_flag(spark, sf):
    layout = V.events_layout(spark, sf)
    out = I.cluster_bounds(V.hypothesis(spark, sf), clusters_of(spark, sf, layout), layout, "seg_idx")
    return out.select("media_id", "seg_idx", F.col("first_start").isNotNull().alias("overlaps"))


@query(
    "cross_speaker_overlaps",
    "JN-06",
    f"""{SEG} SELECT a.media_id, a.seg_idx AS left_id, b.seg_idx AS right_id, greatest(a."start", b."start") AS "start",
 least(a."end", b."end") AS "end", least(a."end", b."end") - greatest(a."start", b."start") AS duration,
 least(a.speaker, b.speaker) || ',' || greatest(a.speaker, b.speaker) AS speakers
 FROM v_val a JOIN v_val b ON a.media_id = b.media_id AND a.speaker <> b.speaker AND a."start" < b."end" AND a."end" > b."start"
 AND (a."start", a."end", a.speaker, a.seg_idx) < (b."start", b."end", b.speaker, b.seg_idx)""",
)
def cross_speaker_overlaps(spark, sf):
    pairs = I.cross_speaker_overlaps(V.valid_segments(spark, sf), 4 * HOUR)
    return pairs.withColumn("speakers", F.array_join("speakers", ","))


@query(
    "nearest_neighbours",
    "JN-07",
    f"""{SEG}, {V.HYPOTHESIS} SELECT media_id, seg_idx,
 (SELECT max(v."end") FROM v_val v WHERE v.media_id = h.media_id AND v.seg_idx % 3 = 0 AND v."end" <= h."start") AS preceding_end,
 (SELECT min(v."start") FROM v_val v WHERE v.media_id = h.media_id AND v.seg_idx % 3 = 0 AND v."start" >= h."end") AS following_start
 FROM v_hyp h""",
)
def nearest_neighbours(spark, sf):
    layout = V.events_layout(spark, sf)
    others = V.valid_segments(spark, sf).where("seg_idx % 3 = 0")
    out = I.neighbour_bounds(V.hypothesis(spark, sf), others, layout, "seg_idx")
    return out.select("media_id", "seg_idx", "preceding_end", "following_start")


@query(
    "collar_exclusion",
    "JN-08",
    f"""{SEG}, bd AS (SELECT media_id, "start" AS b FROM v_val UNION SELECT media_id, "end" FROM v_val),
 pt AS (SELECT user_id AS media_id, event_id, epoch_us(ts) - 1704067200000000 + 1800000000 AS "at" FROM events)
 SELECT media_id, event_id, pt."at" FROM pt WHERE NOT EXISTS
  (SELECT 1 FROM bd WHERE bd.media_id = pt.media_id AND abs(pt."at" - bd.b) < 900000000)""",
)
def collar_exclusion(spark, sf):
    layout = V.events_layout(spark, sf)
    segs = V.valid_segments(spark, sf)
    bounds = segs.select("media_id", F.explode(F.array("start", "end")).alias("boundary")).distinct()
    points = V.events_us(spark, sf).select(
        F.col("user_id").alias("media_id"), "event_id", (F.col("us") + 1_800_000_000).alias("at")
    )
    return I.outside_collars(points, bounds, 900_000_000, layout)


def turn_starts(source: str) -> str:
    """Starts of segments whose speaker differs from the previous one's, numbered in order."""
    return f"""SELECT media_id, "start" AS p, row_number() OVER (PARTITION BY media_id ORDER BY "start") AS k FROM (
   SELECT media_id, "start", speaker, lag(speaker) OVER (PARTITION BY media_id ORDER BY "start", "end", seg_idx) AS q FROM {source}) WHERE q <> speaker"""


#: One hypothesis boundary of every recording at a time: the nearest reference boundary that none has taken.
GREEDY = f"""WITH RECURSIVE {V.SEGMENTS}, {V.VALID}, {V.HYPOTHESIS}, br AS MATERIALIZED ({turn_starts("v_val")}), bh AS MATERIALIZED ({turn_starts("v_hyp")}),
 gs AS (SELECT DISTINCT media_id, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS err FROM bh
  UNION ALL SELECT media_id, k, CASE WHEN b IS NULL THEN used ELSE list_append(used, b.j) END, b.e FROM (
   SELECT gs.media_id, bh.k, any_value(used) AS used, min(CASE WHEN br.k IS NOT NULL THEN {{'e': abs(br.p - bh.p), 'j': br.k}} END) AS b
   FROM gs JOIN bh ON bh.media_id = gs.media_id AND bh.k = gs.k + 1
   LEFT JOIN br ON br.media_id = gs.media_id AND abs(br.p - bh.p) <= 120000000 AND NOT list_contains(used, br.k) GROUP BY 1, 2))"""


@query(
    "greedy_boundary_matches",
    "JN-09 UD-05",
    f"""{GREEDY} SELECT media_id, count(*) AS matched, max(err) AS largest_error FROM gs WHERE err IS NOT NULL GROUP BY 1""",
)
def greedy_boundary_matches(spark, sf):
    layout = V.events_layout(spark, sf)
    reference = I.change_boundaries(V.valid_segments(spark, sf), layout)
    found = I.change_boundaries(V.hypothesis(spark, sf), layout)
    return I.match_boundaries(reference, found, 120_000_000, layout).groupBy("media_id").agg(
        F.sum("matches").alias("matched"), F.max("error").alias("largest_error")
    )


@query(
    "greedy_interval_matches",
    "JN-10 UD-05",
    f"""WITH RECURSIVE {V.SEGMENTS}, {V.VALID}, {V.HYPOTHESIS}, tl AS (SELECT unnest([60000000, 180000000])::BIGINT AS tol),
 ir AS MATERIALIZED (SELECT media_id, substr(speaker, 1, 2) AS sp, "start" AS s, "end" AS e, row_number() OVER (PARTITION BY media_id, substr(speaker, 1, 2) ORDER BY "start", "end", seg_idx) AS k FROM v_val),
 ih AS MATERIALIZED (SELECT media_id, substr(speaker, 3, 2) AS sp, "start" AS s, "end" AS e, row_number() OVER (PARTITION BY media_id, substr(speaker, 3, 2) ORDER BY "start", "end", seg_idx) AS k FROM v_hyp),
 gs AS (SELECT DISTINCT media_id, sp, tol, 0::BIGINT AS k, []::BIGINT[] AS used, false AS met FROM ir, tl
  UNION ALL SELECT media_id, sp, tol, k, CASE WHEN b IS NULL THEN used ELSE list_append(used, b.j) END, b IS NOT NULL FROM (
   SELECT gs.media_id, gs.sp, tol, ir.k, any_value(used) AS used, min(CASE WHEN ih.k IS NOT NULL THEN {{'c': abs(ih.s - ir.s) + abs(ih.e - ir.e), 'j': ih.k}} END) AS b
   FROM gs JOIN ir ON ir.media_id = gs.media_id AND ir.sp = gs.sp AND ir.k = gs.k + 1
   LEFT JOIN ih ON ih.media_id = gs.media_id AND ih.sp = gs.sp AND abs(ih.s - ir.s) <= tol AND abs(ih.e - ir.e) <= tol AND NOT list_contains(used, ih.k) GROUP BY 1, 2, 3, 4))
 SELECT m.media_id, tol AS tolerance, count(*) FILTER (WHERE gs.met) AS matched FROM (SELECT media_id FROM v_val UNION SELECT media_id FROM v_hyp) m CROSS JOIN tl
  LEFT JOIN gs USING (media_id, tol) GROUP BY 1, 2""",
)
def greedy_interval_matches(spark, sf):
    layout = V.events_layout(spark, sf)
    reference = V.valid_segments(spark, sf).withColumn("speaker", F.substring("speaker", 1, 2))
    found = V.hypothesis(spark, sf).withColumn("speaker", F.substring("speaker", 3, 2))
    return I.match_intervals(reference, found, [60_000_000, 180_000_000], layout)


@query(
    "zip_by_index",
    "JN-11",
    f"""{SEG}, {V.HYPOTHESIS}, a AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY "start", "end", seg_idx) - 1 AS idx FROM v_val),
 b AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY "start", "end", seg_idx) - 1 AS idx FROM v_hyp)
 SELECT a.media_id, a.idx, a.seg_idx, b.seg_idx AS seg_idx_r, abs(a."start" - b."start") AS start_delta, abs(a."end" - b."end") AS end_delta
 FROM a JOIN b ON a.media_id = b.media_id AND a.idx = b.idx""",
)
def zip_by_index(spark, sf):
    layout = V.events_layout(spark, sf)
    pairs = I.zip_by_index(
        V.valid_segments(spark, sf), V.hypothesis(spark, sf), ["start", "end", "seg_idx"], layout
    )
    return pairs.select(
        "media_id",
        "idx",
        "seg_idx",
        "seg_idx_r",
        F.abs(F.col("start") - F.col("start_r")).alias("start_delta"),
        F.abs(F.col("end") - F.col("end_r")).alias("end_delta"),
    )


@query(
    "lookup_with_default",
    "JN-13",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(s_acctbal, 0.0) AS gain FROM lineitem LEFT JOIN supplier
 ON s_suppkey = l_suppkey + 1""",
)
def lookup_with_default(spark, sf):
    gains = V.table(spark, sf, "supplier").select((F.col("s_suppkey") - 1).alias("l_suppkey"), F.col("s_acctbal").alias("gain"))
    lines = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return lines.join(gains, "l_suppkey", "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))


@query(
    "missing_members",
    "JN-16",
    "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
)
def missing_members(spark, sf):
    ready = V.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return V.table(spark, sf, "customer").select("c_custkey").join(ready, "c_custkey", "left_anti")


@query(
    "speaker_changes",
    "RG-11",
    f"""{SEG} SELECT media_id, boundary FROM (SELECT media_id, "start" AS boundary, speaker,
 lag(speaker) OVER (PARTITION BY media_id ORDER BY "start", "end", seg_idx) AS p FROM v_val) WHERE p <> speaker""",
)
def speaker_changes(spark, sf):
    return I.change_boundaries(V.valid_segments(spark, sf), V.events_layout(spark, sf))


@query(
    "active_set_transitions",
    "RG-12 AG-25",
    FRAME_SETS.replace("SELECT fr.media_id, frame_idx", ", sets AS (SELECT fr.media_id, frame_idx", 1)
    + """) SELECT media_id, frame_idx FROM (SELECT *, lag(speakers) OVER (PARTITION BY media_id ORDER BY frame_idx) AS p FROM sets)
 WHERE p <> speakers""",
)
def active_set_transitions(spark, sf):
    layout = V.events_layout(spark, sf)
    sets = frame_label_sets(spark, sf)
    frames = V.tightened(layout, GRID)
    seen = running(sets, ["media_id"], ["frame_idx"], frames, _p=lag(F.col("speakers")))
    return seen.where("_p <> speakers").select("media_id", "frame_idx")


@query(
    "segment_ids",
    "RG-13 SO-01",
    f"""{SEG} SELECT media_id, seg_idx, 'seg-' || lpad(CAST(row_number() OVER (PARTITION BY media_id
 ORDER BY "start", "end", speaker, seg_idx) AS VARCHAR), 4, '0') AS region_id FROM v_val""",
)
def segment_ids(spark, sf):
    layout = V.events_layout(spark, sf)
    order = ("start", "end", "speaker", "seg_idx")
    return R.region_ids(V.valid_segments(spark, sf), "seg-", 4, layout, order).select(
        "media_id", "seg_idx", "region_id"
    )


@query(
    "scoring_windows",
    "RG-14",
    """WITH d AS (SELECT conv_id AS media_id, CAST(max(turn) + 1 AS DOUBLE) AS dur FROM conversations GROUP BY 1),
 w AS (SELECT *, least(3.0::DOUBLE, dur) AS win FROM d)
 SELECT DISTINCT media_id, s AS window_start, s + win AS window_end FROM (
  SELECT media_id, win, unnest([0.0::DOUBLE, greatest(0, (dur - win) / 2), greatest(0, dur - win)]) AS s FROM w)""",
)
def scoring_windows(spark, sf):
    lengths = (
        V.table(spark, sf, "conversations")
        .groupBy(F.col("conv_id").alias("media_id"))
        .agg((F.max("turn") + 1).cast("double").alias("duration"))
    )
    return scoring.scoring_windows(lengths, 3.0).select("media_id", "window_start", "window_end")


@query(
    "repeat_windows",
    "RG-15",
    f"""{SEG} SELECT media_id, seg_idx, w AS window_idx, "start" - w * {240 * HOUR} AS "start", "end" - w * {240 * HOUR} AS "end", speaker
 FROM v_val, (SELECT unnest([0, 1, 2]) AS w) WHERE "start" >= w * {240 * HOUR} AND "end" <= (w + 1) * {240 * HOUR}""",
)
def repeat_windows(spark, sf):
    return repeats.repeat_windows(V.valid_segments(spark, sf), 240 * HOUR, 3)


#: Length that the recordings are declared to have; what lies beyond is reported, never cut.
DECLARED = 720 * HOUR


@query(
    "monotonic_flags",
    "RG-16 DQ-12",
    f"""WITH {V.SEGMENTS}, s AS (SELECT *, lag("start") OVER w AS ps, lag("end") OVER w AS pe FROM v_seg WINDOW w AS (PARTITION BY media_id ORDER BY seg_idx))
 SELECT media_id, bool_and(coalesce("start" >= ps, true)) AS starts_nondecreasing, bool_and(coalesce("end" >= pe, true)) AS ends_nondecreasing,
 bool_and("end" >= "start") AS ends_after_starts, bool_and("start" >= 0 AND "end" <= {DECLARED} + {HOUR}) AS inside_signal FROM s GROUP BY 1""",
)
def monotonic_flags(spark, sf):
    segs = V.segments(spark, sf)
    layout = V.measure_layout(segs, ["media_id"], F.col("seg_idx"), 1_000_000)
    return I.monotonic_flags(segs, F.lit(DECLARED), HOUR, layout)


@query(
    "accepted_overlap_check",
    "TL-06",
    f"""{SEG} SELECT media_id, "start", "end" FROM (SELECT media_id, "start", max("end") AS "end",
   max(max("end")) OVER (PARTITION BY media_id ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
   FROM v_val GROUP BY 1, 2) WHERE reach > "start" """,
)
def accepted_overlap_check(spark, sf):
    layout = V.events_layout(spark, sf)
    starts = V.valid_segments(spark, sf).groupBy("media_id", "start").agg(F.max("end").alias("end"))
    return I.overlap_violations(starts, layout)


@query(
    "region_problems",
    "DQ-11",
    f"""WITH {V.SEGMENTS}, s AS (SELECT media_id, seg_idx, "start", "end", lag("end") OVER (PARTITION BY media_id ORDER BY "start", seg_idx) AS pe FROM v_seg)
 SELECT media_id, seg_idx, "start", "end", CASE WHEN "end" <= "start" THEN 'empty' WHEN "start" < 0 OR "end" > {DECLARED} THEN 'outside_signal'
  WHEN pe > "start" THEN 'overlaps_previous' END AS problem FROM s WHERE "end" <= "start" OR "start" < 0 OR "end" > {DECLARED} OR pe > "start" """,
)
def region_problems(spark, sf):
    regions = V.segments(spark, sf).withColumn("total_samples", F.lit(DECLARED))
    found = quality.region_sanity(regions, V.events_layout(spark, sf), ["start", "seg_idx"])
    return found.select("media_id", "seg_idx", "start", "end", "problem")


@query(
    "selection_counts",
    "AG-17",
    f"""{SEG} SELECT v.media_id, count(*) AS segments, CAST(sum(p.pairs) AS BIGINT) AS overlap_pairs, CAST(sum(p.shared) AS BIGINT) AS overlap_us
 FROM v_val v, LATERAL (SELECT count(*) AS pairs, coalesce(sum(least(v."end", o."end") - o."start"), 0) AS shared FROM v_val o
   WHERE o.media_id = v.media_id AND (o."start" > v."start" OR (o."start" = v."start" AND o.seg_idx > v.seg_idx)) AND o."start" < v."end") p GROUP BY 1""",
)
def selection_counts(spark, sf):
    """Segments, overlapping pairs and the time they share, from one sweep: no pair is formed."""
    return I.overlap_counts(V.valid_segments(spark, sf), V.events_layout(spark, sf))


@query(
    "boundary_union",
    "SE-03",
    f"""{SEG} SELECT media_id, "start" AS boundary FROM v_val UNION SELECT media_id, "end" FROM v_val""",
)
def boundary_union(spark, sf):
    segs = V.valid_segments(spark, sf)
    return segs.select("media_id", F.explode(F.array("start", "end")).alias("boundary")).distinct()


@query(
    "label_set_relations",
    "SE-01 SE-02 SE-04 AG-25",
    """WITH a AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS x, list_sort(list(DISTINCT substr(o_orderpriority, 1, 1))) AS y,
  list_sort(list(DISTINCT CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '2' ELSE '3' END)) AS z FROM orders GROUP BY 1)
 SELECT o_custkey, array_to_string(x, ',') AS labels, len(list_intersect(y, z)) AS shared,
  array_to_string(list_sort(list_filter(z, lambda v: NOT list_contains(y, v))), ',') AS unknown,
  array_to_string(list_sort(list_concat(list_filter(z, lambda v: NOT list_contains(y, v)), list_filter(y, lambda v: NOT list_contains(z, v)))), ',') AS symmetric,
  y = z AS equal_sets FROM a""",
)
def label_set_relations(spark, sf):
    status = F.col("o_orderstatus")
    code = F.when(status == "F", "1").when(status == "O", "2").otherwise("3")
    sets = V.table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.array_sort(F.collect_set(status)).alias("x"),
        F.array_sort(F.collect_set(F.substring("o_orderpriority", 1, 1))).alias("y"),
        F.array_sort(F.collect_set(code)).alias("z"),
    )
    only_z, only_y = F.array_except("z", "y"), F.array_except("y", "z")
    return sets.select(
        "o_custkey",
        F.array_join("x", ",").alias("labels"),
        F.size(F.array_intersect("y", "z")).cast("bigint").alias("shared"),
        F.array_join(F.array_sort(only_z), ",").alias("unknown"),
        F.array_join(F.array_sort(F.concat(only_z, only_y)), ",").alias("symmetric"),
        (F.col("y") == F.col("z")).alias("equal_sets"),
    )


@query(
    "best_candidate",
    "SO-02",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r
 FROM orders) WHERE r = 1""",
)
def best_candidate(spark, sf):
    best = F.max_by(
        F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey"))
    )
    return (
        V.table(spark, sf, "orders")
        .groupBy("o_custkey")
        .agg(best.alias("b"))
        .select("o_custkey", "b.o_orderkey", "b.o_totalprice")
    )


@query(
    "duration_batches",
    "SO-03 SO-04",
    f"""{SEG}, o AS (SELECT media_id, seg_idx, "end" - "start" AS d, row_number() OVER (PARTITION BY media_id ORDER BY "end" - "start", seg_idx) - 1 AS r FROM v_val),
 c AS (SELECT *, r // 8 AS batch, coalesce(sum(d) OVER (PARTITION BY media_id ORDER BY r // 8 RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM o)
 SELECT media_id, seg_idx, batch, CAST(spent AS BIGINT) AS spent_before, spent < 100000000000 AS processed FROM c""",
)
def duration_batches(spark, sf):
    segs = V.valid_segments(spark, sf).withColumn("duration", F.col("end") - F.col("start"))
    layout = V.measure_layout(segs, ["media_id"], F.col("duration"), 60_000_000)
    return scheduling.budgeted_batches(segs, 8, 100_000_000_000, layout).select(
        "media_id", "seg_idx", "batch", "spent_before", "processed"
    )


@query(
    "drift_examples",
    "SO-05",
    """SELECT o_orderpriority, count(*) AS drifted, array_to_string(list_slice(list_sort(list(o_orderkey)), 1, 5), ',') AS examples
 FROM orders WHERE o_totalprice > 400000 GROUP BY 1""",
)
def drift_examples(spark, sf):
    drift = V.table(spark, sf, "orders").where("o_totalprice > 400000")
    return quality.capped_examples(drift, ["o_orderpriority"], "o_orderkey", 5, "drifted").withColumn(
        "examples", F.array_join("examples", ",")
    )


@query(
    "abstention_ledger",
    "TL-05",
    f"""WITH {TURNS} SELECT media_id, 'multiple_anonymous_speakers_active' AS reason, s AS "start", e AS "end", e - s AS duration, speakers FROM spans WHERE kind = 'overlap'
 UNION ALL SELECT media_id, 'only_filtered_raw_fragments_active', s, e, e - s, '' FROM spans WHERE kind = 'raw_fragment_abstain'
 UNION ALL SELECT media_id, 'raw_diarizer_fragment_below_predeclared_minimum', "start", "end", "end" - "start", speaker FROM frag
 UNION ALL SELECT media_id, 'final_turn_below_asr_minimum', s, e, e - s, speaker FROM turns WHERE e - s < 1800000000
 UNION ALL SELECT media_id, 'empty_after_crop', "start", "end", "end" - "start", speaker FROM v_seg WHERE NOT "end" > "start" """,
)
def abstention_ledger(spark, sf):
    layout, _, filtered, _, spans = plan_parts(spark, sf)
    spans = cut(spans)
    turns = T.build_turns(spans, TURN_GAP, layout)
    invalid = (
        V.segments(spark, sf)
        .where(~(F.col("end") > F.col("start")))
        .withColumn("reason", F.lit("empty_after_crop"))
    )
    out = T.abstentions(spans, turns, filtered, invalid, TURN_MIN)
    return out.withColumn("speakers", F.array_join("speakers", ","))


@query(
    "region_manifest",
    "TL-07",
    f"""{SEG}, {V.HYPOTHESIS} SELECT media_id, 'speech' AS kind, 'speech_' || seg_idx AS region_id, "start", "end", NULL::BOOLEAN AS overlaps_speech FROM v_val
 UNION ALL SELECT media_id, 'non_speech_program', 'machine_audio_' || seg_idx, "start", "end", seg_idx % 2 = 0 FROM v_hyp""",
)
def region_manifest(spark, sf):
    speech = V.valid_segments(spark, sf).select(
        "media_id", F.lit("speech").alias("kind"), F.concat(F.lit("speech_"), "seg_idx").alias("region_id"), "start", "end"
    )
    machine = V.hypothesis(spark, sf).select(
        "media_id",
        F.lit("non_speech_program").alias("kind"),
        F.concat(F.lit("machine_audio_"), "seg_idx").alias("region_id"),
        "start",
        "end",
        (F.col("seg_idx") % 2 == 0).alias("overlaps_speech"),
    )
    return speech.unionByName(machine, allowMissingColumns=True)
