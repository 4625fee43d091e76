import random

import pytest
from pyspark.sql import functions as F

from sonoframe.operators import timeline as T
from sonoframe.operators.scan import Layout

SCHEMA = "media_id long, start long, end long, speaker string"


def sequential_spans(kept, filtered, total):
    cuts = sorted({0, total, *(x for r in kept + filtered for x in r[:2])})
    spans = []
    for s, e in zip(cuts, cuts[1:]):
        speakers = tuple(sorted({r[2] for r in kept if r[0] < e and r[1] > s}))
        fragment = any(r[0] < e and r[1] > s for r in filtered)
        if spans and spans[-1][2:] == (speakers, fragment):
            spans[-1] = (spans[-1][0], e, speakers, fragment)
        else:
            spans.append((s, e, speakers, fragment))
    return spans


def kind(span):
    return "overlap" if len(span[2]) > 1 else "single_speaker" if span[2] else "raw_fragment_abstain" if span[3] else "gap"


def sequential_turns(spans, gap):
    turns, i = [], 0
    while i < len(spans):
        if kind(spans[i]) != "single_speaker":
            i += 1
            continue
        s, e, who, _ = spans[i]
        active, bridge = e - s, 0
        while (
            i + 2 < len(spans) and kind(spans[i + 1]) == "gap" and spans[i + 1][1] - spans[i + 1][0] <= gap
            and kind(spans[i + 2]) == "single_speaker" and spans[i + 2][2] == who
        ):
            bridge += spans[i + 1][1] - spans[i + 1][0]
            active += spans[i + 2][1] - spans[i + 2][0]
            e = spans[i + 2][1]
            i += 2
        turns.append((s, e, who[0], active, bridge))
        i += 1
    return turns


@pytest.mark.parametrize("span", [None, 13])
def test_timeline_turns_and_ledger_match_sequential(spark, span):
    rng = random.Random(5)
    layout, total, cases = Layout(span), 200, []
    for _ in range(60):
        rows = [(s := rng.randint(0, 190), min(200, s + rng.randint(1, 30)), rng.choice("ABC")) for _ in range(rng.randint(0, 14))]
        cases.append(([r for r in rows if r[1] - r[0] >= 6], [r for r in rows if r[1] - r[0] < 6]))
    kept = spark.createDataFrame([(m, *r) for m, (k, _) in enumerate(cases) for r in k], SCHEMA)
    filtered = spark.createDataFrame([(m, *r) for m, (_, f) in enumerate(cases) for r in f], SCHEMA)
    totals = spark.createDataFrame([(m, total) for m in range(len(cases))], "media_id long, total long")
    spans = T.atomic_timeline(kept, filtered, totals, layout)
    turns = T.build_turns(spans, 9, layout)
    ledger = {r.media_id: r for r in T.coverage_ledger(spans, turns, totals, 12).collect()}
    spans, turns = spans.orderBy("media_id", "start").collect(), turns.orderBy("media_id", "start").collect()
    for m, (k, f) in enumerate(cases):
        want = sequential_spans(k, f, total)
        assert [(r.start, r.end, tuple(r.speakers), r.filtered_active) for r in spans if r.media_id == m] == want
        assert [r.kind for r in spans if r.media_id == m] == [kind(s) for s in want]
        wanted = sequential_turns(want, 9)
        assert [(r.start, r.end, r.speaker, r.active_samples, r.bridge_gap_samples) for r in turns if r.media_id == m] == wanted
        assert ledger[m].is_exact and ledger[m].partition_sum == total
        assert ledger[m].accepted_active == sum(t[3] for t in wanted if t[1] - t[0] >= 12)
        assert ledger[m].short_turn == sum(t[3] for t in wanted if t[1] - t[0] < 12)


def test_worked_example(spark):
    rate = 16_000
    rows = [(0, 0, 10, "A"), (0, 8, 12, "B"), (0, 12, 20, "A"), (0, 20.2, 25, "A")]
    kept = spark.createDataFrame([(m, int(s * rate), int(e * rate), w) for m, s, e, w in rows], SCHEMA)
    totals = spark.createDataFrame([(0, 30 * rate)], "media_id long, total long")
    none = kept.where("false")
    spans = T.atomic_timeline(kept, none, totals, Layout(None))
    turns = T.build_turns(spans, int(0.3 * rate), Layout(None)).orderBy("start").collect()
    assert [(t.start / rate, t.end / rate, t.speaker, t.bridge_gap_samples / rate) for t in turns] == [
        (0, 8, "A", 0), (10, 12, "B", 0), (12, 25, "A", 0.2),
    ]


def test_more_labels_than_one_mask_word(spark):
    """Every label is active at once: the set must not be capped at one word of bits."""
    rows = [(0, i, 500 - i, f"s{i:03d}") for i in range(150)]
    kept = spark.createDataFrame(rows, SCHEMA)
    totals = spark.createDataFrame([(0, 600)], "media_id long, total long")
    spans = T.atomic_timeline(kept, kept.where("false"), totals, Layout(None))
    widest = spans.orderBy(F.size("speakers").desc()).first()
    assert widest.speakers == [f"s{i:03d}" for i in range(150)] and (widest.start, widest.end) == (149, 351)


def test_interval_normalisation_reasons(spark):
    rows = [
        (0, 0, "1.0", "2.0", "A", 32000), (0, 1, "x", "2.0", "A", 32000), (0, 2, "NaN", "2", "A", 32000),
        (0, 3, "5", "9", "A", 32000), (0, 4, "-1", "0.5", "A", 32000), (0, 5, "1", "Infinity", "A", 32000),
        (0, 6, "1", "1e300", "A", 32000), (0, 7, "1", "2", None, 32000),
    ]
    raw = spark.createDataFrame(rows, "media_id long, seg_idx long, start_s string, end_s string, speaker string, total long")
    out = {r.seg_idx: r for r in T.normalize_intervals(raw, 16000).collect()}
    assert (out[0].start, out[0].end, out[0].reason) == (16000, 32000, None)
    assert (out[4].start, out[4].end, out[4].reason) == (0, 8000, None)
    assert (out[6].start, out[6].end) == (16000, 32000)
    assert [out[i].reason for i in (1, 2, 3, 5, 7)] == [
        "invalid_fields", "nonfinite_bounds", "empty_after_crop", "nonfinite_bounds", "invalid_fields",
    ]
