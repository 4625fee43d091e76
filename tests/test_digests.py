"""Digest trees, comparisons in order, and the streamed matchers."""

import random

import pytest
from pyspark.sql import functions as F

from sonoframe.operators import comparison as C
from sonoframe.operators.digests import chunk_digests, sequence_digests
from sonoframe.operators.intervals import _greedy, _greedy_intervals
from sonoframe.operators.repeats import fingerprints_agree, window_fingerprints
from sonoframe.operators.scan import SINGLE, Layout

SEGMENT = "media_id long, window_idx long, seg_idx long, start long, `end` long, speaker string, text string"


def windows(spark, changed=None, pieces=60):
    rows = []
    for window in range(3):
        for k in range(pieces):
            text = "other" if (window, k) == changed else f"text {k}"
            rows.append((1, window, 1000 * window + k, 10 * k, 10 * k + 5, "ab"[k % 2], text))
    return spark.createDataFrame(rows, SEGMENT).repartition(4)


@pytest.mark.parametrize("chunk,layout", [(4096, SINGLE), (3, Layout(70)), (7, SINGLE)])
def test_equal_windows_agree_and_one_change_shows(spark, chunk, layout):
    agree = fingerprints_agree(window_fingerprints(windows(spark), layout, chunk)).first()
    assert agree.all_segments_equal and agree.all_texts_equal
    differ = fingerprints_agree(window_fingerprints(windows(spark, (2, 31)), layout, chunk)).first()
    assert not differ.all_segments_equal and not differ.all_texts_equal


def test_the_changed_chunk_is_found(spark):
    item = {"sha": F.col("text")}
    keys, order = ["media_id", "window_idx"], ["start", "end", "seg_idx"]
    found = chunk_digests(windows(spark, (2, 31)), keys, order, item, SINGLE, 8)
    assert found.agg(F.max("items")).first()[0] == 8
    by_place = {}
    for r in found.collect():
        by_place.setdefault(r.level_idx, {})[r.window_idx] = r.sha
    assert [k for k, v in sorted(by_place.items()) if len(set(v.values())) > 1] == [31 // 8]


def test_order_and_length_count(spark):
    rows = [(1, 0, "a"), (1, 1, "b"), (2, 0, "b"), (2, 1, "a"), (3, 0, "a"), (3, 1, "b"), (4, 0, "a"), (4, 1, None), (5, 0, "a")]
    frame = spark.createDataFrame(rows, "media_id long, k long, text string")
    got = {r.media_id: (r.items, r.sha) for r in sequence_digests(frame, ["media_id"], ["k"], {"sha": F.col("text")}, SINGLE).collect()}
    assert got[1] == got[3] and len({got[k] for k in (1, 2, 4, 5)}) == 4 and got[5][0] == 1


def test_segment_texts(spark):
    schema = "media_id long, seg_idx long, start long, `end` long, speaker string, text string"
    left = [(m, k, 10 * k, 10 * k + 9, "a", f"t{k}") for m in (1, 2, 3) for k in range(5)]
    right = [(m, k, 10 * k + m - 1, 10 * k + 9, "a" if k else "b", f"t{k}" if m < 3 else "t") for m in (1, 2, 3) for k in range(5 if m < 2 else 4)]
    right = [r if r[0] > 1 else (*r[:4], "a", r[5]) for r in right]
    got = {r.media_id: r for r in C.segment_texts(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), SINGLE).collect()}
    assert got[1].digest_matches and got[1].text_sequences_identical and got[1].start_max == 0
    assert not got[2].segment_count_matches and not got[2].text_sequences_identical and got[2].identical_text == 4
    assert (got[2].identical_speaker, got[2].start_count, got[2].start_mean, got[2].start_p95, got[2].end_max) == (3, 4, 1.0, 1.0, 0.0)
    assert got[3].identical_text == 0 and not got[3].digest_matches


def test_word_bound_deltas_skip_unequal_and_unplaced(spark):
    schema = "k long, starts array<double>, ends array<double>, other_starts array<double>, other_ends array<double>"
    rows = [
        (1, [0.0, 1.0], [0.5, 1.5], [0.25, None], [0.5, 1.75]),
        (1, [0.0, 1.0], [0.5, 1.5], [9.0], [9.0]),
        (2, [0.0], [0.5], [], []),
    ]
    got = C.word_bound_deltas(spark.createDataFrame(rows, schema), ["k"], SINGLE).collect()
    assert [(r.k, r.start_count, r.start_max, r.end_count, r.end_mean) for r in got] == [(1, 1, 0.25, 2, 0.125)]


def whole_list(rows, tolerance):
    """The matching with all positions in one list."""
    free, found = {r[0]: r[1] for r in rows}, []
    for at, _, wanted in rows:
        for error, place in sorted((abs(p - at), p) for p in free if abs(p - at) <= tolerance):
            taken = min(wanted, free[place])
            if taken:
                free[place] -= taken
                wanted -= taken
                found.append((error, taken))
            if not wanted:
                break
    return found


def test_streamed_matching_equals_the_whole_list():
    rnd = random.Random(2)
    for _ in range(300):
        places = sorted(rnd.sample(range(60), rnd.randint(1, 25)))
        rows = [(p, rnd.choice([0, 1, 1, 3]), rnd.choice([0, 1, 2])) for p in places]
        tolerance = rnd.choice([0, 1, 4, 15])
        assert list(_greedy(iter(rows), tolerance)) == whole_list(rows, tolerance)


def test_streamed_interval_matching_equals_the_whole_list():
    rnd = random.Random(3)
    for _ in range(300):
        rows = sorted(((s := rnd.randint(0, 40)), s + rnd.randint(1, 12), rnd.randint(0, 1)) for _ in range(rnd.randint(1, 25)))
        rows = [(side, s, e) for s, e, side in rows]
        tolerance = rnd.choice([0, 2, 6])
        free, matched = [r for r in rows if r[0]], 0
        for _, s, e in [r for r in rows if not r[0]]:
            fits = [h for h in free if abs(h[1] - s) <= tolerance and abs(h[2] - e) <= tolerance]
            if fits:
                free.remove(min(fits, key=lambda h: abs(h[1] - s) + abs(h[2] - e)))
                matched += 1
        assert _greedy_intervals(iter(rows), tolerance) == matched


def test_streamed_matching_holds_only_what_is_within_reach():
    seen = 0

    def rows():
        nonlocal seen
        for k in range(100_000):
            seen = k
            yield k, 1, 1

    matches = _greedy(rows(), 3)
    for k in range(50_000):
        assert next(matches) == (0, 1)
        assert seen - k < 10
