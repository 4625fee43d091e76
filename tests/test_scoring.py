import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoframe.operators import intervals as I
from sonoframe.operators import scoring as S
from sonoframe.operators import statistics as St
from sonoframe.operators.assignment import apply_mapping, best_mapping, frame_totals
from sonoframe.operators.scan import SINGLE, Layout

SCHEMA = "media_id long, seg_idx long, start long, end long, speaker string"


def segments(spark, rows):
    return spark.createDataFrame([(0, i, *r) for i, r in enumerate(rows)], SCHEMA)


def brute_der(ref, hyp, duration, frame, collar, overlap):
    frames = []
    for i in range(math.ceil(duration / frame)):
        t = min(duration, (i + 0.5) * frame)
        r = {x[2] for x in ref if x[0] <= t < x[1]}
        if not overlap and len(r) > 1 or collar and any(abs(t - b) < collar for x in ref for b in x[:2]):
            continue
        frames.append((r, {x[2] for x in hyp if x[0] <= t < x[1]}))
    rs, hs = sorted({x[2] for x in ref}), sorted({x[2] for x in hyp})
    targets = [*rs, *[None] * max(0, len(hs) - len(rs))]
    best = None
    for assignment in itertools.permutations(targets, len(hs)):
        m = dict(zip(hs, assignment))
        counts = [0, 0, 0]
        for r, h in frames:
            g = {m[x] for x in h} - {None}
            counts[0] += max(0, len(r) - len(g))
            counts[1] += max(0, len(g) - len(r))
            counts[2] += min(len(r), len(g)) - len(r & g)
        if best is None or sum(counts) < sum(best[1]):
            best = (m, counts)
    return best[0], best[1], len(frames), sum(len(r) for r, _ in frames)


@pytest.mark.parametrize("seed", range(6))
def test_diarization_error_matches_brute_force(spark, seed):
    rng = random.Random(seed)

    def some(labels, n):
        return [(s := rng.randint(0, 900), s + rng.randint(1, 250), rng.choice(labels)) for _ in range(n)]

    ref, hyp = some("AB" if seed % 2 else "ABC", 8), some("wxyz" if seed % 3 == 0 else "xy", 9)
    duration, frame, collar = 1013, 20, 25
    lengths = spark.createDataFrame([(0, duration)], "media_id long, duration long")
    for span in (None, 70):
        patterns, ranks, words = S.frame_patterns(
            segments(spark, ref), segments(spark, hyp), lengths, frame, Layout(span), collar
        )
        out = {r.setting: r for r in S.diarization_error(patterns, ranks, words, lengths, frame).collect()}
        for name, use_collar, overlap in S.SETTINGS:
            mapping, errors, n, speaker = brute_der(ref, hyp, duration, frame, collar if use_collar else 0, overlap)
            r = out[name]
            assert [r.missed_frames, r.false_alarm_frames, r.confusion_frames] == errors
            assert (r.evaluated_frames, r.reference_frames) == (n, speaker)
            assert r.mapping == ",".join(f"{k}={v or ''}" for k, v in sorted(mapping.items()))


def test_swapped_labels_score_zero(spark):
    ref = [(0, 100, "A"), (100, 200, "B")]
    lengths = spark.createDataFrame([(0, 200)], "media_id long, duration long")
    swapped = segments(spark, [(0, 100, "x2"), (100, 200, "x1")])
    patterns, ranks, words = S.frame_patterns(segments(spark, ref), swapped, lengths, 10, SINGLE, 0)
    out = S.diarization_error(patterns, ranks, words, lengths, 10).where("setting = 'overlap_included_no_collar'").first()
    assert out.diarization_error_rate == 0 and out.mapping == "x1=B,x2=A"


@pytest.mark.parametrize("shape", [(3, 3), (4, 2), (2, 4), (9, 8), (8, 9)])
def test_mapping_is_the_first_minimum(shape):
    rng = np.random.default_rng(sum(shape))
    n_ref, n_hyp = shape
    ref, hyp = rng.integers(0, 2, (30, n_ref)), rng.integers(0, 2, (30, n_hyp))
    weight = rng.integers(1, 9, 30)
    mapping, errors = best_mapping(ref, hyp, weight)
    if max(shape) <= 4:
        targets = [*range(n_ref), *[None] * max(0, n_hyp - n_ref)]
        tried = [
            (m, frame_totals(ref, apply_mapping(hyp, m, n_ref), weight))
            for m in itertools.permutations(targets, n_hyp)
        ]
        least = min(sum(e) for _, e in tried)
        assert mapping == next(m for m, e in tried if sum(e) == least)
    assert errors == frame_totals(ref, apply_mapping(hyp, mapping, n_ref), weight)
    for _ in range(300):
        other = [*range(n_ref), *[None] * max(0, n_hyp - n_ref)]
        other = tuple(rng.permutation(np.array(other, dtype=object))[:n_hyp])
        assert sum(frame_totals(ref, apply_mapping(hyp, other, n_ref), weight)) >= sum(errors)


def first_of(overlap):
    """Targets of rows that share so many frames with each column, one label a side in every frame."""
    rows, columns = overlap.shape
    pairs = [(i, j) for i in range(rows) for j in range(columns)]
    hyp, ref = np.eye(rows, dtype=int)[[p[0] for p in pairs]], np.eye(columns, dtype=int)[[p[1] for p in pairs]]
    return best_mapping(ref, hyp, overlap.ravel())[0]


def test_assignment_ties_take_the_first_columns():
    assert first_of(np.ones((4, 6), int)) == (0, 1, 2, 3)
    rng = np.random.default_rng(1)
    for _ in range(30):
        overlap = rng.integers(0, 4, (3, 5))
        options = [(-sum(overlap[i, j] for i, j in enumerate(p)), p) for p in itertools.permutations(range(5), 3)]
        assert first_of(overlap) == min(options)[1]


def test_mappings_equal_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n_ref, n_hyp, n = (int(rng.integers(0, k)) for k in (5, 6, 12))
        share = rng.choice([0.2, 0.5, 0.8])
        ref, hyp = (rng.random((n, n_ref)) < share).astype(int), (rng.random((n, n_hyp)) < share).astype(int)
        weight = rng.integers(1, rng.choice([2, 4, 50]), n)
        orders = sorted(set(itertools.permutations([*range(n_ref)] + [n_ref] * max(0, n_hyp - n_ref), n_hyp)))
        targets = [tuple(None if t == n_ref else t for t in order) for order in orders]
        wanted = min(targets, key=lambda m: sum(frame_totals(ref, apply_mapping(hyp, m, n_ref), weight)))
        assert best_mapping(ref, hyp, weight)[0] == wanted


def test_forty_labels_against_twenty():
    """Each of twenty speakers is found as two labels, with some overlap and some noise."""
    rng = np.random.default_rng(1)
    ref, hyp = np.zeros((2000, 20), int), np.zeros((2000, 40), int)
    for k in range(2000):
        for speaker in rng.integers(0, 20, 1 + (rng.random() < 0.1)):
            ref[k, speaker] = 1
            hyp[k, speaker + 20 * rng.integers(0, 2)] = 1
            if rng.random() < 0.02:
                hyp[k, rng.integers(0, 40)] = 1
    weight = rng.integers(1, 100, 2000)
    started = time.process_time()
    mapping, errors = best_mapping(ref, hyp, weight)
    assert time.process_time() - started < 1
    assert sorted(t for t in mapping if t is not None) == list(range(20))
    both = hyp.T @ (ref * weight[:, None])
    greedy = [None] * 40
    for speaker in range(20):
        greedy[max((speaker, speaker + 20), key=lambda h: both[h, speaker])] = speaker
    assert sum(errors) <= sum(frame_totals(ref, apply_mapping(hyp, greedy, 20), weight))


def test_activity_counts(spark):
    lengths = spark.createDataFrame([(0, 2000)], "media_id long, duration long")
    a, b = segments(spark, [(0, 1000, "a")]), segments(spark, [(500, 1500, "b")])
    r = S.activity_scores(a, b, lengths, 500, SINGLE, strict=True).first()
    assert (r.both_active, r.first_only, r.second_only) == (1, 1, 1)
    assert r.precision == r.recall == r.f1 == 0.5


def test_single_speaker_ties_and_missing(spark):
    lengths = spark.createDataFrame([(0, 100)], "media_id long, duration long")
    ref = segments(spark, [(0, 40, "p")])
    hyp = segments(spark, [(0, 20, "b"), (20, 40, "a"), (60, 80, "c")])
    out = {r.speaker: r for r in S.single_speaker_scores(ref, hyp, lengths, 10, SINGLE).collect()}
    assert out["a"].is_best and not out["b"].is_best
    assert (out["a"].tp, out["a"].fp, out["a"].fn) == (2, 0, 2) and out["c"].f1 is None


def test_repeat_agreement_matches_brute_force(spark):
    rng = random.Random(4)
    for _ in range(3):
        first = [(s := rng.randint(0, 180), s + rng.randint(5, 60), w) for w in "ABAB"]
        second = [(s + rng.randint(-9, 9), e + rng.randint(-2, 9), {"A": "q", "B": "p"}[w]) for s, e, w in first]
        second = [(max(0, s), min(240, e), w) for s, e, w in second if e > max(0, s)]
        lengths = spark.createDataFrame([(0, 240)], "media_id long, duration long")
        r = S.repeat_agreement(segments(spark, first), segments(spark, second), lengths, 10, SINGLE).first()

        def sets(rows, rename=lambda w: w):
            return [{rename(x[2]) for x in rows if x[0] <= (i + 0.5) * 10 < x[1]} for i in range(24)]

        left = sets(first)
        options = []
        for targets in itertools.permutations("AB"):
            m = dict(zip("pq", targets))
            right = sets(second, m.get)
            options.append((sum(len(x ^ y) for x, y in zip(left, right)), right))
        error, right = min(options, key=lambda o: o[0])
        assert r.status == "ok" and r.error_frames == error
        assert r.exact_frames == sum(x == y for x, y in zip(left, right))
        assert r.voiced_frames == sum(bool(x or y) for x, y in zip(left, right))
    different = S.repeat_agreement(
        segments(spark, [(0, 50, "A")]), segments(spark, [(0, 50, "p"), (60, 90, "q")]), lengths, 10, SINGLE
    ).first()
    assert different.status == "different_label_counts"


def greedy_boundaries(ref, hyp, tolerance):
    free, errors = set(range(len(ref))), []
    for b in hyp:
        near = [i for i in free if abs(ref[i] - b) <= tolerance]
        if near:
            best = min(near, key=lambda i: (abs(ref[i] - b), i))
            free.remove(best)
            errors.append(abs(ref[best] - b))
    return errors


@pytest.mark.parametrize("span", [None, 40])
def test_boundary_matching_matches_brute_force(spark, span):
    rng = random.Random(9)
    cases = []
    for _ in range(60):
        cases.append([sorted(rng.choice(range(200)) for _ in range(rng.randint(0, 25))) for _ in range(2)])
    cases.append([[1000, 2000], [1600, 1900]])
    flat = [[(m, b) for m, c in enumerate(cases) for b in c[side]] for side in (0, 1)]
    ref, hyp = (spark.createDataFrame(f, "media_id long, boundary long") for f in flat)
    for tolerance in (5, 1000):
        out = I.match_boundaries(ref, hyp, tolerance, Layout(span)).collect()
        for m, (r, h) in enumerate(cases):
            got = sorted(x.error for x in out if x.media_id == m for _ in range(x.matches))
            assert got == sorted(greedy_boundaries(r, h, tolerance)), (m, r, h)


def test_boundary_scores_weigh_copies(spark):
    ref = spark.createDataFrame([(0, 10)] * 3 + [(0, 50)], "media_id long, boundary long")
    hyp = spark.createDataFrame([(0, 11)] * 3 + [(0, 54), (0, 90)], "media_id long, boundary long")
    for span in (None, 3):
        matches = I.match_boundaries(ref, hyp, 5, Layout(span))
        r = S.boundary_scores(matches, ref, hyp, Layout(span)).first()
        assert (r.matched, r.reference_count, r.hypothesis_count) == (4, 4, 5)
        assert (r.median_error, r.p95_error, r.precision, r.recall) == (1.0, 4.0, 0.8, 1.0)


def test_interval_matching_matches_brute_force(spark):
    rng = random.Random(2)
    ref = sorted({(s := rng.randint(0, 300), s + rng.randint(5, 20), rng.choice("AB")) for _ in range(60)})
    hyp = sorted({(max(0, s + rng.randint(-4, 4)), e + rng.randint(-4, 4), w) for s, e, w in ref})
    for span in (None, 25):
        out = I.match_intervals(segments(spark, ref), segments(spark, hyp), [2, 6], Layout(span))
        got = {r.tolerance: r.matched for r in out.collect()}
        for tolerance in (2, 6):
            free, matched = set(range(len(hyp))), 0
            for s, e, w in ref:
                near = [i for i in free if hyp[i][2] == w and abs(hyp[i][0] - s) <= tolerance and abs(hyp[i][1] - e) <= tolerance]
                if near:
                    free.remove(min(near, key=lambda i: (abs(hyp[i][0] - s) + abs(hyp[i][1] - e), i)))
                    matched += 1
            assert got[tolerance] == matched


def test_order_statistics_differ(spark):
    df = spark.createDataFrame([(0, float(v)) for v in (1, 2, 3, 10)], "k long, x double")
    picks = {
        "linear": "linear_0.95", "nearest": "nearest_0.95", "rounded": "rounded_0.95",
        "upper": "upper_median", "median": "median", "top": "max",
    }
    for span in (None, 2):
        r = St.order_statistics(df, ["k"], "x", Layout(span), picks).first()
        assert r.linear == pytest.approx(8.95)
        assert (r.nearest, r.rounded, r.upper, r.median, r.top) == (10, 10, 3, 2.5, 10)
    one = spark.createDataFrame([(0, 4.0)], "k long, x double")
    r = St.order_statistics(one, ["k"], "x", SINGLE, picks).first()
    assert {r.linear, r.nearest, r.rounded, r.upper, r.median} == {4.0}
