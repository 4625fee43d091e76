"""Transcript scores in tiles against the whole edit table."""

import random

import pytest
from pyspark.sql import functions as F

from sonoframe.functions import text as X
from sonoframe.functions.text import edit_counts_of
from sonoframe.operators import transcripts
from sonoframe.operators.scan import SINGLE, Layout
from sonoframe.operators.scoring import scoring_windows
from sonoframe.operators.transcripts import Tile, aligned, token_tiles, transcript_report

SEGMENT = "media_id long, start double, `end` double, text string, k long"


def segments(seed: int, media: int, pieces: int, words: int):
    rnd = random.Random(seed)
    rows = []
    for k in range(pieces):
        text = " ".join(rnd.choices(["a", "b", "c", "it's", "漢字", "xxx", "no@m", "-"], k=rnd.randint(0, words)))
        rows.append((media, float(k), k + rnd.choice([0.5, 1.0, 2.5]), text if k % 7 else None, k))
    return rows


def tokens(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    return [r[0] for r in frame.select(X.mixed_tokens(F.col("text"))).collect()]


@pytest.mark.parametrize("tile,layout", [(7, Layout(4)), (150, SINGLE), (2048, Layout(3))])
def test_report_equals_scores_of_joined_texts(spark, tile, layout):
    shape = {7: (6, 5)}.get(tile, (40, 20))
    ref = [r for m in range(3) for r in segments(m, m, *shape)]
    hyp = [r for m in range(2) for r in segments(50 + m, m, shape[0] - 3, shape[1])]
    lengths = spark.createDataFrame([(m, shape[0] + d) for m, d in ((0, 0.0), (1, 2.5), (2, 0.0), (3, 1.0))], "media_id long, duration double")
    windows = scoring_windows(lengths, 4.0)
    got = transcript_report(
        spark.createDataFrame(ref, SEGMENT), spark.createDataFrame(hyp, SEGMENT), windows, ["k"], layout, tile=tile
    ).collect()
    wanted = {(w["media_id"], w["window_start"], w["window_end"]) for w in windows.collect()} | {(m, None, None) for m in range(4)}
    assert {(r["media_id"], r["window_start"], r["window_end"]) for r in got} == wanted and len(got) == len(wanted)
    texts = []
    for r in got:
        for side in (ref, hyp):
            whole = r["window_start"] is None
            texts.append(" ".join(s[3] or "" for s in side if s[0] == r["media_id"] and (whole or (s[2] > r["window_start"] and s[1] < r["window_end"]))))
    both = tokens(spark, texts)
    for k, r in enumerate(got):
        left, right = both[2 * k], both[2 * k + 1]
        distance, deletions, insertions = edit_counts_of(left, right)
        assert (r["reference_tokens"], r["hypothesis_tokens"]) == (len(left), len(right))
        assert (r["distance"], r["deletions"], r["insertions"]) == (distance, deletions, insertions)
        assert r["substitutions"] == distance - deletions - insertions
        assert r["mixed_error_rate"] == (distance / len(left) if left else None)


def test_complete_text_of_the_reference_counts_overall_only(spark):
    ref = spark.createDataFrame([(1, 0.0, 1.0, "a b", 0)], SEGMENT)
    full = spark.createDataFrame([(1, 0.0, 1.0, "a b c d", 0)], SEGMENT)
    windows = scoring_windows(spark.createDataFrame([(1, 1.0)], "media_id long, duration double"), 9.0)
    got = {r["window_start"]: r["distance"] for r in transcript_report(ref, ref, windows, ["k"], SINGLE, full).collect()}
    assert got == {None: 2, 0.0: 0}


def test_one_long_pair_is_many_tiles(spark):
    rnd = random.Random(3)
    words = [rnd.choice("abcdefgh") for _ in range(1500)]
    other = [w for w in words if rnd.random() > 0.1]
    rows = lambda side: spark.createDataFrame([(1, k, " ".join(side[k : k + 50])) for k in range(0, len(side), 50)], "media_id long, k long, text string")
    tiles = [token_tiles(rows(side), ["media_id"], ["k"], Layout(200), 500) for side in (words, other)]
    assert tiles[0].count() == 3 and tiles[0].agg(F.max(F.size("tokens"))).first()[0] == 500
    got = aligned(*tiles, spark.createDataFrame([(1,)], "media_id long"), ["media_id"], 500).first()
    assert (got["distance"], got["deletions"], got["insertions"]) == edit_counts_of(words, other)


def test_a_word_of_any_length_is_one_token(spark):
    assert tokens(spark, ["a-" * 50_000 + "a", "a'" * 50_000]) == [["a-" * 50_000 + "a"], ["a'" * 49_999 + "a"]]


@pytest.mark.parametrize("kept", [3, 512])
def test_way_back_through_one_tile_is_the_plain_alignment(monkeypatch, kept):
    monkeypatch.setattr(transcripts, "KEPT", kept)
    rnd = random.Random(kept)
    for _ in range(500):
        left, right = (rnd.choices("abcde"[: rnd.randint(1, 5)], k=rnd.randint(1, 14)) for _ in range(2))
        i, j, edits, deletions = Tile(left, right).way_back(len(left), len(right))
        assert (edits + i + j, deletions + i) == edit_counts_of(left, right)[:2]


def test_segments_go_to_tiles_in_slices_and_not_in_tokens(spark):
    """One row for each tile that a segment reaches, so the rows of the shuffle don't grow with the tokens."""
    rows = spark.createDataFrame([(1, k, "a b " * 500) for k in range(4)], "media_id long, k long, text string")
    tiles = token_tiles(rows, ["media_id"], ["k"], Layout(4), 1500)
    assert [len(r["tokens"]) for r in tiles.orderBy("tile").collect()] == [1500, 1500, 1000]
    assert "posexplode" not in tiles._jdf.queryExecution().optimizedPlan().toString()
