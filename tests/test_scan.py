import random
import re

import pytest
from pyspark.sql import functions as F

from sonoframe.operators.scan import (
    SINGLE, Layout, as_of, islands, lag, last_known, lead, measure_layout, next_known, row_index,
    running, running_max, running_sum,
)
from sonoframe.operators import scan
from sonoframe.operators.rangejoin import overlapping_pairs, points_in_intervals

RNG = random.Random(7)
ROWS = [
    (m, at, RNG.choice([None, 1, 2, 3, 4]), RNG.randint(-5, 5))
    for m in range(3)
    for at in sorted(RNG.sample(range(500), 80))
]


@pytest.mark.parametrize("span", [None, 1, 7, 50, 10_000])
def test_running_measures_match_brute_force(spark, span):
    df = spark.createDataFrame(ROWS, "media_id long, at long, v int, d long")
    out = running(
        df, ["media_id"], ["at"], Layout(span),
        total=running_sum(F.col("d")), before=running_sum(F.col("d"), inclusive=False),
        top=running_max(F.col("v"), inclusive=False), known=last_known(F.col("v")),
        coming=next_known(F.col("v"), inclusive=False), prev=lag(F.col("v")), nxt=lead(F.col("v")), idx=row_index(),
    )
    got = {(r.media_id, r["at"]): r for r in out.collect()}
    for media in range(3):
        rows = [r for r in ROWS if r[0] == media]
        for i, (_, at, v, d) in enumerate(rows):
            r = got[(media, at)]
            seen = [x[2] for x in rows[:i] if x[2] is not None]
            here = seen + ([v] if v is not None else [])
            after = [x[2] for x in rows[i + 1 :] if x[2] is not None]
            assert r.total == sum(x[3] for x in rows[: i + 1]) and r.before == r.total - d
            assert r.top == (max(seen) if seen else None)
            assert r.known == (here[-1] if here else None)
            assert r.coming == (after[0] if after else None)
            assert r.prev == (rows[i - 1][2] if i else None)
            assert r.nxt == (rows[i + 1][2] if i + 1 < len(rows) else None)
            assert r.idx == i


@pytest.mark.parametrize("span", [None, 3])
def test_islands_and_as_of(spark, span):
    layout = Layout(span)
    df = spark.createDataFrame([(1, x) for x in (1, 2, 3, 9, 10, 30)], "media_id long, at long")
    seen = running(df, ["media_id"], ["at"], layout, p=lag(F.col("at")))
    grouped = islands(seen, ["media_id"], ["at"], layout, F.col("p").isNull() | (F.col("at") - F.col("p") > 2))
    assert [r.island for r in grouped.orderBy("at").collect()] == [1, 1, 1, 2, 2, 3]
    points = spark.createDataFrame([(1, x) for x in (0, 3, 9, 40)], "media_id long, t long")
    kwargs = dict(event_at="at", value="at", tie_break=[])
    back = as_of(points, df, ["media_id"], "t", layout, alias="b", **kwargs)
    assert [r.b for r in back.orderBy("t").collect()] == [None, 3, 9, 30]
    strict = as_of(points, df, ["media_id"], "t", layout, alias="b", include_equal=False, **kwargs)
    assert [r.b for r in strict.orderBy("t").collect()] == [None, 2, 3, 30]
    ahead = as_of(points, df, ["media_id"], "t", layout, alias="b", forward=True, **kwargs)
    assert [r.b for r in ahead.orderBy("t").collect()] == [1, 3, 9, None]
    later = as_of(points, df, ["media_id"], "t", layout, alias="b", forward=True, include_equal=False, **kwargs)
    assert [r.b for r in later.orderBy("t").collect()] == [1, 9, 10, None]


def test_layout_follows_the_densest_bucket(spark, monkeypatch):
    df = spark.range(1000).select(F.lit(1).alias("media_id"), "id")
    assert measure_layout(df, ["media_id"], F.col("id"), 10) == SINGLE
    monkeypatch.setattr(scan, "TARGET_ROWS", 100)
    assert measure_layout(df, ["media_id"], F.col("id"), 10) == Layout(100)
    monkeypatch.setattr(scan, "TARGET_ROWS", 5)
    assert measure_layout(df, ["media_id"], F.col("id"), 10) == Layout(5)


def test_hot_recording_is_split_into_chunks(spark):
    """Row-level windows are partitioned by chunk; only chunk summaries meet per recording."""
    df = spark.range(1000).select((F.col("id") % 2).alias("media_id"), F.col("id").alias("at"))
    out = running(df, ["media_id"], ["at"], Layout(100), n=row_index())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    specs = re.findall(r"windowspecdefinition\(([^)]*?), specifiedwindowframe", plan)
    assert specs and all("_chunk#" in spec for spec in specs)
    assert [s for s in specs if re.match(r"media_id#\d+L?, _chunk#\d+L?, at#", s)]
    assert not [s for s in specs if re.match(r"media_id#\d+L?, at#", s)]


def test_range_joins_match_brute_force(spark):
    rng = random.Random(3)
    intervals = [(rng.randint(0, 1), i, s := rng.randint(0, 90), s + rng.randint(0, 40)) for i in range(40)]
    points = [(rng.randint(0, 1), i, rng.randint(0, 120)) for i in range(50)]
    a = spark.createDataFrame(intervals, "media_id long, a long, s long, e long")
    b = spark.createDataFrame(intervals, "media_id long, b long, bs long, be long")
    p = spark.createDataFrame(points, "media_id long, p long, t long")
    got = {(r.p, r.a) for r in points_in_intervals(p, a, ["media_id"], "t", "s", "e", 16).collect()}
    assert got == {(p_, a_) for m, p_, t in points for n, a_, s, e in intervals if m == n and s <= t < e}
    pairs = overlapping_pairs(a, b, ["media_id"], ("s", "e"), ("bs", "be"), 16).collect()
    want = {(x[1], y[1]) for x in intervals for y in intervals if x[0] == y[0] and x[2] < y[3] and x[3] > y[2]}
    assert len(pairs) == len(want) and {(r.a, r.b) for r in pairs} == want
