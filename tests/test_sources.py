import io
import json
import wave

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sonoframe.functions import fingerprint
from sonoframe.operators import quality, repeats, rules, telemetry
from sonoframe.operators.scan import SINGLE, Layout
from sonoframe.sources import adjustments as A
from sonoframe.sources import annotations as N
from sonoframe.sources import catalog as K
from sonoframe.sources import media, pcm, sinks


def wav(values, rate=16_000, channels=1, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(np.asarray(values, dtype="<i2" if width == 2 else "u1").tobytes())
    return out.getvalue()


def test_wav_files_from_disk(spark, tmp_path):
    good = np.arange(-5, 20_000 - 5) % 1000
    (tmp_path / "good.wav").write_bytes(wav(good))
    (tmp_path / "stereo.wav").write_bytes(wav(range(8), channels=2))
    (tmp_path / "bytes.wav").write_bytes(wav([1, 2, 3], width=1))
    (tmp_path / "cut.wav").write_bytes(wav(good)[:500])
    (tmp_path / "text.wav").write_bytes(b"version https://pointer")
    files = media.read_files(spark, str(tmp_path), "*.wav")
    rows = media.parse_wav(files).collect()
    by_name = {}
    for r in rows:
        by_name.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert {n: r[0].error for n, r in by_name.items()} == {
        "good.wav": None, "stereo.wav": None, "bytes.wav": "not_pcm16", "cut.wav": "short_read", "text.wav": "not_a_wave_file",
    }
    chunks = sorted(by_name["good.wav"], key=lambda r: r.chunk_id)
    assert [len(c.ch0) for c in chunks] == [16_000, 4_000] and chunks[0].ch1 is None
    assert np.allclose(np.concatenate([c.ch0 for c in chunks]), good / 32768)
    assert by_name["stereo.wav"][0].ch1 == pytest.approx([x / 32768 for x in (1, 3, 5, 7)])
    wrong = media.parse_wav(files.where("path like '%good%'"), rate=8000).first()
    assert wrong.error == "unexpected_sample_rate"
    assert media.inventory(files).where("length(sha256) = 64").count() == 5


def test_ranges_of_files_give_the_rows_of_whole_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    for k, (n, channels) in enumerate([(0, 1), (1, 1), (999, 1), (5000, 2), (16_000, 2)]):
        (tmp_path / f"f{k}.wav").write_bytes(wav(rng.integers(-9999, 9999, n * channels), rate=1000 * (k + 1), channels=channels))
    listed = wav(range(100))
    extra = listed[:12] + b"LIST" + (5).to_bytes(4, "little") + b"abcde\0" + listed[12:] + b"tail" + (2).to_bytes(4, "little") + b"zz"
    (tmp_path / "list.wav").write_bytes(extra)
    (tmp_path / "bytes.wav").write_bytes(wav([1, 2, 3], width=1))
    (tmp_path / "cut.wav").write_bytes(wav(range(900))[:500])
    (tmp_path / "text.wav").write_bytes(b"version https://pointer")
    (tmp_path / "empty.wav").write_bytes(b"")

    def plain(df):
        return sorted((tuple(map(lambda v: tuple(v) if isinstance(v, list) else v, r)) for r in df.collect()), key=repr)

    whole = plain(media.parse_wav(media.read_files(spark, str(tmp_path), "*.wav"), 0.25))
    for size in (37, 1000, 1 << 20):
        assert plain(pcm.read_pcm(spark, str(tmp_path), "*.wav", 0.25, range_bytes=size)) == whole
    assert len({r[0] for r in whole if r[-1]}) == 3 and len(whole) > 10
    wrong = pcm.read_pcm(spark, str(tmp_path), "f4.wav", rate=8000, range_bytes=100).collect()
    assert [r.error for r in wrong] == ["unexpected_sample_rate"]


def test_written_files_read_back(spark, tmp_path):
    files = spark.createDataFrame([(f"{k}.bin", bytearray(range(k)) * 100) for k in range(5)], "name string, content binary")
    folder = str(tmp_path / "out")
    assert {(r["name"], r["bytes"]) for r in sinks.write_files(files, folder).collect()} == {(f"{k}.bin", 100 * k) for k in range(5)}
    assert {p.name: p.stat().st_size for p in (tmp_path / "out").glob("*.bin")} == {f"{k}.bin": 100 * k for k in range(5)}


EAF = """<ANNOTATION_DOCUMENT><TIME_ORDER><TIME_SLOT TIME_SLOT_ID="t1" TIME_VALUE="10"/><TIME_SLOT TIME_SLOT_ID="t2" TIME_VALUE="20"/>
<TIME_SLOT TIME_SLOT_ID="t3"/></TIME_ORDER><TIER TIER_ID="A"><ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="a1" TIME_SLOT_REF1="t1" TIME_SLOT_REF2="t2">
<ANNOTATION_VALUE> 你好 </ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION><ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="a2" TIME_SLOT_REF1="t1" TIME_SLOT_REF2="t3">
<ANNOTATION_VALUE/></ALIGNABLE_ANNOTATION></ANNOTATION><ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="a3" TIME_SLOT_REF1="t1" TIME_SLOT_REF2="t2"/></ANNOTATION></TIER><TIER TIER_ID="B"/></ANNOTATION_DOCUMENT>"""


def test_eaf(spark):
    out = N.parse_eaf(spark.createDataFrame([("x", EAF)], "path string, xml string"))
    rows = {r.annotation_id: r for r in out.collect()}
    assert (rows["a1"].start_ms, rows["a1"].end_ms, rows["a1"].value, rows["a1"].error) == (10, 20, "你好", "duplicate_interval")
    assert rows["a2"].error == "unresolved_time_slot" and rows["a3"].value == ""
    assert sorted(r.annotation_id for r in out.collect() if r.error == "duplicate_interval") == ["a1", "a3"]


GRID = '''File type = "ooTextFile"
item []: 
    item [1]:
        class = "IntervalTier" 
        name = "utterance" 
        intervals [1]:
            xmin = 0 
            xmax = 1.5 
            text = "he said ""hi""" 
        intervals [2]:
            xmin = 1.5 
            xmax = 2 
            text = "" 
    item [2]:
        class = "IntervalTier" 
        name = "task" 
        intervals [1]:
            xmin = 0 
            xmax = 2 
            text = "故事" 
'''


def test_textgrid(spark):
    df = spark.createDataFrame([("x", bytearray(GRID.encode("utf-16")))], "path string, content binary")
    rows = N.parse_textgrid(df).orderBy("tier", "position").collect()
    assert [(r.tier, r.start_s, r.end_s, r.text) for r in rows] == [
        ("task", 0, 2, "故事"), ("utterance", 0, 1.5, 'he said "hi"'), ("utterance", 1.5, 2, ""),
    ]


def item(**changes):
    base = {"type": "gain", "gain_db": -6, "scope": {"time": "all", "frequency": "all"}}
    base.update(changes)
    return base


def scope(time="all", frequency="all"):
    return {"time": time, "frequency": frequency}


CASES = [
    (item(), None, None),
    (item(gain_db=-24.1), "gain_out_of_range", "adjustments[0].gain_db"),
    (item(gain_db=12.1), "gain_out_of_range", "adjustments[0].gain_db"),
    (item(gain_db=True), "invalid_number", "adjustments[0].gain_db"),
    (item(gain_db="3"), "invalid_number", "adjustments[0].gain_db"),
    (item(gain_db=float("nan")), "non_finite_number", "adjustments[0].gain_db"),
    (item(type="eq"), "invalid_adjustment", "adjustments[0].type"),
    (item(extra=1), "invalid_adjustment", None),
    (item(scope=scope({"start": 1, "end": 1})), "scope_out_of_range", "adjustments[0].scope.time"),
    (item(scope=scope({"start": -1, "end": 1})), "scope_out_of_range", "adjustments[0].scope.time"),
    (item(scope=scope({"start": 1, "end": 10.5})), "scope_out_of_range", "adjustments[0].scope.time"),
    (item(scope=scope({"start": 1, "end": float("inf")})), "non_finite_number", "adjustments[0].scope.time.end"),
    (item(scope=scope({"start": 1})), "invalid_adjustment", "adjustments[0].scope.time"),
    (item(scope=scope({"start": 1, "end": 10})), None, None),
    (item(scope=scope(frequency={"low_hz": 19, "high_hz": 90, "shape": "band"})), "scope_out_of_range", "adjustments[0].scope.frequency"),
    (item(scope=scope(frequency={"low_hz": 20, "high_hz": 4000, "shape": "band"})), "scope_out_of_range", "adjustments[0].scope.frequency"),
    (item(scope=scope(frequency={"low_hz": 20, "high_hz": 90, "shape": "bell"})), "invalid_adjustment", "adjustments[0].scope.frequency.shape"),
    (item(scope=scope(frequency={"low_hz": 20, "high_hz": 90, "shape": "notch"})), None, None),
]


def test_adjustment_matrix(spark):
    rows = [(i, 10.0, 4000.0, json.dumps({"adjustments": [c[0]]})) for i, c in enumerate(CASES)]
    rows += [(100, 10.0, 4000.0, "{"), (101, 10.0, 4000.0, '{"adjustments": {}}'), (102, 10.0, 4000.0, '{"adjustments": []}')]
    df = spark.createDataFrame(rows, "media_id long, duration_s double, nyquist_hz double, json string")
    out = {r.media_id: r for r in A.parse_adjustments(df).collect()}
    for i, (_, code, field) in enumerate(CASES):
        error = out[i].error
        assert (error.code if error else None) == code, (i, error)
        assert code is None or error.field == field, (i, error)
    assert out[0].adjustment_id == "adjustment_001" and out[0].end is None and out[13].end == 10
    assert out[100].error.code == out[101].error.code == "invalid_document" and 102 not in out
    mixed = json.dumps({"adjustments": [CASES[0][0], CASES[1][0], CASES[3][0]]})
    first = A.first_errors(A.parse_adjustments(spark.createDataFrame([(0, 10.0, 4000.0, mixed)], df.schema))).first()
    assert (first.first_error_index, first.code) == (1, "gain_out_of_range")


def test_run_words_and_lenient_bounds(spark):
    doc = {"segments": [{"text": "a", "words": [{"word": "a", "start": 0, "end": 1}]}, {"speaker": "s", "text": "b", "start": 1}]}
    df = spark.createDataFrame([("r", json.dumps(doc))], "run_id string, json string")
    strict = {r.seg_idx: r.error for r in N.run_segments(df).collect()}
    assert strict == {0: None, 1: "labelled_segment_lacks_time_bound"}
    words = N.segment_words(N.run_segments(df, strict=False)).orderBy("seg_idx").collect()
    assert [(w.seg_idx, w.text, w.end_s) for w in words] == [(0, "a", 1.0), (1, None, None)]


def test_selection_forms_exclude_each_other(spark):
    catalog = spark.createDataFrame([("a", ["s1"])], "id string, consumers array<string>")
    with pytest.raises(ValueError):
        K.select_artifacts(catalog, consumer="s1", ids=["a"])
    assert K.select_artifacts(catalog, ids=["a", "b"]).count() == 1


def test_sinks_refuse_to_overwrite(spark, tmp_path):
    reports = spark.createDataFrame([(1, (2.5, float("nan")))], "id long, doc struct<b:double,a:double>")
    path = str(tmp_path / "reports")
    sinks.write_reports(reports, "id", "doc", path)
    assert spark.read.parquet(path).first().report == '{"a":null,"b":2.5}'
    with pytest.raises(AnalysisException):
        sinks.write_reports(reports, "id", "doc", path)
    sinks.write_reports(reports, "id", "doc", path, replace=True)
    segs = spark.createDataFrame([(1, 5, "b"), (1, 2, "a")], "media_id long, start long, text string")
    sinks.write_jsonl(segs.coalesce(1), str(tmp_path / "lines"))
    lines = [json.loads(x) for f in sorted((tmp_path / "lines").glob("part*")) for x in f.read_text().splitlines()]
    assert [x["start"] for x in lines] == [2, 5]
    samples = spark.createDataFrame([(0, 0, 0, [0.5], None)], "media_id long, chunk_id long, start_sample long, ch0 array<float>, ch1 array<float>")
    sinks.write_samples(samples, str(tmp_path / "samples"))
    assert spark.read.parquet(str(tmp_path / "samples")).count() == 1


def test_digest_ignores_field_order(spark):
    df = spark.range(1).select(F.struct(F.lit(1).alias("a"), F.lit("x").alias("b")).alias("p"), F.struct(F.lit("x").alias("b"), F.lit(1).alias("a")).alias("q"))
    p, q = (fingerprint.digest(F.col(c), df.schema[c].dataType) for c in "pq")
    assert df.select((p == q).alias("same")).first().same


def test_repeat_drift_and_fingerprints(spark):
    rows = [(0, 0, 0, 5, "s", "a"), (0, 1, 5, 9, "s", "b"), (0, 2, 100, 105, "s", "a"), (0, 3, 105, 108, "s", "b"),
            (1, 0, 0, 5, "s", "a"), (1, 1, 100, 105, "t", "a")]
    df = spark.createDataFrame(rows, "media_id long, seg_idx long, start long, end long, speaker string, text string")
    for layout in (SINGLE, Layout(4)):
        windowed = repeats.repeat_windows(df, 100, 2)
        out = {r.media_id: r for r in repeats.paired_drift(windowed, 2, layout).collect()}
        assert out[0].pairable and out[0].maximum_drift == 1 and out[0].within_tolerance and out[0].timestamps == 4
        assert not out[1].pairable and out[1].maximum_drift is None and not out[1].within_tolerance
        agree = {r.media_id: r for r in repeats.fingerprints_agree(repeats.window_fingerprints(windowed, layout)).collect()}
        assert not agree[0].all_segments_equal and agree[0].all_texts_equal


def test_skip_lists_and_stage_order(spark):
    df = spark.createDataFrame([(None,), ("voice-enhance, x",), ("voice-enhance,voice-enhance",), ("a,,b",)], "raw string")
    out = [r.p.error for r in df.select(rules.skip_list(F.col("raw")).alias("p")).collect()]
    assert out == [None, "unknown:x", "duplicate", "empty_item"]


def test_stability_cap_is_three_valued(spark):
    runs = spark.createDataFrame([(1, 10.0, 5, 5, False), (2, 10.0, 5, 5, True), (3, 10.0, None, 5, False)],
                                 "run_id long, duration double, generated int, cap int, end_seen boolean")
    segs = spark.createDataFrame([(1, 0, 0.0, 10.05), (2, 0, 0.0, 10.2), (2, 1, 1.0, 2.0)], "run_id long, seg_idx long, start_s double, end_s double")
    out = {r.run_id: r for r in telemetry.stability_flags(runs, segs, 0.1, SINGLE).collect()}
    assert [out[i].hit_generation_cap for i in (1, 2, 3)] == [True, False, None]
    assert [out[i].bounds_valid for i in (1, 2, 3)] == [True, False, None]


def test_region_sanity(spark):
    rows = [(0, 0, 5, 20), (0, 4, 9, 20), (0, 12, 12, 20), (0, 15, 30, 20)]
    df = spark.createDataFrame(rows, "media_id long, start long, end long, total_samples long")
    out = [r.problem for r in quality.region_sanity(df, Layout(3)).orderBy("start").collect()]
    assert out == ["overlaps_previous", "empty", "outside_signal"]


def test_one_reject_row_per_bad_document(spark):
    xml = spark.createDataFrame([("bad", "no xml"), ("x", EAF)], "path string, xml string")
    assert [(r.path, r.error) for r in N.parse_eaf(xml).collect() if r.error == "unparseable_document"] == [("bad", "unparseable_document")]
    grids = spark.createDataFrame([("bad", bytearray("nothing".encode("utf-16")))], "path string, content binary")
    assert [(r.path, r.error) for r in N.parse_textgrid(grids).collect()] == [("bad", "unparseable_document")]
    runs = spark.createDataFrame([("bad", "not json"), ("none", '{"segments": []}')], "run_id string, json string")
    assert [(r.run_id, r.seg_idx, r.error) for r in N.run_segments(runs).collect()] == [("bad", None, "unparseable_document")]
    lists = spark.createDataFrame([("not json",)], "json string")
    assert [(r.id, r.error) for r in K.parse_catalog(lists).collect()] == [(None, "unparseable_document")]


def test_the_last_value_of_a_repeated_slot_counts(spark):
    xml = (
        '<ANNOTATION_DOCUMENT><TIME_ORDER><TIME_SLOT TIME_SLOT_ID="a" TIME_VALUE="1"/><TIME_SLOT TIME_SLOT_ID="b" TIME_VALUE="5"/>'
        '<TIME_SLOT TIME_SLOT_ID="a" TIME_VALUE="2"/></TIME_ORDER><TIER TIER_ID="t"><ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="1" '
        'TIME_SLOT_REF1="a" TIME_SLOT_REF2="b"><ANNOTATION_VALUE>v</ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION>'
        '<ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="2" TIME_SLOT_REF1="b" TIME_SLOT_REF2="b"><ANNOTATION_VALUE>w</ANNOTATION_VALUE>'
        "</ALIGNABLE_ANNOTATION></ANNOTATION></TIER></ANNOTATION_DOCUMENT>"
    )
    rows = N.parse_eaf(spark.createDataFrame([("x", xml)], "path string, xml string")).orderBy("annotation_id").collect()
    assert [(r.start_ms, r.end_ms, r.error) for r in rows] == [(2, 5, "repeated_time_slot"), (5, 5, None)]
