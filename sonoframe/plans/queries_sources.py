"""Ingest, integrity, catalogue and contract queries over documents Spark derives from the tables."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from sonoframe.functions import fingerprint
from sonoframe.operators import comparison, quality, rules, telemetry
from sonoframe.operators.scan import lag, running
from sonoframe.plans import views as V
from sonoframe.plans.registry import query
from sonoframe.session import checkpoint_root
from sonoframe.sources import adjustments as A
from sonoframe.sources import annotations as N
from sonoframe.sources import catalog as K
from sonoframe.sources import media, pcm, sinks


@query(
    "content_inventory",
    "SRC-01",
    "SELECT 'doc/' || doc_id AS path, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, sha256(text) AS sha256 FROM documents",
)
def content_inventory(spark, sf):
    files = V.table(spark, sf, "documents").select(
        F.concat(F.lit("doc/"), "doc_id").alias("path"), F.encode("text", "UTF-8").alias("content")
    )
    return media.inventory(files.withColumn("bytes", F.octet_length("content").cast("bigint")))


@pandas_udf(T.BinaryType())
def stereo_wav(left: pd.Series, right: pd.Series) -> pd.Series:
    """Interleaved PCM16 bytes with a header, to have files to parse."""
    out = []
    for l, r in zip(left, right):
        pcm = np.rint(np.stack([l, r], axis=1) * 32767).astype("<i2").tobytes()
        head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(pcm), b"WAVE", b"fmt ", 16, 1, 2, 80, 320, 4, 16, b"data", len(pcm))
        out.append(head + pcm)
    return pd.Series(out)


PCM_SUMS = """WITH p AS (SELECT a.vec_id, unnest(a.embedding) AS x, unnest(b.embedding) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 2 = 0)
 SELECT 'wav/' || vec_id AS path, CASE WHEN vec_id % 14 = 0 THEN 'short_read' END AS error, CASE WHEN vec_id % 14 <> 0 THEN 64 END AS samples,
 CASE WHEN vec_id % 14 <> 0 THEN CAST(sum(round_even(x * 32767.0::FLOAT, 0)) AS BIGINT) END AS left_sum,
 CASE WHEN vec_id % 14 <> 0 THEN CAST(sum(round_even(y * 32767.0::FLOAT, 0)) AS BIGINT) END AS right_sum FROM p GROUP BY vec_id"""


@query("pcm_ingest", "SRC-02", PCM_SUMS)
def pcm_ingest(spark, sf):
    return sample_sums(media.parse_wav(wave_files(spark, sf), chunk_seconds=0.25))


def wave_files(spark, sf):
    """A stereo file of each pair of vectors; every seventh one is cut short."""
    vectors = V.table(spark, sf, "embeddings").select("vec_id", "embedding")
    right = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    paired = vectors.where("vec_id % 2 = 0").join(right, "vec_id")
    content = stereo_wav("embedding", "other")
    return paired.select("vec_id", content.alias("content")).select(
        F.concat(F.lit("wav/"), "vec_id").alias("path"),
        F.when(F.col("vec_id") % 14 == 0, F.expr("substring(content, 1, 100)")).otherwise(F.col("content")).alias("content"),
    )


def sample_sums(chunks):
    def level(channel):
        return F.aggregate(
            channel, F.lit(0).cast("bigint"), lambda a, x: a + F.round(x.cast("double") * 32768).cast("bigint")
        )

    return chunks.groupBy("path", "error").agg(
        F.sum(F.size("ch0")).alias("_n"), F.sum(level("ch0")).alias("left_sum"), F.sum(level("ch1")).alias("right_sum")
    ).select("path", "error", F.when(F.col("error").isNull(), F.col("_n")).alias("samples"), "left_sum", "right_sum")


@query("pcm_file_ranges", "SRC-02", PCM_SUMS)
def pcm_file_ranges(spark, sf):
    """The same files written to the shared folder and read back in ranges of 100 bytes."""
    folder = f"{checkpoint_root(spark)}/waves-{uuid.uuid4().hex}"
    named = wave_files(spark, sf).select(F.concat(F.substring_index("path", "/", -1), F.lit(".wav")).alias("name"), "content")
    sinks.write_files(named, folder)
    sums = sample_sums(pcm.read_pcm(spark, folder, "*.wav", chunk_seconds=0.25, range_bytes=100))
    return sums.withColumn("path", F.regexp_extract("path", r"([^/]*)\.wav$", 1)).withColumn("path", F.concat(F.lit("wav/"), "path"))


@query(
    "probe_facts",
    "SRC-03 SRC-04",
    """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'no_audio_stream' END AS error, CASE WHEN event_id % 10 = 0 OR event_id % 3 = 0 THEN value + 1 WHEN event_id % 3 = 1 THEN value ELSE 0 END AS duration_seconds,
 CASE WHEN event_id % 10 = 0 THEN 0 ELSE 48000 END AS sample_rate_hz, event_id % 2 = 0 AS has_video, event_id % 4 = 0 AS processed FROM events""".replace(
        "CASE WHEN event_id % 10 = 0 OR event_id % 3 = 0 THEN value + 1",
        "CASE WHEN event_id % 3 = 2 THEN 0.0::DOUBLE WHEN event_id % 10 = 0 OR event_id % 3 = 0 THEN round_even(value + 1, 6)",
    ),
)
def probe_facts(spark, sf):
    i, value = F.col("event_id"), F.col("value")
    audio = F.struct(
        F.when(i % 10 == 0, "subtitle").otherwise("audio").alias("codec_type"),
        F.when((i % 3 == 1), value.cast("string")).alias("duration"),
        F.lit("48000").alias("sample_rate"),
    )
    video = F.struct(
        F.lit("video").alias("codec_type"), F.lit(None).cast("string").alias("duration"), F.lit(None).cast("string").alias("sample_rate")
    )
    streams = F.when(i % 2 == 0, F.array(video, audio)).otherwise(F.array(audio))
    form = F.struct(
        F.when(i % 3 != 2, (value + 1).cast("string")).alias("duration"),
        F.create_map(F.lit("comment"), F.when(i % 4 == 0, F.lit("Was Enhanced here")).otherwise("plain")).alias("tags"),
    )
    documents = V.table(spark, sf, "events").select(
        "event_id", F.to_json(F.struct(streams.alias("streams"), form.alias("format"))).alias("json")
    )
    facts = media.probe_facts(documents)
    return facts.select(
        "event_id",
        "error",
        "duration_seconds",
        "sample_rate_hz",
        "has_video",
        media.already_processed(F.col("tags"), "enhanced").alias("processed"),
    )


def turn_table(spark, sf):
    return V.table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", F.translate("text", "\n\r\t", "   ").alias("text")
    )


TURN_TEXT = "translate(text, chr(10) || chr(13) || chr(9), '   ')"


@query(
    "elan_ingest",
    "SRC-05 JN-02",
    f"""SELECT conv_id, turn, role AS tier, CASE WHEN turn % 6 <> 5 THEN turn * 1000 END AS start_ms, turn * 1000 + 700 AS end_ms, md5(trim({TURN_TEXT})) AS digest,
 CASE WHEN turn % 6 = 5 THEN 'unresolved_time_slot' WHEN length(text) % 4 = 1 THEN 'duplicate_interval' END AS error
 FROM conversations, (SELECT unnest([1, 2]) AS copy) WHERE copy = 1 OR length(text) % 4 = 1""",
)
def elan_ingest(spark, sf):
    turns = turn_table(spark, sf)
    t = F.col("turn").cast("string")
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    slot = F.when(
        F.col("turn") % 6 != 5,
        F.format_string('<TIME_SLOT TIME_SLOT_ID="a%s" TIME_VALUE="%d"/>', t, F.col("turn") * 1000),
    ).otherwise("")
    late = F.format_string('<TIME_SLOT TIME_SLOT_ID="b%s" TIME_VALUE="%d"/>', t, F.col("turn") * 1000 + 700)
    note = F.format_string(
        '<ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="%s" TIME_SLOT_REF1="a%s" TIME_SLOT_REF2="b%s"><ANNOTATION_VALUE>%s</ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION>',
        t, t, t, escaped,
    )
    tiers = turns.groupBy("conv_id", "role").agg(
        F.array_join(F.collect_list(F.concat(slot, late)), "").alias("slots"),
        # Some annotations stand in their tier twice.
        F.array_join(F.collect_list(F.repeat(note, F.when(F.length("text") % 4 == 1, 2).otherwise(1))), "").alias("notes"),
    )
    documents = tiers.groupBy("conv_id").agg(
        F.concat(
            F.lit("<ANNOTATION_DOCUMENT><TIME_ORDER>"),
            F.array_join(F.collect_list("slots"), ""),
            F.lit("</TIME_ORDER>"),
            F.array_join(F.collect_list(F.format_string('<TIER TIER_ID="%s">%s</TIER>', "role", "notes")), ""),
            F.lit("</ANNOTATION_DOCUMENT>"),
        ).alias("xml")
    )
    parsed = N.parse_eaf(documents.select(F.col("conv_id").cast("string").alias("path"), "xml"))
    return parsed.select(
        F.col("path").cast("bigint").alias("conv_id"),
        F.col("annotation_id").cast("bigint").alias("turn"),
        "tier",
        "start_ms",
        "end_ms",
        F.md5("value").alias("digest"),
        "error",
    )


@query(
    "textgrid_ingest",
    "SRC-06",
    f"""SELECT conv_id, role AS tier, turn * 0.5::DOUBLE AS start_s, turn * 0.5::DOUBLE + 0.25 AS end_s, md5({TURN_TEXT} || ' "q"') AS digest FROM conversations""",
)
def textgrid_ingest(spark, sf):
    turns = turn_table(spark, sf)
    quoted = F.replace(F.concat("text", F.lit(' "q"')), F.lit('"'), F.lit('""'))
    row = F.format_string(
        '        intervals [%d]:\n            xmin = %s \n            xmax = %s \n            text = "%s" \n',
        F.col("turn") + 1, (F.col("turn") * 0.5).cast("string"), (F.col("turn") * 0.5 + 0.25).cast("string"), quoted,
    )
    tiers = turns.groupBy("conv_id", "role").agg(F.array_join(F.collect_list(row), "").alias("rows"))
    item = F.format_string(
        '    item [%d]:\n        class = "IntervalTier" \n        name = "%s" \n%s', F.ascii("role"), "role", "rows"
    )
    documents = tiers.groupBy("conv_id").agg(
        F.encode(F.concat(F.lit("File type\nitem []: \n"), F.array_join(F.collect_list(item), "")), "UTF-16").alias("content")
    )
    parsed = N.parse_textgrid(documents.select(F.col("conv_id").cast("string").alias("path"), "content"))
    return parsed.select(
        F.col("path").cast("bigint").alias("conv_id"), "tier", "start_s", "end_s", F.md5("text").alias("digest")
    )


@query(
    "run_ingest",
    "SRC-07",
    """SELECT event_id AS run_id, 0 AS seg_idx, CASE event_id % 4 WHEN 3 THEN floor(value * 1000) / 1000.0 WHEN 2 THEN NULL ELSE value END AS start_s,
 CASE WHEN event_id % 4 = 3 THEN floor(value * 2000) / 1000.0 ELSE value * 2 END AS end_s, event_type AS speaker,
 CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS words, CASE WHEN event_id % 4 = 2 THEN 'labelled_segment_lacks_time_bound' END AS error FROM events""",
)
def run_ingest(spark, sf):
    i, v, label = F.col("event_id"), F.col("value"), F.col("event_type")
    word = F.array(F.struct(F.lit("w").alias("word"), v.alias("start"), (v * 2).alias("end")))
    plain = F.struct(label.alias("speaker"), v.alias("start_s"), (v * 2).alias("end_s"), word.alias("words"))
    camel = F.struct(label.alias("speakerId"), v.alias("startTimeSeconds"), (v * 2).alias("endTimeSeconds"))
    unbound = F.struct(label.alias("speaker_id"), (v * 2).alias("end_time"))
    millis = F.struct(
        label.alias("speaker_id"), F.floor(v * 1000).alias("start_ms"), F.floor(v * 2000).alias("end_ms")
    )
    json = (
        F.when(i % 4 == 0, F.to_json(F.struct(F.struct(F.array(plain).alias("segments")).alias("output"))))
        .when(i % 4 == 1, F.to_json(F.struct(F.array(camel).alias("segments"))))
        .when(i % 4 == 2, F.to_json(F.struct(F.array(unbound).alias("segments"))))
        .otherwise(
            F.to_json(F.struct(F.struct(F.struct(F.array(millis).alias("sentences")).alias("result")).alias("output")))
        )
    )
    runs = V.table(spark, sf, "events").select(i.cast("string").alias("run_id"), json.alias("json"))
    out = N.run_segments(runs)
    return out.select(
        F.col("run_id").cast("bigint").alias("run_id"),
        "seg_idx",
        "start_s",
        "end_s",
        "speaker",
        F.when(F.col("words").isNull(), 0).otherwise(F.size("words")).alias("words"),
        "error",
    )


@query(
    "reference_ingest",
    "SRC-08",
    """SELECT event_id AS media_id, CASE event_id % 3 WHEN 0 THEN 'utterances' WHEN 1 THEN 'segments' ELSE 'unsupported' END AS shape,
 CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN event_id / 1000.0::DOUBLE END AS start_s, CASE event_id % 3 WHEN 0 THEN value + 1 WHEN 1 THEN (event_id + 500) / 1000.0::DOUBLE END AS end_s,
 CASE WHEN event_id % 3 < 2 THEN event_type END AS speaker, CASE event_id % 3 WHEN 0 THEN 99.5::DOUBLE WHEN 1 THEN 12.25 END AS duration_s FROM events""",
)
def reference_ingest(spark, sf):
    i, v, label = F.col("event_id"), F.col("value"), F.col("event_type")
    utterance = F.struct(v.alias("start_s"), (v + 1).alias("end_s"), label.alias("speaker"), F.lit("t").alias("text"))
    segment = F.struct(
        i.alias("start_ms"), (i + 500).alias("end_ms"), label.alias("speaker"), F.struct(F.lit("t").alias("characters_cer")).alias("text")
    )
    json = (
        F.when(
            i % 3 == 0,
            F.to_json(F.struct(F.array(utterance).alias("utterances"), F.struct(F.lit(99.5).alias("duration_s")).alias("source"))),
        )
        .when(
            i % 3 == 1,
            F.to_json(F.struct(F.array(segment).alias("segments"), F.struct(F.lit(12250).alias("duration_ms")).alias("clip"))),
        )
        .otherwise("{}")
    )
    refs = V.table(spark, sf, "events").select(i.alias("media_id"), json.alias("json"))
    return N.reference_segments(refs).select("media_id", "shape", "start_s", "end_s", "speaker", "duration_s")


@query(
    "manifest_required_keys",
    "SRC-09 DQ-01",
    """SELECT 'm/' || o_orderkey AS path, k AS missing FROM orders, (SELECT unnest(['slice_id','language','corpus','source','clip','tiers']) AS k, unnest(range(6)) AS p)
 WHERE (o_orderkey + p) % 9 = 0""",
)
def manifest_required_keys(spark, sf):
    key = F.col("o_orderkey")
    fields = [
        F.when((key + p) % 9 != 0, F.lit("x")).alias(name) for p, name in enumerate(N.MANIFEST_KEYS)
    ]
    manifests = V.table(spark, sf, "orders").select(
        F.concat(F.lit("m/"), key).alias("path"), F.to_json(F.struct(*fields)).alias("json")
    )
    return N.manifest_problems(manifests)


ADJUSTED = "CASE o_orderkey % 8 WHEN 0 THEN 'ok' WHEN 1 THEN 'gain_out_of_range' WHEN 2 THEN 'invalid_number' WHEN 3 THEN 'non_finite_number' WHEN 4 THEN 'scope_out_of_range' WHEN 5 THEN 'scope_out_of_range' WHEN 6 THEN 'invalid_adjustment' ELSE 'ok' END"


@query(
    "adjustment_ingest",
    "SRC-11 SC-11",
    f"""WITH a AS (SELECT o_orderkey AS media_id, o_orderkey % 8 AS k, {ADJUSTED} AS code FROM orders)
 SELECT media_id, CASE WHEN code <> 'ok' THEN code END AS code, CASE k WHEN 1 THEN 'adjustments[0].gain_db' WHEN 2 THEN 'adjustments[0].gain_db' WHEN 3 THEN 'adjustments[0].gain_db'
  WHEN 4 THEN 'adjustments[0].scope.time' WHEN 5 THEN 'adjustments[0].scope.frequency' END AS field,
 CASE WHEN code = 'ok' THEN 'adjustment_001' END AS adjustment_id, CASE WHEN code = 'ok' THEN -6.5::DOUBLE END AS gain_db,
 CASE WHEN k = 0 THEN 'before-voice-enhance' WHEN k = 7 THEN 'after-source-balance' END AS placement, CASE WHEN k = 0 THEN 100.0::DOUBLE WHEN k = 7 THEN 50.0 END AS resolved_end FROM a""",
)
def adjustment_ingest(spark, sf):
    k = F.col("o_orderkey") % 8
    gain = F.when(k == 1, "12.5").when(k == 2, "true").when(k == 3, "-Infinity").otherwise("-6.5")
    time = F.when(k == 4, '{"start": 5, "end": 101}').when(k == 7, '{"start": 1, "end": 50}').otherwise('"all"')
    band = (
        F.when(k == 5, '{"low_hz": 10, "high_hz": 100, "shape": "notch"}')
        .when(k == 0, '{"low_hz": 30, "high_hz": 100, "shape": "band"}')
        .otherwise('"all"')
    )
    extra = F.when(k == 6, ', "note": 1').otherwise("")
    json = F.format_string(
        '{"adjustments": [{"type": "gain", "gain_db": %s, "scope": {"time": %s, "frequency": %s}%s}]}', gain, time, band, extra
    )
    documents = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("media_id"),
        F.lit(100.0).alias("duration_s"),
        F.lit(24_000.0).alias("nyquist_hz"),
        json.alias("json"),
    )
    parsed = A.parse_adjustments(documents)
    placed = rules.adjustment_placement(
        F.struct("low_hz", "start", "end"), F.lit(100.0)
    )
    ok = F.col("error").isNull()
    return parsed.select(
        "media_id",
        "error.code",
        "error.field",
        "adjustment_id",
        "gain_db",
        F.when(ok, placed["placement"]).alias("placement"),
        F.when(ok, placed["resolved_end"]).alias("resolved_end"),
    )


def catalogue(spark, sf):
    docs = V.table(spark, sf, "documents")
    i = F.col("doc_id")
    size = F.octet_length("text").cast("bigint")
    return docs.select(
        F.concat(F.lit("d"), i).alias("id"),
        F.when(i % 97 == 0, "nowhere").otherwise(F.col("source")).alias("grp"),
        F.when(i % 89 == 0, "plugin").when(i % 2 == 0, "weights").otherwise("toolchain").alias("kind"),
        F.when(i % 83 == 0, F.array(F.lit("cook"))).otherwise(F.array(F.lit("asr"), F.lit("vad"))).alias("roles"),
        F.array(F.col("lang"), F.concat(F.lit("s"), i % 4)).alias("consumers"),
        F.when(i % 7 != 0, size).alias("bytes"),
        F.when(i % 21 == 0, size + 1).alias("recorded_bytes"),
        F.struct(
            F.when(i % 3 == 0, "url").otherwise("repo").alias("type"), F.when(i % 6 == 0, "file").alias("filename")
        ).alias("source"),
        F.when(i % 5 == 0, size + F.when(i % 10 == 0, 1).otherwise(0)).alias("parts_bytes"),
    )


@query(
    "catalogue_ingest",
    "SRC-12",
    """SELECT 'd' || doc_id AS id, source AS grp, CASE WHEN doc_id % 2 = 0 THEN 'weights' ELSE 'toolchain' END AS kind, CASE WHEN doc_id % 7 <> 0 THEN n_chars END AS bytes, lang AS consumer FROM documents""",
)
def catalogue_ingest(spark, sf):
    i = F.col("doc_id")
    entry = F.struct(
        F.col("source").alias("environment"),
        F.when(i % 2 == 0, "weights").otherwise("toolchain").alias("kind"),
        F.array(F.lit("asr")).alias("roles"),
        F.array("lang").alias("stacks"),
        F.when(i % 7 != 0, F.col("n_chars")).alias("bytes"),
    )
    packages = F.create_map(F.concat(F.lit("d"), i), entry)
    documents = V.table(spark, sf, "documents").select(F.to_json(F.struct(packages.alias("packages"))).alias("json"))
    return K.parse_catalog(documents).select("id", "grp", "kind", "bytes", F.col("consumers")[0].alias("consumer"))


CATALOGUE = """c AS (SELECT 'd' || doc_id AS id, CASE WHEN doc_id % 97 = 0 THEN 'nowhere' ELSE source END AS grp, CASE WHEN doc_id % 89 = 0 THEN 'plugin' WHEN doc_id % 2 = 0 THEN 'weights' ELSE 'toolchain' END AS kind,
  CASE WHEN doc_id % 83 = 0 THEN ['cook'] ELSE ['asr', 'vad'] END AS roles, lang, doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size,
  CASE WHEN doc_id % 7 <> 0 THEN CAST(octet_length(encode(text)) AS BIGINT) END AS bytes FROM documents)"""


@query(
    "artifact_selection",
    "FLT-12",
    f"WITH {CATALOGUE} SELECT id, kind FROM c WHERE lang = 'en' OR 's' || (doc_id % 4) = 'en'",
)
def artifact_selection(spark, sf):
    return K.select_artifacts(catalogue(spark, sf), consumer="en").select("id", "kind")


@query(
    "unknown_artifacts",
    "FLT-12 SE-01 JN-16",
    "SELECT 'd' || (doc_id * 2) AS id FROM documents WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = documents.doc_id * 2)",
)
def unknown_artifacts(spark, sf):
    requested = V.table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id") * 2).alias("id"))
    return K.unknown_ids(catalogue(spark, sf), requested)


@query(
    "size_rollup",
    "AG-23",
    f"""WITH {CATALOGUE}, s AS (SELECT *, coalesce(CASE WHEN doc_id % 21 = 0 THEN size + 1 END, bytes) AS b FROM c)
 SELECT grp, CAST(coalesce(sum(b), 0) AS BIGINT) AS known_bytes, count(*) FILTER (WHERE b IS NULL) AS unsized, count(*) AS artifacts FROM s GROUP BY 1""",
)
def size_rollup(spark, sf):
    return K.size_rollup(catalogue(spark, sf), ["grp"])


@query(
    "unsized_artifacts",
    "AG-23",
    f"WITH {CATALOGUE} SELECT grp, id FROM c WHERE doc_id % 7 = 0 AND doc_id % 21 <> 0",
)
def unsized_artifacts(spark, sf):
    return K.unsized_ids(catalogue(spark, sf), ["grp"])


@query(
    "artifacts_not_ready",
    "JN-16",
    f"WITH {CATALOGUE} SELECT id FROM c WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE 'd' || l.doc_id = c.id AND quality = 1)",
)
def artifacts_not_ready(spark, sf):
    registry = V.table(spark, sf, "labels").select(
        F.concat(F.lit("d"), "doc_id").alias("id"), F.when(F.col("quality") == 1, "ready").otherwise("failed").alias("state")
    )
    return K.not_ready(catalogue(spark, sf), registry).select("id")


@query(
    "catalogue_consistency",
    "DQ-10",
    f"""WITH {CATALOGUE}, g AS (SELECT DISTINCT source AS grp FROM documents UNION ALL SELECT 'empty_env')
 SELECT id, 'unknown_group:' || grp AS problem FROM c WHERE grp NOT IN (SELECT grp FROM g) UNION ALL SELECT id, 'unexpected_kind:plugin' FROM c WHERE kind = 'plugin'
 UNION ALL SELECT id, 'url_without_filename' FROM c WHERE doc_id % 3 = 0 AND doc_id % 6 <> 0 UNION ALL SELECT id, 'unknown_role:cook' FROM c WHERE doc_id % 83 = 0
 UNION ALL SELECT id, 'size_is_not_sum_of_parts' FROM c WHERE doc_id % 5 = 0 AND (bytes IS NULL OR doc_id % 10 = 0)
 UNION ALL SELECT grp, 'group_without_member' FROM g WHERE grp NOT IN (SELECT grp FROM c)""",
)
def catalogue_consistency(spark, sf):
    groups = V.table(spark, sf, "documents").select(F.explode(F.array("source", F.lit("empty_env"))).alias("grp")).distinct()
    return K.consistency_problems(catalogue(spark, sf), groups.withColumn("provisioned", F.lit(True)), ["asr", "vad"])


@query(
    "file_integrity",
    "JN-15",
    """WITH e AS (SELECT doc_id, sha256(text) AS h, n_chars AS d FROM documents WHERE doc_id % 11 <> 0),
 f AS (SELECT doc_id, sha256(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END) AS h, n_chars + CASE WHEN doc_id % 17 = 0 THEN 2 WHEN doc_id % 19 = 0 THEN 1 ELSE 0 END AS d FROM documents WHERE doc_id % 7 <> 0)
 SELECT 'f/' || coalesce(e.doc_id, f.doc_id) AS path, CASE WHEN f.doc_id IS NULL THEN 'missing' WHEN e.doc_id IS NULL THEN 'unexpected' WHEN e.h <> f.h THEN 'changed' WHEN abs(e.d - f.d) > 1 THEN 'facts_drift' ELSE 'ok' END AS status
 FROM e FULL JOIN f ON e.doc_id = f.doc_id""",
)
def file_integrity(spark, sf):
    docs, i = V.table(spark, sf, "documents"), F.col("doc_id")
    path = F.concat(F.lit("f/"), i).alias("path")
    rate, one = F.lit(16_000).alias("sample_rate_hz"), F.lit(1).alias("channels")
    expected = docs.where(i % 11 != 0).select(
        path, F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("duration_ms"), rate, one
    )
    changed = F.when(i % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    shift = F.when(i % 17 == 0, 2).when(i % 19 == 0, 1).otherwise(0)
    found = docs.where(i % 7 != 0).select(
        path, F.sha2(changed, 256).alias("sha256"), (F.col("n_chars") + shift).alias("duration_ms"), rate, one
    )
    return media.integrity(expected, found)


@query(
    "evidence_ledger",
    "CP-06",
    "SELECT 'e/' || d.doc_id AS path, b.doc_id IS NOT NULL AS present, sha256(b.text) AS sha256, b.n_chars AS bytes FROM documents d LEFT JOIN (SELECT * FROM documents WHERE doc_id % 3 <> 0) b ON b.doc_id = d.doc_id",
)
def evidence_ledger(spark, sf):
    docs = V.table(spark, sf, "documents")
    path = F.concat(F.lit("e/"), "doc_id").alias("path")
    found = docs.where("doc_id % 3 <> 0").select(path, F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("bytes"))
    return comparison.evidence_ledger(docs.select(path), found)


@query(
    "target_ratios",
    "CP-08 AG-22",
    """SELECT o_orderkey AS run_id, o_totalprice / nullif(o_custkey % 10 * 1e5, 0) AS rtf, o_totalprice / nullif(o_custkey % 10 * 1e5, 0) <= 1 AS meets_target FROM orders""",
)
def target_ratios(spark, sf):
    runs = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("wall"), (F.col("o_custkey") % 10 * 1e5).alias("duration")
    )
    return comparison.target_ratios(runs, 1.0).select("run_id", "rtf", "meets_target")


def telemetry_rows(spark, sf):
    """Line items as samples: unique per order by the full ordering key."""
    return V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_returnflag").alias("phase"),
        (F.col("l_linenumber") * 1.5).alias("elapsed_s"),
        (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("sample_idx"),
        F.floor("l_extendedprice").cast("bigint").alias("rss_bytes"),
        F.floor(F.col("l_extendedprice") / 3).cast("bigint").alias("available_bytes"),
        F.col("l_quantity").cast("bigint").alias("swap_bytes"),
    )


@query(
    "telemetry_peaks",
    "AG-21",
    """SELECT l_orderkey AS run_id, l_returnflag AS phase, CAST(max(floor(l_extendedprice)) AS BIGINT) AS peak_rss_bytes, CAST(min(floor(l_extendedprice / 3)) AS BIGINT) AS minimum_available_bytes, count(*) AS samples
 FROM lineitem GROUP BY GROUPING SETS ((l_orderkey), (l_orderkey, l_returnflag))""",
)
def telemetry_peaks(spark, sf):
    return telemetry.peak_rollup(telemetry_rows(spark, sf))


@query(
    "telemetry_gaps",
    "AG-21",
    """WITH t AS (SELECT l_orderkey AS run_id, l_linenumber * 1.5::DOUBLE AS e, l_partkey * 1000000 + l_suppkey AS s, CAST(l_quantity AS BIGINT) AS w FROM lineitem),
 g AS (SELECT *, e - lag(e) OVER (PARTITION BY run_id ORDER BY e, s) AS gap, first_value(w) OVER (PARTITION BY run_id ORDER BY e, s, w) AS w0 FROM t)
 SELECT run_id, max(gap) AS longest_gap_s, greatest(0, max(w) - min(w0)) AS swap_growth_bytes FROM g GROUP BY 1""",
)
def telemetry_gaps(spark, sf):
    rows = telemetry_rows(spark, sf)
    layout = V.measure_layout(rows, ["run_id"], F.col("elapsed_s"), 60)
    return telemetry.sampling_gaps(rows, layout)


@query(
    "stage_timing",
    "AG-22",
    """WITH s AS (SELECT l_orderkey AS run_id, sum(l_quantity) AS w, count(*) AS n FROM lineitem GROUP BY 1)
 SELECT o_orderkey AS run_id, coalesce(w, 0) AS stage_wall, coalesce(n, 0) AS stage_calls, o_totalprice / 1000 / nullif(o_custkey % 100, 0) AS rtf,
 greatest(0, o_totalprice / 1000 - coalesce(w, 0)) AS overhead FROM orders LEFT JOIN s ON run_id = o_orderkey""",
)
def stage_timing(spark, sf):
    runs = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        (F.col("o_totalprice") / 1000).alias("wall"),
        (F.col("o_custkey") % 100).cast("double").alias("duration"),
    )
    stages = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_quantity").alias("wall"))
    out = telemetry.stage_timing(runs, stages)
    return out.select("run_id", "stage_wall", "stage_calls", "rtf", "overhead")


@query(
    "stability_flags",
    "DQ-12",
    f"""WITH {V.SEGMENTS}, s AS (SELECT media_id, seg_idx, "start" / 1e6 AS b, "end" / 1e6 AS e, lag("start") OVER w AS pb, lag("end") OVER w AS pe, "start" AS ib, "end" AS ie FROM v_seg WINDOW w AS (PARTITION BY media_id ORDER BY seg_idx))
 SELECT media_id AS run_id, bool_and((pb IS NULL OR (ib >= pb AND ie >= pe)) AND b >= 0 AND e >= b AND e <= 2592000 + 0.1) AS bounds_valid, count(*) AS segment_count,
 round(arg_max(e, seg_idx) / 2592000, 6) AS last_end_ratio, CASE WHEN media_id % 3 <> 0 THEN count(*) = 70 AND media_id % 2 = 0 END AS hit_generation_cap FROM s GROUP BY 1""",
)
def stability_flags(spark, sf):
    segs = V.segments(spark, sf).select(
        F.col("media_id").alias("run_id"), "seg_idx", (F.col("start") / 1e6).alias("start_s"), (F.col("end") / 1e6).alias("end_s")
    )
    k = F.col("run_id")
    runs = segs.groupBy("run_id").agg(F.count("*").alias("generated")).select(
        "run_id",
        F.lit(2_592_000.0).alias("duration"),
        "generated",
        F.lit(70).alias("cap"),
        F.when(k % 3 != 0, k % 2 != 0).alias("end_seen"),
    )
    layout = V.measure_layout(segs, ["run_id"], F.col("seg_idx"), 1_000_000)
    out = telemetry.stability_flags(runs, segs, 0.1, layout)
    return out.select(
        "run_id", "bounds_valid", "segment_count", F.round("last_end_ratio", 6).alias("last_end_ratio"), "hit_generation_cap"
    )


@query(
    "missing_fields",
    "DQ-01",
    """SELECT event_id, f AS missing FROM events, (SELECT unnest(['speaker', 'text']) AS f) WHERE (f = 'speaker' AND event_id % 5 = 0) OR (f = 'text' AND event_id % 8 = 0)""",
)
def missing_fields(spark, sf):
    i = F.col("event_id")
    rows = V.table(spark, sf, "events").select(
        "event_id", F.when(i % 5 != 0, F.col("event_type")).alias("speaker"), F.when(i % 8 != 0, F.col("props")).alias("text")
    )
    return quality.missing_fields(rows, ["event_id"], ["speaker", "text"])


@query(
    "exact_key_sets",
    "DQ-01",
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'scope' ELSE '' END AS missing, 'k' AS unexpected FROM events",
)
def exact_key_sets(spark, sf):
    extended = F.when(
        F.col("event_id") % 4 != 0, F.concat(F.lit('{"scope": 1, '), F.substr("props", F.lit(2)))
    ).otherwise(F.col("props"))
    rows = V.table(spark, sf, "events").select("event_id", extended.alias("json"))
    out = quality.key_set_problems(rows, ["event_id"], "json", ["scope"])
    return out.withColumns({c: F.array_join(c, ",") for c in ("missing", "unexpected")})


@query(
    "count_drift",
    "DQ-02 AG-17",
    """WITH a AS (SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS convs FROM conversations GROUP BY 1),
 e AS (SELECT role, count(*) + CASE WHEN role = 'user' THEN 1 ELSE 0 END AS turns, count(DISTINCT conv_id) AS convs FROM conversations GROUP BY 1)
 SELECT a.role, 'turns' AS metric, a.turns AS actual, e.turns AS expected FROM a JOIN e ON a.role = e.role WHERE a.turns <> e.turns
 UNION ALL SELECT a.role, 'convs', a.convs, e.convs FROM a JOIN e ON a.role = e.role WHERE a.convs <> e.convs""",
)
def count_drift(spark, sf):
    actual = V.table(spark, sf, "conversations").groupBy("role").agg(
        F.count("*").alias("turns"), F.count_distinct("conv_id").alias("convs")
    )
    expected = actual.withColumn("turns", F.col("turns") + F.when(F.col("role") == "user", 1).otherwise(0))
    return quality.count_drift(actual, expected, ["role"], ["turns", "convs"])


@query(
    "structural_counts",
    "AG-17",
    """WITH c AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
 SELECT conv_id, count(*) AS segments, count(*) FILTER (WHERE p <> role) AS transitions, count(*) FILTER (WHERE role = 'user') AS user_segments, count(*) FILTER (WHERE length(trim(text)) = 0) AS empty_references FROM c GROUP BY 1""",
)
def structural_counts(spark, sf):
    turns = V.table(spark, sf, "conversations")
    layout = V.measure_layout(turns, ["conv_id"], F.col("turn"), 1000)
    seen = running(turns, ["conv_id"], ["turn"], layout, _p=lag(F.col("role")))

    def times(flag):
        return F.count(F.when(flag, F.lit(1)))

    return seen.groupBy("conv_id").agg(
        F.count("*").alias("segments"),
        times(F.col("_p") != F.col("role")).alias("transitions"),
        times(F.col("role") == "user").alias("user_segments"),
        times(F.length(F.trim("text")) == 0).alias("empty_references"),
    )


@query(
    "interval_problems",
    "DQ-03",
    """WITH s AS (SELECT user_id AS media_id, event_id // 3 AS "start", CASE WHEN event_id % 10 = 0 THEN event_id // 3 ELSE event_id // 3 + 5 END AS "end" FROM events)
 SELECT media_id, "start", "end", count(*) AS copies, CASE WHEN "end" <= "start" THEN 'invalid_interval' ELSE 'duplicate_interval' END AS problem FROM s GROUP BY 1, 2, 3 HAVING "end" <= "start" OR count(*) > 1""",
)
def interval_problems(spark, sf):
    start = F.floor(F.col("event_id") / 3).cast("bigint")
    rows = V.table(spark, sf, "events").select(
        F.col("user_id").alias("media_id"),
        start.alias("start"),
        F.when(F.col("event_id") % 10 == 0, start).otherwise(start + 5).alias("end"),
    )
    return quality.interval_problems(rows, ["media_id"])


# Capabilities of run documents, the arrays they fill and the segment fields they fill, with the divisors
# by which the queries below request and fill them.
GATED_ARRAYS = {
    "diarization": ("turns", 2, 3),
    "lid": ("lid_regions", 7, 14),
    "overlapped_speech": ("overlapped_speech", 3, 6),
    "vad": ("vad_regions", 5, 4),
}
GATED_FIELDS = {
    "end": ("segment_timestamps", 5, 7),
    "speaker": ("diarization", 2, 2),
    "start": ("segment_timestamps", 5, 5),
    "words": ("word_timestamps", 3, 3),
}


@query(
    "capability_gating",
    "DQ-05",
    " UNION ALL ".join(
        f"""SELECT o_orderkey AS doc_id, '{column}:' || CASE WHEN o_orderkey % {filled} = 0 THEN 'present_not_requested' ELSE 'requested_absent' END AS problem
 FROM orders WHERE (o_orderkey % {asked} = 0) <> (o_orderkey % {filled} = 0)"""
        for column, asked, filled in GATED_ARRAYS.values()
    ),
)
def capability_gating(spark, sf):
    k = F.col("o_orderkey")
    requested = [F.when(k % asked == 0, capability) for capability, (_, asked, _) in GATED_ARRAYS.items()]
    documents = V.table(spark, sf, "orders").select(
        k.alias("doc_id"),
        F.array_compact(F.array(*requested)).alias("requested"),
        *(F.when(k % filled == 0, F.array(F.lit("x"))).alias(column) for column, _, filled in GATED_ARRAYS.values()),
    )
    return quality.capability_gating(documents, {c: column for c, (column, _, _) in GATED_ARRAYS.items()})


@query(
    "segment_gating",
    "DQ-05",
    " UNION ALL ".join(
        f"""SELECT l_orderkey AS doc_id, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS segment_id, '{field}:present_not_requested' AS problem
 FROM lineitem WHERE l_orderkey % {asked} <> 0 AND l_linenumber % {filled} = 0"""
        for field, (_, asked, filled) in GATED_FIELDS.items()
    ),
)
def segment_gating(spark, sf):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    asked = {capability: divisor for capability, divisor, _ in GATED_FIELDS.values()}
    rows = V.table(spark, sf, "lineitem").select(
        k.alias("doc_id"),
        (F.col("l_partkey") * 100_000 + F.col("l_suppkey") * 10 + n).alias("segment_id"),
        F.array_compact(F.array(*(F.when(k % d == 0, c) for c, d in asked.items()))).alias("requested"),
        *(F.when(n % filled == 0, "a").alias(field) for field, (_, _, filled) in GATED_FIELDS.items()),
    )
    return quality.segment_gating(rows, {field: capability for field, (capability, _, _) in GATED_FIELDS.items()})


@query(
    "observation_problems",
    "DQ-06",
    """WITH s AS (SELECT l_orderkey AS run_id, sum(l_quantity) AS w, max(l_extendedprice) AS p, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT *, run_id % 4 AS k FROM s)
 SELECT run_id, 'segment_count' AS problem FROM r WHERE k = 1 UNION ALL SELECT run_id, 'stage_wall_sum' FROM r WHERE k = 2 UNION ALL SELECT run_id, 'peak_not_maximum' FROM r WHERE k = 3""",
)
def observation_problems(spark, sf):
    stages = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_quantity").alias("wall"), F.col("l_extendedprice").alias("peak")
    )
    k = F.col("run_id") % 4
    runs = stages.groupBy("run_id").agg(
        F.count("*").alias("_n"), F.sum("wall").alias("_w"), F.max("peak").alias("_p")
    ).select(
        "run_id",
        (F.col("_n") + F.when(k == 1, 1).otherwise(0)).alias("observed_segments"),
        (F.col("_w") + F.when(k == 2, 0.5).otherwise(0.0)).alias("total_wall"),
        (F.col("_p") + F.when(k == 3, 1.0).otherwise(0.0)).alias("peak"),
    )
    return quality.observation_problems(runs, stages, stages.select("run_id"))


@query(
    "punctuation_invariant",
    "DQ-07 SC-04",
    r"""SELECT conv_id, count(*) FILTER (WHERE turn % 4 = 3) AS violations FROM conversations WHERE length(text) > 0 GROUP BY 1""",
)
def punctuation_invariant(spark, sf):
    turns = V.table(spark, sf, "conversations").where("length(text) > 0")
    words = F.split("text", r"\s+")
    spoiled = F.when(F.col("turn") % 4 == 3, F.concat(words, F.array(F.lit("zz")))).otherwise(words)
    holds = quality.punctuation_invariant(turns, F.col("text"), spoiled)
    return turns.groupBy("conv_id").agg(F.count(F.when(~holds, F.lit(1))).alias("violations"))


@query(
    "word_bound_problems",
    "DQ-08",
    """SELECT event_id AS doc_id, event_id AS segment_id, p AS problem FROM events, (SELECT unnest(['words_backwards', 'words_outside_segment', 'segment_outside_source']) AS p, unnest([3, 5, 7]) AS m)
 WHERE event_id % m = 0""",
)
def word_bound_problems(spark, sf):
    i, v = F.col("event_id"), F.col("value")

    def word(start, end):
        return F.struct(F.lit("w").alias("text"), start.alias("start"), end.alias("end"))

    second = F.when(i % 3 == 0, v + 0.5).otherwise(v + 1.0)
    last = F.when(i % 5 == 0, v + 9.0).otherwise(v + 2.0)
    rows = V.table(spark, sf, "events").select(
        i.alias("doc_id"),
        i.alias("segment_id"),
        v.alias("start"),
        (v + 3.0).alias("end"),
        F.when(i % 7 == 0, v).otherwise(v + 10.0).alias("duration"),
        F.array(word(v, v + 1.0), word(second, last)).alias("words"),
    )
    return quality.word_bound_problems(rows)


@query(
    "sentinel_speakers",
    "DQ-09 SC-19",
    """SELECT conv_id AS doc_id, CASE WHEN turn % 2 = 0 THEN 'segments' ELSE 'turns' END AS place, count(*) AS published FROM conversations WHERE turn % 3 = 0 GROUP BY 1, 2""",
)
def sentinel_speakers(spark, sf):
    rows = V.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        F.when(F.col("turn") % 2 == 0, "segments").otherwise("turns").alias("place"),
        F.when(F.col("turn") % 3 == 0, "N/A").otherwise(F.col("role")).alias("speaker"),
    )
    return quality.sentinel_speakers(rows)


@query(
    "canonical_digests",
    "SC-15 SNK-01",
    """SELECT o_orderkey, report, sha256(report) AS sha256 FROM (SELECT o_orderkey,
 '{"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '","o_totalprice":' || CAST(o_totalprice AS VARCHAR) || '}' AS report FROM orders)""",
)
def canonical_digests(spark, sf):
    orders = V.table(spark, sf, "orders").select(
        "o_orderkey", F.struct("o_totalprice", "o_orderstatus", "o_custkey").alias("report")
    )
    schema = orders.schema["report"].dataType
    return orders.select(
        "o_orderkey",
        fingerprint.digest(F.col("report"), schema).alias("sha256"),
        sinks.report_json("report", schema).alias("report"),
    )


@query(
    "operations_fingerprints",
    "SC-16",
    """SELECT o_orderkey, true AS agree, sha256('{"adjustments":[{"gain_db":' || o_orderkey % 5 || '}],"profile":{"name":"transcription","target_lufs":-23.0},"source_sha256":"'
  || sha256(CAST(o_orderkey AS VARCHAR)) || '","stages":[{"name":"program-loudness","operations":[{"gain_db":' || o_orderkey % 7
  || ',"type":"gain"}],"reason":"program_outside_profile_target","status":"applied"}]}') AS dry_sha256 FROM orders""",
)
def operations_fingerprints(spark, sf):
    """Same plan, with and without the codec correction only a render knows: the digests agree."""
    k = F.col("o_orderkey")

    def plan(correction):
        operation = F.struct(F.lit("gain").alias("type"), (k % 7).alias("gain_db"), correction.alias("codec_peak_correction_db"))
        stage = F.struct(
            F.lit("program-loudness").alias("name"),
            F.lit("applied").alias("status"),
            F.lit("program_outside_profile_target").alias("reason"),
            F.array(operation).alias("operations"),
        )
        return F.array(stage)

    rows = V.table(spark, sf, "orders").select(
        "o_orderkey",
        F.struct(F.lit("transcription").alias("name"), F.lit(-23.0).alias("target_lufs")).alias("profile"),
        plan(F.lit(None).cast("double")).alias("dry"),
        plan((k % 3) * -0.1).alias("rendered"),
        F.array(F.struct((k % 5).alias("gain_db"))).alias("adjustments"),
        F.sha2(k.cast("string"), 256).alias("source"),
    )
    types = {
        "profile": rows.schema["profile"].dataType,
        "stages": rows.schema["rendered"].dataType,
        "adjustments": rows.schema["adjustments"].dataType,
    }

    def digest(stages):
        return fingerprint.operations_fingerprint(
            F.col("profile"), F.col(stages), F.col("adjustments"), F.col("source"), types
        )

    return rows.select(
        "o_orderkey", digest("dry").alias("dry_sha256"), (digest("dry") == digest("rendered")).alias("agree")
    )
