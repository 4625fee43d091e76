"""Annotation and run documents to segment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EAF = (
    "TIME_ORDER struct<TIME_SLOT:array<struct<_TIME_SLOT_ID:string,_TIME_VALUE:bigint>>>, "
    "TIER array<struct<_TIER_ID:string,ANNOTATION:array<struct<ALIGNABLE_ANNOTATION:struct<"
    "_ANNOTATION_ID:string,_TIME_SLOT_REF1:string,_TIME_SLOT_REF2:string,ANNOTATION_VALUE:string>>>>>"
)


def parse_eaf(documents: DataFrame) -> DataFrame:
    """Aligned annotations of ``(path, xml)`` documents with their slot times in milliseconds.

    Slots resolve inside the document, so nothing is shuffled. Of a repeated slot the last value counts, and ``error``
    marks the annotations that use it; it also marks unresolved slots and intervals that a tier holds more than once, and
    one row stands for a document without tiers.
    """
    parsed = documents.withColumn("_d", F.from_xml("xml", EAF))
    usable = F.reverse(
        F.filter(
            F.coalesce("_d.TIME_ORDER.TIME_SLOT", F.array().cast("array<struct<_TIME_SLOT_ID:string,_TIME_VALUE:bigint>>")),
            lambda s: s["_TIME_SLOT_ID"].isNotNull() & s["_TIME_VALUE"].isNotNull(),
        )
    )
    tiers = parsed.select(
        "path",
        usable.alias("_slots"),
        F.transform(usable, lambda s: s["_TIME_SLOT_ID"]).alias("_ids"),
        F.explode(F.coalesce("_d.TIER", F.array(F.lit(None)))).alias("_t"),
    ).withColumn("_ids_forward", F.reverse("_ids"))

    def slot(reference: Column) -> Column:
        return F.get("_slots", F.array_position("_ids", reference) - 1)["_TIME_VALUE"]

    def repeated(reference: Column) -> Column:
        # First from the front and first from the back are the same place unless the slot is repeated.
        places = F.array_position("_ids", reference) + F.array_position("_ids_forward", reference)
        return F.coalesce(places != F.size("_ids") + 1, F.lit(False))

    def placed(a: Column) -> Column:
        start, end = a["_TIME_SLOT_REF1"], a["_TIME_SLOT_REF2"]
        return F.struct(
            F.struct(slot(start).alias("start_ms"), slot(end).alias("end_ms")).alias("at"),
            (repeated(start) | repeated(end)).alias("repeated"),
            a["_ANNOTATION_ID"].alias("annotation_id"),
            F.trim(F.coalesce(a["ANNOTATION_VALUE"], F.lit(""))).alias("value"),
        )

    # Intervals that a tier holds more than once stand beside their equals when sorted.
    notes = F.transform("_t.ANNOTATION.ALIGNABLE_ANNOTATION", placed)
    sorted_ = tiers.withColumn("_notes", notes).withColumn("_sorted", F.sort_array("_notes.at"))
    paired = F.arrays_zip(
        F.slice("_sorted", F.lit(1), F.greatest(F.size("_sorted") - 1, F.lit(0))).alias("a"),
        F.slice("_sorted", F.lit(2), F.greatest(F.size("_sorted") - 1, F.lit(0))).alias("b"),
    )
    twice = F.array_distinct(F.transform(F.filter(paired, lambda p: p["a"] == p["b"]), lambda p: p["a"]))
    each = (
        sorted_.withColumn("_twice", twice)
        .withColumn("_a", F.explode(F.when(F.col("_t").isNull(), F.array(F.lit(None))).otherwise(F.col("_notes"))))
        .where("_a IS NOT NULL OR _t IS NULL")
    )
    error = (
        F.when(F.col("_t").isNull(), "unparseable_document")
        .when(F.col("_a.at.start_ms").isNull() | F.col("_a.at.end_ms").isNull(), "unresolved_time_slot")
        .when(F.col("_a.repeated"), "repeated_time_slot")
        .when(F.array_contains("_twice", F.col("_a.at")), "duplicate_interval")
    )
    return each.select(
        "path",
        F.col("_t._TIER_ID").alias("tier"),
        "_a.annotation_id",
        "_a.at.start_ms",
        "_a.at.end_ms",
        F.when(F.col("_a").isNull(), F.lit("")).otherwise(F.col("_a.value")).alias("value"),
        error.alias("error"),
    )


# The indentation-based layout of long-form interval files.
GRID_ITEM = r"(?ms)^    item \[\d+\]:\n(.*?)(?=^    item \[|\z)"
GRID_NAME = r'(?m)^        name = "(.*?)" *$'
GRID_INTERVAL = (
    r"(?ms)^        intervals \[\d+\]:\n"
    r"            xmin = ([0-9.eE+-]+) *\n"
    r"            xmax = ([0-9.eE+-]+) *\n"
    r'            text = "(.*?)" *$'
)


def parse_textgrid(documents: DataFrame) -> DataFrame:
    """Intervals of ``(path, content)`` UTF-16 grids: tier, position, bounds in seconds and text.

    A document in which no tier can be read is one row with an ``error``.
    """
    text = F.regexp_replace(F.decode("content", "UTF-16"), "\r\n?", "\n")
    found = F.filter(F.regexp_extract_all(text, F.lit(GRID_ITEM), F.lit(1)), lambda i: i.rlike(GRID_NAME))
    nothing = F.array(F.lit(None).cast("string"))
    items = documents.select("path", F.explode(F.when(F.size(found) > 0, found).otherwise(nothing)).alias("_i"))
    intervals = F.when(F.col("_i").isNull(), nothing).otherwise(F.regexp_extract_all("_i", F.lit(GRID_INTERVAL), F.lit(0)))
    named = items.select(
        "path",
        F.regexp_extract("_i", GRID_NAME, 1).alias("tier"),
        F.when(F.col("_i").isNull(), "unparseable_document").alias("error"),
        F.posexplode(intervals).alias("position", "_m"),
    )

    def group(index: int) -> Column:
        return F.regexp_extract("_m", GRID_INTERVAL, index)

    return named.select(
        "path",
        "tier",
        "position",
        group(1).cast("double").alias("start_s"),
        group(2).cast("double").alias("end_s"),
        F.replace(group(3), F.lit('""'), F.lit('"')).alias("text"),
        "error",
    )


# Superset of the field names different runners used for the same thing.
WORD = "struct<text:string,word:string,start:double,end:double,start_s:double,end_s:double>"
SEGMENT = (
    "struct<speaker_id:string,speaker:string,speakerId:string,start_s:double,start_time:double,startTimeSeconds:double,"
    "start_ms:double,start:double,end_s:double,end_time:double,endTimeSeconds:double,end_ms:double,end:double,"
    f"text:string,words:array<{WORD}>>"
)
BODY = f"segments array<{SEGMENT}>, result struct<sentences:array<{SEGMENT}>>"
RUN = f"output struct<{BODY.replace('segments array', 'segments:array').replace('result struct', 'result:struct')}>, {BODY}"


def run_segments(runs: DataFrame, strict: bool = True) -> DataFrame:
    """Segments of ``(run_id, json)`` run documents, whatever aliases they use.

    ``strict``: a labelled segment without both bounds is reported in ``error``; otherwise missing
    bounds stay null. Words are kept nested and normalised. A document in which no list of segments
    can be read is one row without a segment number.
    """
    parsed = runs.withColumn("_r", F.from_json("json", RUN))
    raw = F.when(
        F.col("_r.output").isNotNull(),
        F.coalesce("_r.output.segments", "_r.output.result.sentences"),
    ).otherwise(F.coalesce("_r.segments", "_r.result.sentences"))
    listed = F.when(raw.isNull(), F.array(F.lit(None).cast(SEGMENT))).otherwise(raw)
    rows = parsed.select("run_id", raw.isNull().alias("_bad"), F.posexplode(listed).alias("seg_idx", "_s"))

    def bound(side: str) -> Column:
        names = [f"{side}_s", f"{side}_time", f"{side}TimeSeconds", side]
        seconds = [F.col(f"_s.{n}") for n in names]
        return F.coalesce(*seconds, F.col(f"_s.{side}_ms") / 1000.0)

    def word(w: Column) -> Column:
        return F.struct(
            F.coalesce(w["word"], w["text"], F.lit("")).alias("text"),
            F.coalesce(w["start"], w["start_s"]).alias("start_s"),
            F.coalesce(w["end"], w["end_s"]).alias("end_s"),
        )

    out = rows.select(
        "run_id",
        "_bad",
        F.when(~F.col("_bad"), F.col("seg_idx").cast("bigint")).alias("seg_idx"),
        bound("start").alias("start_s"),
        bound("end").alias("end_s"),
        F.coalesce("_s.speaker_id", "_s.speaker", "_s.speakerId").alias("speaker"),
        F.coalesce("_s.text", F.lit("")).alias("text"),
        F.transform("_s.words", word).alias("words"),
    )
    unbound = F.col("start_s").isNull() | F.col("end_s").isNull()
    labelled = F.col("speaker").isNotNull()
    error = F.when(F.col("_bad"), "unparseable_document").when(
        F.lit(strict) & labelled & unbound, "labelled_segment_lacks_time_bound"
    )
    return out.withColumn("error", error).drop("_bad")


def segment_words(segments: DataFrame) -> DataFrame:
    """One row per word; segments without words keep one row with nulls."""
    return segments.select("run_id", "seg_idx", F.posexplode_outer("words").alias("word_idx", "_w")).select(
        "run_id", "seg_idx", "word_idx", "_w.text", "_w.start_s", "_w.end_s"
    )


REFERENCE = (
    "utterances array<struct<start_s:double,end_s:double,speaker:string,text:string>>, "
    "segments array<struct<start_ms:double,end_ms:double,speaker:string,text:struct<characters_cer:string>>>, "
    "source struct<duration_s:double>, clip struct<duration_ms:double>, reference_text string"
)


def reference_segments(references: DataFrame) -> DataFrame:
    """Segments of ``(media_id, json)`` references in either shape, with a ``shape`` column.

    Documents of neither shape come back as one row of shape ``unsupported``.
    """
    parsed = references.withColumn("_r", F.from_json("json", REFERENCE))
    shape = (
        F.when(F.col("_r.utterances").isNotNull(), "utterances")
        .when(F.col("_r.segments").isNotNull(), "segments")
        .otherwise("unsupported")
    )
    common = "struct<start_s:double,end_s:double,speaker:string,text:string>"
    unified = (
        F.when(F.col("shape") == "utterances", F.col("_r.utterances"))
        .when(
            F.col("shape") == "segments",
            F.transform(
                "_r.segments",
                lambda s: F.struct(
                    (s["start_ms"] / 1000.0).alias("start_s"),
                    (s["end_ms"] / 1000.0).alias("end_s"),
                    s["speaker"].alias("speaker"),
                    s["text"]["characters_cer"].alias("text"),
                ),
            ),
        )
        .cast(f"array<{common}>")
    )
    return (
        parsed.withColumn("shape", shape)
        .withColumns(
            {
                "_u": unified,
                "duration_s": F.coalesce("_r.source.duration_s", F.col("_r.clip.duration_ms") / 1000.0),
            }
        )
        .select("media_id", "shape", "duration_s", F.posexplode_outer("_u").alias("seg_idx", "_s"))
        .select("media_id", "shape", "duration_s", "seg_idx", "_s.start_s", "_s.end_s", "_s.speaker", "_s.text")
    )


MANIFEST_KEYS = ("slice_id", "language", "corpus", "source", "clip", "tiers")


def manifest_problems(manifests: DataFrame) -> DataFrame:
    """Missing required keys of ``(path, json)`` manifests."""
    keys = F.coalesce(F.json_object_keys("json"), F.array().cast("array<string>"))
    wanted = F.array(*[F.lit(k) for k in MANIFEST_KEYS])
    return manifests.select("path", F.explode(F.array_except(wanted, keys)).alias("missing"))
