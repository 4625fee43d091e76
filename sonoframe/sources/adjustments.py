"""Bounded gain adjustments: exact-key validation with the first failure per item as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NON_FINITE = r"([:\[,]\s*)(-?Infinity|NaN)(?=\s*[,}\]])"
NUMBERS = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def _keys(json: Column) -> Column:
    return F.array_sort(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")))


def _exactly(json: Column, *names: str) -> Column:
    return _keys(json) == F.array(*[F.lit(n) for n in sorted(names)])


PATHS = (
    "$.type",
    "$.gain_db",
    "$.scope.time",
    "$.scope.time.start",
    "$.scope.time.end",
    "$.scope.frequency",
    "$.scope.frequency.low_hz",
    "$.scope.frequency.high_hz",
    "$.scope.frequency.shape",
)


def _extracted() -> dict[str, Column]:
    """Type, number and text of every path, each read once per item."""
    out = {}
    for path in PATHS:
        out[f"_type {path}"] = F.expr(f"schema_of_variant(try_variant_get(_v, '{path}', 'variant'))")
        out[f"_number {path}"] = F.expr(f"try_variant_get(_v, '{path}', 'double')")
        out[f"_text {path}"] = F.expr(f"try_variant_get(_v, '{path}', 'string')")
    return out


def _type(path: str) -> Column:
    return F.col(f"`_type {path}`")


def _number(path: str) -> Column:
    return F.col(f"`_number {path}`")


def _text(path: str) -> Column:
    return F.col(f"`_text {path}`")


def _not_number(path: str) -> Column:
    return ~F.coalesce(_type(path).rlike(NUMBERS), F.lit(False))


def _non_finite(path: str) -> Column:
    return F.coalesce(_text(path).rlike(r"^#(-?Infinity|NaN)$"), F.lit(False))


def _error(code: str, field: str | None, provided: Column | None = None, allowed: str | None = None) -> Column:
    where = F.concat(F.lit("adjustments["), F.col("index").cast("string"), F.lit(f"].{field}")) if field else F.lit(None)
    return F.struct(
        F.lit(code).alias("code"),
        where.cast("string").alias("field"),
        (F.lit(None) if provided is None else provided).cast("string").alias("provided"),
        F.lit(allowed).cast("string").alias("allowed"),
    )


def parse_adjustments(documents: DataFrame) -> DataFrame:
    """Items of ``(media_id, duration_s, nyquist_hz, json)`` documents, accepted or with ``error``.

    A document whose top level is wrong yields one row with index null. Booleans are not numbers.
    """
    quoted = F.regexp_replace("json", NON_FINITE, '$1"#$2"')
    tops = documents.withColumn("_j", quoted).withColumn(
        "_top_ok",
        F.expr("coalesce(schema_of_variant(try_parse_json(_j)) LIKE 'OBJECT%', false)")
        & _exactly(F.col("_j"), "adjustments")
        & F.expr(
            "coalesce(schema_of_variant(try_variant_get(try_parse_json(_j), '$.adjustments', 'variant')) LIKE 'ARRAY%', false)"
        ),
    )
    items = F.from_json("_j", "adjustments array<string>")["adjustments"]
    rows = tops.select(
        "media_id",
        "duration_s",
        "nyquist_hz",
        "_top_ok",
        F.posexplode_outer(F.when(F.col("_top_ok"), items)).alias("index", "_item"),
    ).where(~F.col("_top_ok") | F.col("index").isNotNull())
    parsed = rows.withColumn("_v", F.expr("try_parse_json(_item)")).withColumns(_extracted())
    scope = F.get_json_object("_item", "$.scope")
    time, band = F.get_json_object("_item", "$.scope.time"), F.get_json_object("_item", "$.scope.frequency")
    gain, start, end = _number("$.gain_db"), _number("$.scope.time.start"), _number("$.scope.time.end")
    low, high = _number("$.scope.frequency.low_hz"), _number("$.scope.frequency.high_hz")
    shape = _text("$.scope.frequency.shape")
    all_time = F.coalesce(_text("$.scope.time") == "all", F.lit(False))
    all_band = F.coalesce(_text("$.scope.frequency") == "all", F.lit(False))

    checks: list[tuple[Column, Column]] = [
        (~F.col("_top_ok"), _error("invalid_document", None)),
        (~_exactly(F.col("_item"), "type", "gain_db", "scope"), _error("invalid_adjustment", None)),
        (~F.coalesce(_text("$.type") == "gain", F.lit(False)), _error("invalid_adjustment", "type")),
    ]

    def number(path: str, field: str, unless: Column | None = None) -> None:
        for test, code in ((_non_finite, "non_finite_number"), (_not_number, "invalid_number")):
            bad = test(path) if unless is None else ~unless & test(path)
            checks.append((bad, _error(code, field, _text(path), "finite_number")))

    number("$.gain_db", "gain_db")
    checks.append((~gain.between(-24.0, 12.0), _error("gain_out_of_range", "gain_db", gain, "-24..12")))
    checks.append((~_exactly(scope, "time", "frequency"), _error("invalid_adjustment", "scope")))
    checks.append((~all_time & ~_exactly(time, "start", "end"), _error("invalid_adjustment", "scope.time")))
    number("$.scope.time.start", "scope.time.start", all_time)
    number("$.scope.time.end", "scope.time.end", all_time)
    bad_time = (start < 0) | (end <= start) | (end > F.col("duration_s"))
    checks.append((~all_time & bad_time, _error("scope_out_of_range", "scope.time", time, "0<=start<end<=duration")))
    checks.append(
        (~all_band & ~_exactly(band, "low_hz", "high_hz", "shape"), _error("invalid_adjustment", "scope.frequency"))
    )
    number("$.scope.frequency.low_hz", "scope.frequency.low_hz", all_band)
    number("$.scope.frequency.high_hz", "scope.frequency.high_hz", all_band)
    checks.append(
        (
            ~all_band & ~F.coalesce(shape.isin("notch", "band"), F.lit(False)),
            _error("invalid_adjustment", "scope.frequency.shape"),
        )
    )
    bad_band = (low < 20.0) | (high <= low) | (high >= F.col("nyquist_hz"))
    checks.append(
        (~all_band & bad_band, _error("scope_out_of_range", "scope.frequency", band, "20<=low<high<nyquist"))
    )
    error = F.when(checks[0][0], checks[0][1])
    for bad, what in checks[1:]:
        error = error.when(bad, what)
    ok = F.col("error").isNull()
    return parsed.withColumn("error", error).select(
        "media_id",
        F.col("index"),
        F.when(ok, F.format_string("adjustment_%03d", F.col("index") + 1)).alias("adjustment_id"),
        F.when(ok, F.bround(gain, 6)).alias("gain_db"),
        F.when(ok, F.when(all_time, 0.0).otherwise(F.bround(start, 6))).alias("start"),
        F.when(ok & ~all_time, F.bround(end, 6)).alias("end"),
        F.when(ok & ~all_band, low).alias("low_hz"),
        F.when(ok & ~all_band, high).alias("high_hz"),
        F.when(ok & ~all_band, shape).alias("shape"),
        "error",
    )


def first_errors(parsed: DataFrame) -> DataFrame:
    """Index and code of the first bad item per document: where a fail-fast reader would stop."""
    return parsed.where("error IS NOT NULL").groupBy("media_id").agg(
        F.min(F.coalesce("index", F.lit(-1))).alias("first_error_index"),
        F.min_by("error.code", F.coalesce("index", F.lit(-1))).alias("code"),
    )
