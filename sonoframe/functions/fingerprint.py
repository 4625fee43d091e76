"""Canonical JSON and digests of structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(value: Column, schema: T.DataType) -> Column:
    """The same value with struct fields in name order and non-finite numbers as null, at any depth."""
    if isinstance(schema, T.StructType):
        fields = sorted(schema.fields, key=lambda f: f.name)
        built = F.struct(*[canonical(value[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(value.isNotNull(), built)
    if isinstance(schema, T.ArrayType):
        return F.transform(value, lambda x: canonical(x, schema.elementType))
    if isinstance(schema, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)
    if isinstance(schema, T.MapType):
        raise TypeError("maps have no stable order; use a struct or an array of entries")
    return value


def digest(value: Column, schema: T.DataType) -> Column:
    """SHA-256 of the canonical JSON; stable within this library."""
    return F.sha2(F.to_json(canonical(value, schema), {"ignoreNullFields": "false"}), 256)


def operations_fingerprint(profile: Column, stages: Column, adjustments: Column, source_sha256: Column, types: dict) -> Column:
    """Digest of a resolved plan, leaving out the codec correction that only a render can know.

    ``types`` holds the data types of ``profile``, ``stages`` and ``adjustments``. Stage operations are
    structs; a ``codec_peak_correction_db`` field in them is dropped.
    """
    stage_type = types["stages"].elementType
    operations = stage_type["operations"].dataType.elementType
    kept = [f for f in operations.fields if f.name != "codec_peak_correction_db"]

    def stage(s: Column) -> Column:
        trimmed = F.transform(s["operations"], lambda o: F.struct(*[o[f.name].alias(f.name) for f in kept]))
        return F.struct(
            s["name"].alias("name"),
            s["status"].alias("status"),
            s["reason"].alias("reason"),
            trimmed.alias("operations"),
        )

    plan = F.struct(
        profile.alias("profile"),
        F.transform(stages, stage).alias("stages"),
        adjustments.alias("adjustments"),
        source_sha256.alias("source_sha256"),
    )
    trimmed_stage = T.StructType(
        [
            *[T.StructField(n, stage_type[n].dataType) for n in ("name", "status", "reason")],
            T.StructField("operations", T.ArrayType(T.StructType(kept))),
        ]
    )
    schema = T.StructType(
        [
            T.StructField("profile", types["profile"]),
            T.StructField("stages", T.ArrayType(trimmed_stage)),
            T.StructField("adjustments", types["adjustments"]),
            T.StructField("source_sha256", T.StringType()),
        ]
    )
    return digest(plan, schema)
