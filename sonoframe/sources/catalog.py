"""Artifact catalogue: ingest, selection, readiness, sizes and consistency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRY = (
    "struct<environment:string,kind:string,roles:array<string>,stacks:array<string>,bytes:bigint,"
    "source:struct<type:string,filename:string,revision:string,sha256:string,repos:array<struct<bytes:bigint>>>>"
)


def parse_catalog(documents: DataFrame) -> DataFrame:
    """One row per artifact of ``(json)`` catalogues keyed by id; ``error`` stands for a catalogue that can't be read."""
    packages = F.col("_d.packages")
    parsed = documents.select(F.from_json("json", f"packages map<string,{ENTRY}>").alias("_d"))
    nothing = F.array(F.lit(None).cast(f"struct<key:string,value:{ENTRY}>"))
    rows = parsed.select(
        F.when(packages.isNull(), "unparseable_document").alias("error"),
        F.explode(F.when(packages.isNull(), nothing).otherwise(F.map_entries(packages))).alias("_e"),
    ).select("error", F.col("_e.key").alias("id"), F.col("_e.value").alias("_p"))
    return rows.select(
        "id",
        F.col("_p.environment").alias("grp"),
        "_p.kind",
        F.coalesce("_p.roles", F.array().cast("array<string>")).alias("roles"),
        F.coalesce("_p.stacks", F.array().cast("array<string>")).alias("consumers"),
        "_p.bytes",
        F.struct("_p.source.type", "_p.source.filename", "_p.source.sha256").alias("source"),
        F.aggregate(
            "_p.source.repos", F.lit(0).cast("bigint"), lambda a, r: a + F.coalesce(r["bytes"], F.lit(0))
        ).alias("parts_bytes"),
        "error",
    )


def select_artifacts(
    catalog: DataFrame, consumer: str | None = None, ids: Sequence[str] | None = None
) -> DataFrame:
    """Artifacts of a consumer, or the named ones; exactly one form may be used."""
    if (consumer is None) == (ids is None):
        raise ValueError("select by consumer or by ids, not both")
    if consumer is not None:
        return catalog.where(F.array_contains("consumers", consumer))
    return catalog.where(F.col("id").isin(list(ids)))


def unknown_ids(catalog: DataFrame, requested: DataFrame) -> DataFrame:
    return requested.join(catalog.select("id"), "id", "left_anti")


def size_rollup(selection: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Known bytes, and how many and which artifacts have no recorded size.

    Unknown is never zero; ``recorded_bytes`` overrides the catalogue. Ids are listed up to the caller's
    need through :func:`unsized_ids`, so no group is collected here.
    """
    size = F.coalesce("recorded_bytes", "bytes")
    return selection.groupBy(*keys).agg(
        F.coalesce(F.sum(size), F.lit(0)).alias("known_bytes"),
        F.count(F.when(size.isNull(), F.lit(1))).alias("unsized"),
        F.count("*").alias("artifacts"),
    )


def unsized_ids(selection: DataFrame, keys: Sequence[str]) -> DataFrame:
    return selection.where(F.coalesce("recorded_bytes", "bytes").isNull()).select(*keys, "id")


def not_ready(selection: DataFrame, registry: DataFrame) -> DataFrame:
    """Selected artifacts the registry does not hold as ready."""
    ready = registry.where("state = 'ready'").select("id")
    return selection.join(ready, "id", "left_anti")


def consistency_problems(catalog: DataFrame, groups: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Every problem at once: unknown group, role or kind, sizes that are not sums, empty groups.

    ``groups``: ``(grp, provisioned)``.
    """
    known = groups.select("grp").withColumn("_known", F.lit(True))
    joined = catalog.join(known, "grp", "left")
    unknown_roles = F.array_except("roles", F.array(*[F.lit(r) for r in roles]))
    problems = F.array_compact(
        F.concat(
            F.array(
                F.when(F.col("_known").isNull(), F.concat(F.lit("unknown_group:"), "grp")),
                F.when(~F.col("kind").isin("weights", "toolchain"), F.concat(F.lit("unexpected_kind:"), "kind")),
                F.when(
                    (F.col("source.type") == "url") & F.col("source.filename").isNull(), "url_without_filename"
                ),
                F.when(
                    F.col("parts_bytes").isNotNull() & ~F.col("bytes").eqNullSafe(F.col("parts_bytes")),
                    "size_is_not_sum_of_parts",
                ),
            ),
            F.transform(unknown_roles, lambda r: F.concat(F.lit("unknown_role:"), r)),
        )
    )
    by_artifact = joined.select("id", F.explode(problems).alias("problem"))
    empty = (
        groups.where("provisioned")
        .join(catalog.select("grp"), "grp", "left_anti")
        .select(F.col("grp").alias("id"), F.lit("group_without_member").alias("problem"))
    )
    return by_artifact.unionByName(empty)
