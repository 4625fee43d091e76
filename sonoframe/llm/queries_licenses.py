"""op8: license notices in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm.common import query, table
from sonoframe.llm.licenses import scan_licenses


@query("op8_license_scans")
def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda f: f["phrase"])
    places = F.flatten(F.transform(base, lambda f: f["places"]))
    labels = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda f: f["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        "score",
    )
