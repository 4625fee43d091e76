"""Corpus pipeline over `documents`: quality rules, near duplicates, secrets, packing.

Every stage takes the table that its predecessor wrote and returns its successor's; all but the last return the columns
of `documents`. Null, empty and repeated rows are treated as the operators in sonoframe.llm say.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonoframe.llm.common import Entry, settle, small
from sonoframe.llm.jaccard import jaccard_components
from sonoframe.llm.packing import pack
from sonoframe.llm.quality import judge, thresholds, with_features
from sonoframe.llm.secrets import find_secrets, redact

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the adaptive limits of their language and source."""
    features = settle(with_features(docs.select(COLUMNS)), "pipeline-quality")
    return judge(features, thresholds(features)).where("kept").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): that with the least doc_id, then the
    least digest of its text.

    Rows without doc_id stay. Different texts under one doc_id are documents of their own; of equal ones one stays.
    """
    docs = docs.select(COLUMNS)
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = settle(repeated, "pipeline-repeated")
    if not repeated.isEmpty():
        return _near_duplicates_by_text(docs, repeated)
    found = settle(jaccard_components(docs), "pipeline-components")
    copies = found.where("doc_id <> component_id").select(F.col("doc_id").alias("copy_id"))
    return docs.join(small(copies), docs["doc_id"] == F.col("copy_id"), "left_anti")


def _near_duplicates_by_text(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """The same where doc_ids repeat: each text of such an id gets a key of its own below all doc_ids."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")
    below = min(0, docs.agg(F.min("doc_id")).first()[0]) - 1
    texts = docs.join(small(repeated), "doc_id", "left_semi").select("doc_id", digest).distinct()
    own = settle(settle(texts, "pipeline-texts").withColumn("key", F.lit(below) - F.monotonically_increasing_id()), "pipeline-keys")
    keyed = settle(
        docs.withColumn("digest", digest)
        .join(small(own), ["doc_id", "digest"], "left")
        .withColumn("key", F.coalesce("key", "doc_id")),
        "pipeline-keyed",
    )
    found = settle(jaccard_components(keyed.select(F.col("key").alias("doc_id"), "text")), "pipeline-components")
    ids = keyed.where("key is not null").select("key", "doc_id", "digest").distinct()
    first = F.min(F.struct("doc_id", "digest", "key"))["key"].alias("key")
    groups = found.where("doc_id is not null").select(F.col("doc_id").alias("key"), "component_id").distinct()
    kept = settle(groups.join(ids, "key").groupBy("component_id").agg(first).select("key"), "pipeline-kept")
    once = Window.partitionBy("key").orderBy(*COLUMNS)
    stay = keyed.join(kept, "key", "left_semi").withColumn("r", F.row_number().over(once)).where("r = 1")
    return stay.select(COLUMNS).unionByName(keyed.where("key is null").select(COLUMNS))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    clean = redact(find_secrets(docs.select(COLUMNS)))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, laid out in sequences."""
    return pack(docs.select(COLUMNS), public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("packing", packing),
]
#: The sketches, the join and the tokenizer have no SQL form; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


ENTRIES = {"pipeline": Entry(run, ORACLE_SQL)}
