"""op4: documents with surrogates in place of personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sonoframe.llm.common import query, table
from sonoframe.llm.pii import with_surrogates

#: In production the key comes from a secret store; equal keys give equal surrogates.
KEY = b"surrogate key of the registered query"


@query("op4_pii_surrogates")
def pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(table(spark, sf_dir, "documents"), KEY)
