"""op6: byte-level ids of all documents, encoded and decoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sonoframe.llm.byte_bpe import digests
from sonoframe.llm.common import query, table


@query("op6_byte_level_bpe")
def byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
