"""op13: pieces of all documents in as few sequences as best fit decreasing needs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm.best_fit import best_fit_pack
from sonoframe.llm.common import query, scratch, settle, table

WORDS_49K = public_tokenizers.path("word_bpe_49k.json")


@query("op13_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as keep:
        pieces = best_fit_pack(table(spark, sf_dir, "documents"), WORDS_49K)
        digest = F.crc32("ids").alias("ids_crc32")
        named = pieces.select("doc_id", "piece", "start", "length", digest, "sequence_id", "offset")
        return keep(settle(named, "best-fit"))
