"""op9 and op10: packed pieces, and documents read back from Arrow stream files."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm.arrow_store import read_store, write_store
from sonoframe.llm.common import query, shared_folder, table
from sonoframe.llm.packing import pack

WORDS_49K, WORDS_49K_SIZE = public_tokenizers.path("word_bpe_49k.json"), 49_408


@query("op9_harmonic_packing")
def harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), WORDS_49K)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op10_arrow_stream_files")
def arrow_stream_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-store")
    manifest = write_store(table(spark, sf_dir, "documents"), folder, WORDS_49K, WORDS_49K_SIZE)
    return read_store(spark, manifest, folder)
