"""Sinks: what they write, read back."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sonoframe.plans import signals as G
from sonoframe.plans import views as V
from sonoframe.plans.registry import query
from sonoframe.session import checkpoint_root
from sonoframe.sources import sinks


def new_folder(spark, name):
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "written_samples",
    "SNK-03",
    f"""WITH {G.SAMPLES} SELECT media_id, chunk_id, 64 AS samples, round(sum(l), 4) AS left_sum, round(sum(r), 4) AS right_sum
 FROM (SELECT *, i // 64 AS chunk_id FROM v_s) GROUP BY 1, 2""",
)
def written_samples(spark, sf):
    folder = new_folder(spark, "samples")
    sinks.write_samples(G.samples(spark, sf), folder)

    def total(channel):
        return F.round(F.aggregate(channel, F.lit(0.0), lambda a, x: a + x), 4)

    return spark.read.parquet(folder).select(
        "media_id", "chunk_id", F.size("ch0").alias("samples"), total("ch0").alias("left_sum"), total("ch1").alias("right_sum")
    )


@query(
    "written_segments",
    "SP-04 SNK-02",
    f"""WITH {V.SEGMENTS}, {V.VALID} SELECT media_id, seg_idx, "start", "end", speaker, true AS second_refused FROM v_val""",
)
def written_segments(spark, sf):
    """Segments as JSON lines, and whether a second write to the same place was refused."""
    segments, folder = V.valid_segments(spark, sf), new_folder(spark, "segments")
    sinks.write_jsonl(segments, folder)
    try:
        sinks.write_jsonl(segments, folder)
        refused = False
    except AnalysisException:
        refused = True
    return spark.read.schema(segments.schema).json(folder).withColumn("second_refused", F.lit(refused))
