"""Frame grids: a Python table function for SQL, and the built-in form for bulk use."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


class FrameGrid:
    def eval(self, duration: float, frame: float):
        for index in range(math.ceil(duration / frame)):
            yield index, min(duration, (index + 0.5) * frame)


def register_frame_grid(spark: SparkSession, name: str = "frame_grid") -> None:
    """Make ``SELECT * FROM frame_grid(duration, frame)`` available, also through LATERAL."""
    spark.udtf.register(name, udtf(FrameGrid, returnType="frame_idx bigint, centre double"))


def frame_grid(spark: SparkSession, durations: DataFrame, frame: float) -> DataFrame:
    register_frame_grid(spark)
    return spark.sql(
        "SELECT media_id, frame_idx, centre FROM {durations}, LATERAL frame_grid(duration, :frame)",
        args={"frame": float(frame)},
        durations=durations,
    )


def grid_frames(durations: DataFrame, frame: float) -> DataFrame:
    """Same rows from built-in expressions."""
    count = F.ceil(F.col("duration") / F.lit(frame)).cast("bigint")
    gridded = durations.where(F.col("duration") > 0).withColumn(
        "frame_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1))
    )
    return gridded.withColumn(
        "centre", F.least(F.col("duration"), (F.col("frame_idx") + 0.5) * F.lit(frame))
    )
