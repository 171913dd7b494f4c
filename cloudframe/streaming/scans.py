"""A folder that keeps receiving ``name x y z`` files, as a stream of points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

C = F.col


def stream_xyz(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    rows = lines.select(F.split(F.trim("value"), r"\s+").alias("t")).where(F.size("t") > 1)
    return rows.select(C("t")[0].alias("point_id"), *(F.coalesce(F.get("t", F.lit(i)).cast("double"), F.lit(0.0)).alias(a)
                                                      for i, a in ((1, "x"), (2, "y"), (3, "z"))))
