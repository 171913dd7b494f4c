"""Writers and stored properties."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cloudframe.skew import lookup

C = F.col
ROWS_PER_BLOCK = 1_000_000


def write_pts(points: DataFrame, path: str, rows_per_block: int = ROWS_PER_BLOCK) -> None:
    """One folder per cloud with blocks of a count line and tab-separated lines (three decimals, whole numbers for the rest).

    A large cloud is written as several blocks by several tasks; the format allows any number of blocks.
    """
    extra = [c for c in ("intensity", "r", "g", "b") if c in points.columns]
    pattern = "\t".join(["%.3f"] * 3 + ["%d"] * len(extra))
    clouds = points.groupBy("cloud_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(rows_per_block))).alias("_parts"))
    rows = lookup(points, clouds, ["cloud_id"]).select("cloud_id", F.pmod(F.xxhash64("point_id"), C("_parts")).alias("block"), F.lit(1).alias("_o"),
        F.format_string(pattern, "x", "y", "z", *(C(c).cast("bigint") for c in extra)).alias("value"))
    counts = rows.groupBy("cloud_id", "block").agg(F.count(F.lit(1)).cast("string").alias("value")).select("cloud_id", "block", F.lit(0).alias("_o"), "value")
    out = counts.union(rows).repartition("cloud_id", "block").sortWithinPartitions("cloud_id", "block", "_o")
    out.select("cloud_id", "block", "value").write.partitionBy("cloud_id", "block").text(path)


def write_points_with_attributes(points: DataFrame, properties: list[DataFrame], path: str, form: str = "parquet") -> None:
    """Points joined with any number of properties (keyed by ``point_id``), as one wide table."""
    wide = points
    for values in properties:
        wide = wide.join(values, "point_id", "left")
    wide.write.format(form).option("header", True).save(path)


def save_property(values: DataFrame, path: str, name: str, dataset: DataFrame | None = None) -> None:
    """Store a property under its name, with its data set when given."""
    values.withColumn("_property", F.lit(name)).write.parquet(f"{path}/values")
    if dataset is not None:
        dataset.write.parquet(f"{path}/dataset")


def load_property(spark: SparkSession, path: str, with_dataset: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(values with their name in ``_property``, data set or None)."""
    return spark.read.parquet(f"{path}/values"), spark.read.parquet(f"{path}/dataset") if with_dataset else None


def cached_table(spark: SparkSession, folder: str, name: str, parameters: dict, build: Callable[[], DataFrame], overwrite: bool = False) -> DataFrame:
    """Read the stored result of ``name`` with these parameters, or build and store it first."""
    key = hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{folder}/{name}-{key}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    ready = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    if overwrite or not ready:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
