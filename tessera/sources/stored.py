"""Tiles known from earlier runs: their ids and paths in a Parquet folder that runs share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import assign_ids

#: What a stored set is beside the files at hand.
EXISTS, NONE, MISMATCH = "exists", "none", "count mismatch"
_SCHEMA = "tile_id long, file_path string"


def create(spark: SparkSession, path: str) -> None:
    """An empty set, unless there is one."""
    spark.createDataFrame([], _SCHEMA).write.mode("ignore").parquet(path)


def clear(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], _SCHEMA).write.mode("overwrite").parquet(path)


def check(files: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: files, stored (their numbers) and status: NONE if nothing is stored, EXISTS if as many as there are files,
    else MISMATCH."""
    counts = files.agg(F.count("*").alias("files")).crossJoin(stored.agg(F.count("*").alias("stored")))  # one row each
    status = F.when(F.col("stored") == 0, NONE).when(F.col("stored") == F.col("files"), EXISTS).otherwise(MISMATCH)
    return counts.select("files", "stored", status.alias("status"))


def known(files: DataFrame, path: str, path_col: str = "file_path") -> DataFrame:
    """tile_id, file_path of the stored set if it exists for these files; else they're stored anew, in the order of their
    paths."""
    spark = files.sparkSession
    create(spark, path)
    if check(files, spark.read.schema(_SCHEMA).parquet(path)).first().status != EXISTS:
        assign_ids(files.select(F.col(path_col).alias("file_path")), "file_path").select("tile_id", "file_path").write.mode("overwrite").parquet(path)
    return spark.read.schema(_SCHEMA).parquet(path)
