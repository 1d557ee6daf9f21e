"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, as in tests, one in the warehouse of a local master; on
    a cluster it's an error, since executors don't share the driver's folders."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tessera-shared"
    return f"{top.rstrip('/')}/tiles-{uuid.uuid4().hex}"


def _files(spark: SparkSession, folder: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet and read again: cuts the lineage of loops and survives lost executors. The files go when the
    driver ends, or with dropped()."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    df.write.parquet(f"{folder}/table")
    files, path = _files(spark, folder)
    files.deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(f"{folder}/table")


def parted(df: DataFrame, column: str) -> Callable[[int], pa.Table]:
    """df, written as Parquet, a folder for each value of an integer column; and what reads the rows of one value, in tasks
    too. The files go when the driver ends."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    df.repartition(column).write.partitionBy(column).parquet(f"{folder}/table")
    files, path = _files(spark, folder)
    files.deleteOnExit(path)
    top = re.sub("^file:/+", "file:///", path.makeQualified(files.getUri(), files.getWorkingDirectory()).toString())

    def read(value: int) -> pa.Table:
        files, at = pafs.FileSystem.from_uri(f"{top}/table")
        found = files.get_file_info(pafs.FileSelector(f"{at}/{column}={value}", allow_not_found=True))
        parts = [pq.ParquetFile(files.open_input_file(x.path)).read() for x in found if x.base_name.startswith("part-")]
        return pa.concat_tables(parts) if parts else pa.table({})

    return read


def dropped(df: DataFrame) -> None:
    """Deletes the written() table that df reads; nothing may read it any more."""
    folders = {f.rsplit("/", 2)[0] for f in df.inputFiles()}
    for folder in folders:
        if not folder.rsplit("/", 1)[1].startswith("tiles-"):
            raise ValueError(f"not a written table: {folder}")
        files, path = _files(df.sparkSession, folder)
        files.delete(path, True)
