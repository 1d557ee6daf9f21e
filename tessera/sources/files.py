"""Folders of tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.pixels import decode_tiles
from tessera.plans.store import written


def assign_ids(df: DataFrame, order_col: str, id_col: str = "tile_id") -> DataFrame:
    """df with id_col, its rows' places from 0 by order_col. Rows are sorted by ranges; a count for each range, not a row,
    goes to the driver."""
    parts = written(df.repartitionByRange(F.col(order_col)).withColumn("__part", F.spark_partition_id()))
    n = {r["__part"]: r["count"] for r in parts.groupBy("__part").count().collect()}
    start, at = {}, 0
    for part in sorted(n):
        start[part] = at
        at += n[part]
    offset = F.element_at(F.create_map(*[x for k, v in start.items() for x in (F.lit(k), F.lit(v))]), F.col("__part")) if start else F.lit(0)
    place = F.row_number().over(Window.partitionBy("__part").orderBy(order_col)) - 1
    return parts.withColumn(id_col, (place + offset).cast("long")).drop("__part")


def scan_files(spark: SparkSession, path: str, *, pattern: str | None = None) -> DataFrame:
    """path, modificationTime, length and content of all files under a folder, its subfolders included. A missing folder
    is an error. Spark leaves out empty files; see empty_files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def empty_files(spark: SparkSession, path: str) -> list[str]:
    """The paths of files without bytes under a folder, listed by Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(top, True)
    out = []
    while files.hasNext():
        status = files.next()
        if not status.getLen():
            out.append(status.getPath().toString())
    return sorted(out)


def scan_tiles(spark: SparkSession, path: str, *, pattern: str | None = None) -> DataFrame:
    """tile_id, file_path and content of the files under a folder; ids follow the paths' order, which decides the result.
    Paths alone are sorted and numbered, without reading contents, and meet the contents of the same listing."""
    files = scan_files(spark, path, pattern=pattern).select(F.col("path").alias("file_path"), "content")
    numbered = assign_ids(files.select("file_path"), "file_path")
    return files.join(numbered, "file_path").select("tile_id", "file_path", "content")


def read_tiles(spark: SparkSession, path: str, *, width: int = 256, height: int = 256, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Tiles (tile_id, file_path, px) and what can't be one (tile_id, file_path, error_code, error_text)."""
    decoded = written(decode_tiles(scan_tiles(spark, path, pattern=pattern), width=width, height=height))
    return decoded.where("px is not null").select("tile_id", "file_path", "px"), decoded.where("px is null").select("tile_id", "file_path", "error_code", "error_text")
