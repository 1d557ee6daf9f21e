"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, as in tests, one in the warehouse of a local master; on
    a cluster it's an error, since executors don't share the driver's folders."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tessera-shared"
    return f"{top.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def _until_exit(spark: SparkSession, folder: str) -> None:
    """The files of a folder go when the driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows of df, written once as Parquet and read again; cuts the lineage and survives lost executors. The files go
    when the driver ends."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    _until_exit(spark, folder)
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def bucketed(df: DataFrame, column: str, n: int) -> DataFrame:
    """As written(), dealt by a column into n buckets: joins on it move the other side alone."""
    spark, name = df.sparkSession, f"tessera_{uuid.uuid4().hex}"
    folder = shared_folder(spark)
    df.write.bucketBy(n, column).option("path", f"{folder}/{name}").option("compression", "zstd").saveAsTable(name)
    _until_exit(spark, folder)
    return spark.table(name)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name one that df has no column of: operators add working columns beside whatever the input has."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def carried(df: DataFrame, columns: list[str] | None, *made: str) -> list[str]:
    """The given columns, all of df's if none are given, but those that an operator makes, in whatever case they're written:
    Spark doesn't tell `SCORE` from `score`."""
    made_ = {m.lower() for m in made}
    return [c for c in (df.columns if columns is None else columns) if c.lower() not in made_]


def rows_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scanned_bytes(df: DataFrame) -> int:
    """About the bytes of the files behind df, as the optimizer sees them; 0 if it can't tell."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


__all__ = ["F", "bucketed", "carried", "fresh", "read_table", "rows_of", "scanned_bytes", "shared_folder", "shuffle_partitions", "written"]
