"""What a reduction did, from its rows tile_id, mirror_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def leaders(result: DataFrame) -> DataFrame:
    return result.where("tile_id = mirror_id").select("tile_id")


def reduced(result: DataFrame) -> DataFrame:
    return result.where("tile_id <> mirror_id").select("tile_id", "mirror_id")


def group_sizes(result: DataFrame) -> DataFrame:
    """mirror_id, n, last_id: how many tiles a leader stands for, itself included, and the last of them."""
    return result.groupBy("mirror_id").agg(F.count("*").alias("n"), F.max("tile_id").alias("last_id"))


def summary(result: DataFrame, max_diff: int) -> DataFrame:
    """One row: total, kept, reduced, max_diff_pixels."""
    gone = F.count_if(F.col("tile_id") != F.col("mirror_id"))
    return result.agg(F.count("*").alias("total"), (F.count("*") - gone).alias("kept"), gone.alias("reduced"), F.lit(max_diff).cast("long").alias("max_diff_pixels"))


def counted(result: DataFrame) -> tuple[DataFrame, Observation]:
    """result, and an observation that holds `hits` (tiles that an earlier leader absorbed) and `misses` (those that became
    leaders) once an action has run over it: no pass of its own."""
    seen = Observation("reduction")
    hit = F.col("tile_id") != F.col("mirror_id")
    return result.observe(seen, F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses")), seen


def summary_line(row) -> str:
    return f"{row.total} tiles reduced to {row.kept} with max different pixels = {row.max_diff_pixels}"
