"""Reduction of tiles as they arrive: arrival order is the order that decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.reduce import BLOCK_BYTES, _distinct, absorbed, reduce_by_blocks


class StreamReducer:
    """Holds the leaders so far as a table under `folder`, a partition for each batch, and the mirrors beside it."""

    def __init__(self, folder: str, max_diff: int, *, block_bytes: int = BLOCK_BYTES) -> None:
        self.folder, self.max_diff, self.block_bytes = folder.rstrip("/"), max_diff, block_bytes

    def _leaders(self, spark: SparkSession, number: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and pixels of the leaders of the batches before this one, in order of arrival, block_bytes of pixels at a time."""
        if not number:
            return
        top, ids, px, held = f"{self.folder}/leaders", [], [], 0
        known = spark.read.option("basePath", top).schema("tile_id long, px binary, batch int").parquet(*[f"{top}/batch={k}" for k in range(number)])
        for row in known.orderBy("batch", "tile_id").toLocalIterator():
            ids.append(row.tile_id)
            px.append(np.frombuffer(bytes(row.px), np.uint32))
            held += len(row.px)
            if held >= self.block_bytes:
                yield np.array(ids), np.stack(px)
                ids, px, held = [], [], 0
        if ids:
            yield np.array(ids), np.stack(px)

    def batch(self, tiles: DataFrame, number: int) -> None:
        """Reduces a batch (tile_id, px). Leaders of earlier batches come first, in order, whatever their ids; they meet the
        batch's different tiles, not each other. Within a batch ids decide. A batch that runs again overwrites itself."""
        fresh = tiles.select(F.col("tile_id").cast("long").alias("tile_id"), "px")
        same, rest = _distinct(fresh)
        done = []
        for ids, px in self._leaders(tiles.sparkSession, number):
            later = absorbed(rest, ids, px, self.max_diff)
            done.append(later.where("mirror_id is not null").select("tile_id", "mirror_id"))
            rest = later.where("mirror_id is null").select("tile_id", "px")
        reduced = reduce_by_blocks(rest, self.max_diff, block_bytes=self.block_bytes)
        for part in done:
            reduced = reduced.unionByName(part)
        result = same.join(reduced.withColumnRenamed("tile_id", "rep"), "rep").select("tile_id", "mirror_id")
        result.write.mode("overwrite").parquet(f"{self.folder}/mirrors/{number}")
        kept = tiles.sparkSession.read.parquet(f"{self.folder}/mirrors/{number}").where("tile_id = mirror_id").select("tile_id")
        fresh.join(kept, "tile_id", "left_semi").write.mode("overwrite").parquet(f"{self.folder}/leaders/batch={number}")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
