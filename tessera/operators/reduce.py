"""Ordered greedy reduction: every tile keeps itself or is absorbed by the first earlier kept tile near to it.

A tile is a leader if no earlier leader differs from it in max_diff pixels or fewer; any other tile's mirror is its first
such leader. Mirrors are leaders themselves: it's a star for each leader, not the closure of nearness. Equal tiles are one
before anything is compared: the first of them decides for all, as they're equally far from every tile.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.pixels import LONG, as_rows, counts, tile_diff
from tessera.operators.pairs import near_pairs
from tessera.plans.store import dropped, written

#: Bytes of tiles, and tiles, that the driver takes from the undecided at a time, and broadcasts at most.
BLOCK_BYTES, BLOCK_TILES = 32 << 20, 1 << 17
#: Bytes of tiles that meet a leader at once.
SLICE_BYTES = 4 << 20
#: Runs of pixels for each difference allowed and one more: tiles whose hashes differ in more runs than the threshold are far.
RUNS = 4
#: Runs are used if a key has HOT tiles at most and all keys PAIRS_A_TILE pairs for each tile and key; else blocks are.
HOT, PAIRS_A_TILE = 8192, 64


def first_of_equal(tiles: DataFrame, px_col: str = "px") -> DataFrame:
    """tile_id, mirror_id of exact duplicates: the least id of the same pixels. Sums before the shuffle, so a tile that most
    others equal costs a row a task."""
    firsts = tiles.groupBy(F.col(px_col).alias("__px")).agg(F.min("tile_id").alias("mirror_id"))
    return tiles.join(firsts, F.col(px_col).eqNullSafe(F.col("__px"))).select("tile_id", "mirror_id")


def _distinct(tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tile_id, rep of all tiles; and tile_id, px of the reps."""
    keyed = written(tiles.select("tile_id", F.sha2("px", 256).alias("key")))
    reps = keyed.groupBy("key").agg(F.min("tile_id").alias("rep"))
    same = written(keyed.join(reps, "key").select("tile_id", "rep"))
    return same, tiles.join(same.where("tile_id = rep").select("tile_id"), "tile_id", "left_semi")


class _Open:
    """Tiles that no leader has absorbed, in order. Absorbed ones go once they're an eighth of those kept."""

    def __init__(self, px: np.ndarray):
        self.px, self.at, self.free, self.left = px, np.arange(len(px)), np.ones(len(px), bool), len(px)

    def first(self) -> int:
        """The place of the first open tile."""
        return int(self.at[np.argmax(self.free)])

    def absorbed(self, one: np.ndarray, max_diff: int) -> np.ndarray:
        """The places of the open tiles near to one; they're open no more."""
        near = np.flatnonzero(self.free & (counts(one, self.px) <= max_diff))
        places = self.at[near]
        self.free[near] = False
        self.left -= len(near)
        if self.left * 8 <= len(self.free) * 7:
            self.px = self.px[self.free] if self.px.shape[1] >= LONG else self.px.T.compress(self.free, axis=1).T
            self.at, self.free = self.at[self.free], np.ones(self.left, bool)
        return places


def greedy(ids: np.ndarray, px: np.ndarray, max_diff: int) -> tuple[np.ndarray, np.ndarray]:
    """The mirrors of a block of tiles in order, none near an earlier leader, and the places of its own leaders. The first
    tile that no leader has absorbed is the next one, and meets all that are left at once. Leaders are kept by their places:
    a row of what is left would keep all of it."""
    open_, heads, mirrors = _Open(px), [], ids.copy()
    while open_.left:
        heads.append(open_.first())
        mirrors[open_.absorbed(px[heads[-1]], max_diff)] = ids[heads[-1]]
    return mirrors, np.array(heads, np.int64)


def absorbed(tiles: DataFrame, ids: np.ndarray, px: np.ndarray, max_diff: int) -> DataFrame:
    """tile_id, px and mirror_id: the first of the leaders (ids and px), a block that is broadcast, that a tile is near to, or
    null. Absorbed tiles have no px any more."""
    shared = tiles.sparkSession.sparkContext.broadcast((ids, px))

    def first_leaders(tiles: np.ndarray) -> pa.Array:
        mirrors, missing, open_ = np.zeros(len(tiles), np.int64), np.ones(len(tiles), bool), _Open(tiles)
        for number, one in zip(*shared.value, strict=True):
            if not open_.left:
                break
            near = open_.absorbed(one, max_diff)
            mirrors[near], missing[near] = number, False
        return pa.array(mirrors, mask=missing)

    def absorb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            step = max(1, SLICE_BYTES // max(1, len(batch.column(1)[0].as_buffer())))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                found = first_leaders(as_rows(part.column(1)))
                rest = pc.if_else(pc.is_null(found), part.column(1), pa.scalar(None, part.column(1).type))
                yield pa.RecordBatch.from_arrays([part.column(0), rest, found], ["tile_id", "px", "mirror_id"])

    out = written(tiles.select("tile_id", "px").mapInArrow(absorb, "tile_id long, px binary, mirror_id long"))
    shared.destroy()
    return out


def reduce_by_blocks(tiles: DataFrame, max_diff: int, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """tile_id, mirror_id of different tiles (tile_id, px). The first undecided tiles, block_bytes of them and BLOCK_TILES at
    most, are reduced among themselves; their leaders are broadcast, absorb later undecided tiles near them, and the rest goes
    into the next round.
    As leaders of earlier blocks come first, that's exact. Compares each tile with leaders alone."""
    spark = tiles.sparkSession
    rest = written(tiles.select("tile_id", "px"))
    size = rest.agg(F.max(F.length("px"))).first()[0]
    if size is None:
        return rest.select("tile_id", F.col("tile_id").alias("mirror_id"))
    n, done = max(1, min(BLOCK_TILES, block_bytes // max(1, size))), []
    # ids alone are sorted by the engine, so no task gets the first pixels of all others
    while (last := rest.select("tile_id").orderBy("tile_id").limit(n).agg(F.max("tile_id")).first()[0]) is not None:
        # columns, not rows or tiles: an object for each takes many times the bytes of a small tile
        block = rest.where(F.col("tile_id") <= last).toArrow().sort_by("tile_id")
        ids, px = block["tile_id"].to_numpy(), as_rows(block["px"])
        del block
        mirrors, heads = greedy(ids, px, max_diff)
        done.append(written(spark.createDataFrame(pa.table({"tile_id": ids, "mirror_id": mirrors}))))
        if len(ids) < n:
            break
        later = absorbed(rest.where(F.col("tile_id") > last), ids[heads], px[heads], max_diff)
        done.append(written(later.where("mirror_id is not null").select("tile_id", "mirror_id")))
        dropped(rest)  # pixels are kept once, not for each round
        rest = later.where("mirror_id is null").select("tile_id", "px")
    dropped(rest)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def hashed_runs(tiles: DataFrame, max_diff: int, pixels: int) -> DataFrame:
    """tile_id, runs: hashes of (max_diff + 1) * RUNS runs of a tile's pixels, as even as can be."""
    n = (max_diff + 1) * RUNS
    at = f"int(({{}}) * {pixels}L div {n}) * 4"
    low, high = at.format("k"), at.format("k + 1")
    return tiles.select("tile_id", F.expr(f"transform(sequence(0, {n - 1}), k -> xxhash64(substring(px, {low} + 1, {high} - {low})))").alias("runs"))


def reduce_by_runs(tiles: DataFrame, max_diff: int, pixels: int, *, hot: int = HOT, pairs_a_tile: int = PAIRS_A_TILE) -> DataFrame | None:
    """tile_id, mirror_id of different tiles (tile_id, px), or None where equal runs of pixels don't tell tiles apart: a key
    with over `hot` tiles, or over pairs_a_tile pairs for each tile and key.

    Tiles within the threshold agree in one of max_diff + 1 keys, each of RUNS runs, and differ in max_diff runs at most; pairs that
    don't are dropped by their hashes. Round by round the tiles without an undecided lower neighbour become leaders, and
    only pairs of a new leader and a tile that no lower leader has are compared by their pixels. Rounds are as many as the
    longest chain of undecided neighbours; nothing is broadcast or collected.
    """
    hashed = written(hashed_runs(tiles, max_diff, pixels))
    keyed = hashed.select("tile_id", F.explode(F.expr(f"transform(sequence(0, {max_diff}), p -> xxhash64(p, slice(runs, p * {RUNS} + 1, {RUNS})))")).alias("key"))
    n = F.col("n").cast("double")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum(n * (n - 1) / 2).alias("pairs"), F.sum(n).alias("keys")).first()
    if sizes.most is not None and (sizes.most > hot or sizes.pairs > pairs_a_tile * sizes.keys):
        return None

    def of(df: DataFrame, side: str, value: str) -> DataFrame:
        return df.select(F.col("tile_id").alias(f"{side}_id"), F.col(value).alias(f"{side}_{value}"))

    left, right = of(keyed, "left", "key"), of(keyed, "right", "key")
    met = left.join(right, (F.col("left_key") == F.col("right_key")) & (F.col("left_id") < F.col("right_id"))).select("left_id", "right_id").distinct()
    met = met.join(of(hashed, "left", "runs"), "left_id").join(of(hashed, "right", "runs"), "right_id")
    differ = F.size(F.filter(F.zip_with("left_runs", "right_runs", lambda a, b: a != b), lambda x: x))
    open_ = written(met.where(differ <= max_diff).select("left_id", "right_id"))
    found = []
    while not open_.isEmpty():
        # the lower tile of an open pair is undecided, so one that is in no pair as the higher one is a leader
        heads = written(open_.select("left_id").distinct().join(open_.select(F.col("right_id").alias("left_id")), "left_id", "left_anti"))
        asked = open_.join(heads, "left_id", "left_semi").join(of(tiles, "left", "px"), "left_id").join(of(tiles, "right", "px"), "right_id")
        near = written(asked.where(tile_diff("left_px", "right_px") <= max_diff).select("left_id", "right_id"))
        found.append(near)
        first = near.groupBy("right_id").agg(F.min("left_id").alias("first"))
        left_over = open_.join(heads, "left_id", "left_anti").join(first.select(F.col("right_id").alias("left_id")), "left_id", "left_anti")
        after = written(left_over.join(first, "right_id", "left").where("first is null or left_id < first").select("left_id", "right_id"))
        dropped(open_)
        dropped(heads)
        open_ = after
    if not found:
        return hashed.select("tile_id", F.col("tile_id").alias("mirror_id"))
    mirrors = functools.reduce(DataFrame.unionByName, found).groupBy("right_id").agg(F.min("left_id").alias("m"))
    return hashed.select("tile_id").join(mirrors, F.col("tile_id") == F.col("right_id"), "left").select("tile_id", F.coalesce("m", "tile_id").alias("mirror_id"))


def reduce_by_edges(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """tile_id, mirror_id from the near pairs left_id, right_id. Round by round an undecided tile is absorbed if a lower
    neighbour is a leader, and a leader if all of them are absorbed; then each takes its least leader."""
    edges = written(edges.select("left_id", "right_id"))
    state = written(ids.join(edges.select(F.col("right_id").alias("tile_id")).distinct(), "tile_id", "left_anti").select("tile_id", F.lit(1).alias("s")).unionByName(edges.select(F.col("right_id").alias("tile_id")).distinct().select("tile_id", F.lit(0).alias("s"))))
    while state.where("s = 0").limit(1).count():
        around = edges.join(state.withColumnRenamed("tile_id", "left_id"), "left_id").groupBy("right_id").agg(F.max(F.when(F.col("s") == 1, 1).otherwise(0)).alias("led"), F.min((F.col("s") == 2).cast("int")).alias("free"))
        nearer = state.join(around, F.col("tile_id") == F.col("right_id"), "left")
        after = F.when(F.col("s") != 0, F.col("s")).when(F.col("led") == 1, 2).when(F.col("free") == 1, 1).otherwise(0)
        before, state = state, written(nearer.select("tile_id", after.alias("s")))
        dropped(before)
    leaders = state.where("s = 1").select(F.col("tile_id").alias("left_id"))
    mirrors = edges.join(leaders, "left_id").groupBy("right_id").agg(F.min("left_id").alias("m"))
    # a leader has no leader below it, so it has no row among the mirrors
    return ids.join(mirrors, F.col("tile_id") == F.col("right_id"), "left").select("tile_id", F.coalesce("m", "tile_id").alias("mirror_id"))


def reduce_tiles(tiles: DataFrame, max_diff: int, *, id_col: str = "tile_id", px_col: str = "px", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """tile_id, mirror_id of tiles of equal size (RGBA bytes, four for each pixel), in the order of their ids.

    Ids are unique. An empty table gives no rows; null pixels are an error, as are negative thresholds. At a threshold of 0
    equal tiles meet in one shuffle; at all pixels or more everything mirrors the first tile; else different tiles are
    reduced by equal runs of pixels if they're more than a block, runs have 8 pixels or more and tell them apart, and block
    by block if not.
    """
    if max_diff < 0:
        raise ValueError("the threshold is negative")
    tiles = tiles.select(F.col(id_col).cast("long").alias("tile_id"), F.col(px_col).alias("px"))
    shape = tiles.agg(F.min(F.length("px")).alias("low"), F.max(F.length("px")).alias("high"), F.count_if(F.col("px").isNull()).alias("missing"), F.min("tile_id").alias("first")).first()
    if shape.missing or shape.low != shape.high:
        raise ValueError("tiles without pixels, or of different sizes")
    if shape.first is None:
        return tiles.select("tile_id", F.col("tile_id").alias("mirror_id"))
    if max_diff >= shape.high // 4:
        return tiles.select("tile_id", F.lit(shape.first).alias("mirror_id"))
    same, reps = _distinct(tiles)
    if max_diff == 0:
        return same.select("tile_id", F.col("rep").alias("mirror_id"))
    reduced = None
    if (max_diff + 1) * 8 <= shape.high // 4 and same.where("tile_id = rep").count() * shape.high > block_bytes:
        reduced = reduce_by_runs(reps, max_diff, shape.high // 4)
    if reduced is None:
        reduced = reduce_by_blocks(reps, max_diff, block_bytes=block_bytes)
    return same.join(reduced.withColumnRenamed("tile_id", "rep"), "rep").select("tile_id", "mirror_id")


def reduce_narrow(tiles: DataFrame, max_diff: int, pixels: int) -> DataFrame:
    """tile_id, mirror_id of tiles that carry lanes, through the table of near pairs."""
    return reduce_by_edges(tiles.select("tile_id"), near_pairs(tiles, max_diff, pixels))
