"""Every query of the tile engine, with SQL that an independent engine runs on the same tables.

The tables hold no images, so tiles are made of `embeddings`: a channel is 255 where a value exceeds 0.15, else 0, and four
channels are a pixel; 16 pixels make a tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import png
from tessera.functions.pixels import decode_tiles, lanes, tile_diff
from tessera.operators import pairs, reduce, summary
from tessera.plans.store import written
from tessera.sources import stored
from tessera.sources.files import assign_ids

PIXELS = 16


def _channels() -> F.Column:
    return F.transform("embedding", lambda x: F.when(x.cast("double") > 0.15, 255).otherwise(0).cast("bigint"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile_id, lanes."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("tile_id"), lanes(_channels()).alias("lanes"))


def raw_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile_id, px."""
    hexes = F.transform("embedding", lambda x: F.when(x.cast("double") > 0.15, "FF").otherwise("00"))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("tile_id"), F.unhex(F.array_join(hexes, "")).alias("px"))


def tile_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = raw_tiles(spark, sf_dir).select(F.concat(F.lit("tile/"), F.col("tile_id").cast("string"), F.lit(".png")).alias("file_path"), F.length("px").cast("long").alias("length"))
    return assign_ids(files, "file_path").select("tile_id", "file_path", "length")


def tile_pixels_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles(spark, sf_dir).select("tile_id", F.posexplode("lanes").alias("pos", "color")).select("tile_id", F.col("pos").cast("long"), "color")


def pixel_inequality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tile against the tile with the next id, pixel by pixel."""
    px = tile_pixels_exploded(spark, sf_dir)
    after = px.select((F.col("tile_id") - 1).alias("tile_id"), "pos", F.col("color").alias("other"))
    return px.join(after, ["tile_id", "pos"]).where(~F.col("color").eqNullSafe(F.col("other"))).groupBy("tile_id").agg(F.count("*").alias("diff"))


def pair_diff_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.all_pairs(tiles(spark, sf_dir))


def one_vs_many_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.one_with_many(tiles(spark, sf_dir), 0)


def pair_diff_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.near_pairs(tiles(spark, sf_dir), 4, PIXELS)


def pair_diff_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_diff_all(spark, sf_dir).groupBy("diff").agg(F.count("*").alias("n"))


def pair_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair's key is its ordered ids; pairs of neighbours, given in either order."""
    t = tiles(spark, sf_dir).select("tile_id")
    given = t.select("tile_id", (F.col("tile_id") + 1).alias("other")).unionByName(t.select((F.col("tile_id") + 1).alias("tile_id"), F.col("tile_id").alias("other")))
    return given.groupBy(F.least("tile_id", "other").alias("low"), F.greatest("tile_id", "other").alias("high")).agg(F.count("*").alias("n"))


def reduce_t0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.reduce_tiles(raw_tiles(spark, sf_dir), 0)


def reduce_mid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.reduce_tiles(raw_tiles(spark, sf_dir), 6)


def reduce_mid_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As reduce_mid, in blocks of 50 tiles."""
    return reduce.reduce_tiles(raw_tiles(spark, sf_dir), 6, block_bytes=50 * 4 * PIXELS)


def reduce_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles differing in one pixel at most, by equal runs of pixels."""
    return reduce.reduce_tiles(raw_tiles(spark, sf_dir), 1, block_bytes=1)


def reduce_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.reduce_tiles(raw_tiles(spark, sf_dir), 8)


def reduce_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the table of near pairs, round by round."""
    return reduce.reduce_narrow(written(tiles(spark, sf_dir)), 4, PIXELS)


def reduce_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.reduce_tiles(raw_tiles(spark, sf_dir), PIXELS)


def leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.leaders(reduce_mid(spark, sf_dir))


def reduced_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.reduced(reduce_mid(spark, sf_dir))


def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.group_sizes(reduce_high(spark, sf_dir))


def reduce_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.summary(reduce_mid(spark, sf_dir), 6)


def exact_dup_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal contents to the first of them, over the texts of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("tile_id"), F.sha2("text", 256).alias("px"))
    return reduce.first_of_equal(docs)


def color_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.color_index(tiles(spark, sf_dir))


def color_overlap_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.color_bound(tiles(spark, sf_dir), PIXELS)


def count_equality_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.count_equality(tiles(spark, sf_dir))


def pigeonhole_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.candidates(tiles(spark, sf_dir), 3, PIXELS)


def channel_abs_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of absolute channel differences of each tile and the next."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("tile_id"), _channels().alias("ch"))
    after = e.select((F.col("tile_id") - 1).alias("tile_id"), F.col("ch").alias("other"))
    total = F.aggregate(F.zip_with("ch", "other", lambda x, y: F.abs(x - y)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return e.join(after, "tile_id").select("tile_id", total.alias("abs_diff"))


def row_column_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differing pixels of each tile and the next by column of a 4 x 4 tile: partial sums of the distance."""
    px = tile_pixels_exploded(spark, sf_dir)
    after = px.select((F.col("tile_id") - 1).alias("tile_id"), "pos", F.col("color").alias("other"))
    return px.join(after, ["tile_id", "pos"]).groupBy("tile_id", (F.col("pos") % 4).alias("x")).agg(F.sum((F.col("color") != F.col("other")).cast("long")).alias("diff"))


def pivot_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pivot_candidates(written(tiles(spark, sf_dir)), 0, 1)


def png_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles as PNG files of 4 x 4 pixels, decoded again: bytes that differ, and errors."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [png.encode(np.frombuffer(x.as_buffer(), np.uint8).reshape(4, 4, 4)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(files, pa.binary())], ["tile_id", "raw", "content"])

    files = raw_tiles(spark, sf_dir).mapInArrow(encode, "tile_id long, raw binary, content binary")
    found = decode_tiles(files, width=4, height=4)
    return found.select("tile_id", (F.col("px") == F.col("raw")).alias("same"), F.coalesce(F.col("error_code"), F.lit(0)).cast("long").alias("error_code"))


def row_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differing pixels of each tile and the next by row of a 4 x 4 tile."""
    px = tile_pixels_exploded(spark, sf_dir)
    after = px.select((F.col("tile_id") - 1).alias("tile_id"), "pos", F.col("color").alias("other"))
    return px.join(after, ["tile_id", "pos"]).groupBy("tile_id", F.floor(F.col("pos") / 4).alias("y")).agg(F.sum((F.col("color") != F.col("other")).cast("long")).alias("diff"))


def reduction_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and misses of a reduction, observed while it's written."""
    result, seen = summary.counted(reduce_mid(spark, sf_dir))
    written(result)
    return spark.createDataFrame([(seen.get["hits"], seen.get["misses"])], "hits long, misses long")


def stored_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files at hand beside no stored set, the same one and one that lacks a file."""
    files = tile_scan(spark, sf_dir).select("tile_id", "file_path")
    sets = (("empty", files.limit(0)), ("same", files), ("other", files.where("tile_id > 0")))
    found = [stored.check(files, s).select(F.lit(name).alias("case_name"), "files", "stored", "status") for name, s in sets]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _full_tiles(spark: SparkSession, n: int, each: int) -> DataFrame:
    """tile_id, px of 256 x 256 tiles: white, then black, then crossing ones, `each` of a kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x = np.mgrid[:256, :256]
        bright = [np.full((256, 256), 255), np.zeros((256, 256)), 255 * ((y ^ x) & 1)]
        kinds = [np.dstack([b, b, b, np.full((256, 256), 255)]).astype(np.uint8).tobytes() for b in bright]
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                ids = batch.column(0).slice(at, 32)
                yield pa.RecordBatch.from_arrays([ids, pa.array([kinds[i // each % 3] for i in ids.to_pylist()], pa.binary())], ["tile_id", "px"])

    return spark.range(n).select(F.col("id").alias("tile_id")).mapInArrow(run, "tile_id long, px binary")


def reduce_full_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """256 white and 256 black full tiles, threshold 64."""
    return reduce.reduce_tiles(_full_tiles(spark, 512, 256), 64)


def reduce_full_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.reduce_tiles(_full_tiles(spark, 512, 256), 65536)


def reduce_full_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a, and 256 crossing tiles, which differ from both in 32,768 pixels, a pixel over the threshold."""
    return reduce.reduce_tiles(_full_tiles(spark, 768, 256), 32767)


def reduce_full_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.reduce_tiles(_full_tiles(spark, 768, 256), 32769)


def one_vs_many_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first full tile against 1,024, kinds taking turns, by the Arrow kernel."""
    many = _full_tiles(spark, 1024, 1)
    one = many.where("tile_id = 0").select(F.col("px").alias("one"))
    return many.join(F.broadcast(one)).select("tile_id", tile_diff("one", "px").cast("long").alias("diff"))


#: Colour type, depth, filter and interlacing of the files of png_decode_matrix.
_MATRIX = [("grey1", 0, 1, 0, 0), ("grey2", 0, 2, 1, 1), ("grey4", 0, 4, 2, 0), ("grey8key", 0, 8, 3, 1), ("grey16", 0, 16, 4, 0), ("greya8", 4, 8, 4, 1), ("greya16", 4, 16, 3, 0), ("palette1", 3, 1, 0, 1), ("palette4", 3, 4, 4, 0), ("rgb8", 2, 8, 4, 1), ("rgb16key", 2, 16, 1, 0), ("rgba8", 6, 8, 3, 1), ("rgba16", 6, 16, 4, 0)]


def png_decode_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles as files of every colour type, many depths, all filters and interlacing, decoded: sums of each channel, pixels
    weighed by their place. Grey and indices follow the red channel; palette index 0 is (10, 20, 30) with alpha 7, index 1
    (200, 100, 50); keys make bright pixels transparent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for number, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rgba = np.frombuffer(raw, np.uint8).reshape(4, 4, 4).astype(np.uint16)
                for name, colour, depth, kind, interlaced in _MATRIX:
                    most, chunks = (1 << depth) - 1, []
                    samples = {0: rgba[..., :1], 2: rgba[..., :3], 3: rgba[..., :1], 4: rgba[..., ::3], 6: rgba}[colour] // 255 * (1 if colour == 3 else most)
                    if colour == 3:
                        chunks = [(b"PLTE", bytes([10, 20, 30, 200, 100, 50])), (b"tRNS", bytes([7]))]
                    elif name.endswith("key"):
                        chunks = [(b"tRNS", most.to_bytes(2) * (3 if colour == 2 else 1))]
                    rows.append((number, name, png.encode_as(samples, colour, depth, kind=kind, interlaced=bool(interlaced), chunks=tuple(chunks))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.binary()))], ["tile_id", "variant", "content"])

    files = raw_tiles(spark, sf_dir).mapInArrow(run, "tile_id long, variant string, content binary")
    found = decode_tiles(files, width=4, height=4)
    part = lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(0).cast("bigint"), lambda total, p: total + (p + 1) * F.conv(F.hex(F.col("px").substr(p * 4 + k + 1, F.lit(1))), 16, 10).cast("bigint"))
    return found.select("tile_id", "variant", *(part(k).alias(c) for k, c in enumerate("rgba")))


_TILES = """
ch AS MATERIALIZED (SELECT vec_id::BIGINT AS tile_id, list_transform(embedding, lambda x: CASE WHEN x::DOUBLE > 0.15 THEN 255 ELSE 0 END::BIGINT) AS ch FROM embeddings),
tiles AS MATERIALIZED (SELECT tile_id, list_transform(range(16), lambda p: ((ch[p * 4 + 1] * 256 + ch[p * 4 + 2]) * 256 + ch[p * 4 + 3]) * 256 + ch[p * 4 + 4]) AS lanes FROM ch)"""
_PX = ", px AS MATERIALIZED (SELECT tile_id, unnest(range(16))::BIGINT AS pos, unnest(lanes)::BIGINT AS color FROM tiles)"
_DIFFS = ", diffs AS MATERIALIZED (SELECT a.tile_id AS left_id, b.tile_id AS right_id, len(list_filter(range(1, 17), lambda i: a.lanes[i] <> b.lanes[i]))::BIGINT AS diff FROM tiles a JOIN tiles b ON a.tile_id < b.tile_id)"


_MATRIX_SQL = f"""WITH {_TILES},
c AS MATERIALIZED (SELECT tile_id, pos + 1 AS place, ch[pos * 4 + 1] AS r, ch[pos * 4 + 2] AS g, ch[pos * 4 + 3] AS b, ch[pos * 4 + 4] AS a FROM ch, range(16) AS t(pos)),
v AS (
  SELECT tile_id, place, unnest(['grey1', 'grey2', 'grey4', 'grey16']) AS variant, r AS r, r AS g, r AS b, 255 AS a FROM c
  UNION ALL SELECT tile_id, place, 'grey8key', r, r, r, CASE WHEN r = 255 THEN 0 ELSE 255 END FROM c
  UNION ALL SELECT tile_id, place, unnest(['greya8', 'greya16']), r, r, r, a FROM c
  UNION ALL SELECT tile_id, place, unnest(['palette1', 'palette4']), CASE WHEN r = 255 THEN 200 ELSE 10 END, CASE WHEN r = 255 THEN 100 ELSE 20 END, CASE WHEN r = 255 THEN 50 ELSE 30 END, CASE WHEN r = 255 THEN 255 ELSE 7 END FROM c
  UNION ALL SELECT tile_id, place, 'rgb8', r, g, b, 255 FROM c
  UNION ALL SELECT tile_id, place, 'rgb16key', r, g, b, CASE WHEN r = 255 AND g = 255 AND b = 255 THEN 0 ELSE 255 END FROM c
  UNION ALL SELECT tile_id, place, unnest(['rgba8', 'rgba16']), r, g, b, a FROM c)
SELECT tile_id, variant, sum(r * place)::BIGINT AS r, sum(g * place)::BIGINT AS g, sum(b * place)::BIGINT AS b, sum(a * place)::BIGINT AS a FROM v GROUP BY 1, 2"""


def _mapping(t: int) -> str:
    """The greedy loop: tile by tile, carrying the leaders so far."""
    return f"""WITH RECURSIVE {_TILES}{_DIFFS},
near AS MATERIALIZED (SELECT right_id AS tile_id, list(left_id ORDER BY left_id) AS lower FROM diffs WHERE diff <= {t} GROUP BY right_id),
placed AS MATERIALIZED (SELECT t.tile_id, row_number() OVER (ORDER BY t.tile_id) AS pos, coalesce(n.lower, []) AS lower FROM tiles t LEFT JOIN near n USING (tile_id)),
walk AS (
  SELECT 0::BIGINT AS pos, NULL::BIGINT AS tile_id, NULL::BIGINT AS mirror_id, []::BIGINT[] AS led
  UNION ALL
  SELECT p.pos, p.tile_id, coalesce(list_min(list_intersect(p.lower, w.led)), p.tile_id),
         CASE WHEN len(list_intersect(p.lower, w.led)) = 0 THEN list_append(w.led, p.tile_id) ELSE w.led END
  FROM walk w JOIN placed p ON p.pos = w.pos + 1),
mapping AS (SELECT tile_id, mirror_id FROM walk WHERE pos > 0)
"""


def oracle_sql() -> dict[str, str]:
    with_tiles, with_px, with_diffs = f"WITH {_TILES}", f"WITH {_TILES}{_PX}", f"WITH {_TILES}{_DIFFS}"
    index = ", idx AS (SELECT tile_id, color, count(*) AS n FROM px GROUP BY ALL)"
    runs = ", runs AS (SELECT tile_id, unnest([0, 1, 2, 3]) AS part, unnest([lanes[1:4], lanes[5:8], lanes[9:12], lanes[13:16]]) AS run FROM tiles)"
    return {
        "tile_scan": "SELECT (row_number() OVER (ORDER BY file_path) - 1)::BIGINT AS tile_id, file_path, 64::BIGINT AS length FROM (SELECT 'tile/' || vec_id || '.png' AS file_path FROM embeddings)",
        "tile_pixels_exploded": f"{with_px} SELECT * FROM px",
        "pixel_inequality": f"{with_px} SELECT a.tile_id, count(*) AS diff FROM px a JOIN px b ON b.tile_id = a.tile_id + 1 AND a.pos = b.pos WHERE a.color <> b.color GROUP BY 1",
        "pair_diff_all": f"{with_diffs} SELECT * FROM diffs",
        "one_vs_many_diff": f"{with_diffs} SELECT right_id AS tile_id, diff FROM diffs WHERE left_id = 0",
        "pair_diff_threshold": f"{with_diffs} SELECT * FROM diffs WHERE diff <= 4",
        "pair_diff_histogram": f"{with_diffs} SELECT diff, count(*) AS n FROM diffs GROUP BY 1",
        "pair_key": f"{with_tiles} SELECT tile_id AS low, tile_id + 1 AS high, 2::BIGINT AS n FROM tiles",
        "reduce_t0": f"{with_tiles} SELECT tile_id, min(tile_id) OVER (PARTITION BY lanes) AS mirror_id FROM tiles",
        "reduce_mid": f"{_mapping(6)} SELECT * FROM mapping",
        "reduce_mid_blocks": f"{_mapping(6)} SELECT * FROM mapping",
        "reduce_runs": f"{_mapping(1)} SELECT * FROM mapping",
        "reduce_high": f"{_mapping(8)} SELECT * FROM mapping",
        "reduce_edges": f"{_mapping(4)} SELECT * FROM mapping",
        "reduce_all": f"{with_tiles} SELECT tile_id, min(tile_id) OVER () AS mirror_id FROM tiles",
        "leaders": f"{_mapping(6)} SELECT tile_id FROM mapping WHERE tile_id = mirror_id",
        "reduced_pairs": f"{_mapping(6)} SELECT * FROM mapping WHERE tile_id <> mirror_id",
        "group_sizes": f"{_mapping(8)} SELECT mirror_id, count(*) AS n, max(tile_id) AS last_id FROM mapping GROUP BY 1",
        "reduce_summary": f"{_mapping(6)} SELECT count(*) AS total, count(*) FILTER (tile_id = mirror_id) AS kept, count(*) FILTER (tile_id <> mirror_id) AS reduced, 6::BIGINT AS max_diff_pixels FROM mapping",
        "exact_dup_docs": "SELECT doc_id AS tile_id, min(doc_id) OVER (PARTITION BY text) AS mirror_id FROM documents",
        "color_index": f"{with_px} SELECT tile_id, color, count(*) AS n FROM px GROUP BY ALL",
        "color_overlap_bound": f"{with_px}{index} SELECT a.tile_id AS left_id, b.tile_id AS right_id, (16 - sum(least(a.n, b.n)))::BIGINT AS bound FROM idx a JOIN idx b ON a.color = b.color AND a.tile_id < b.tile_id GROUP BY 1, 2",
        "count_equality_pairs": f"{with_px}{index} SELECT a.tile_id AS left_id, b.tile_id AS right_id, count(*) AS equal_colors FROM idx a JOIN idx b ON a.color = b.color AND a.n = b.n AND a.tile_id < b.tile_id GROUP BY 1, 2",
        "pigeonhole_candidates": f"{with_tiles}{runs} SELECT DISTINCT a.tile_id AS left_id, b.tile_id AS right_id FROM runs a JOIN runs b ON a.part = b.part AND a.run = b.run AND a.tile_id < b.tile_id",
        "channel_abs_diff": f"{with_tiles} SELECT a.tile_id, list_sum(list_transform(range(1, 65), lambda i: abs(a.ch[i] - b.ch[i])))::BIGINT AS abs_diff FROM ch a JOIN ch b ON b.tile_id = a.tile_id + 1",
        "row_column_sums": f"{with_px} SELECT a.tile_id, a.pos % 4 AS x, sum((a.color <> b.color)::INT)::BIGINT AS diff FROM px a JOIN px b ON b.tile_id = a.tile_id + 1 AND a.pos = b.pos GROUP BY 1, 2",
        "pivot_prune": f"{with_diffs}, p AS (SELECT right_id AS tile_id, diff FROM diffs WHERE left_id = 0) SELECT a.tile_id AS left_id, b.tile_id AS right_id FROM p a JOIN p b ON a.tile_id < b.tile_id AND abs(a.diff - b.diff) <= 1",
        "row_sums": f"{with_px} SELECT a.tile_id, a.pos // 4 AS y, sum((a.color <> b.color)::INT)::BIGINT AS diff FROM px a JOIN px b ON b.tile_id = a.tile_id + 1 AND a.pos = b.pos GROUP BY 1, 2",
        "reduction_counters": f"{_mapping(6)} SELECT count(*) FILTER (tile_id <> mirror_id) AS hits, count(*) FILTER (tile_id = mirror_id) AS misses FROM mapping",
        "stored_check": "SELECT case_name, n AS files, s AS stored, status FROM (SELECT count(*)::BIGINT AS n FROM embeddings), LATERAL (VALUES ('empty', 0::BIGINT, 'none'), ('same', n, 'exists'), ('other', n - 1, 'count mismatch')) AS v(case_name, s, status)",
        "reduce_full_a": "SELECT range AS tile_id, CASE WHEN range < 256 THEN 0 ELSE 256 END::BIGINT AS mirror_id FROM range(512)",
        "reduce_full_b": "SELECT range AS tile_id, 0::BIGINT AS mirror_id FROM range(512)",
        "reduce_full_c": "SELECT range AS tile_id, (range // 256 * 256)::BIGINT AS mirror_id FROM range(768)",
        "reduce_full_d": "SELECT range AS tile_id, CASE WHEN range < 256 OR range >= 512 THEN 0 ELSE 256 END::BIGINT AS mirror_id FROM range(768)",
        "one_vs_many_full": "SELECT range AS tile_id, CASE range % 3 WHEN 0 THEN 0 WHEN 1 THEN 65536 ELSE 32768 END::BIGINT AS diff FROM range(1024)",
        "png_decode_matrix": _MATRIX_SQL,
        "png_round_trip": "SELECT vec_id::BIGINT AS tile_id, true AS same, 0::BIGINT AS error_code FROM embeddings",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = oracle_sql()
    return {name: globals()[name] for name in names}
