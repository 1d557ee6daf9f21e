"""Distances and reductions: full-size tiles, a literal loop on random ones, and the invariants of the result."""

import collections
import itertools
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.cli import parse, run
from tessera.functions import pixels, png
from tessera.operators import pairs, reduce, summary
from tessera.params import ReduceParams
from tessera.plans import catalog, store
from tessera.sources import files
from tessera.streaming.reduce_stream import StreamReducer

SIDE = 256


def solid(grey):
    return np.dstack([np.full((SIDE, SIDE, 3), grey, np.uint8), np.full((SIDE, SIDE, 1), 255, np.uint8)])


def crossing():
    c = ((np.arange(SIDE)[:, None] ^ np.arange(SIDE)) & 1).astype(np.uint8) * 255
    return np.dstack([c, c, c, np.full((SIDE, SIDE), 255, np.uint8)])


WHITE, BLACK, CROSS = solid(255), solid(0), crossing()


def loop(tiles, t):
    leaders, out = [], {}
    for number, px in tiles:
        mirror = next((i for i, x in leaders if (np.frombuffer(x, "u4") != np.frombuffer(px, "u4")).sum() <= t), None)
        if mirror is None:
            leaders.append((number, px))
        out[number] = number if mirror is None else mirror
    return out


def frame(spark, tiles):
    return spark.createDataFrame([(i, bytearray(px)) for i, px in tiles], "tile_id long, px binary")


def mapping(df):
    return {r.tile_id: r.mirror_id for r in df.collect()}


def test_distances(spark):
    images = [x.tobytes() for x in (WHITE, BLACK, CROSS)]
    df = frame(spark, enumerate(images))
    got = {(r.a, r.b): r.d for r in df.alias("x").join(df.alias("y")).select(F.col("x.tile_id").alias("a"), F.col("y.tile_id").alias("b"), pixels.tile_diff("x.px", "y.px").alias("d")).collect()}
    assert got[0, 1] == got[1, 0] == 65536 and got[0, 2] == got[2, 1] == 32768 and got[0, 0] == 0
    many = np.stack([np.frombuffer(images[k % 2], "u4") for k in range(64)])
    assert pixels.counts(np.frombuffer(images[0], "u4"), many).tolist() == [0, 65536] * 32


@pytest.mark.parametrize("t,expected", [(64, {0: 256, 256: 256, 512: 256}), (32767, {0: 256, 256: 256, 512: 256}), (32768, {0: 512, 256: 256}), (32769, {0: 512, 256: 256}), (65536, {0: 768})])
def test_full_size(spark, t, expected):
    kinds = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate((WHITE, BLACK, CROSS))], "k int, px binary")
    tiles = spark.range(768).select(F.col("id").alias("tile_id"), F.floor(F.col("id") / 256).cast("int").alias("k")).join(F.broadcast(kinds), "k").select("tile_id", "px")
    result = reduce.reduce_tiles(tiles, t)
    assert {r.mirror_id: r.n for r in summary.group_sizes(result).collect()} == expected
    row = summary.summary(result, t).first()
    assert summary.summary_line(row) == f"768 tiles reduced to {len(expected)} with max different pixels = {t}"


@pytest.mark.parametrize("seed", range(4))
def test_forms_against_loop(spark, seed):
    random = np.random.default_rng(seed)
    base = random.integers(0, 3, (5, 16))
    rows = []
    for i in random.permutation(60):
        x = base[random.integers(5)].copy()
        x[random.integers(0, 16, random.integers(0, 5))] = random.integers(0, 3)
        rows.append((int(i) * 3, x.astype("u4").tobytes()))
    rows.sort()
    df = frame(spark, rows)
    narrow = spark.createDataFrame([(i, np.frombuffer(x, "u4").tolist()) for i, x in rows], "tile_id long, lanes array<long>").cache()
    for t in (0, 1, 3, 16):
        expected = loop(rows, t)
        assert mapping(reduce.reduce_tiles(df, t, block_bytes=7 * 64)) == expected
        assert mapping(reduce.reduce_tiles(df, t)) == expected
        for i, m in expected.items():
            assert m <= i and expected[m] == m
    assert mapping(reduce.reduce_narrow(narrow, 1, 16)) == loop(rows, 1)
    assert mapping(reduce.reduce_narrow(narrow, 4, 16)) == loop(rows, 4)
    few = pairs.near_pairs(narrow, 1, 16).collect()
    assert {(r.left_id, r.right_id, r.diff) for r in few} == {(r.left_id, r.right_id, r.diff) for r in pairs.all_pairs(narrow, block_tiles=16).where("diff <= 1").collect()}


def test_kernels_agree(spark):
    random = np.random.default_rng(5)
    rows = [(int(i) * 7 - 90, random.integers(0, 2, 16 - i % 3).tolist()) for i in range(40)]
    rows += [(500, None), (501, None), (502, []), (503, [None, 1]), (504, [2**32 - 1] * 16)]
    tiles = spark.createDataFrame(rows, "tile_id long, lanes array<long>").cache()

    def found(**how):
        return sorted((r.left_id, r.right_id, -1 if r.diff is None else r.diff) for r in pairs.all_pairs(tiles, **how).collect())

    whole = found(kernel="sql")
    assert len(whole) == 45 * 44 // 2
    assert whole == found(kernel="arrow") == found(kernel="arrow", block_tiles=7) == found(kernel="sql", block_tiles=7) == found(min_tiles_for_kernel=45)
    near = [x for x in whole if 0 <= x[2] <= 5]
    assert near and near == found(kernel="arrow", at_most=5, block_tiles=7) == found(kernel="sql", at_most=5)
    assert pairs.all_pairs(tiles.limit(0), kernel="arrow").count() == 0 == pairs.all_pairs(tiles.limit(1), kernel="arrow").count()
    with pytest.raises(KeyError):
        pairs.all_pairs(tiles, kernel="none")


def colored_tiles(spark):
    """Tiles with common, rare and no colours, a null lane, one of several colours that only it has; and their counts."""
    random = np.random.default_rng(9)
    rows = [(int(i) * 3 - 50, [*random.integers(0, 3, 9).tolist(), *random.integers(10, 40, 5).tolist(), 2**32 - 1][: 15 - i % 2]) for i in range(70)]
    rows += [(900, []), (901, None), (902, [None, 1, 1]), (903, [77] * 400 + [78]), (904, [79])]
    counts = {i: collections.Counter(x for x in lanes or [] if x is not None) for i, lanes in rows}
    return spark.createDataFrame(rows, "tile_id long, lanes array<long>").repartition(3), counts


@pytest.mark.parametrize("block_tiles", [7, 2048])
def test_equal_counts_without_a_row_for_each_shared_color(spark, block_tiles):
    tiles, counts = colored_tiles(spark)
    expected = {(i, j): s for i, a in counts.items() for j, b in counts.items() if i < j and (s := sum(a[c] == b[c] for c in a))}
    found = pairs.count_equality(tiles, block_tiles=block_tiles)
    assert sorted((r.left_id, r.right_id, r.equal_colors) for r in found.collect()) == sorted((*k, s) for k, s in expected.items())
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block_tiles", [7, 2048])
def test_color_bound_without_a_row_for_each_shared_color(spark, block_tiles):
    tiles, counts = colored_tiles(spark)
    expected = {(i, j): 15 - s for i, a in counts.items() for j, b in counts.items() if i < j and (s := sum(min(a[c], b[c]) for c in a))}
    found = pairs.color_bound(tiles, 15, block_tiles=block_tiles)
    assert sorted((r.left_id, r.right_id, r.bound) for r in found.collect()) == sorted((*k, s) for k, s in expected.items())
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.schema.simpleString() == "struct<left_id:bigint,right_id:bigint,bound:bigint>"
    assert pairs.color_bound(tiles.limit(0), 15).count() == 0


def test_blocks_of_colors_are_stored_once(spark, tmp_path, monkeypatch):
    """Ten tiles a block, fifteen blocks: a row for each tile is written, and no row is dealt to every block."""
    monkeypatch.setattr(store, "shared_folder", lambda _: f"file://{tmp_path}/tiles-0")
    random = np.random.default_rng(4)
    rows = [(i, random.integers(0, 30, 4).tolist()) for i in range(150)]
    tiles = spark.createDataFrame(rows, "tile_id long, lanes array<long>").repartition(3)
    found = pairs.color_bound(tiles, 4, block_tiles=10)
    counts = [collections.Counter(lanes) for _, lanes in rows]
    expected = {(i, j): 4 - s for i, j in itertools.combinations(range(150), 2) if (s := (counts[i] & counts[j]).total())}
    assert sorted(map(tuple, found.collect())) == sorted((*k, s) for k, s in expected.items())
    stored = spark.read.parquet(f"file://{tmp_path}/tiles-0/table")
    assert stored.count() == 150 == stored.select("tile_id").distinct().count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("most_pairs,matches,frequent", [(33, 10, 1), (333, 100, 8), (1 << 18, 1 << 20, 10**9)])
@pytest.mark.parametrize("colors", [16, 500, 100_000])
def test_color_sums_of_common_and_rare_colors(most_pairs, matches, frequent, colors, monkeypatch):
    """Sums beyond a byte, too, whichever colours count as frequent and however few pairs are looked at at a time."""
    for name, value in (("PAIRS", most_pairs), ("MATCHES", matches), ("FREQUENT", frequent)):
        monkeypatch.setattr(pairs, name, value)
    random = np.random.default_rng(colors)
    for match in (np.minimum, np.equal):
        blocks = [[dict(zip(*(x.tolist() for x in np.unique(random.zipf(1.3, 400).clip(max=colors), return_counts=True)), strict=True)) for _ in range(n)] for n in (20, 23)]
        left, right = (pairs._Colors(np.arange(len(b)), *(pa.array([list(f(t)) for t in b], pa.list_(pa.int64())) for f in (dict.keys, dict.values))) for b in blocks)
        found = np.vstack([sums for _, sums in pairs.color_sums(left, right, match)])
        assert found.tolist() == [[sum(int(match(a[c], b[c])) for c in a.keys() & b.keys()) for b in blocks[1]] for a in blocks[0]]


@pytest.mark.parametrize("t", [1, 3, 6])
def test_runs_against_loop(spark, t):
    """By equal runs, with chains of near tiles, tiles that agree in most runs but not in pixels, and shuffled ids."""
    random = np.random.default_rng(t)
    base = random.integers(0, 2, (6, 61)).astype("u4")
    drift = base[0].copy()
    rows = []
    for i in random.permutation(90):
        x = base[random.integers(6)].copy() if i % 3 else drift.copy()
        drift[random.integers(61)] += 1
        x[random.integers(0, 61, random.integers(0, 2 * t))] = random.integers(2, 5)
        rows.append((int(i) * 5 - 100, x.tobytes()))
    rows = sorted({px: (i, px) for i, px in sorted(rows, reverse=True)}.values())
    df = frame(spark, rows).repartition(5)
    assert mapping(reduce.reduce_by_runs(df, t, 61)) == loop(rows, t)
    assert reduce.reduce_by_runs(df, t, 61, hot=1) is None and reduce.reduce_by_runs(df, t, 61, pairs_a_tile=0) is None
    assert mapping(reduce.reduce_tiles(df, t, block_bytes=500)) == loop(rows, t)


def test_leaders_dont_keep_what_they_met(spark):
    """2,000 tiles of 1 KB, half of them leaders that absorb one each: the driver holds a few times the block, not a copy of the
    rest for each leader (740 MB)."""
    rows = [(i, np.array([i // 2, i % 2, *[i // 2] * 254], "u4").tobytes()) for i in range(2000)]
    df = frame(spark, rows).repartition(4).cache()
    df.count()
    expected = {i: i // 2 * 2 for i, _ in rows}
    assert mapping(reduce.reduce_tiles(df, 1)) == expected
    tracemalloc.start()
    result = reduce.reduce_by_blocks(df, 1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20
    assert mapping(result) == expected


def test_driver_takes_a_bounded_block_of_small_tiles(spark):
    """200,000 tiles of 16 pixels: the driver holds a few times 8 MB, not an object for each of them."""
    ids = np.arange(200_000)
    lanes = np.repeat((ids % 50)[:, None] * 20, 16, axis=1).astype("u4")
    lanes[:, 0] += ids.astype("u4")
    px = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.arange(0, 64 * len(ids) + 1, 64, "i4")), pa.py_buffer(lanes)])
    df = spark.createDataFrame(pa.table({"tile_id": ids, "px": px})).repartition(4).cache()
    df.count()
    tracemalloc.start()
    result = reduce.reduce_by_blocks(df, 1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20
    assert result.where("mirror_id <> tile_id % 50").count() == 0 and result.count() == result.distinct().count() == 200_000


def test_blocks_of_few_tiles_against_loop(spark, monkeypatch):
    """BLOCK_TILES bounds a block whatever its bytes; only ids are sorted by the engine."""
    taken, greedy = [], reduce.greedy
    monkeypatch.setattr(reduce, "BLOCK_TILES", 7)
    monkeypatch.setattr(reduce, "greedy", lambda ids, px, t: taken.append(len(ids)) or greedy(ids, px, t))
    random = np.random.default_rng(8)
    rows = sorted((int(i) * 3 - 60, random.integers(0, 3, 6).astype("u4").tobytes()) for i in random.permutation(50))
    assert mapping(reduce.reduce_by_blocks(frame(spark, rows).repartition(5), 2)) == loop(rows, 2)
    assert len(taken) > 1 and max(taken) == 7


@pytest.fixture(scope="module")
def many_embeddings(tmp_path_factory):
    """A folder with embeddings of 160,000 tiles of 16 kinds in turn, far apart, each tile within three pixels of its kind."""
    n, random = 160_000, np.random.default_rng(6)
    px = np.repeat((np.arange(n) % 16)[:, None], 16, axis=1)
    for _ in range(3):
        px[np.arange(n), random.integers(0, 16, n)] = random.integers(0, 16, n)
    channels = (px[..., None] >> np.arange(4) & 1).astype("f4").reshape(n, 64)
    folder = tmp_path_factory.mktemp("embeddings")
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(channels.ravel(), 64).cast(pa.list_(pa.float32()))}), folder / "embeddings.parquet")
    return str(folder)


def of_bounded_memory(query, spark, folder):
    """A query's result; the driver holds a few times a block of 8 MB for it, no object for each tile and no copy for each leader."""
    tracemalloc.start()
    result = catalog.queries()[query](spark, folder)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20
    return result


def test_summary_of_many_tiles(spark, many_embeddings):
    found = of_bounded_memory("reduce_summary", spark, many_embeddings)
    assert list(map(tuple, found.collect())) == [(160_000, 16, 159_984, 6)]


def test_pairs_of_many_tiles(spark, many_embeddings):
    found = of_bounded_memory("reduced_pairs", spark, many_embeddings)
    assert found.count() == found.distinct().count() == 159_984 and found.where("tile_id < 16 or mirror_id <> tile_id % 16").count() == 0


def test_counters_of_many_tiles(spark, many_embeddings):
    found = of_bounded_memory("reduction_counters", spark, many_embeddings)
    assert list(map(tuple, found.collect())) == [(159_984, 16)]


def test_rows_of_columns():
    tiles = [np.arange(k, k + 3).astype("u4").tobytes() for k in range(5)]
    for kind in (pa.binary(), pa.large_binary()):
        assert pixels.as_rows(pa.array(tiles, kind).slice(1, 3)).tolist() == [[1, 2, 3], [2, 3, 4], [3, 4, 5]]
        assert pixels.as_rows(pa.chunked_array([tiles[:2], tiles[4:]], kind)).tolist() == [[0, 1, 2], [1, 2, 3], [4, 5, 6]]
        for bad in ([tiles[0], None], [None, tiles[0]], [tiles[0], tiles[1] + bytes(4)], [tiles[0] + bytes(4), tiles[1], bytes(8)]):
            with pytest.raises(ValueError):
                pixels.as_rows(pa.array(bad, kind))


def test_tables_of_rounds_are_dropped(spark, tmp_path, monkeypatch):
    numbers = itertools.count()
    monkeypatch.setattr(store, "shared_folder", lambda _: f"file://{tmp_path}/tiles-{next(numbers)}")
    rows = [(i, np.array([i, i // 2, 5, 5], "u4").tobytes()) for i in range(40)]
    assert mapping(reduce.reduce_by_blocks(frame(spark, rows), 1, block_bytes=64)) == loop(rows, 1)
    left = [spark.read.parquet(f"file://{t}/table").columns for t in tmp_path.glob("tiles-*")]
    assert left and all(columns == ["tile_id", "mirror_id"] for columns in left)
    with pytest.raises(ValueError):
        store.dropped(spark.read.parquet("/root/testdata/sf0.001/region.parquet"))


def test_runs_of_no_or_one_tile(spark):
    assert reduce.reduce_by_runs(frame(spark, []), 1, 16).count() == 0
    assert mapping(reduce.reduce_by_runs(frame(spark, [(3, bytes(64))]), 1, 16)) == {3: 3}


def test_chain_and_alpha(spark):
    a, b, c = (np.array(x, "u4").tobytes() for x in ([0, 0, 0], [1, 0, 0], [1, 1, 0]))
    assert mapping(reduce.reduce_tiles(frame(spark, [(0, a), (1, b), (2, c)]), 1)) == {0: 0, 1: 0, 2: 2}
    assert mapping(reduce.reduce_tiles(frame(spark, [(0, b), (1, a), (2, c)]), 1)) == {0: 0, 1: 0, 2: 0}
    clear = [bytes([0, 0, 0, 0]), bytes([9, 0, 0, 0]), bytes([0, 0, 0, 255])]
    assert mapping(reduce.reduce_tiles(frame(spark, list(enumerate(clear))), 0)) == {0: 0, 1: 1, 2: 2}


def test_edges_of_input(spark):
    assert reduce.reduce_tiles(frame(spark, []), 3).count() == 0
    assert mapping(reduce.reduce_tiles(frame(spark, [(7, bytes(4))]), 0)) == {7: 7}
    with pytest.raises(ValueError):
        reduce.reduce_tiles(frame(spark, [(7, bytes(4))]), -1)
    with pytest.raises(ValueError):
        reduce.reduce_tiles(frame(spark, [(7, bytes(4)), (8, bytes(8))]), 1)
    with pytest.raises(ValueError):
        ReduceParams(max_diff_pixels=-1)


def test_folder_and_cli(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for name, image in {"a.png": WHITE, "b.png": BLACK, "sub/c.png": WHITE, "sub/d.png": WHITE[:128, :128]}.items():
        (tmp_path / "in" / name).write_bytes(png.encode(image))
    (tmp_path / "in/e.png").write_bytes(b"no image at all, but long enough to have a header")
    (tmp_path / "in/f.png").write_bytes(b"")
    params, out = parse(["--path", str(tmp_path / "in"), "--max-diff-pixels", "8", "--out", str(tmp_path / "out")])
    assert run(spark, params, out) == "3 tiles reduced to 2 with max different pixels = 8"
    kept_back = {r.file_path.rsplit("/", 1)[1]: (r.tile_id, r.error_code) for r in spark.read.parquet(f"{out}-quarantine").collect()}
    assert kept_back == {"d.png": (4, -1), "e.png": (2, 28), "f.png": (None, 48)}
    tiles, broken = files.read_tiles(spark, str(tmp_path / "in"))
    assert [r.file_path.rsplit("/", 1)[1] for r in tiles.orderBy("tile_id").collect()] == ["a.png", "b.png", "c.png"]
    assert {r.error_code for r in broken.collect()} == {-1, 28}
    assert [x.rsplit("/", 1)[1] for x in files.empty_files(spark, str(tmp_path / "in"))] == ["f.png"]
    pixels.register(spark)
    assert spark.sql("SELECT decode_png(X'00').error_code").first()[0] == 27


def test_stream(spark, tmp_path):
    rows = [(i, np.array([i % 3, i % 2, 5, 5], "u4").tobytes()) for i in range(12)]
    reducer = StreamReducer(str(tmp_path / "state"), 1)
    for number in range(3):
        reducer.batch(frame(spark, rows[number * 4 : number * 4 + 4]), number)
        if number == 1:
            reducer.batch(frame(spark, rows[4:8]), 1)
    assert mapping(spark.read.parquet(str(tmp_path / "state/mirrors/*"))) == loop(rows, 1)
    for k in range(2):
        frame(spark, rows[k * 6 : k * 6 + 6]).write.mode("append").parquet(str(tmp_path / "source"))
    stream = spark.readStream.schema("tile_id long, px binary").parquet(str(tmp_path / "source"))
    StreamReducer(str(tmp_path / "own"), 0).start(stream, str(tmp_path / "mark")).awaitTermination()
    assert mapping(spark.read.parquet(str(tmp_path / "own/mirrors/*"))) == loop(rows, 0)


def test_stream_order_of_arrival(spark, tmp_path):
    """Earlier leaders decide, even over tiles of lower ids and over equal ones, however many blocks leaders take."""
    rng = np.random.default_rng(3)
    ids = rng.permutation(40).tolist()
    rows = [(i, rng.integers(0, 2, 6, dtype="u4").tobytes()) for i in ids]
    batches = [sorted(rows[k : k + 10]) for k in range(0, 40, 10)]
    for name, size in (("some", 120), ("all", 1 << 20)):
        reducer = StreamReducer(str(tmp_path / name), 2, block_bytes=size)
        for number, part in enumerate(batches):
            reducer.batch(frame(spark, part), number)
        reducer.batch(frame(spark, []), 4)
        assert mapping(spark.read.parquet(str(tmp_path / name / "mirrors/*"))) == loop([x for part in batches for x in part], 2)
