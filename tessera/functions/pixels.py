"""Pixel expressions. Narrow tiles carry lanes: an array of one int per pixel; full tiles carry px: RGBA bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import png


def lanes(channels: Column) -> Column:
    """An array of channel values, four for each pixel, as one int per pixel."""

    def of(known: Column) -> Column:
        n = (F.size(known) / 4).cast("int")
        at = lambda p, k: F.element_at(known, p * 4 + k)
        whole = F.transform(F.sequence(F.lit(0), n - 1), lambda p: ((at(p, 1) * 256 + at(p, 2)) * 256 + at(p, 3)) * 256 + at(p, 4))
        return F.when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))

    # a variable of one value, else channels are computed again for each pixel's four
    return F.element_at(F.transform(F.array(channels), of), 1)


def diff(left: Column, right: Column) -> Column:
    """In how many pixels two arrays of lanes differ; null differs from any value but null."""
    return F.size(F.filter(F.zip_with(left, right, lambda x, y: ~x.eqNullSafe(y)), lambda d: d))


#: Lanes from which rows are counted one by one.
LONG = 1024


def counts(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """In how many pixels (lanes) each row of many differs from one. Long rows are counted one by one, short ones at once:
    fastest where many has them by columns."""
    if many.shape[1] >= LONG:
        return np.array([np.count_nonzero(row != one) for row in many], np.int64)
    return np.add.reduce(many != one, axis=1, dtype=np.uint16)


def as_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Tiles of one size as rows of lanes, short ones by columns; no tile becomes an object of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = int(bounds[1] - bounds[0])
    if column.null_count or (np.diff(bounds) != size).any():
        raise ValueError("tiles without pixels, or of different sizes")
    rows = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]].view(np.uint32).reshape(len(column), size // 4)
    return rows if rows.shape[1] >= LONG else np.asfortranarray(rows)


@F.arrow_udf(T.IntegerType())
def tile_diff(left: pa.Array, right: pa.Array) -> pa.Array:
    """The differing pixels of two RGBA byte strings; null if either is null or their sizes differ."""
    out = []
    for x, y in zip(left, right, strict=True):
        same = x.is_valid and y.is_valid and len(x.as_buffer()) == len(y.as_buffer())
        out.append(int(np.count_nonzero(np.frombuffer(x.as_buffer(), np.uint32) != np.frombuffer(y.as_buffer(), np.uint32))) if same else None)
    return pa.array(out, pa.int32())


@F.arrow_udf(T.StructType().add("px", T.BinaryType()).add("width", T.IntegerType()).add("height", T.IntegerType()).add("error_code", T.IntegerType()).add("error_text", T.StringType()))
def decode_png(content: pa.Array) -> pa.Array:
    """RGBA bytes and size of a PNG file, or the number and text of what's wrong with it; null reads as an empty file."""
    out = []
    for x in content:
        try:
            image = png.decode(x.as_py() or b"")
            out.append({"px": image.tobytes(), "width": image.shape[1], "height": image.shape[0], "error_code": None, "error_text": None})
        except png.PngError as e:
            out.append({"px": None, "width": None, "height": None, "error_code": e.code, "error_text": str(e)})
    return pa.array(out, pa.struct([("px", pa.binary()), ("width", pa.int32()), ("height", pa.int32()), ("error_code", pa.int32()), ("error_text", pa.string())]))


def register(spark: SparkSession) -> None:
    """tile_diff and decode_png for SQL."""
    spark.udf.register("tile_diff", tile_diff)
    spark.udf.register("decode_png", decode_png)


def decode_tiles(files: DataFrame, *, width: int = 256, height: int = 256, content_col: str = "content") -> DataFrame:
    """The files with px, error_code and error_text: files that don't decode, or to another size (-1), have no px."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                px, code, text = [], [], []
                for x in part.column(part.schema.get_field_index(content_col)):
                    try:
                        image = png.decode(x.as_py() or b"")
                        if image.shape[:2] != (height, width):
                            raise png.PngError(-1)
                        px.append(image.tobytes())
                        code.append(None)
                        text.append(None)
                    except png.PngError as e:
                        px.append(None)
                        code.append(e.code)
                        text.append(str(e))
                kept = [(n, c) for n, c in zip(part.schema.names, part.columns, strict=True) if n != content_col]
                yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(px, pa.binary()), pa.array(code, pa.int32()), pa.array(text, pa.string())], [*(n for n, _ in kept), "px", "error_code", "error_text"])

    rest = files.drop("px", "error_code", "error_text")
    schema = rest.drop(content_col).schema.add("px", "binary").add("error_code", "integer").add("error_text", "string")
    return rest.mapInArrow(run, schema)
