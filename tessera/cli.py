"""python -m tessera.cli --path FOLDER: reduces the PNG tiles under a folder."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from tessera.operators.reduce import reduce_tiles
from tessera.operators.summary import reduced, summary, summary_line
from tessera.params import ReduceParams
from tessera.plans.store import written
from tessera.sources.files import empty_files, read_tiles

log = logging.getLogger("tessera")


def parse(args: list[str] | None = None) -> tuple[ReduceParams, str | None]:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    p.add_argument("--path", required=True)
    p.add_argument("--max-diff-pixels", type=int, default=ReduceParams.max_diff_pixels)
    p.add_argument("--max-cache-size-mb", type=int, default=ReduceParams.max_cache_mb)
    p.add_argument("--max-num-threads", type=int, default=ReduceParams.max_num_threads)
    p.add_argument("--out", help="folder for the mapping as Parquet")
    x = p.parse_args(args)
    return ReduceParams(path=x.path, max_diff_pixels=x.max_diff_pixels, max_cache_mb=x.max_cache_size_mb, max_num_threads=x.max_num_threads), x.out


def run(spark: SparkSession, params: ReduceParams, out: str | None = None) -> str:
    """Reduces the folder; returns, and logs, the summary. Files that are no tiles are logged, all of them, and with out also
    written to the folder of that name with -quarantine at its end; empty files have no id there."""
    tiles, broken = read_tiles(spark, params.path, width=params.tile_width, height=params.tile_height)
    empty = spark.createDataFrame([(None, p, 48, "the file is empty") for p in empty_files(spark, params.path)], broken.schema)
    quarantine = broken.unionByName(empty)
    for row in quarantine.toLocalIterator():
        log.error("%s: %s %s", row.file_path, row.error_code, row.error_text)
    result = written(reduce_tiles(tiles, params.max_diff_pixels, block_bytes=max(params.pixels * 4, min(params.max_cache_mb, 256) << 20)))
    if out:
        result.write.mode("overwrite").parquet(out)
        quarantine.write.mode("overwrite").parquet(f"{out.rstrip('/')}-quarantine")
    if log.isEnabledFor(logging.DEBUG):
        for row in reduced(result).toLocalIterator():
            log.debug("%d reduced by %d", row.tile_id, row.mirror_id)
    line = summary_line(summary(result, params.max_diff_pixels).first())
    log.info(line)
    return line


def main(args: list[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    params, out = parse(args)
    run(SparkSession.builder.appName("tessera").getOrCreate(), params, out)


if __name__ == "__main__":
    main()
