"""Settings of a reduction."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ReduceParams:
    """max_diff_pixels decides the result; the others are hints for execution and never change it."""

    path: str = ""
    max_diff_pixels: int = 32
    max_cache_mb: int = 512  #: bytes of leaders that are broadcast at a time
    max_num_threads: int = 2  #: kept for callers; Spark's partitions decide
    min_tiles_for_kernel: int = 128  #: tiles from which pairs are compared by array kernels instead of SQL
    tile_width: int = 256
    tile_height: int = 256

    def __post_init__(self) -> None:
        if self.max_diff_pixels < 0:
            raise ValueError("max_diff_pixels is negative")
        if self.max_cache_mb <= 0 or self.tile_width <= 0 or self.tile_height <= 0:
            raise ValueError("sizes must be positive")

    @property
    def pixels(self) -> int:
        return self.tile_width * self.tile_height
