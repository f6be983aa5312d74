"""Frames with their neighbours on the scan: tiles that carry a halo of whole frames.

The scan is cut into tiles. A frame goes to its own tile and, as halo, to each
tile within the depth; so every tile has all it needs, and one shuffle hands
each frame to a tile and the few around it. A function then sees a block of
frames at once, and the halo is cut off its result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbourhood import gaussian_kernel


def tiled(frames: DataFrame, depth: int, tile: int) -> DataFrame:
    """frames with (ty, tx), a row for each tile that a frame lies in or no more than depth beside."""

    def span(axis: str):
        return F.explode(F.sequence(F.floor((F.col(axis) - depth) / tile).cast("int"), F.floor((F.col(axis) + depth) / tile).cast("int")))

    return frames.withColumn("ty", span("y")).withColumn("tx", span("x"))


def block_of(rows: pd.DataFrame, top: int, left: int, side: int, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(side, side, *shape) of frames by position, and which positions there are; missing frames hold zeros."""
    block, there = np.zeros((side, side, *shape)), np.zeros((side, side), bool)
    at = rows["y"].to_numpy() - top, rows["x"].to_numpy() - left
    block[at] = np.stack(rows["frame"].to_numpy()).astype(float).reshape(-1, *shape)
    there[at] = True
    return block, there


def map_blocks(frames: DataFrame, shape: tuple[int, int], function: Callable[[np.ndarray, np.ndarray], np.ndarray], depth: int, tile: int = 16) -> DataFrame:
    """frames (y, x, frame, ...) with function applied to blocks of them.

    function gets a block (rows, columns, *shape) and a map of the positions that
    have a frame, and gives a block of the same rows and columns; what it makes
    of a position may depend on frames up to depth beside it. The result doesn't
    depend on the tile's size. A position has one frame (of repeated ones any, and
    all their rows get its result); a null frame is a missing one, and gives no row. Other columns are kept. An
    empty table gives an empty result.
    """
    side = tile + 2 * depth

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        top, left = int(key[0]) * tile - depth, int(key[1]) * tile - depth
        own = rows[(rows["y"] // tile == key[0]) & (rows["x"] // tile == key[1])]
        if not len(own):
            return own.drop(columns=["ty", "tx"])
        out = function(*block_of(rows.drop_duplicates(["y", "x"]), top, left, side, shape))
        at = out[own["y"].to_numpy() - top, own["x"].to_numpy() - left].reshape(len(own), -1)
        return own.drop(columns=["ty", "tx"]).assign(frame=list(at))

    schema = ", ".join(f"`{n}` {'array<double>' if n == 'frame' else t}" for n, t in frames.dtypes)
    return tiled(frames.where("frame IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL"), depth, tile).groupBy("ty", "tx").applyInPandas(run, schema)


def nav_blur(frames: DataFrame, shape: tuple[int, int], sigma: float, tile: int = 16) -> DataFrame:
    """Each frame as the Gaussian-weighted mean of the frames around it on the scan (to ceil(3 sigma) positions on each axis); weights of positions without a frame, such as those beyond the edge, are shared by the others."""
    if sigma <= 0:
        return frames
    kernel = np.array(gaussian_kernel(sigma))
    depth = len(kernel) // 2

    def along(a: np.ndarray, axis: int) -> np.ndarray:
        a = np.moveaxis(a, axis, 0)
        out = np.zeros_like(a)
        for k, w in enumerate(kernel):
            d = k - depth
            out[max(0, -d) : len(a) - max(0, d)] += w * a[max(0, d) : len(a) - max(0, -d)]
        return np.moveaxis(out, 0, axis)

    def blurred(block: np.ndarray, there: np.ndarray) -> np.ndarray:
        weight = along(along(there.astype(float), 0), 1)
        return along(along(block, 0), 1) / np.maximum(weight, 1e-300)[:, :, None, None]

    return map_blocks(frames, shape, blurred, depth, tile)
