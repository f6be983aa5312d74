"""Table functions for SQL: what a frame kernel finds, as rows of a lateral join.

    SELECT f.y, f.x, p.* FROM frames f, LATERAL find_vectors(f.frame, 64, 64, 3.0, 'nxcorr', 0.5) p

A frame comes as an array, rows first, with its height and width. A null frame
gives no row; a frame of another size is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import kernels


def _image(frame: list[float], height: int, width: int) -> np.ndarray:
    return np.array(frame, float).reshape(height, width)


@udtf(returnType="py int, px int, value double", useArrow=True)
class LocalMaxima:
    """local_maxima(frame, height, width, reach, threshold): pixels of at least the threshold that no pixel within reach exceeds."""

    def eval(self, frame: list[float], height: int, width: int, reach: int, threshold: float) -> Iterator[tuple]:
        if frame is not None:
            a = _image(frame, height, width)
            for y, x in kernels.local_maxima(a, int(reach), float(threshold)):
                yield int(y), int(x), float(a[y, x])


@udtf(returnType="rank int, py double, px double, intensity double, confidence double", useArrow=True)
class FindVectors:
    """find_vectors(frame, height, width, radius, method, threshold): sub-pixel peaks at least two radii apart, strongest first, rank from 1."""

    def eval(self, frame: list[float], height: int, width: int, radius: float, method: str, threshold: float) -> Iterator[tuple]:
        if frame is not None:
            found = kernels.find_peaks(_image(frame, height, width), method, float(radius), float(threshold), 2 * float(radius))
            for rank, p in enumerate(found, 1):
                yield rank, *map(float, p[:4])


@udtf(returnType="i int, value double", useArrow=True)
class LineProfile:
    """line_profile(frame, height, width, y0, x0, y1, x1, lanes): samples along a line, none if it is shorter than a pixel."""

    def eval(self, frame: list[float], height: int, width: int, y0: float, x0: float, y1: float, x1: float, lanes: int) -> Iterator[tuple]:
        samples = None if frame is None else kernels.line_profile(_image(frame, height, width), (float(y0), float(x0)), (float(y1), float(x1)), int(lanes))
        for i, v in enumerate(() if samples is None else samples):
            yield i, float(v)


FUNCTIONS = {"local_maxima": LocalMaxima, "find_vectors": FindVectors, "line_profile": LineProfile}


def register(spark: SparkSession) -> None:
    """Make the table functions callable from the session's SQL."""
    for name, f in FUNCTIONS.items():
        spark.udtf.register(name, f)
