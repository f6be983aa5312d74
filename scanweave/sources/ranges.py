"""Stacks of frames in files, read by ranges of bytes through Spark's Python data source: a task reads its frames and no others."""

from __future__ import annotations

import io
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "path string, i long, height int, width int, frame array<double>"
#: Bytes that a task reads by default, and that it holds at a time.
TASK_BYTES, CHUNK_BYTES = 64 << 20, 4 << 20
#: Pixel types by the mode of an MRC header.
MRC_MODES = {0: "i1", 1: "i2", 2: "f4", 6: "u2"}


@dataclass
class Layout:
    """Where a file's frames begin, how many there are, and what they hold; columnwise files can't be cut by frames."""

    start: int
    frames: int
    height: int
    width: int
    dtype: str
    columnwise: bool = False

    @property
    def size(self) -> int:
        return self.height * self.width * np.dtype(self.dtype).itemsize


@dataclass
class FrameRange(InputPartition):
    path: str
    layout: Layout
    first: int
    last: int


def _npy_layout(f) -> Layout:
    head = io.BytesIO(f.read(min(f.size(), 1 << 16)))
    version = np.lib.format.read_magic(head)
    shape, columnwise, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if dtype.hasobject:
        raise ValueError("an array of objects isn't a stack of frames")
    h, w = shape[-2:] if len(shape) > 1 else (1, *shape) if shape else (1, 1)
    return Layout(head.tell(), int(np.prod(shape[:-2], dtype=np.int64)) if len(shape) > 1 else 1, h, w, dtype.str, columnwise and len(shape) > 1)


def _mrc_layout(f) -> Layout:
    """Sizes and mode in the first four words, the length of an extended header in word 24, pixels after both."""
    head = f.read(1024)
    nx, ny, nz, mode = (int(v) for v in np.frombuffer(head, "<i4", 4))
    if mode not in MRC_MODES:
        raise ValueError(f"can't read MRC mode {mode}")
    return Layout(1024 + int(np.frombuffer(head, "<i4", 1, 92)[0]), nz, ny, nx, "<" + MRC_MODES[mode])


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    # Hadoop writes local files with one slash
    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


class FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.kind = options["path"], options.get("kind", "raw")
        if self.kind not in ("raw", "npy", "mrc"):
            raise ValueError("kind is raw, npy or mrc")
        self.shape = int(options.get("height", 0)), int(options.get("width", 0))
        if self.kind == "raw" and min(self.shape) < 1:
            raise ValueError("raw files need height and width")
        self.dtype, self.header = options.get("dtype", "<u2"), int(options.get("header", 0))
        self.task_bytes = int(options.get("task_bytes", TASK_BYTES))
        self.least, self.most = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of i are kept here, so that ranges outside of them are never planned; Spark still applies what is yielded."""
        for f in filters:
            if getattr(f, "attribute", None) != ("i",):
                yield f
                continue
            match f:
                case EqualTo(value=v):
                    low, high = v, v
                case GreaterThan(value=v):
                    low, high = v + 1, None
                case GreaterThanOrEqual(value=v):
                    low, high = v, None
                case LessThan(value=v):
                    low, high = None, v - 1
                case LessThanOrEqual(value=v):
                    low, high = None, v
                case In(value=v) if len(v):
                    low, high = min(v), max(v)
                    yield f
                case _:
                    low = high = None
                    yield f
            self.least = self.least if low is None else max(self.least, low)
            self.most = self.most if high is None else high if self.most is None else min(self.most, high)

    def layout(self, path: str, size: int) -> Layout:
        if self.kind == "raw":
            one = self.shape[0] * self.shape[1] * np.dtype(self.dtype).itemsize
            return Layout(self.header, max(0, size - self.header) // one, *self.shape, self.dtype)
        with self.files.open_input_file(path) as f:
            return (_npy_layout if self.kind == "npy" else _mrc_layout)(f)

    def partitions(self) -> list[InputPartition]:
        """Ranges of about task_bytes; only sizes and headers are read here."""
        self.files, root = _filesystem(self.path)
        info = self.files.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else sorted((f for f in self.files.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        with ThreadPoolExecutor(32) as pool:
            layouts = list(pool.map(lambda f: self.layout(f.path, f.size), found))
        out: list[InputPartition] = []
        for f, at in zip(found, layouts, strict=True):
            step = max(1, at.frames if at.columnwise else self.task_bytes // max(1, at.size))
            low, high = self.least, at.frames if self.most is None else min(at.frames, self.most + 1)
            out += [FrameRange(f.path, at, a, min(high, a + step)) for a in range(low, high, step)]
        return out or [FrameRange("", Layout(0, 0, 0, 0, "u1"), 0, 0)]

    def read(self, part: FrameRange) -> Iterator[pa.RecordBatch]:
        if part.first >= part.last:
            return
        at, pixels = part.layout, part.layout.height * part.layout.width
        with _filesystem(self.path)[0].open_input_file(part.path) as f:
            if at.columnwise:
                whole = np.load(io.BytesIO(f.read()), allow_pickle=False).reshape(at.frames, pixels)
            step = max(1, CHUNK_BYTES // max(1, at.size))
            for a in range(part.first, part.last, step):
                n = min(part.last, a + step) - a
                if at.columnwise:
                    values = whole[a : a + n]
                else:
                    f.seek(at.start + a * at.size)
                    data = f.read(n * at.size)
                    if len(data) < n * at.size:
                        raise ValueError(f"{part.path} ends inside frame {a + len(data) // max(1, at.size)}")
                    values = np.frombuffer(data, at.dtype)
                flat = pa.array(np.ascontiguousarray(values, dtype=np.float64).ravel())
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * pixels, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.path] * n, pa.string()), pa.array(np.arange(a, a + n)), pa.array(np.full(n, at.height, np.int32)), pa.array(np.full(n, at.width, np.int32)), pa.ListArray.from_arrays(offsets, flat)],
                    names=["path", "i", "height", "width", "frame"],
                )


class FrameFiles(DataSource):
    """Options: path (a file, or a folder whose files are all read), kind (raw, npy or mrc), for raw ones height, width, dtype and header (bytes), task_bytes."""

    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(dict(self.options))


def frame_ranges(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, i, height, width, frame) of the stacks of a file or folder: see FrameFiles.

    A file of any length becomes as many tasks as it has ranges of task_bytes, and
    comparisons of i with numbers keep ranges from being read. Bytes after the
    last whole frame of a raw file are left; a file with a header that promises more frames than
    it holds is an error, as is a path that isn't there. Only columnwise (Fortran order) arrays are
    read by one task a file. An empty folder gives an empty table.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameFiles)
    return spark.read.format("frame_files").options(**{k: str(v) for k, v in options.items()}).load(path)
