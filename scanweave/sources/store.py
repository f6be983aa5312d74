"""Reading and writing: tables with axes and provenance, raw binary frames, summaries, exports."""

from __future__ import annotations

import io
import json
import tempfile
from dataclasses import asdict
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..axes import Axis
from ..operators.ragged import FORMAT_VERSION, upgraded
from .ranges import MRC_MODES, frame_ranges

#: Readable and writable kinds by ending; the rest of the formats of the field need libraries that aren't here.
READERS = {".parquet": "parquet", ".orc": "orc", ".csv": "csv", ".json": "json", ".raw": "raw", ".rpl": "raw", ".npy": "npy", ".mrc": "mrc"}
WRITERS = (".parquet", ".csv", ".json")


def working_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder where it is unset and Spark runs in one process (as in tests)."""
    to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not to:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        to = "file://" + tempfile.mkdtemp(prefix="scanweave-")
        spark.sparkContext.setCheckpointDir(to)
    return to


def save(df: DataFrame, path: str, axes: dict[str, Axis] | None = None, provenance: dict | None = None, partition: tuple[str, ...] = ()) -> None:
    """The table and, beside it, a one-row table of its axes, provenance and format version."""
    spark = df.sparkSession
    (df.write.partitionBy(*partition) if partition else df.write).parquet(f"{path}/data")
    about = {"version": FORMAT_VERSION, "axes": {n: asdict(a) for n, a in (axes or {}).items()}, "provenance": provenance or {}}
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.parquet(f"{path}/about")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, Axis], dict]:
    """The table, its axes and its provenance; vectors of an older format get their late columns as null, a newer format is an error."""
    about = json.loads(spark.read.parquet(f"{path}/about").first()[0])
    df = spark.read.parquet(f"{path}/data")
    if about["version"] > FORMAT_VERSION:
        raise ValueError(f"format {about['version']} is newer than {FORMAT_VERSION}")
    if about["version"] < FORMAT_VERSION:
        df = upgraded(df, about["version"])
    return df, {n: Axis(**a) for n, a in about["axes"].items()}, about["provenance"]


def open_file(spark: SparkSession, path: str, **options) -> DataFrame:
    """A file or folder by its ending; an unknown ending is an error that lists the known ones."""
    ending = PurePosixPath(path.rstrip("/")).suffix.lower()
    if ending not in READERS:
        raise ValueError(f"can't read {ending or 'a path without ending'}; known: {', '.join(READERS)}")
    if READERS[ending] == "raw":
        return frame_ranges(spark, path, **options).select("path", "i", "frame")
    if READERS[ending] in STACKS:
        return frame_ranges(spark, path, kind=READERS[ending])
    return spark.read.options(**({"header": "true", "inferSchema": "true"} if ending == ".csv" else {}) | options).format(READERS[ending]).load(path)


def raw_frames(spark: SparkSession, path: str, height: int, width: int, dtype: str = "<u2", header: int = 0) -> DataFrame:
    """(path, i, frame) of headerless binary stacks: each file is decoded by the task that reads it, a frame a row; for globs and short files, others are read by `ranges.frame_ranges`."""
    size = height * width * np.dtype(dtype).itemsize

    def decode(batches):
        for rows in batches:
            for name, data in rows[["path", "content"]].itertuples(index=False):
                n = (len(data) - header) // size
                for first in range(0, n, 256):
                    last = min(n, first + 256)
                    a = np.frombuffer(data, dtype, (last - first) * height * width, header + first * size).reshape(last - first, -1)
                    yield pd.DataFrame({"path": name, "i": np.arange(first, last), "frame": list(a.astype(float))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, i long, frame array<double>")


def _npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def _mrc(data: bytes) -> np.ndarray:
    """A stack of an MRC file: sizes and mode in the first four words, the length of an extended header in word 24, pixels after both."""
    nx, ny, nz, mode = np.frombuffer(data, "<i4", 4)
    if int(mode) not in MRC_MODES:
        raise ValueError(f"can't read MRC mode {mode}")
    extended = int(np.frombuffer(data, "<i4", 1, 92)[0])
    return np.frombuffer(data, "<" + MRC_MODES[int(mode)], int(nx) * int(ny) * int(nz), 1024 + extended).reshape(nz, ny, nx)


STACKS = {"npy": _npy, "mrc": _mrc}


def stack_frames(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, i, height, width, frame) of files that say their own shape: the last two axes are a frame, the others are numbered in C order. Each file is decoded by the task that reads it."""
    read = STACKS[kind]

    def decode(batches):
        for rows in batches:
            for name, data in rows[["path", "content"]].itertuples(index=False):
                a = read(data)
                a = a.reshape(-1, *a.shape[-2:]) if a.ndim > 1 else a.reshape(1, 1, -1)
                for first in range(0, len(a), 256):
                    part = a[first : first + 256]
                    yield pd.DataFrame({"path": name, "i": np.arange(first, first + len(part)), "height": a.shape[1], "width": a.shape[2], "frame": list(part.reshape(len(part), -1).astype(float))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, i long, height int, width int, frame array<double>")


def save_orientations(matches: DataFrame, path: str, phases: list[dict], provenance: dict | None = None) -> None:
    """An orientation map (y, x, …, phase) with the phases that its numbers stand for."""
    save(matches, path, None, {"kind": "orientations", "phases": phases} | (provenance or {}))


def load_orientations(spark: SparkSession, path: str) -> tuple[DataFrame, list[dict]]:
    df, _, about = load(spark, path)
    if about.get("kind") != "orientations":
        raise ValueError("this isn't an orientation map")
    return df, about["phases"]


def save_drift(shifts: DataFrame, path: str, reference: str, parameters: dict | None = None) -> None:
    """A drift model: (t, dy, dx, …) with the reference and the parameters of its solution."""
    save(shifts, path, None, {"kind": "drift", "reference": reference, "parameters": parameters or {}})


def load_drift(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    df, _, about = load(spark, path)
    if about.get("kind") != "drift":
        raise ValueError("this isn't a drift model")
    return df, about


def fingerprint(spark: SparkSession, path: str) -> str:
    """Sizes and times of a source's files, as one hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    got = files.agg(F.count("*"), F.sum("length"), F.max("modificationTime"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return "-".join(str(int(v.timestamp() * 1e6) if hasattr(v, "timestamp") else v) for v in got)


def summary(spark: SparkSession, source: str, sidecar: str, make) -> DataFrame:
    """make(), kept beside the source under its fingerprint; a stale summary is computed again."""
    path = f"{sidecar}/{fingerprint(spark, source)}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A small result as text; arrays become JSON. Frames are exported as Parquet."""
    if kind == "parquet":
        df.write.parquet(path)
        return
    if kind not in ("csv", "json"):
        raise ValueError("kind is csv, json or parquet")
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) and kind == "csv" else F.col(c) for c, t in df.dtypes])
    (flat.write.option("header", "true") if kind == "csv" else flat.write).format(kind).save(path)


def metadata(df: DataFrame, axes: dict[str, Axis]) -> DataFrame:
    """(axis, size, scale, offset, units) as a table."""
    rows = [(a.name, a.size, float(a.scale), float(a.offset), a.units) for a in axes.values()]
    return df.sparkSession.createDataFrame(rows, "axis string, size int, scale double, offset double, units string")


def with_unit(df: DataFrame, column: str, unit: str) -> DataFrame:
    return df.withMetadata(column, {"unit": unit})


def parse_cif(text: Column) -> dict[str, Column]:
    """Cell lengths and angles, space group and elements of a CIF text; null where it doesn't say."""
    num = lambda tag: F.regexp_extract(text, rf"(?m)^\s*_cell_{tag}\s+([0-9.]+)", 1).try_cast("double")
    group = F.trim(F.regexp_extract(text, r"(?m)^\s*_(?:symmetry_)?space_group_name_H-M(?:_alt)?\s+'?([A-Za-z0-9/_ -]+)'?", 1))
    formula = F.regexp_extract(text, r"(?m)^\s*_chemical_formula_sum\s+'?([A-Za-z0-9 .]+)'?", 1)
    cell = {n: num(f"length_{n}") for n in "abc"} | {n: num(f"angle_{n}") for n in ("alpha", "beta", "gamma")}
    return cell | {"space_group": F.nullif(group, F.lit("")), "elements": F.array_sort(F.array_distinct(F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)"), F.lit(1))))}
