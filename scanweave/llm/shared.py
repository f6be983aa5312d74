"""Helpers that several operators of this subpackage use.

Whole texts are read as UTF-8; a null text counts as an empty one. A word is a
maximal run of bytes other than the six ASCII white-space characters.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is unset and Spark runs in one process (as in tests) a local one."""
    to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not to:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        to = "file://" + tempfile.mkdtemp(prefix="scanweave-")
        spark.sparkContext.setCheckpointDir(to)
    return to.rstrip("/")


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder (in a folder for each value of the column by) and read it again: later steps don't repeat the work, and a lost executor costs none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scanweave/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class WordHashes:
    """64-bit hashes of words, memoised; the memo is emptied when it gets large."""

    def __init__(self, most: int = 400_000):
        self.memo: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.memo) > self.most:
            self.memo.clear()
        memo = self.memo
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit numbers that spreads them evenly."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size consecutive entries of h; empty if h is shorter."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        out ^= out >> np.uint64(29)
    return mixed(out)


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of an Arrow column, b"" for null."""
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def lists(flat: np.ndarray, sizes: np.ndarray | list[int], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column of the given row sizes over flat."""
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


#: Bytes of a text that `pieces` takes apart at a time.
PIECE = 1 << 20


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, parted by spaces, in lists of bounded size; a word longer than PIECE makes its list longer."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            cut = text.find(b" ", end)
            end = cut if cut >= 0 else len(text)
        yield text[at:end].split()
        at = end
