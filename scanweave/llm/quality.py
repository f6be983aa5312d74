"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every whole text gives a row of numbers; the trees, grown on the driver from a
bounded sample of labelled rows, are flattened into arrays and score a batch of
documents at once. Labels, language, source and id are never inputs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boosting
from .shared import text_bytes

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "stops", "high_bytes", "odd_endings", "distinct_words", "top_word", "repeated_word", "longest_run",
    "repeated_lines", "distinct_triples", "line_words", "bare_symbols", "capitalised", "log_longest_word", "shouted",
)
_CLASS = np.zeros(256, np.int64)
for _name, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&!|~^<>{}[]\\/=_@+", b".,;:?", bytes(range(128, 256))), 1):
    _CLASS[list(_chars)] = _name
_ENDS = frozenset(b"#*$%&!|~^<>{}[]\\/=_@+")


def statistics(text: bytes) -> list[float]:
    """STATISTICS of one whole text, all finite; an empty text has zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    count = np.bincount(_CLASS, np.bincount(np.frombuffer(text, np.uint8), minlength=256), 7)
    size, letters = len(text), max(1.0, count[1] + count[2])
    tally = Counter(words)
    same = [a == b for a, b in zip(words, words[1:], strict=False)]
    run = longest = 0
    if any(same):
        for x in same:
            run = run + 1 if x else 0
            longest = max(longest, run)
    lines = [x for x in text.split(b"\n") if x]
    triples = max(1, n - 2)
    ends = [w[-1] in _ENDS for w in words]
    return [
        np.log1p(size), np.log1p(n), (size - n) / n, count[1] / letters, count[3] / size, count[4] / size, count[5] / size, count[6] / size, sum(ends) / n, len(tally) / n, max(tally.values()) / n, sum(same) / n, longest / n,
        1 - len(set(lines)) / max(1, len(lines)), len(set(zip(words, words[1:], words[2:], strict=False))) / triples, n / max(1, len(lines)), sum(e and len(w) == 1 for e, w in zip(ends, words, strict=True)) / n,
        sum(65 <= w[0] <= 90 for w in words) / n, np.log1p(max(map(len, tally))), sum(w.isupper() for w in words) / n,
    ]


def table_of(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t) for t in text_bytes(texts)], float).reshape(-1, len(STATISTICS))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = table_of(b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))], ["label", "x"])


def remainder(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000) -> boosting.Forest:
    """Trees from labelled documents whose remainder isn't 0: at most max_rows of them, the first by MD5 of the id.

    Labels other than 0 and 1 are no labels; an id with several labels has the
    greatest, an id with several texts the least. With no labelled rows, or labels of one kind, the trees score all
    documents alike.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("lid")).agg(F.max(label_col).cast("double").alias("label"))
    drawn = known.where(remainder(F.col("lid")) != 0).orderBy(F.md5(F.col("lid").cast("string")), "lid").limit(max_rows)
    cols = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # max_rows bounds the broadcast side
    rows = cols.join(F.broadcast(drawn), cols["doc_id"] == drawn["lid"]).groupBy("lid").agg(F.min("label").alias("label"), F.min("text").alias("text"))
    # a row for each drawn id, of the size of its statistics
    got = rows.select("label", "text").mapInArrow(_statistics, "label double, x array<double>").toArrow()
    y = got["label"].to_numpy()
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(STATISTICS))
    order = np.lexsort((*x.T, y))  # the trees don't depend on the order in which rows come
    return boosting.fit(x[order], y[order])


def score(docs: DataFrame, forest: boosting.Forest, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with one more column, name: the score of the whole text, from 0 to 1. A null text is an empty one."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forest.score(table_of(b.column(at))))], [*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.3, max_rows: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per row of docs, which may repeat ids or have null ones; an empty table gives an empty result."""
    forest = train(docs, labels, id_col, text_col, max_rows=max_rows)
    scored = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), forest)
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, accept: float = 0.3) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    name = "score"
    while name in docs.columns:
        name = "_" + name
    return score(docs, train(docs, labels), name=name).where(F.col(name) >= accept).drop(name)
