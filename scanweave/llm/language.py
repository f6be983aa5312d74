"""Language identification with a string kernel.

Two texts are alike by the byte n-grams, of one to four bytes, that both hold:
for each n the number of shared ones over the geometric mean of both texts'
numbers (how often one occurs plays no part), and the kernel is the mean over n.
n-grams are told apart by 15 bits of a hash. Letters are bytes: ASCII capitals
are made small, bytes over 127 stay, all else parts words.

A Nyström approximation maps every text to its kernel with a few landmarks,
whole training texts, and kernel ridge regression against each language gives
the coefficients. Documents are scored a batch at a time: their presence matrix
times the landmarks' presence matrix is the kernel, times the coefficients the
languages' scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import remainder
from .shared import pieces, text_bytes

LONGEST, BITS = 4, 15
SIZE = 1 << BITS
#: Documents whose presence matrix is multiplied at a time.
BATCH = 64
_LETTERS = bytes(c if chr(c).isalpha() else 32 for c in range(128)).lower() + bytes(range(128, 256))


def presence(text: bytes) -> np.ndarray:
    """Which n-grams a whole text holds: (LONGEST, SIZE) of booleans."""
    seen = np.zeros((LONGEST, SIZE), bool)
    last: list[bytes] = []
    for words in pieces(text.translate(_LETTERS)):
        if not words:
            continue
        # the last word of the piece before: no n-gram of four bytes reaches over more than two words
        x = np.frombuffer(b" " + b" ".join(last + words) + b" ", np.uint8).astype(np.uint32)
        last = words[-1:]
        gram = np.zeros(len(x), np.uint32)
        for n in range(LONGEST):
            gram = (gram[: len(x) - n] << np.uint32(8)) | x[n:]
            seen[n, (gram * np.uint32(2654435761)) >> np.uint32(32 - BITS)] = True
    return seen


def scales(seen: np.ndarray) -> np.ndarray:
    """For each n (the last axis but one), what its n-grams count in the kernel."""
    return 1 / np.sqrt(LONGEST * np.maximum(1, seen.sum(axis=-1)))


@dataclass
class Model:
    """names of the languages; landmarks: packed presence of each; coefficients: (landmarks + 1, languages), the last row constant."""

    names: list[str]
    landmarks: np.ndarray
    coefficients: np.ndarray

    def __post_init__(self):
        self._matrix = None

    def __getstate__(self):
        return {**self.__dict__, "_matrix": None}

    def matrix(self) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """The n-grams that landmarks hold, the same by n, and (n-grams, landmarks) of what each counts."""
        if self._matrix is None:
            seen = np.unpackbits(self.landmarks, axis=1).reshape(-1, LONGEST, SIZE).astype(bool)
            held = seen.any(axis=0)
            weights = np.concatenate([seen[:, n, held[n]].T * scales(seen)[:, n] for n in range(LONGEST)]).astype(np.float32)
            self._matrix = np.flatnonzero(held), np.cumsum([0, *held.sum(axis=1)]), weights
        return self._matrix

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, landmarks) from the presence of each text."""
        at, ends, weights = self.matrix()
        x = np.empty((len(texts), len(at)), np.float32)
        for row, seen in zip(x, texts, strict=True):
            np.copyto(row, seen.ravel()[at])
            for n, scale in enumerate(scales(seen)):
                row[ends[n] : ends[n + 1]] *= scale
        return x @ weights

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, languages)."""
        return self.kernel(texts) @ self.coefficients[:-1] + self.coefficients[-1]


def fit(names: list[str], seen: np.ndarray, labels: np.ndarray, landmarks: int = 160, ridge: float = 0.1) -> Model:
    """seen: packed presence of the training texts; labels: places in names. The landmarks are the first texts, each language in turn."""
    turn = np.empty(len(labels), np.int64)
    for k in range(len(names)):
        own = labels == k
        turn[own] = np.arange(own.sum())
    chosen = np.lexsort((labels, turn))[:landmarks]
    model = Model(names, seen[chosen], np.zeros((len(chosen) + 1, len(names)), np.float32))
    unpacked = lambda rows: [np.unpackbits(r).reshape(LONGEST, SIZE).astype(bool) for r in rows]
    k = np.concatenate([model.kernel(unpacked(seen[i : i + BATCH])) for i in range(0, len(seen), BATCH)]).astype(float)
    values, vectors = np.linalg.eigh(k[chosen])
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    x = np.column_stack([k @ root, np.ones(len(k))])
    # each language counts alike, however many texts it has
    weight = 1.0 / np.bincount(labels, minlength=len(names))[labels]
    y = (labels[:, None] == np.arange(len(names))).astype(float)
    penalty = np.diag([ridge / len(names)] * kept.sum() + [0.0])
    w = np.linalg.lstsq((x * weight[:, None]).T @ x + penalty, (x * weight[:, None]).T @ y, rcond=None)[0]
    model.coefficients = np.vstack([root @ w[:-1], w[-1:]]).astype(np.float32)
    return model


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bits = [np.packbits(presence(t)).tobytes() for t in text_bytes(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.binary())], ["lang", "seen"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 2000, max_langs: int = 100, landmarks: int = 160, ridge: float = 0.1) -> Model | None:
    """A model from documents with a language whose remainder isn't 0: the max_langs most frequent languages, at most max_rows documents in all, one of each of as many cells of hashes of the id in every language.

    A row without id, or whose text has no letter, teaches nothing; an id with several
    texts has the least. With nothing to learn from there is no model.
    """
    cols = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 0))
    names = sorted(r["lang"] for r in cols.where("text IS NOT NULL").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect())
    if not names:
        return None
    # a hash of the id deals a language's ids into cells, and the first of each cell is drawn: combined in each task before it is shuffled, however frequent a language is
    h = F.xxhash64("doc_id")
    cell = F.pmod(h, F.lit(max(1, max_rows // len(names)))).alias("cell")
    drawn = cols.where(F.col("lang").isin(names) & F.col("text").isNotNull()).groupBy("lang", cell).agg(F.min_by("doc_id", h).alias("its_id")).select(F.col("lang").alias("its_lang"), "its_id")
    # max_rows bounds the broadcast side
    rows = cols.join(F.broadcast(drawn), (cols["lang"] == drawn["its_lang"]) & (cols["doc_id"] == drawn["its_id"])).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    # a row of LONGEST * SIZE bits for each drawn document
    got = rows.where(F.col("text").rlike(r"\p{L}")).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "lang").select("lang", "text").mapInArrow(_packed, "lang string, seen binary").toArrow()
    if not got.num_rows:
        return None
    names = sorted(set(got["lang"].to_pylist()))
    labels = np.array([names.index(x) for x in got["lang"].to_pylist()])
    seen = np.frombuffer(b"".join(got["seen"].to_pylist()), np.uint8).reshape(len(labels), -1)
    return fit(names, seen, labels, landmarks, ridge)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", sharpness: float = 5.0) -> DataFrame:
    """(doc_id, lang_pred, score), a row per row of docs: the language of the highest score, and its share by softmax of sharpness times the scores.

    A text that is null or without a letter is `und` with score 0, and so is every
    text where there is no model. An empty table gives an empty result. Other
    columns are ignored.
    """
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    cols = docs.select(F.col(id_col).alias("doc_id"), F.when(letter, F.col(text_col)).alias("text"))
    if model is None:
        return cols.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH):
                b = batch.slice(first, BATCH)
                known = b.column(1).is_valid().to_numpy(zero_copy_only=False)
                f = sharpness * model.scores([presence(t) for t in text_bytes(b.column(1))]).astype(float)
                share = 1 / np.exp(f - f.max(axis=1, keepdims=True)).sum(axis=1)
                names = [model.names[k] if ok else "und" for k, ok in zip(f.argmax(axis=1), known, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(np.where(known, share, 0.0))], ["doc_id", "lang_pred", "score"])

    return cols.mapInArrow(run, f"doc_id {cols.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 2000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row per row of docs, which may repeat ids or have null ones; the language is learned from the rows not held out."""
    found = identify(docs, train(docs, id_col, text_col, lang_col, max_rows), id_col, text_col)
    return found.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
