"""Token counts by section, by offset-mapped attribution.

A document is encoded once, as a whole. Each token's bytes give its span of
characters, and an interval join of spans with sections gives every token its
section. A token that crosses a boundary goes to the section that holds most of
its characters, the earlier one where they are equal; so the sections' counts
always sum to the document's.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_bytes

RESULT = "doc_id long, section int, char_start long, char_end long, n_tokens long, n_crossing long, doc_tokens long"


class Encoder:
    """A byte-level BPE vocabulary in rank format, with the bytes that each id stands for."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = [len(x) for x in ranks]

    def spans(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end) in characters of each token, and where each character starts in bytes. Tokens that share a character both have it."""
        ids = np.array(self.encoding.encode_ordinary(text.decode()), np.int64)
        end = np.cumsum(self.size[ids])
        heads = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
        char = np.cumsum(heads) - 1
        return char[end - self.size[ids]], char[end - 1] + 1, np.flatnonzero(heads)


def line_bounds(text: bytes) -> np.ndarray:
    """Character offsets at which lines start, and the text's length; a line keeps its line feed. A text without characters has one empty line."""
    raw = np.frombuffer(text, np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80)
    n = int(char[-1]) if len(char) else 0
    starts = char[np.flatnonzero(raw == 10)]
    return np.unique(np.concatenate([[0], starts, [n]])) if n else np.array([0, 0])


def attribute(start: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's section, and whether it crosses a boundary."""
    inner = bounds[1:-1]
    first, last = np.searchsorted(inner, start, "right"), np.searchsorted(inner, end - 1, "right")
    out, crossing = first.copy(), first != last
    for t in np.flatnonzero(crossing):
        s = np.arange(first[t], last[t] + 1)
        held = np.minimum(end[t], bounds[s + 1]) - np.maximum(start[t], bounds[s])
        out[t] = s[held.argmax()]
    return out, crossing


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _counted(path: str, pattern: str) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, pattern) not in _ENCODERS:
            _ENCODERS[path, pattern] = Encoder(path, pattern)
        encoder = _ENCODERS[path, pattern]
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True):
                bounds = line_bounds(text)
                start, end, _ = encoder.spans(text)
                section, crossing = attribute(start, end, bounds)
                n = len(bounds) - 1
                parts = ([doc] * n, np.arange(n), bounds[:-1], bounds[1:], np.bincount(section, minlength=n), np.bincount(section[crossing], minlength=n), [len(start)] * n)
                for c, x in zip(cols, parts, strict=True):
                    c.extend(x)
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            names = [x.split()[0] for x in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def by_section(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each line of each row of docs: its characters (end exclusive), its tokens, those of them that cross a boundary, and the document's tokens.

    A null text is an empty one; an empty text has one empty section without
    tokens. Null and repeated ids stay as they are; an empty table gives an empty
    result. Other columns are ignored.
    """
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return cols.mapInArrow(_counted(vocabulary, pattern), RESULT)
