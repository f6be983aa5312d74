"""Benchmark decontamination by spaced-seed hashing.

A seed is a hash of the six words that a mask picks from a run of a text, so
words that the mask ignores may differ. Seeds of the benchmark are joined with
those of every document; around each hit the two texts are laid on each other
and compared word by word, which tolerates substitutions. A document is
contaminated by an item if some window of 13 words agrees with the item's in 10
of them or more; an item of 8 to 12 words must agree in four of five over its
whole length; shorter ones are phrases that stand anywhere, and contaminate a
document only if it consists of the same words and no more.

The benchmark is the smaller side: it is taken in blocks of a fixed number of
words, each of which is sent to the executors once and joined with all
documents there. A pass takes a few blocks and is written before the next ones
are read: a larger benchmark takes more passes, not more memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WordHashes, materialise, text_bytes

#: Offsets that each mask keeps; all of weight six. At every allowed substitution in a window of 8 to 13 words some mask at some place meets only words that agree, so no overlap is missed.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 2, 4, 5, 6), (0, 1, 3, 4, 6, 7), (0, 1, 2, 7, 8, 9), (0, 1, 3, 6, 8, 9), (0, 1, 2, 8, 9, 10))
WINDOW, AGREE, LEAST = 13, 10, 8
#: Words of a block of the benchmark, and blocks of a pass.
BLOCK_WORDS, BLOCKS = 1_000_000, 4
#: Words of documents taken at once, and shared seeds laid out at once.
AT_ONCE, LAID_OUT = 1 << 16, 1 << 20
#: Odd factors for the six kept words.
_FACTORS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_EDGE = b".,;:!?\"'()[]{}<>*#%&$|/\\-_=+~^`"
RESULT = "doc_id long, item_id long, agreed int, window int, equal_words int, item_words int, doc_start int, item_start int"


def tokens(text: bytes) -> list[bytes]:
    """Words with ASCII letters lower-cased and ASCII punctuation off both ends; words of punctuation alone are left out."""
    return [w for w in (x.strip(_EDGE) for x in text.lower().split()) if w]


def seeds(h: np.ndarray) -> list[np.ndarray]:
    """For each mask the seeds at all its places: sums of the words' hashes times a factor for each kept offset. Word hashes are spread evenly, so a factor each is enough."""
    scaled = [h * np.uint64(f) for f in _FACTORS]
    out = []
    for m, mask in enumerate(MASKS):
        n = max(0, len(h) - mask[-1])
        s = np.full(n, m, np.uint64)
        for k, p in enumerate(mask):
            s += scaled[k][p : p + n]
        out.append((s ^ (s >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15))
    return out


class Items:
    """A block of the benchmark: its words' hashes, its seeds in order, and a bitmap of them."""

    def __init__(self, rows: list[tuple[int | None, bytes]], hashes: WordHashes):
        self.ids = [i for i, _ in rows]
        self.words = [hashes(tokens(t)) for _, t in rows]
        seed, item, at = [], [], []
        for i, h in enumerate(self.words):
            for s in seeds(h) if len(h) >= LEAST else ():
                seed.append(s)
                item.append(np.full(len(s), i, np.int32))
                at.append(np.arange(len(s), dtype=np.int32))
        none = np.zeros(0, np.uint64)
        self.seed, self.item, self.at = (np.concatenate([none.astype(t), *x]).astype(t) for x, t in ((seed, np.uint64), (item, np.int32), (at, np.int32)))
        order = np.argsort(self.seed, kind="stable")
        self.seed, self.item, self.at = self.seed[order], self.item[order], self.at[order]
        self.short: dict[bytes, list[int]] = {}
        for i, h in enumerate(self.words):
            if 0 < len(h) < LEAST:
                self.short.setdefault(h.tobytes(), []).append(i)
        self.bits = min(26, max(16, int(32 * len(self.seed) + 1).bit_length()))
        self.bitmap = np.zeros(1 << self.bits, bool)
        self.bitmap[self.seed >> np.uint64(64 - self.bits)] = True

    def hits(self, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Distinct (document, item, place of the item's first word in the document) of shared seeds; h holds documents one after the other, from starts on."""
        out = [np.zeros((0, 3), np.int64)]
        for s in seeds(h):
            p = np.flatnonzero(self.bitmap[s >> np.uint64(64 - self.bits)])
            lo, hi = np.searchsorted(self.seed, s[p], "left"), np.searchsorted(self.seed, s[p], "right")
            n = hi - lo
            # a frequent seed's places are laid out in slices, so that memory is bounded
            total = np.concatenate([[0], np.cumsum(n)])
            for first in range(0, int(total[-1]), LAID_OUT):
                place = np.arange(first, min(first + LAID_OUT, int(total[-1])))
                k = np.searchsorted(total, place, "right") - 1
                entry, at = lo[k] + place - total[k], p[k]
                doc = np.searchsorted(starts, at, "right") - 1
                out.append(np.unique(np.stack([doc, self.item[entry].astype(np.int64), at - starts[doc] - self.at[entry]], axis=1), axis=0))
        return np.unique(np.concatenate(out), axis=0)

    def best(self, h: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int, int]]:
        """(item, agreed, window, equal words, item's words, start in h, start in item) of each item's best verified window, of (item, place) candidates."""
        best: dict[int, tuple] = {}
        for i, place in places.tolist():
            item = self.words[i]
            a, b = max(0, place), min(len(h), place + len(item))
            size = min(WINDOW, len(item))
            if b - a < size:
                continue
            total = np.concatenate([[0], np.cumsum(h[a:b] == item[a - place : b - place])])
            agreed = total[size:] - total[:-size]
            k = int(agreed.argmax())
            found = (int(agreed[k]), size, int(total[-1]), len(item), a + k, a + k - place)
            if found[0] >= (AGREE if size == WINDOW else 0.8 * size) and found[:3] > best.get(i, (0,))[:3]:
                best[i] = found
        for i, found in sorted(best.items()):
            yield i, *found

    def overlaps(self, texts: Iterator[bytes], hashes: WordHashes) -> Iterator[tuple]:
        """(number of the text, *best) for all texts."""
        held: list[np.ndarray] = []
        first = size = 0

        def searched() -> Iterator[tuple]:
            starts = np.cumsum([0, *map(len, held[:-1])])
            found = self.hits(np.concatenate(held), starts)
            docs, from_ = np.unique(found[:, 0], return_index=True)
            for d, a, b in zip(docs.tolist(), from_, np.append(from_, len(found))[1:], strict=True):
                for x in self.best(held[d], found[a:b, 1:]):
                    yield first + d, *x
            for d, h in enumerate(held) if self.short else ():
                for i in self.short.get(h.tobytes(), ()) if len(h) < LEAST else ():
                    yield first + d, i, len(h), len(h), len(h), len(h), 0, 0

        for t in texts:
            held.append(hashes(tokens(t)))
            size += len(held[-1])
            if size >= AT_ONCE:
                yield from searched()
                first, size, held = first + len(held), 0, []
        if held:
            yield from searched()


def _search(items) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, block = WordHashes(), items.value
        for batch in batches:
            doc = batch.column(0).to_pylist()
            rows = [(doc[n], block.ids[i], *x) for n, i, *x in block.overlaps(text_bytes(batch.column(1)), hashes)]
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            names = [x.split()[0] for x in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.int32()) for i, c in enumerate(cols)], names)

    return run


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    rows, size, hashes = [], 0, WordHashes()
    for r in benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).toLocalIterator():
        text = (r[1] or "").encode()
        rows.append((r[0], text))
        size += len(text) // 4 + 1
        if size >= BLOCK_WORDS:
            yield Items(rows, hashes)
            rows, size = [], 0
    yield Items(rows, hashes)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and item that overlap, with the best window; documents without overlap have none.

    Null texts are empty and match nothing; null ids stay null; a row of docs
    that is repeated is found in each; either table may be empty. Whole texts
    are searched. Other columns are ignored.
    """
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    send = docs.sparkSession.sparkContext.broadcast
    out: list[DataFrame] = []
    for more, blocks in _passes(benchmark, item_col, item_text_col):
        sent = [send(b) for b in blocks]
        found = reduce(DataFrame.union, [cols.mapInArrow(_search(b), RESULT) for b in sent])
        out.append(_settled(found, sent) if more else found)
    return reduce(DataFrame.union, out)


def _passes(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[bool, list[Items]]]:
    """(whether more follow, the blocks) of each pass, one at a time."""
    held: list[Items] = []
    for b in _blocks(benchmark, id_col, text_col):
        if len(held) == BLOCKS:
            yield True, held
            held = []
        held.append(b)
    yield False, held


def _settled(df: DataFrame, sent: list) -> DataFrame:
    """df written and read again; its broadcasts are given up."""
    out = materialise(df, "overlaps")
    for b in sent:
        b.destroy()
    return out


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that overlap no item, with all their columns; a row with a null id is kept only if its text is clean too."""
    out = docs
    at = docs.columns.index(text_col)
    for more, blocks in _passes(benchmark, "item_id", "text"):
        sent = [docs.sparkSession.sparkContext.broadcast(b) for b in blocks]

        def run(batches: Iterator[pa.RecordBatch], sent: list = sent) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for items in sent:
                    keep[[n for n, *_ in items.value.overlaps(text_bytes(batch.column(at)), hashes)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
        if more:
            out = _settled(out, sent)
    return out
