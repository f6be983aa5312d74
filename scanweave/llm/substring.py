"""Removing repeated passages, by difference-cover anchors.

{0, 1, 3} is a difference cover modulo 7: for any two positions there is a shift
below 7 that takes both into the cover. A hash of 7 words is taken only at
positions whose remainder modulo 7 is in the cover (the anchors). Two equal
windows of 13 words, wherever they stand, then share an anchor inside: 7 + 7 - 1
= 13. So the first pass finds the anchors that stand in two documents; the
second extends them, hashing the whole windows around them only, and finds each
window's smallest document; the last removes the covered words.

Anchors are a filter, so 64-bit keys do. Windows are judged equal by 128 bits.
Keys with their document travel in columnar pieces: a row holds a batch's keys of
one bucket, in order of documents, which are kept as steps. What a batch already
settles (an anchor in two of its documents, a window with a smaller one) is
passed on under the document's own bucket, and only one or two entries of such a
key go to the key's bucket. So a passage that a third of all documents share
costs its bucket an entry a batch, not one a document. The number of buckets
follows the bytes of text, so that a bucket fits into a task however long the
documents are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WordHashes, lists, materialise, text_bytes, windows

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: Keys that a task gathers before it passes them on; bytes of text whose keys make up a bucket at most.
FLUSH, BUCKET_TEXT = 2_000_000, 64 << 20
PIECES = "bucket int, settled boolean, keys binary, base long, docs binary"
#: The second half of a window's key comes from word hashes turned by this odd factor.
TURN = np.uint64(0xD6E8FEB86659FD93)


def anchor_positions(n_words: int) -> np.ndarray:
    """The cover positions of a text at which an anchor can start, if it has a window at all."""
    if n_words < WINDOW:
        return np.zeros(0, np.int64)
    p = np.arange(n_words - ANCHOR + 1)
    return p[np.isin(p % PERIOD, COVER)]


def _by_key(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (key, doc) in order, and for each the least and the greatest doc of its key, and whether it is its key's first. A row of keys is one key."""
    order = np.lexsort((docs, *keys.T[::-1]))
    keys, docs = keys[order], docs[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    new = first.copy()
    new[1:] |= docs[1:] != docs[:-1]
    keys, docs, first = keys[new], docs[new], first[new]
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(keys)))
    return keys, docs, np.repeat(docs[starts], sizes), np.repeat(docs[starts + sizes - 1], sizes), first


def _shared(docs: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    return least != most


def _beaten(docs: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    return least != docs


def _pieces(keys: np.ndarray, docs: np.ndarray, buckets: int, wanted: Callable, ends: bool) -> Iterator[pa.RecordBatch]:
    """A batch's keys: settled ones by document, one entry for each key (with ends, the least and the greatest) by key."""
    keys, docs, least, most, first = _by_key(keys, docs)
    done = wanted(docs, least, most)
    open_keys, open_docs = keys[first], docs[first]
    if ends:
        last = np.append(first[1:], True) & ~first
        open_keys, open_docs = np.concatenate([open_keys, keys[last]]), np.concatenate([open_docs, docs[last]])
    # what is settled is known by the first half of its key
    parts = [(x[0], True, *x[1:]) for x in _dealt(keys[done, :1], docs[done], _spread(docs[done]), buckets)] + [(x[0], False, *x[1:]) for x in _dealt(open_keys, open_docs, open_keys[:, 0], buckets)]
    yield _batch(parts, PIECES)


def _batch(parts: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "long": pa.int64()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in parts], kinds[k]) for i, (_, k) in enumerate(names)], [n for n, _ in names])


def _spread(docs: np.ndarray) -> np.ndarray:
    return docs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _dealt(keys: np.ndarray, docs: np.ndarray, by: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, int, bytes]]:
    """(bucket, keys, base, docs) of each bucket that by's hashes choose; docs ascend, as steps from the one before (the first from base) in as few bytes each as the widest step needs."""
    bucket = ((by >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((docs, bucket))
    bucket, keys, docs = bucket[order], keys[order], docs[order]
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
    for a, b in zip(at, [*at[1:], len(bucket)], strict=True) if len(bucket) else ():
        d = docs[a:b]
        base, packed = int(d[0]), d
        if int(d[-1]) - base < 1 << 32:
            steps = np.diff(d, prepend=d[0])
            packed = steps.astype(np.min_scalar_type(int(steps.max())))
        yield int(bucket[a]), keys[a:b].tobytes(), base, packed.tobytes()


#: Steps by the bytes of each; eight bytes hold the docs themselves.
_STEPS = {1: np.uint8, 2: np.uint16, 4: np.uint32}


def _docs_of(base: int, data: pa.Buffer, n: int) -> np.ndarray:
    """The n docs that _dealt packed."""
    wide = data.size // n
    return np.frombuffer(data, np.int64) if wide == 8 else base + np.cumsum(np.frombuffer(data, _STEPS[wide]), dtype=np.int64)


def _entries(batches: Iterator[pa.RecordBatch], words: int, settled: bool | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The keys, of so many 64-bit words each, and docs of all pieces (that are settled, or not)."""
    keys, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for b in batches:
        take = [True] * len(b) if settled is None else b.column("settled").to_pylist()
        for k, base, d, t in zip(b.column("keys"), b.column("base").to_pylist(), b.column("docs"), take, strict=True):
            if settled is None or t == settled:
                k, d = k.as_buffer(), d.as_buffer()
                keys.append(np.frombuffer(k, np.uint64))
                docs.append(_docs_of(base, d, k.size // (8 * words)))
    return np.concatenate(keys).reshape(-1, words), np.concatenate(docs)


def _gathered(found: Iterator[tuple[int, np.ndarray]], buckets: int, wanted: Callable, ends: bool) -> Iterator[pa.RecordBatch]:
    keys, docs, size = [], [], 0
    for doc, k in found:
        keys.append(k)
        docs.append(np.full(len(k), doc, np.int64))
        size += len(k)
        if size >= FLUSH:
            yield from _pieces(np.concatenate(keys), np.concatenate(docs), buckets, wanted, ends)
            keys, docs, size = [], [], 0
    if size:
        yield from _pieces(np.concatenate(keys), np.concatenate(docs), buckets, wanted, ends)


def _anchors(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()

        def found() -> Iterator[tuple[int, np.ndarray]]:
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                    words = text.split()
                    if doc is not None and len(words) >= WINDOW:
                        yield doc, windows(hashes(words), ANCHOR)[anchor_positions(len(words))][:, None]

        yield from _gathered(found(), buckets, _shared, True)

    return run


def near_anchor(h: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For each window whether it holds a shared anchor. shared is sorted."""
    p = anchor_positions(len(h))
    hit = np.zeros(len(h) - ANCHOR + 1, np.int32)
    hit[p] = np.isin(windows(h, ANCHOR)[p], shared)
    total = np.concatenate([[0], np.cumsum(hit)])
    return total[PERIOD:] > total[:-PERIOD]


def _extended(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()

        def found() -> Iterator[tuple[int, np.ndarray]]:
            for batch in batches:
                for doc, text, keys in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2), strict=True):
                    h = hashes(text.split())
                    near = near_anchor(h, keys.values.to_numpy().view(np.uint64))
                    yield doc, np.stack([windows(h, WINDOW)[near], windows(h * TURN, WINDOW)[near]], axis=1)

        yield from _gathered(found(), buckets, _beaten, False)

    return run


def _settle(wanted: Callable, words: int, shares: int) -> Callable:
    """For one bucket: the wanted (key, doc), dealt into shares by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        k, d, least, most, _ = _by_key(*_entries(batches, words, False))
        take = wanted(d, least, most)
        known = _entries(batches, 1, True)
        k, d = np.concatenate([k[take, :1], known[0]]), np.concatenate([d[take], known[1]])
        yield _batch(list(_dealt(k, d, _spread(d), shares)), SHARES)

    return run


SHARES = "share int, keys binary, base long, docs binary"


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For one share of the documents: a row with all its keys for each."""
    k, d = _entries(batches, 1)
    order = np.argsort(d, kind="stable")
    names, sizes = np.unique(d, return_counts=True)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), lists(k[order, 0].view(np.int64), sizes, pa.int64())], ["did", "keys"])


def _settled(pieces: DataFrame, wanted: Callable, words: int, buckets: int, shares: int) -> DataFrame:
    """(did, keys): the first halves of a document's wanted keys, a row for each document that has any. A bucket, and then a share, is a partition."""
    out = pieces.repartitionById(buckets, F.col("bucket")).mapInArrow(_settle(wanted, words, shares), SHARES)
    return out.repartitionById(shares, F.col("share")).mapInArrow(_by_document, "did long, keys array<long>")


def covered(h: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """For each word whether a repeated window covers it."""
    at = np.flatnonzero(np.isin(windows(h, WINDOW), repeated))
    change = np.zeros(len(h) + 1, np.int32)
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    return np.cumsum(change[:-1]) > 0


def _removed(with_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out = {"doc_id": batch.column(0).to_pylist(), "n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
            keys = batch.column(2) if batch.num_columns > 2 else [None] * batch.num_rows
            for text, k in zip(text_bytes(batch.column(1)), keys, strict=True):
                words = text.split()
                out["n_words"].append(len(words))
                kept = words
                if k is not None and k.is_valid:
                    gone = covered(hashes(words), k.values.to_numpy().view(np.uint64))
                    kept = [w for w, g in zip(words, gone, strict=True) if not g]
                joined = b" ".join(kept)
                out["n_removed"].append(len(words) - len(kept))
                out["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
                out["kept"].append(joined.decode() if with_text else None)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = list(out)[: 5 if with_text else 4]
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, kinds)], names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]), a row per row of docs.

    A word goes if a window of 13 words that covers it also starts in a document
    of a smaller id; kept is what stays, joined by single spaces. A null text has
    no words. Rows of one id are one document, and a row whose id is null is
    neither compared nor changed. An empty table gives an empty result. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    partitions, size = int(spark.conf.get("spark.sql.shuffle.partitions")), cols.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, shares = max(partitions, size // BUCKET_TEXT), max(partitions, size // (2 * BUCKET_TEXT))
    shared = _settled(cols.mapInArrow(_anchors(buckets), PIECES), _shared, 1, buckets, shares)
    near = materialise(cols.join(shared, cols["doc_id"] == shared["did"]).select("doc_id", "text", "keys"), "anchored")
    beaten = _settled(near.mapInArrow(_extended(buckets), PIECES), _beaten, 2, buckets, shares)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    if _repeated_ids(cols):
        both = cols.join(beaten, cols["doc_id"] == beaten["did"], "left").select("doc_id", "text", "keys")
        return both.mapInArrow(_removed(with_text), schema)
    changed = near.select("doc_id", "text").join(beaten, F.col("doc_id") == F.col("did")).select("doc_id", "text", "keys").mapInArrow(_removed(with_text), schema)
    whole = cols.mapInArrow(_removed(with_text), schema)
    names = [c for c in whole.columns if c not in ("doc_id", "n_words")]
    changed = changed.select(F.col("doc_id").alias("cid"), *[F.col(c).alias(f"c_{c}") for c in names])
    return whole.join(changed, whole["doc_id"] == changed["cid"], "left").select("doc_id", "n_words", *[F.coalesce(f"c_{c}", c).alias(c) for c in names])


def _repeated_ids(cols: DataFrame) -> bool:
    """Whether an id stands in more than one row: then results can't be joined by id alone."""
    return not cols.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").isEmpty()
