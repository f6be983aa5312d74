"""Token-id files with Re-Pair grammar compression.

Every whole text is encoded, an end id follows, and documents go in ascending id
order into shards of a bounded number of ids. In each shard frequent pairs of
neighbouring ids are replaced by new symbols (nonterminals), round after round
until no pair is frequent; the shard stores the rules, each symbol's expansion
length and the remaining sequence. Running sums of the lengths find the symbols that hold a document, so
any document, or part of it, is decoded without the rest.

A shard is one row of a Parquet table in the shared folder (any store that Spark
writes to; a task's rows appear only when it has ended), its content in the
layout of `pack`.

Encoding: a tokenizer of the usual lower-case word kind splits a text into pieces
(runs of letters, digits, runs of other marks), drops white space, and encodes
each piece by its own. So a piece that a worker has met before needn't be encoded
again: texts of ASCII and Western European letters are split here and their
pieces' ids are kept in a bounded memo; any other text, and every text where the
vocabulary file says that it splits otherwise, is encoded by the library as a
whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, text_bytes

END_ID = 2
#: Ids of a shard; pairs replaced in one round at most, and the occurrences that make a pair frequent; hash slots that count pairs.
SHARD_IDS, PAIRS, FREQUENT, SLOT_BITS = 1_000_000, 8192, 8, 18
MAGIC = b"RPG2"
#: The normalizer and pre-tokenizer, as a vocabulary file states them, that the splitting here stands for.
_SPLITS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)


#: A text of other characters, or with what may be a special token's name, is encoded by the library as a whole.
_OTHER = re.compile("[^\\x20-\\x7e\\t\\n\\x0b\\x0c\\r\u00df-\u00f6\u00f8-\u00ff]|<\\|")
#: The tokenizer's own way to split a text, for the characters that are left.
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
#: The usual characters for bytes in byte-level vocabularies: printable ones stand for themselves, the others follow from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_VISIBLE = dict(zip([b for b in range(256) if b not in _PRINTABLE], range(256, 512), strict=False))


class _Numbers(dict):
    """Pieces by number; a new one gets the next number and waits to be learnt."""

    def __init__(self):
        self.waiting: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.waiting.append(piece)
        return n


class TextEncoder:
    """Ids of texts, by way of their pieces; flat holds the ids of all known pieces."""

    def __init__(self, path: str, most: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model, self.n_ids = self.tokenizer.model, n_ids(self.tokenizer)
        special = all(t["content"].startswith("<|") and t["special"] for t in said.get("added_tokens") or ())
        self.by_pieces = special and (said.get("normalizer"), said.get("pre_tokenizer")) == _SPLITS and said["model"]["type"] == "BPE"
        self.clear()

    def clear(self) -> None:
        self.memo = _Numbers()
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def learn(self) -> None:
        pieces, self.memo.waiting = self.memo.waiting, []
        ids = [[t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(_VISIBLE))] for p in pieces]
        total, known = sum(map(len, ids)), len(self.memo) - len(pieces)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while known + len(pieces) > len(self.start):
            self.start, self.size = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.size, np.zeros_like(self.size)])
        sizes = np.array([len(x) for x in ids], np.int32)
        self.size[known : known + len(pieces)] = sizes
        self.start[known : known + len(pieces)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.int32, total)
        self.used += total

    def __call__(self, text: bytes) -> np.ndarray:
        whole = text.decode()
        lower = whole.lower()
        if not self.by_pieces or _OTHER.search(lower):
            return np.array(self.tokenizer.encode(whole, add_special_tokens=False).ids, np.int32)
        pieces = _PIECE.findall(lower)
        if len(self.memo) > self.most:
            self.clear()
        at = np.fromiter(map(self.memo.__getitem__, pieces), np.int64, len(pieces))
        if self.memo.waiting:
            self.learn()
        size = self.size[at]
        first = np.cumsum(size) - size
        return self.flat[np.repeat(self.start[at] - first, size) + np.arange(size.sum())]


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """A worker's encoder, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def compress(ids: np.ndarray, first_symbol: int, pairs: int = PAIRS, least: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(rules, sequence): rule r says which two symbols first_symbol + r stands for.

    Each round counts all pairs of neighbours by slots of a hash table, takes the
    most frequent pairs (one of a slot, at least `least` of each) and replaces
    them from left to right. Rounds end when no pair stands `least` times.
    """
    seq, rules = ids.astype(np.uint32), np.zeros((0, 2), np.uint32)
    while len(seq) >= 2 * least:
        key = (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:]
        slot = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        count = np.bincount(slot, minlength=1 << SLOT_BITS)
        bar = max(least, int(np.partition(count, -pairs)[-pairs]))
        found, n = np.unique(key[(count >= bar)[slot]], return_counts=True)
        order = np.lexsort((found, -n))[: 2 * pairs]
        found, n = found[order], n[order]
        home = ((found * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        one = np.sort(np.unique(home, return_index=True)[1])
        one = one[n[one] >= least][:pairs]
        if not len(one):
            break
        chosen = np.zeros(1 << SLOT_BITS, np.uint64)
        symbol = np.zeros(1 << SLOT_BITS, np.uint32)
        chosen[home[one]] = found[one]
        symbol[home[one]] = first_symbol + len(rules) + np.arange(len(one))
        hit = np.flatnonzero(chosen[slot] == key)
        hit = hit[symbol[slot[hit]] > 0]  # an empty slot looks like the pair (0, 0)
        # of hits that follow each other, every second one would overlap
        run = np.append(True, np.diff(hit) > 1)
        nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
        hit = hit[nth % 2 == 0]
        seq[hit] = symbol[slot[hit]]
        seq = np.delete(seq, hit + 1)
        rules = np.concatenate([rules, np.stack([found[one] >> np.uint64(32), found[one] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)])
    return rules, seq


def lengths(rules: np.ndarray, first_symbol: int) -> np.ndarray:
    """Expansion length of every symbol."""
    out = np.ones(first_symbol + len(rules), np.int64)
    for r, (a, b) in enumerate(rules.tolist(), first_symbol):
        out[r] = out[a] + out[b]
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, first_symbol: int) -> np.ndarray:
    """The ids that the symbols stand for."""
    while len(symbols) and symbols.max() >= first_symbol:
        new = symbols >= first_symbol
        size = 1 + new
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint32)
        out[at[~new]] = symbols[~new]
        pair = rules[symbols[new] - first_symbol]
        out[at[new]], out[at[new] + 1] = pair[:, 0], pair[:, 1]
        symbols = out
    return symbols


def pack(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, vocabulary: int) -> bytes:
    """A shard's bytes: MAGIC; the vocabulary's size; counts of documents, rules, symbols, and bytes a symbol; rules; expansion lengths of the rules; documents' ids, nulls and sizes; symbols. Little-endian."""
    rules, seq = compress(ids, vocabulary)
    wide = 2 if vocabulary + len(rules) <= 1 << 16 else 4
    own = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], "u1")
    parts = (rules.astype("<u4"), lengths(rules, vocabulary)[vocabulary:].astype("<u4"), own, null, sizes.astype("<u4"), seq.astype(f"<u{wide}"))
    return MAGIC + struct.pack("<QQQQQ", vocabulary, len(doc_ids), len(rules), len(seq), wide) + b"".join(p.tobytes() for p in parts)


class Shard:
    """A packed shard, decoded where asked."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard of token ids")
        vocabulary, docs, rules, symbols, wide = struct.unpack_from("<QQQQQ", data, 4)
        at = 44

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * rules).reshape(-1, 2)
        size = np.concatenate([np.ones(vocabulary, np.int64), take("<u4", rules)])
        own, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(own, null, strict=True)]
        self.ends = np.cumsum(take("<u4", docs), dtype=np.int64)
        self.symbols = take(f"<u{wide}", symbols).astype(np.uint32)
        self.after = np.cumsum(size[self.symbols])
        # every symbol's expansion, one after the other
        self.size, self.start = size, np.cumsum(size) - size
        self.flat = np.concatenate([np.arange(vocabulary, dtype=np.uint32), expand(np.arange(vocabulary, vocabulary + rules, dtype=np.uint32), self.rules, vocabulary)])

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end of the shard."""
        if end <= start:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(self.after, start, "right"), np.searchsorted(self.after, end - 1, "right")
        before = int(self.after[a - 1]) if a else 0
        symbols = self.symbols[a : b + 1]
        size = self.size[symbols]
        at = np.repeat(self.start[symbols] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return self.flat[at][start - before : end - before]

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, its end id included."""
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def _encoded(path: str, end_id: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        kind = width(encode.n_ids, end_id)
        for b in batches:
            ids = [np.append(encode(t), end_id).astype(kind).tobytes() for t in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def n_ids(tokenizer) -> int:
    """One more than the greatest id."""
    return 1 + max(tokenizer.get_vocab(with_added_tokens=True).values(), default=0)


def width(vocabulary: int, end_id: int) -> str:
    """The type in which ids travel until they are packed."""
    return "<u2" if max(vocabulary - 1, end_id) < 1 << 16 else "<u4"


def _packed(vocabulary: int, kind: str) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        docs, ids, size = [], [], 0

        def row() -> pa.RecordBatch:
            sizes = np.array([len(i) for i in ids])
            data = pack(docs, sizes, np.concatenate(ids), vocabulary)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_ids": size, "data": data}], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("data", pa.binary())]))

        for b in batches:
            for doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs.append(doc)
                ids.append(np.frombuffer(data, kind).astype(np.uint32))
                size += len(ids[-1])
                if size >= SHARD_IDS:
                    yield row()
                    docs, ids, size, seq = [], [], 0, seq + 1
        if docs:
            yield row()

    return run


def write(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, end_id: int = END_ID) -> DataFrame:
    """The shards (part, seq, n_ids, data), written to the shared folder and read back; in order of (part, seq) the documents ascend by id, null ids first, rows of one id by their ids.

    A null text is an empty one, whose only id is the end id. An empty table gives
    no shards. Other columns are ignored. partitions: how many ranges of ids are
    packed at the same time, by default Spark's shuffle partitions. vocabulary: the
    path of any file of the tokenizers library; its size says how wide ids are.
    """
    from tokenizers import Tokenizer

    size = max(n_ids(Tokenizer.from_file(vocabulary)), end_id + 1)
    spark = docs.sparkSession
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # written first, for finding the ranges reads it as well
    encoded = materialise(cols.mapInArrow(_encoded(vocabulary, end_id), "doc_id long, ids binary"), "token-ids")
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = encoded.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    return materialise(ordered.mapInArrow(_packed(size, width(size, end_id)), "part int, seq int, n_ids long, data binary"), "token-shards")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, seq, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            shard = Shard(data)
            n = np.diff(shard.ends, prepend=0)
            whole = memoryview(shard.ids(0, int(shard.ends[-1])).astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(whole[4 * (e - k) : 4 * e]) for e, k in zip(shard.ends.tolist(), n.tolist(), strict=True)]
            rows = len(n)
            yield pa.RecordBatch.from_arrays([pa.array([part] * rows, pa.int32()), pa.array([seq] * rows, pa.int32()), pa.array(shard.doc_ids, pa.int64()), pa.array(shard.ends - n), pa.array(n), pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"])


def digests(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the shards."""
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select(F.col("part").alias("p"), before(F.lit(0), "part").alias("part_start"))
    starts = shards.select("part", "seq", F.col("n_ids").alias("n")).withColumn("seq_start", before("part", "seq"))
    starts = starts.join(parts, F.col("part") == F.col("p")).select(F.col("part").alias("sp"), F.col("seq").alias("ss"), (F.col("part_start") + F.col("seq_start")).alias("first"))
    rows = shards.select("part", "seq", "data").mapInArrow(_digests, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(starts, (F.col("part") == F.col("sp")) & (F.col("seq") == F.col("ss"))).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
