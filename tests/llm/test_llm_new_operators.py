"""Resampling, language identification and hard negatives against slow versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scanweave.llm import language, negatives, resampling, shared

TARGET = [(1, "w1 w2 w3 w4 w5 w6"), (2, None), (3, ""), (4, "W7 w8-w9 É"), (4, "W7 w8-w9 É")]


def slow_features(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def slow_resample(rows, target):
    every = [(r[0], *slow_features(r[1])) for r in rows]
    s, t = Counter(x for _, _, f in every for x in f), Counter(x for r in target for x in slow_features(r[1])[1])
    here, there = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = [math.floor(1000 * math.log((t[k] + 1) * here / ((s[k] + 1) * there))) for k in range(10_000)]
    out = []
    for i, n, f in every:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    long = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    for rank, r in enumerate(long[: 5 * len(long) // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in out)


def test_resample(spark, docs, rows, empty):
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    got = resampling.resample(docs, target)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert Counter(map(tuple, got.collect())) == slow_resample(rows, TARGET)
    assert resampling.resample(empty, target).collect() == []
    # an empty target is allowed, too
    assert Counter(map(tuple, resampling.resample(docs, target.where("false")).collect())) == slow_resample(rows, [])


def test_features_of_pieces(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(500)).encode()
    whole = sorted(x for _, b in resampling.features(text) for x in b)
    monkeypatch.setattr(shared, "PIECE", 16)
    parts = list(resampling.features(text))
    assert len(parts) > 50 and sum(n for n, _ in parts) == 500 and sorted(x for _, b in parts for x in b) == whole


@pytest.mark.parametrize("kind", ["spread", "ties", "one value"])
def test_draw(spark, kind):
    rng = random.Random(3)
    value = {"spread": lambda: rng.randrange(10**6), "ties": lambda: rng.randrange(5), "one value": lambda: 7}[kind]
    rows = [(rng.randrange(400) if i % 9 else None, value(), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, score long, row long").repartition(5).cache()
    order = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0, r[2]))
    for k in (0, 1, 150, 1500, 3000):
        got, is_drawn = resampling.draw(df, k, 3000, ties=("id", "row"), accuracy=100)
        got = sorted(got.select("place", "id", "score", "row").collect())
        assert [tuple(r)[1:] for r in got] == order[:k] and [r.place for r in got] == list(range(1, k + 1))
        assert df.where(~is_drawn).count() == 3000 - k


def test_bracket_is_widened(spark):
    """Where the sketch says next to nothing, exact counts find it out."""
    df = spark.range(2000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("score")).cache()
    values = sorted((r[0] for r in df.collect()), reverse=True)
    for k in (1, 500, 999, 1000, 1001, 2000):
        above, least, most = resampling.bracket(df, "score", k, 2000, accuracy=1000)
        assert above == sum(v > most for v in values) if most is not None else above == 0
        assert above < k and (least is None or values[k - 1] >= least) and (most is None or values[k - 1] <= most)


def slow_grams(text):
    words = re.findall(rb"[a-z\x80-\xff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode())
    line = b" " + b" ".join(words) + b" " if words else b""
    return [{(int.from_bytes(line[i : i + n], "big") * 2654435761 % 2**32) >> 17 for i in range(len(line) - n + 1)} for n in range(1, 5)]


def slow_kernel(a, b):
    return sum(len(x & y) / math.sqrt(max(1, len(x)) * max(1, len(y))) for x, y in zip(slow_grams(a), slow_grams(b), strict=True)) / 4


def test_kernel(monkeypatch):
    texts = ["the cat sat on the mat", "der Hund lief über die Straße, 7 mal", "", "x", "1 2 3", "été à la plage " * 20]
    seen = [language.presence(t.encode()) for t in texts]
    assert [[set(np.flatnonzero(row)) for row in s] for s in seen] == [slow_grams(t) for t in texts]
    model = language.Model(["a"], np.stack([np.packbits(s) for s in seen]), np.zeros((len(seen) + 1, 1)))
    want = [[slow_kernel(a, b) for b in texts] for a in texts]
    np.testing.assert_allclose(model.kernel(seen), want, atol=1e-6)
    monkeypatch.setattr(shared, "PIECE", 8)
    assert all((language.presence(t.encode()) == s).all() for t, s in zip(texts, seen, strict=True))


def test_language_on_held_out_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.classify(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and len(held) > 150
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    # labels of the held-out rows teach nothing
    other = df.withColumn("lang", F.when(language.remainder(F.col("doc_id")) == 0, F.lit("xx")).otherwise(F.col("lang")))
    same = {(r.doc_id, r.lang_pred, r.score) for r in language.classify(other).collect()}
    assert same == {(r.doc_id, r.lang_pred, r.score) for r in got}


def test_language_of_odd_rows(spark, docs, rows, empty):
    got = language.classify(docs)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    got = got.collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert {r.lang_pred for r in got} <= {"en", "de", "fr", "es", "und"}
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {1, 2, 3} <= und and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert language.classify(empty).collect() == []
    nothing = language.classify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(nothing) == len(rows) and {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    one = language.classify(docs.withColumn("lang", F.lit("la"))).collect()
    assert {r.lang_pred for r in one} == {"la", "und"}


def slow_mine(rows, anchors, k=5):
    """rows: (id, label, vector of whole numbers)."""
    out, done = Counter(), set()
    for i, label, v in sorted(rows):
        if not anchors(i) or (i, len(v)) in done:
            continue
        done.add((i, len(v)))
        score = lambda r, v=v: sum(a * b for a, b in zip(r[2], v, strict=True))
        others = sorted(((-score(r), r[0], r[1]) for r in rows if r[0] != i and len(r[2]) == len(v)), key=lambda x: x[:2])
        for p in [o for o in others if o[2] == label][:k]:
            fit = [o for o in others if o[2] != label and 80 * -p[0] <= 100 * -o[0] <= 100 * -p[0]][:k]
            out.update((i, p[1], rank, n[1], -p[0], -n[0]) for rank, n in enumerate(fit, 1))
    return out


@pytest.mark.parametrize("scale", [3, 40_000, 2**25])
@pytest.mark.parametrize("block", [8192, 3])
def test_mine(spark, scale, block, monkeypatch):
    """Ties, repeated ids and vectors, scores of both signs, one label with a third of the rows, vectors of two lengths and of none."""
    monkeypatch.setattr(negatives, "VECTORS", 50)
    rng = random.Random(scale)
    vector = lambda n: [rng.randint(-scale, scale) for _ in range(n)]
    rows = [(i, 0 if i % 3 else rng.randrange(4), vector(12)) for i in range(400)] + [(1000 + i, i % 3, vector(5)) for i in range(40)]
    rows += [(i, 1, rows[7][2]) for i in range(2000, 2030)] + [(100, 2, vector(12)), (50, 0, rows[0][2]), (3000, 1, []), (3001, 2, [])]
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<long>").repartition(4).withColumns({c: F.lit(1) for c in ("side", "cell", "i", "j", "score", "place", "rank", "windows", "dims")})
    got = negatives.mine(df, F.col("vec_id") % 50 == 0, anchor_block=block)
    assert ", ".join(f"{c} {t}" for c, t in got.dtypes) == negatives.MINED.replace("long", "bigint")
    assert Counter(map(tuple, got.collect())) == slow_mine(rows, lambda i: i % 50 == 0)
    assert negatives.mine(df.where("false"), F.col("vec_id") % 50 == 0).collect() == []


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5, -0.5]), (1, None, [1.0, 1.0]), (2, 1, None), (3, 1, [None, 1.0]), (4, 1, [nan, 1.0]), (5, 1, [inf, 1.0]), (6, 1, [-inf, 0.0]), (None, 1, [1.0, 1.0]), (7, 1, []), (8, 2, [0.001, -0.001])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = negatives.labelled_vectors(df, "vec_id", "embedding", F.col("label"))
    assert sorted(map(tuple, got.collect())) == [(0, 1, [128, -128]), (7, 1, []), (8, 2, [0, -1])]


def test_scan_skips_columns():
    """The bounds drop candidates before the last column is read."""
    rng = np.random.default_rng(1)
    v = rng.integers(-20, 20, (500, 64))
    v[:20] = 20
    block = negatives.Columns(np.ascontiguousarray(v.T.astype(float)), np.arange(500), np.zeros(500, int))
    head, sizes = negatives.Positives(5), []
    stay = head.can_stay
    anchor = np.r_[np.full(8, 50.0), np.full(56, 1.0)]
    at, score = negatives.scan(anchor, block, np.ones(500, bool), lambda low, high: (sizes.append(len(low)), stay(low, high))[1])
    assert sizes[0] == 500 and sizes[1] < 100 and pa.array(score).to_pylist() == (v[at] @ anchor).tolist()
    assert set(np.lexsort((np.arange(500), -(v @ anchor)))[:5]) <= set(at)
