"""Trees and thresholds of personal data learn from all spans of all documents, and trees grown by Spark are those of a plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanweave.llm import boosting, pii


def test_every_span_teaches(spark):
    """More documents than the 4,000 that were drawn, more spans than the 16 of a kind that were read in one, repeated ids, no id, and no two digits in a row."""
    texts = [(i, f"write to a{i}@b.co") for i in range(5000)] + [(7, "x@y.zz"), (None, "u@v.ww"), (5000, "mail " + " , ".join(f"n{i}@m.org" for i in range(300))), (5001, "host 1.2.3.4 up"), (5002, None), (5003, "")]
    got = pii.labelled_proposals(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))
    assert got.count() == 5303
    assert {(r.kind, r.y): r.n for r in got.groupBy("kind", "y").agg(F.count("*").alias("n")).collect()} == {(0, 1): 5302, (1, 1): 1}
    # the same spans, as the trees get them
    rows = pii.counted(got.withColumn("real", F.lit(True)))
    assert rows.agg(F.sum("n")).first()[0] == 5303 and rows.count() < 200


def test_threshold_counts_late_spans(spark):
    """Of held-out documents, telephone numbers that are wrong by their length and stand behind 20 right ones count for the threshold of their kind."""
    held = [i for i in range(40) if spark.range(1).select(F.crc32(F.lit(str(i)).cast("binary")) % 5).first()[0] == 0][:4]
    right = " ; ".join(f"phone +1 437 555 {1000 + i}" for i in range(20))
    wrong = " ; ".join(f"phone +1 437 555 {1000 + i} 4321 22" for i in range(20))
    spans = pii.labelled_proposals(spark.createDataFrame([(i, f"{right} ; {wrong}") for i in held], "doc_id long, text string"))
    assert {(r.held, r.y): r.n for r in spans.where("kind = 3").groupBy("held", "y").agg(F.count("*").alias("n")).collect()} == {(True, 1): 80, (True, 0): 80}


def slow_grow(x, y, n, trees, depth, rate):
    """boosting.grow row by row, with every value of a feature as a cut."""
    unit, fine, p = boosting.UNIT, boosting.FINE, ((y * n).sum() + 1) / (n.sum() + 2)
    margin = np.full(len(x), round(float(np.log(p / (1 - p))) * unit))
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin / unit))
        g, h = n * np.floor((y - q) * fine + 0.5), n * np.maximum(np.floor(q * (1 - q) * fine + 0.5), 1)
        nodes = [np.arange(len(x))]
        for _ in range(depth):
            after = []
            for at in nodes:
                best, left = 1e-9, np.ones(len(at), bool)
                score = lambda a: (g[a].sum() / fine) ** 2 / (h[a].sum() / fine + 1)  # noqa: B023, E731
                for j in range(x.shape[1]):
                    for c in np.unique(x[at, j])[1:]:
                        low = x[at, j] < c
                        if min(h[at[low]].sum(), h[at[~low]].sum()) >= fine and (gain := score(at[low]) + score(at[~low]) - score(at)) > best + 1e-9:
                            best, left = gain, low
                after += [at[left], at[~left]]
            nodes = after
        for at in nodes:
            margin[at] += round(rate * unit * float(np.clip(g[at].sum() / fine / (h[at].sum() / fine + 1), -boosting.STEP, boosting.STEP)))
    return margin


def test_grow(spark):
    rng = np.random.default_rng(4)
    x = np.stack([rng.integers(0, 9, 400), rng.integers(0, 2, 400), rng.integers(0, 5, 400)], axis=1)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 0) | (rng.random(400) < 0.1)).astype(int)
    n = rng.integers(1, 7, 400)
    df = spark.createDataFrame([(list(map(int, a)), int(b), int(c)) for a, b, c in zip(x, y, n, strict=True)], "x array<int>, y int, n long")
    forest = boosting.grow(df.repartition(1), trees=4, depth=2, rate=0.3)
    want = slow_grow(x, y, n, 4, 2, 0.3)
    assert (np.rint(forest.margin(x.astype(float)) * boosting.UNIT) == want).all()
    got = {(tuple(r.x), r.m) for r in df.select("x", forest.units().alias("m")).collect()}
    assert got == {(tuple(map(int, a)), int(m)) for a, m in zip(x, want, strict=True)}
    # neither the partitions nor whether equal rows are one row or many matter
    many = df.select("x", "y", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i")).select("x", "y", F.lit(1).cast("long").alias("n")).repartition(7)
    other = boosting.grow(many, trees=4, depth=2, rate=0.3)
    assert all((getattr(forest, k) == getattr(other, k)).all() for k in ("feature", "cut", "leaf")) and forest.base == other.base
    one = df.where("y = 1")
    assert boosting.grow(one, trees=2).score(x[:2].astype(float)).min() > 0.9
    assert boosting.grow(one.where("false"), trees=2).score(x[:2].astype(float)) == pytest.approx([0.5, 0.5])


def test_steps(spark):
    values = [0, 1, 63, 64, 65, 127, 128, 131, 132, 5000, 123456789, 1 << 40]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(boosting.steps(F.col("v"))).collect()]
    assert got[:10] == [0, 1, 63, 64, 64, 126, 128, 128, 132, 4992] and got == sorted(got) and all(31 * g >= 31 * v - v for g, v in zip(got[:-1], values, strict=False))
