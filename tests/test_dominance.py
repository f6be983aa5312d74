"""Rounds of local dominance against the serial rules: ties, chains, one hot frame, nulls, repeated rows."""

import random
from collections import Counter

import numpy as np
import pytest

from scanweave.operators import dominance, phases

PEAKS = "y int, x int, py double, px double, intensity double, ord long"


def serial(rows, distance, strict):
    """[(head, members)] of each frame, strongest first."""
    out, frames = [], {}
    for r in rows:
        if r[2] is not None and r[3] is not None:
            frames.setdefault(r[:2], []).append(r)
    for group in frames.values():
        left = sorted(group, key=lambda r: (r[4] is None, -(r[4] or 0), r[5]))
        while left:
            h = left[0]
            near = [r for r in left if r is h or ((r[2] - h[2]) ** 2 + (r[3] - h[3]) ** 2 < distance**2 if strict else (r[2] - h[2]) ** 2 + (r[3] - h[3]) ** 2 <= distance**2)]
            out.append((h, near))
            left = [r for r in left if not any(r is n for n in near)]
    return out


def peaks(kind):
    rng = random.Random(5)
    if kind == "hot":
        return [(0 if i % 3 else i % 7, 0, float(rng.randrange(40)), float(rng.randrange(40)), float(rng.randrange(6)), i) for i in range(900)]
    if kind == "chain":
        return [(0, 0, 0.0, 1.0 * i, 100.0 - i, i) for i in range(14)] + [(0, 1, 0.0, 1.0 * i, 1.0, i) for i in range(14)]
    if kind == "one place":
        return [(0, 0, 3.0, 3.0, float(i % 3), i) for i in range(300)] + [(0, 0, None, 3.0, 9.0, 1000), (None, 0, 3.0, 3.0, None, 1001), (None, 0, 3.5, 3.0, -2.0, 1002)]
    return []


@pytest.mark.parametrize("kind", ["hot", "chain", "one place", "empty"])
@pytest.mark.parametrize("strict", [True, False])
def test_separated_and_merged(spark, kind, strict):
    rows = peaks(kind)
    df = spark.createDataFrame(rows, PEAKS).repartition(3)
    want = serial(rows, 2.0, strict)
    kept = [h[5] for h, _ in want] + [r[5] for r in rows if r[2] is None]
    got = dominance.separated(df, 2.0, strict)
    assert got.columns == df.columns and sorted(r.ord for r in got.collect()) == sorted(kept)
    if not strict:
        spots = {(r.y, r.x, r.ord): r for r in dominance.merged(df, 2.0).collect()}
        assert set(spots) == {(*h[:2], h[5]) for h, _ in want}
        for h, near in want:
            w = [max(r[4] or 0.0, 0.0) for r in near]
            w = w if sum(w) > 0 else [1.0] * len(near)
            r = spots[*h[:2], h[5]]
            assert (r.y, r.x, r.n, r.intensity) == (h[0], h[1], len(near), h[4])
            assert r.py == pytest.approx(sum(a * n[2] for a, n in zip(w, near, strict=True)) / sum(w)) and r.px == pytest.approx(sum(a * n[3] for a, n in zip(w, near, strict=True)) / sum(w))


@pytest.mark.parametrize("kind", ["random", "chain", "hot end", "empty"])
def test_best_pairs(spark, kind):
    rng = random.Random(2)
    rows = {
        "random": [(g, rng.randrange(20), rng.randrange(20), float(rng.randrange(5))) for g in (0, 0, 0, 1, None) for _ in range(120)],
        "chain": [(0, i // 2, (i + 1) // 2, float(i)) for i in range(12)],
        "hot end": [(0, 0, i, 1.0) for i in range(500)] + [(0, i, 0, 1.0) for i in range(1, 500)],
        "empty": [],
    }[kind]
    want = []
    for g in {r[0] for r in rows}:
        a, b = set(), set()
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[3], r[1], r[2])):
            if r[1] not in a and r[2] not in b:
                a.add(r[1])
                b.add(r[2])
                want.append(r)
    df = spark.createDataFrame(rows, "g int, a long, b long, distance double").repartition(3)
    got = dominance.best_pairs(df, ["g"])
    assert got.columns == df.columns and Counter(map(tuple, got.collect())) == Counter(want)


def slow_consensus(rows, radius, share):
    pool = np.array([r[2:4] for r in rows if r[2] is not None])
    at = [r[:2] for r in rows if r[2] is not None]
    near = [np.flatnonzero(((pool - p) ** 2).sum(axis=1) <= radius**2) for p in pool]
    used, out = np.zeros(len(pool), bool), []
    for i in sorted(range(len(pool)), key=lambda i: (-len(near[i]), *pool[i])):
        if not used[i]:
            members = [j for j in near[i] if not used[j]]
            used[members] = True
            n = len({at[j] for j in members})
            if n >= max(2, np.ceil(share * len(set(at)))):
                out.append((*np.median(pool[members], axis=0), n))
    return out


@pytest.mark.parametrize("moved", [0.0, 0.125])
def test_ball_consensus(spark, moved):
    """Spots on any cell's border are whole; false positives and repeated vectors don't count."""
    rng = np.random.default_rng(3)
    spots = [(a * 0.25, b * 0.25) for a in (-2, 0, 2) for b in (-2, 0, 2)]
    rows = [(y, x, float(np.round(gx + moved + rng.normal(0, 0.02), 3)), float(np.round(gy + moved + rng.normal(0, 0.02), 3))) for y in range(4) for x in range(4) for gx, gy in spots if rng.random() < 0.9]
    rows += [(0, 0, 1.7, 1.7)] * 30 + [(y, 0, float(rng.uniform(-1, 1)), float(rng.uniform(-1, 1))) for y in range(4)] + [(1, 1, None, 0.0)] + rows[:5]
    df = spark.createDataFrame(rows, "nav_y int, nav_x int, kx double, ky double").repartition(3)
    got = [(r.gx, r.gy, r.n) for r in phases.ball_consensus(df, 0.1, 0.5).orderBy("ref").collect()]
    want = slow_consensus(rows, 0.1, 0.5)
    assert len(got) == len(want) == 9
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, abs=1e-12)
    assert all(min(np.hypot(g[0] - a - moved, g[1] - b - moved) for a, b in spots) < 0.03 for g in got)
    assert phases.ball_consensus(df.where("false"), 0.1, 0.5).collect() == []
