"""Each operator against a brute-force version on rows with nulls, empty and very long texts, ties, repeats and clashing columns, and on an empty table."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scanweave.llm import boosting, components, decontam, minhash, mixing, pii, quality, sharding, substring, token_counts, token_output, topk
from scanweave.llm.shared import WordHashes

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
words = lambda t: WORDS.findall(t or "")
bag = lambda rows: Counter(map(tuple, rows))

# 1 personal data ----------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(2 * int(x), 10)) if i % 2 else int(x) for i, x in enumerate(reversed(d))) % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def base_spans(t):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if good(k, m.group())]


PII_TEXTS = [
    "mail a.b@c.de, c_d@e.f_g@h.i and x@y", "ip 1.2.3.4.5 10.0.0.256 001.02.3.4 1.2.3", "card 4111 1111 1111 1111 4111-1111-1111-1112 79927398713 4111111111111111", "call +1 (437) 555-0689 now +12 +49 30 1234567-8 +1234567890123456",
    "é漢🎈 a@b.co 🎈 1.2.3.4", "+1 234 567 89 0+1 234 567 890", "a@b.c@d.e a@b-.c a..b@c..d", "5 4111111111111111 4111 1111  1111 1111", " ", "@@ .. ++ --",
]


def test_pii_base(spark, docs, rows, empty):
    all_rows = [*[(r[0], r[1]) for r in rows], *[(1000 + i, t) for i, t in enumerate(PII_TEXTS)]]
    df = docs.select("doc_id", "text", "base", "added").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(PII_TEXTS)], "doc_id long, text string").withColumns({"base": F.lit(""), "added": F.lit("")}))
    want = Counter()
    for d, t in all_rows:
        s = base_spans(t)
        want[d, *[sum(x[0] == k for x in s) for k in PATTERNS], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest()] += 1
    got = pii.digest(df).collect()
    assert bag([r[:6] for r in got]) == want
    for r in got:  # base spans stay, and all are in order
        kinds = [x.split(":") for x in r.spans.split(",") if x]
        assert len(kinds) == sum(r[1:5]) + r.n_added and kinds == sorted(kinds, key=lambda x: (pii.NAMES.index(x[0]), int(x[1])))
    assert pii.digest(empty).collect() == []


def test_pii_added_and_clean(spark):
    texts = ["contact john.doe [at] example [dot] com please", "reach me at jane at mail dot org today", "phone: (437) 555-0689 is mine", "login host 10[.]0[.]0[.]7 now", "card 4111.1111.1111.1111 paid"]
    clean = ["we met at noon. Then left", "version 1.2.3 of order 1234 5678", "look at the house. It fell at ten", "in 2020 - 2021 there were 12 345 678 of them", "page 12 section 3.4.5"]
    df = spark.createDataFrame(list(enumerate(texts + clean)), "doc_id long, text string")
    got = {r.doc_id: (len(r.base), [x.m for x in r.added]) for r in pii.find_pii(df).collect()}
    assert all(got[i][1] for i in range(4)), got
    assert all(got[len(texts) + i] == (0, []) for i in range(len(clean))), got
    text = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame([(1, "a é b@c.de, +1 (437) 555-0689!"), (2, None)], "doc_id long, text string")).collect()}
    assert text == {1: "a é [email], [phone]!", 2: ""}


def slow_proposals(t):
    """(kind, start, end, left, right) of every proposed span."""
    out = []
    for k, name in enumerate(pii.NAMES):
        end, found = 0, [(m.start(), m.end()) for m in re.finditer(pii.PROPOSED[name], t, re.ASCII)] if re.search(pii.PROPOSED_HINT[name], t, re.ASCII) else []
        for i, (a, b) in enumerate(found):
            out.append((k, a, b, t[end:a][-pii.CONTEXT :], t[b : found[i + 1][0] if i + 1 < len(found) else len(t)][: pii.CONTEXT]))
            end = b
    return out


def slow_features(kind, m, left, right):
    count, d = (lambda c: len(re.findall(c, m))), re.sub("[^0-9]", "", m)
    near = [int(bool(re.search(pii.NEAR[k], left, re.ASCII))) for k in pii.NAMES]
    small = all(len(x) <= 3 and int(x) <= 255 for x in (x.lstrip("0") or "0" for x in re.findall("[0-9]+", m)))
    glued = re.search("[A-Za-z0-9]$", left) or re.search("^[A-Za-z0-9]", right)
    start = [kind, len(m), count("[0-9]"), count("[A-Za-z]"), count(r"[ \t\n\x0b\x0c\r]"), count(r"[\[\](){}<>]"), count("[.]"), count("[_/-]"), "@" in m, luhn(d), small, near[kind], any(near), bool(re.search(pii.AGAINST, left, re.ASCII))]
    quoted = re.search("[\"'`]$", left) and re.search("^[\"'`]", right)
    return [*start, bool(glued), m.startswith("0"), bool(re.fullmatch(r"([0-9])\1*", d)), m.startswith("+"), count("[0-9]+"), bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", m)), bool(quoted), len(set(m))]


def test_pii_added_by_brute_force(spark, docs, rows):
    """All proposed spans judged and weighed one by one, without columns."""
    texts = [(r[0], r[1]) for r in rows] + [(1000 + i, t) for i, t in enumerate(PII_TEXTS)] + [(2000 + i, e[2] + e[1] + e[3]) for i, e in enumerate(pii.training_examples(400, seed=9))]
    df = spark.createDataFrame(texts, "doc_id long, text string").cache()
    forest, bars = pii.trained(df)
    margin = lambda t, k, a, b, left, right: float(forest.margin(np.array([slow_features(k, t[a:b], left, right)], float))[0])
    want, names = {}, list(PATTERNS)
    for doc, t in texts:
        t = t or ""
        base, proposed, selected = base_spans(t), slow_proposals(t), []
        for c in proposed:
            k, a, b = c[:3]
            if not any(names.index(x[0]) == k and x[1] < b and a < x[2] for x in base if k < 4):
                m = margin(t, *c)
                if m >= bars[k]:
                    selected.append((k, a, b, m))
        ends = {k: 0 for k in names}
        weighed, all_found = [], {k: [(m.start(), m.end()) for m in re.finditer(PATTERNS[k], t)] for k in names}
        for k, a, b in base:
            if any(x[1] < b and a < x[2] for x in selected):
                at = all_found[k].index((a, b))
                before, after = all_found[k][at - 1][1] if at else 0, all_found[k][at + 1][0] if at + 1 < len(all_found[k]) else len(t)
                weighed.append((-1, a, b, margin(t, names.index(k), a, b, t[before:a][-pii.CONTEXT :], t[b:after][: pii.CONTEXT])))
        kept = []
        for c in sorted(selected + weighed, key=lambda c: (-c[3], c[0], c[1])):
            if not any(k[1] < c[2] and c[1] < k[2] for k in kept):
                kept.append(c)
        want[doc, t] = sorted(c[:3] for c in kept if c[0] >= 0), Counter(c[0] for c in proposed)
    assert sum(len(x) for x, _ in want.values()) > 100 and {k for x, _ in want.values() for k, _, _ in x} >= set(range(4))
    for r in pii.find_pii(df, keep=("text",)).collect():
        added, proposed = want[r.doc_id, r.text or ""]
        assert [(s["kind"], s["start"], s["end"]) for s in r.added] == added, (r.doc_id, (r.text or "")[:200])
        assert r.n_proposed == [proposed[k] for k in range(5)]


def test_pii_report(spark):
    """On the given documents every kind is proposed, and trees and thresholds decide: secrets are added, numbers without a checksum aren't."""
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.col("text").rlike('[0-9]{13}|@|[Tt]oken = "')).cache()
    got = {r.kind: r for r in pii.report(df).collect()}
    assert set(got) == set(pii.NAMES) and all(r.proposed > 0 for r in got.values()) and got["secret"].added > 0
    assert got["card"].proposed > got["card"].base and got["secret"].proposed > got["secret"].added
    secret, found, wrong = re.compile('(?i)token = "([0-9a-f]{40})"'), [], 0
    for r in pii.find_pii(df, keep=("text",)).collect():
        spans = {(s.start, s.end) for s in r.added if s.kind == 4}
        found += [m.span(1) in spans for m in secret.finditer(r.text)]
        wrong += sum(s.kind == 2 and not luhn(re.sub("[^0-9]", "", s.m)) for s in r.added)
    assert len(found) > 100 and sum(found) >= 0.95 * len(found) and not wrong


def test_pii_strongest(spark):
    """A span goes only for one that stays, also where the one that beats it goes itself, and over more spans than a block holds."""
    rng = random.Random(3)
    groups = [[(0, 0, 9, 1.0), (1, 8, 15, 2.0), (2, 14, 20, 3.0)], [(0, 0, 5, 1.0), (3, 2, 7, 1.0)], [(1, 4, 6, 0.5)]]
    for n in (5, 40, 700):
        spans = []
        for kind in range(4):
            at = 0
            for _ in range(n):
                at += rng.randrange(0, 12)
                end = at + rng.randrange(1, 12)
                spans.append((kind, at, end, rng.choice([0.5, 1.0, rng.random()])))
                at = end
        groups.append(spans)
    kind = "array<struct<kind:int,start:int,end:int,m:string,margin:double>>"
    df = spark.createDataFrame([(i, [(k, a, b, "", m) for k, a, b, m in g]) for i, g in enumerate(groups)], f"i long, loose {kind}")
    for r in df.select("i", pii.strongest(F.col("loose")).alias("s")).collect():
        kept = []
        for c in sorted(groups[r.i], key=lambda c: (-c[3], c[0], c[1])):
            if not any(k[1] < c[2] and c[1] < k[2] for k in kept):
                kept.append(c)
        assert sorted((s.kind, s.start, s.end, s.margin) for s in r.s) == sorted(kept), r.i


# 2 mixing -----------------------------------------------------------------


def targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w, total = {s: weights[i % len(weights)] for i, s in enumerate(names)}, sum(sizes.values())
    full, out = set(), {}
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = {s for s in rest if share[s] > cap * sizes[s]}
        out = {**{s: cap * sizes[s] for s in full}, **share}
        if not over:
            return out
        full |= over


def test_mix(docs, rows, empty):
    got = mixing.mix(docs).collect()
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(words(r[1]))
    want, taken = targets(size), defaultdict(int)
    assert bag([(r.doc_id, r.size) for r in got]) == bag([(r[0], len(words(r[1]))) for r in rows])
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    again = mixing.mix(docs.repartition(7), ranges=5).collect()  # neither partitions nor ranges matter
    assert bag(got) == bag(again)
    assert mixing.mix(empty).collect() == []


# 3 decontamination --------------------------------------------------------


def test_decontamination(spark, docs, empty):
    import random

    rng = random.Random(1)
    items = [(i, " ".join(f"v{rng.randrange(900)}" for _ in range(rng.randrange(8, 50)))) for i in range(40)] + [(40, None), (41, ""), (42, "too short"), (43, "Too, SHORT"), (None, "v1 v2 v3 v4 v5 v6 v7 v8 v9 v10 v11 v12 v13 v14")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("extra"))
    texts, want = [], set()
    for i, t in items[:40]:
        w = t.split()
        if len(w) >= 13:
            for k in range(0, len(w), 8):  # an eighth of the words replaced
                w[k] = f"sub{k}"
        lead = " ".join(f"u{rng.randrange(9000)}" for _ in range(30))
        texts.append((i, lead + " " + " ".join(x + "***" if i % 3 == 0 else x.upper() for x in w) + " " + lead))
        want.add((i, i))
    texts += [(100 + i, " ".join(f"v{rng.randrange(900)}" for _ in range(300))) for i in range(30)] + [(500, None), (501, ""), (None, "clean"), (502, "too short!"), (503, "this is too short")]
    want |= {(502, 42), (502, 43)}
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("item_id", F.lit("extra"))
    got = decontam.overlaps(df, bench).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert found == want, (want - found, found - want)

    # the same by brute force: every alignment of every pair
    hashes = WordHashes()
    brute = set()
    toks = {i: hashes(decontam.tokens((t or "").encode())) for i, t in items}
    for d, t in texts:
        h = hashes(decontam.tokens((t or "").encode()))
        for i, q in toks.items():
            size = min(13, len(q))
            if len(q) < 8:
                brute |= {(d, i)} if len(q) and np.array_equal(h, q) else set()
                continue
            for place in range(-len(q) + size, len(h) - size + 1):
                a, b = max(0, place), min(len(h), place + len(q))
                c = np.concatenate([[0], np.cumsum(h[a:b] == q[a - place : b - place])])
                if b - a >= size and (c[size:] - c[:-size]).max() >= (10 if size == 13 else 0.8 * size):
                    brute.add((d, i))
    assert found == brute
    kept = decontam.clean(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in texts} - {d for d, _ in found}
    assert decontam.overlaps(empty, bench).collect() == [] and decontam.overlaps(docs, bench.where("false")).collect() == []
    assert decontam.clean(docs, bench.where("false")).count() == docs.count()


def test_decontamination_in_blocks(spark, monkeypatch):
    items = [(i, " ".join(f"q{i}_{k}" for k in range(20))) for i in range(9)]
    df = spark.createDataFrame(items, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 60)
    monkeypatch.setattr(decontam, "BLOCKS", 2)
    monkeypatch.setattr(decontam, "LAID_OUT", 50)
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(df, bench).collect()} == {(i, i) for i in range(9)}
    assert decontam.clean(df, bench).count() == 0


@pytest.mark.parametrize("size", range(8, 16))
def test_decontamination_misses_no_substitution(size):
    """Every choice of replaced words: what the rule allows is found, one word more is not."""
    from itertools import combinations

    hashes = WordHashes()
    item = [f"w{k}" for k in range(size)]
    block = decontam.Items([(1, " ".join(item).encode())], hashes)
    window = min(13, size)
    agree = 10 if window == 13 else -(-4 * window // 5)
    for n in range(window - agree + 2):
        cuts = list(combinations(range(size), n))
        texts = [" ".join(["before", *(f"other{k}" if k in cut else w for k, w in enumerate(item)), "after"]).encode() for cut in cuts]
        found = {cuts[t] for t, *_ in block.overlaps(iter(texts), hashes)}
        most = lambda cut: max(window - sum(a <= k < a + window for k in cut) for a in range(size - window + 1))  # noqa: B023, E731
        assert found == {cut for cut in cuts if most(cut) >= agree}


# 4 quality ----------------------------------------------------------------


def test_boosting():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(int)
    f = boosting.fit(x[:2000], y[:2000])
    assert ((f.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.93
    slow = []
    for row in x[:50]:  # walk the trees one by one
        m = f.base
        for t in range(len(f.feature)):
            i = 0
            while i < f.feature.shape[1]:
                i = 2 * i + 1 + int(row[f.feature[t, i]] > f.threshold[t, i])
            m += f.leaf[t, i - f.feature.shape[1]]
        slow.append(m)
    assert np.allclose(f.margin(x[:50]), slow)
    assert boosting.fit(x[:0], y[:0]).score(x[:2]) == pytest.approx([0.5, 0.5])
    assert boosting.threshold_at(np.array([0.9, 0.8, 0.8, 0.1]), np.array([1, 1, 0, 0]), 1.0) == 0.9
    assert boosting.threshold_at(np.array([0.9]), np.array([0]), 0.9) > 1


def test_forest_as_expression(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    f = boosting.fit(x, (x[:, 0] > x[:, 1]).astype(int), trees=5, depth=3)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "p double, q double")
    got = [r[0] for r in df.select(f.margin_column([F.col("p"), F.col("q")])).collect()]
    assert np.allclose(got, f.margin(x))


def test_quality(spark, docs, rows, empty):
    import random

    rng = random.Random(2)
    sane = lambda: " ".join("".join(rng.choice("aeioubcdt") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 200)))
    texts = [(i, sane(), 1) if i % 3 else (i, " ".join(w.upper() + "***" for w in sane().split()), 0) for i in range(600)]
    df = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(t[0], t[2]) for t in texts] + [(None, 1), (5, None), (7, 9)], "doc_id long, quality int").withColumn("text", F.lit("extra"))
    got = {r.doc_id: r for r in quality.classify(df, labels).collect()}
    held = [i for i, _, _ in texts if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [i for i in sorted(got) if got[i].held_out] == held
    assert np.mean([got[i].predicted == texts[i][2] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    out = quality.classify(docs, labels).collect()
    assert bag([(r.doc_id,) for r in out]) == bag([(r[0],) for r in rows])
    assert all(0 <= r.score <= 1 for r in out) and quality.classify(empty, labels).collect() == []
    none = quality.classify(df, labels.where("false")).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]
    kept = quality.accepted(docs, labels.where("false"))
    assert kept.columns == docs.columns and kept.count() == docs.count()
    forest = quality.train(df, labels, max_rows=50)
    again = quality.train(df.repartition(5), labels, max_rows=50)
    assert np.array_equal(forest.leaf, again.leaf)


def slow_statistics(text):
    """The statistics of a text by their definitions, character by character."""
    b = text.encode()
    w = b.split()
    if not w:
        return [0.0] * 20
    n, size, odd = len(w), len(b), b"#*$%&!|~^<>{}[]\\/=_@+"
    share = lambda chars: sum(c in chars for c in b)
    upper, lower = share(range(65, 91)), share(range(97, 123))
    runs = [len(list(g)) - 1 for _, g in itertools.groupby(w)]
    lines = [x for x in b.split(b"\n") if x]
    ends = [x[-1] in odd for x in w]
    return [
        np.log1p(size), np.log1p(n), (size - n) / n, upper / max(1, upper + lower), share(b"0123456789") / size, share(odd) / size, share(b".,;:?") / size, share(range(128, 256)) / size, sum(ends) / n, len(set(w)) / n,
        max(w.count(x) for x in set(w)) / n, sum(runs) / n, max(runs) / n, 1 - len(set(lines)) / max(1, len(lines)), len({tuple(w[i : i + 3]) for i in range(n - 2)}) / max(1, n - 2), n / max(1, len(lines)),
        sum(e and len(x) == 1 for e, x in zip(ends, w, strict=True)) / n, sum(65 <= x[0] <= 90 for x in w) / n, np.log1p(max(map(len, w))), sum(x.isupper() for x in w) / n,
    ]


def test_statistics(rows):
    for t in [r[1] or "" for r in rows if r[0] not in (200, 201)] + ["A B B B c*\nA B B B c*\n\n# 12.5 É", "x", "* * *", "a\x0bb"]:
        assert quality.statistics(t.encode()) == pytest.approx(slow_statistics(t)), t[:80]


# 5 token counts -----------------------------------------------------------


def test_token_counts(docs, rows, empty):
    path, tok = public_tokenizers.path("byte_bpe_50k.tiktoken"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    got = token_counts.by_section(docs, path, public_tokenizers.PATTERN).collect()
    want = Counter()
    for d, t in {(r[0], r[1]) for r in rows if r[0] != 200}:
        t = t or ""
        lines = re.findall(r"[^\n]*\n|[^\n]+", t) or [""]
        bounds = np.cumsum([0, *map(len, lines)])
        e = tok.encode(t, add_special_tokens=False)
        count = [0] * len(lines)
        for a, b in e.offsets:
            held = [min(b, bounds[i + 1]) - max(a, bounds[i]) for i in range(len(lines))]
            count[int(np.argmax(held))] += 1
        for i, n in enumerate(count):
            want[d, i, int(bounds[i]), int(bounds[i + 1]), n, len(e.ids)] += 1
    assert {(r.doc_id, r.section, r.char_start, r.char_end, r.n_tokens, r.doc_tokens) for r in got if r.doc_id != 200} == set(want)
    total = defaultdict(int)
    for r in got:
        if r.doc_id == 200:
            total[r.doc_tokens] += r.n_tokens
    assert all(v % k == 0 for k, v in total.items())
    assert token_counts.by_section(empty, path, public_tokenizers.PATTERN).collect() == []


def test_crossing_tokens():
    bounds = np.array([0, 3, 10, 12])
    section, crossing = token_counts.attribute(np.array([0, 2, 1, 2, 9]), np.array([2, 4, 5, 12, 12]), bounds)
    assert section.tolist() == [0, 0, 0, 1, 2] and crossing.tolist() == [False, True, True, True, True]


# 6 repeated passages ------------------------------------------------------


def test_cover_aligns():
    for i in range(7):
        for j in range(7):
            assert any((i + k) % 7 in substring.COVER and (j + k) % 7 in substring.COVER for k in range(7))
    assert substring.PERIOD + substring.ANCHOR - 1 == substring.WINDOW


@pytest.mark.parametrize("low, high, wide", [(0, 50, 1), (-(10**5), 10**6, 2), (0, 2**31, 4), (-(2**62), 2**62, 8)])
def test_pieces_keep_documents(low, high, wide):
    rng = np.random.default_rng(3)
    docs, keys = rng.integers(low, high, 1000), rng.integers(0, 2**63, (1000, 2)).astype(np.uint64)
    pieces = list(substring._dealt(keys, docs, keys[:, 0], 7))
    assert {len(docs_) * 16 // len(keys_) for _, keys_, _, docs_ in pieces} == {wide}
    k, d = substring._entries(iter([substring._batch(pieces, substring.SHARES)]), 2)
    assert bag(zip(*k.T.tolist(), d.tolist(), strict=True)) == bag(zip(*keys.T.tolist(), docs.tolist(), strict=True))


def kept_words(texts):
    """doc -> words that stay, by comparing all windows."""
    first = {}
    for d, t in texts:
        w = words(t)
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in texts:
        w = words(t)
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone |= set(range(i, i + 13))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("unique", [True, False])
def test_substring(docs, rows, empty, unique, monkeypatch):
    monkeypatch.setattr(substring, "FLUSH", 500)
    mine = [(r[0], r[1]) for r in rows if r[0] is not None]
    if unique:
        seen = {}
        for d, t in mine:
            seen.setdefault(d, t)
        mine = list(seen.items())
        df = docs.sparkSession.createDataFrame(mine, "doc_id long, text string")
        assert bag(substring.remove_repeats(df).collect()) == bag(kept_words(mine))
        return
    got = substring.remove_repeats(docs, with_text=True).collect()
    want = kept_words(mine) + [(r[0], len(words(r[1])), 0, hashlib.sha256(" ".join(words(r[1])).encode()).hexdigest()) for r in rows if r[0] is None]
    assert bag([r[:4] for r in got]) == bag(want)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert substring.remove_repeats(empty).collect() == []


# 7 near duplicates --------------------------------------------------------


def shingles(t):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(t)]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_classes(texts):
    sets, root = [(d, shingles(t)) for d, t in texts], {d: d for d, _ in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    index = defaultdict(set)
    for i, (_, s) in enumerate(sets):
        for x in s:
            index[x].add(i)
    for i, (d, s) in enumerate(sets):
        for j, n in Counter(j for x in s for j in index[x] if j < i).items():
            e, r = sets[j]
            if 100 * n >= 75 * (len(s) + len(r) - n):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return [(d, len(s), find(d), find(d) == d) for d, s in sets]


def test_minhash(docs, rows, empty):
    mine = [(r[0], r[1]) for r in rows if r[0] is not None]
    got = minhash.near_duplicates(docs).collect()
    assert bag(r for r in got if r.doc_id is not None) == bag(near_classes(mine))
    assert [tuple(r) for r in got if r.doc_id is None] == [(None, len(shingles(rows[0][1])), None, True)]
    assert minhash.near_duplicates(empty).collect() == []


def test_minhash_large_buckets(spark, monkeypatch):
    """Many near copies of one text, links in chains and members apart: the way for large buckets finds the same classes as brute force."""
    import random

    monkeypatch.setattr(minhash, "SMALL_BUCKET", 4)
    monkeypatch.setattr(minhash, "TILE", 16)
    rng = random.Random(3)
    base = [f"b{rng.randrange(9999)}" for _ in range(150)]
    texts = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(0, 14)):
            w[rng.randrange(150)] = f"z{rng.randrange(99999)}"
        texts.append((i, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert bag(got) == bag(near_classes(texts))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    a, b = pool[:1000], pool[200:1200]
    sig = minhash.signatures([np.sort(a), np.sort(b)])
    assert (sig[0] == sig[1]).mean() == pytest.approx(800 / 1200, abs=0.12)
    keys = minhash.band_keys(sig)
    assert keys.shape == (2, minhash.BANDS) and len(np.unique(keys[0])) == minhash.BANDS


def test_components(spark):
    import random

    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(50)] + [(7, 7), (None, 3), (3, 4)] + [(500, 500 + i) for i in range(1, 80)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {**{x: x for x in root if find(x) == x}, **got} == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# 8 exact search -----------------------------------------------------------


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "VECTORS", 16)
    rng = np.random.default_rng(1)
    vec = [(i, [float(x) if rng.random() < 0.5 else 0.0 for x in rng.normal(size=6)]) for i in range(90)]
    vec += [(100 + i, [1.0, 0.5, 0.0, 0.0, 0.0, 0.25]) for i in range(40)]  # ties
    bad = [(300, None), (320, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (340, [float("nan")] * 6), (360, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(vec + bad, "vec_id long, embedding array<double>").withColumn("v", F.lit("extra")).withColumn("score", F.lit("extra")).repartition(3)
    got = topk.top_k(topk.integer_vectors(df, "vec_id", "embedding"), F.col("vec_id") % 20 == 0, 20).collect()
    ints = {i: np.floor(64 * np.array(v)).astype(int) for i, v in vec}
    want = []
    for q in ints:
        if q % 20 == 0:
            best = sorted((-int(ints[q] @ ints[c]), c) for c in ints if c != q)[:20]
            want += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    assert bag(got) == bag(want)
    few = topk.top_k(topk.integer_vectors(df.where("vec_id < 3 OR vec_id = 20"), "vec_id", "embedding"), F.col("vec_id") == 20, 20)
    assert few.count() == 3
    assert topk.top_k(topk.integer_vectors(df.where("false"), "vec_id", "embedding"), F.col("vec_id") == 20).collect() == []


@pytest.mark.parametrize("copies", [3, 30])
def test_topk_of_a_repeated_query(spark, copies):
    rows = [(20, [9, 9])] * copies + [(100 + i, [i % 7, 1]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").coalesce(1)
    got = topk.top_k(df, F.col("vec_id") == 20, 20).collect()
    want = sorted((-9 * (v[0] + v[1]), i) for i, v in rows[copies:])[:20]
    assert bag(got) == bag((20, r, i, -s) for r, (s, i) in enumerate(want, 1))


# 9 token files ------------------------------------------------------------


def test_repair_round_trip():
    rng = np.random.default_rng(0)
    for ids in (rng.integers(0, 49408, 5000), np.tile([1, 2, 3, 4], 3000), np.zeros(1000, int), np.array([5]), np.zeros(0, int), rng.choice([0, 1, 2], 4000)):
        rules, seq = token_output.compress(ids, 49408)
        assert np.array_equal(token_output.expand(seq, rules, 49408), ids)
        assert token_output.lengths(rules, 49408)[seq].sum() == len(ids)
        # no pair is left that is frequent (of a run of one symbol every second pair can be replaced)
        left = Counter(zip(seq[:-1].tolist(), seq[1:].tolist(), strict=True))
        assert all(n < token_output.FREQUENT for (a, b), n in left.items() if a != b) and all(n < 2 * token_output.FREQUENT for (a, b), n in left.items() if a == b)
    assert len(token_output.compress(np.tile([1, 2, 3, 4], 3000), 49408)[1]) < 20


def test_shard_random_access():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 1, 500, 40, 1, 2000])
    ids = rng.choice(50, sizes.sum())
    s = token_output.Shard(token_output.pack([5, None, 7, 8, 9, 10], sizes, ids, 60))
    ends = np.cumsum(sizes)
    for k in range(6):
        assert np.array_equal(s.document(k), ids[ends[k] - sizes[k] : ends[k]])
    for a, b in rng.integers(0, len(ids), (50, 2)):
        assert np.array_equal(s.ids(min(a, b), max(a, b)), ids[min(a, b) : max(a, b)])
    assert s.doc_ids == [5, None, 7, 8, 9, 10]
    with pytest.raises(ValueError):
        token_output.Shard(b"nonsense")


def test_token_files(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(token_output, "SHARD_IDS", 2000)
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    order = sorted(((r[0] if r[0] is not None else -1, [*tok.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows), key=lambda x: (x[0], np.array(x[1], "<u2").tobytes()))
    want, at = [], 0
    for d, ids in order:
        want.append((None if d < 0 else d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert bag(token_output.digests(token_output.write(docs, path)).collect()) == bag(want)
    assert token_output.digests(token_output.write(empty, path)).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_files_of_any_vocabulary(spark, tmp_path, name):
    """A vocabulary that splits otherwise, and ids beyond two bytes."""
    import json

    path = f"{tmp_path}/wide.json"
    said = json.load(open(public_tokenizers.path(name), encoding="utf-8"))
    said["added_tokens"] = [{**(said["added_tokens"] or [{}])[0], "id": 70_000, "content": "zebra", "special": True, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False}]
    json.dump(said, open(path, "w", encoding="utf-8"))
    tok = Tokenizer.from_file(path)
    texts = ["Hello zebra, it's 12 o'clock", "two  spaces\n", None, "naïve ZEBRA zebra " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [[*tok.encode(t or "", add_special_tokens=False).ids, 3] for t in texts]
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_output.digests(token_output.write(df, path, end_id=3)).collect()}
    assert got == {i: (len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for i, w in enumerate(want)}


def test_pieces_encode_like_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(path), token_output.TextEncoder(path, most=8)
    for t in ["Hello  WORLD it's don't", "a b c\u0085d", "<|endoftext|> x<|startoftext|>Y <|ENDOFTEXT|>", "é é ́x ΑΣ ΟΔΟΣ. ǅ İ", "漢字🎈 12.5% [x] {y}", "\x1c \x1d a\x00b", "", " \t\n", "'S 'Re 'll don't", "ÀÉß÷ÿ naïve façade ªº²", "word***,x9y\tz", "e\u0301 \xa0 x", "ñandú!! 12ab"]:
        assert own(t.encode()).tolist() == tok.encode(t, add_special_tokens=False).ids, t


# 10 sharding --------------------------------------------------------------


def test_shard(docs, rows, empty):
    got = sharding.shard(docs, 5).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert bag([(r.doc_id, r.size, r.text_crc32) for r in got]) == bag([(r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows])
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(5)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.shard(docs.repartition(9), 5).collect()
    assert bag([(r.doc_id, r.shard, r.text_crc32) for r in got]) == bag([(r.doc_id, r.shard, r.text_crc32) for r in again])
    assert sharding.shard(empty, 5).collect() == []
    assert sharding.shard(docs, None, target_bytes=10**9).select("shard").distinct().count() == 1


def test_shards_are_near_equal(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "x" * int(rng.integers(10, 500)), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(4000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 40)
    sums = [r.b for r in got.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == 40 and max(sums) < 1.1 * min(sums)
    # a k-d tree: each source but the hot one lies in few shards
    few = got.join(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "doc_id").groupBy("source").agg(F.count_distinct("shard").alias("n")).where("source <> 'hot'")
    assert max(r.n for r in few.collect()) < 20


def brute_tree(points, shards):
    """index -> shard of (keys, size) points: each node's keys sorted along its widest dimension and cut at the exact weighted quantile."""
    out, span = {}, lambda at, d: max(points[i][0][d] >> 32 for i in at) - min(points[i][0][d] >> 32 for i in at)
    root = [max(1, span(range(len(points)), d)) for d in range(4)]

    def cut(at, first, leaves):
        if leaves == 1 or not at:
            out.update((i, first) for i in at)
            return
        d = max(range(4), key=lambda d: (span(at, d) / root[d], -d))
        goal, before = sum(points[i][1] for i in at) * (leaves // 2) / leaves, 0
        for key in sorted({points[i][0][d] for i in at}):
            size = sum(points[i][1] for i in at if points[i][0][d] == key)
            if before + size >= goal:
                break
            before += size
        border = key + 1 if before + size - goal < goal - before else key
        half = leaves // 2
        cut([i for i in at if points[i][0][d] < border], first, half)
        cut([i for i in at if points[i][0][d] >= border], first + half, leaves - half)

    cut(list(range(len(points))), 0, shards)
    return out


@pytest.mark.parametrize("most", [256, 3])
def test_shards_are_those_of_the_tree(spark, monkeypatch, most):
    monkeypatch.setattr(sharding, "MOST_LEAVES", most)
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 900)), "y" * int(rng.integers(0, 300)), ["en", "de", None][i % 3], "hot" if i % 2 else f"s{i % 5}") for i in range(300)] + [(1, "same", "en", "hot")] * 9 + [(None, None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    raw = sharding._points(df, "doc_id", "text", "source", "lang").collect()
    lo, hi, top = min(r.raw_id for r in raw), max(r.raw_id for r in raw), (1 << 30) - 1
    points = [([(v << 32) + r.low for v in (r.v0, r.v1, r.v2, min(max(int((float(r.raw_id) - lo) * (top / max(1.0, hi - lo))), 0), top))], r.size) for r in raw]
    want = Counter((raw[i].doc_id, raw[i].size, raw[i].text_crc32, s) for i, s in brute_tree(points, 13).items())
    got = sharding.shard(df, 13, closeness=0.0).collect()
    assert bag([(r.doc_id, r.size, r.text_crc32, r.shard) for r in got]) == want
