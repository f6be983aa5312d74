r"""Finding and redacting personal data, with DataFrame operations only.

Generators of high recall propose spans, a pattern for each kind: whatever has
an at sign or stands for one, dotted numbers, runs of digits, parted or not, by
length (as cards and as telephone numbers), and long runs of letters and digits
(as secrets: keys, tokens, passwords). Their spans overlap each other and the
base spans, those of a strict pattern with a checksum or range test. Boosted
trees judge every proposed span, base ones too, by its format and by the words
around it; a threshold for each kind selects, and of selected spans that
overlap, the one of the larger margin stays. Base spans are kept in any case,
and what overlaps one is added only if its margin is larger still.

The trees learn from two sources. One is the texts, all of them and all their
proposed spans: a span is right if it meets a base span of its kind or passes its
checksum, or, for a secret, if a name is given its value there (`ASSIGNED`); forms that the base patterns don't
know are left out. The other is a list of examples
made up by rule (`training_examples`), for the spelled-out and spaced-out forms
that texts seldom hold; where spans of texts are more, examples weigh so much
that both sources weigh about the same. Each kind's threshold is the least that is precise
enough on all spans of held-out documents and on held-out examples, each by itself.

Equal rows of features become one with a count, and Spark sums the histograms of
which the trees are grown (`boosting.grow`). The trees run as CASE expressions
inside the plan, so a document's text never leaves the JVM and nothing but those
counts is shuffled.

Positions: splitting a text by a pattern gives the gaps between its matches,
and running sums of gap and match lengths give each match's place. Patterns are
written so that no text makes them slow: repeats are possessive, and a match
may begin inside a run only where the last one ended.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .shared import let, materialise

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans: the base kinds, and one that has no base pattern.
NAMES = (*KINDS, "secret")

BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text holds if it holds a match: spares most texts the pattern.
HINT = {"email": "@", "phone": "+"}

PROPOSED = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9][a-z0-9._%+-]{0,63}+(?:\s{0,2}(?:@|[\[({<]\s?at\s?[\])}>])\s{0,2}[a-z0-9-]{1,63}+(?:(?:\.|\s\.\s|\s?[\[({<]\s?dot\s?[\])}>]\s?|\sdot\s)[a-z0-9-]{1,63}+){0,4}|\sat\s[a-z0-9-]{1,63}+(?:\sdot\s[a-z0-9-]{1,63}+){1,4})",
    "ip": r"(?<![0-9])(?<![0-9]\.)[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|\.|\[dot\])\s?[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[0-9](?:[._/\x20-]{0,3}[0-9]){11,19}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+|00)?\(?[0-9](?:[\x20().-]{0,3}[0-9]){6,16}+(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}",
}
#: A text without this has no proposed span.
PROPOSED_HINT = {"email": r"(?i)@|[\[({<]\s?at\s?[\])}>]|\bat\b[^.]{1,70}\bdot\b", "ip": r"[0-9]\s?(?:\[|\(|\.)", "card": r"[0-9]{2}", "phone": r"[0-9][0-9().\x20-]{3}", "secret": "[0-9]"}

#: Words that stand before a span of a kind, and words that speak against all kinds.
NEAR = {
    "email": r"(?i)e-?mail|contact|write to|reach|reply", "ip": r"(?i)\bip\b|address|host|server|login|client", "card": r"(?i)card|visa|master|amex|payment|account", "phone": r"(?i)phone|\btel\b|call|mobile|\bfax\b|cell|\bsms\b",
    "secret": r"(?i)token|secret|passw|\bpwd\b|api.?key|access.?key|bearer|credential|auth",
}
AGAINST = r"(?i)version|release|\bv\.?\s?$|isbn|order|invoice|serial|\bpage\b|section|\bid\b|price|total|ratio|table|commit|\bmd5\b|\bsha\d*\b|checksum|digest|file|\burl\b|https?:"
#: What stands before a value that a name of a secret is given.
ASSIGNED = r"(?i)(?:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|auth[a-z_]*|bearer)[\x22']?\s{0,3}[=:]\s{0,3}[\x22']?$"

CONTEXT, BLOCK = 24, 128
FEATURES = (
    "kind", "length", "digits", "letters", "spaces", "brackets", "dots", "dashes", "at_sign", "luhn", "small_parts", "near", "near_any", "against", "glued", "zero_start", "same_digit", "plus", "runs", "hexadecimal", "quoted", "distinct",
)


SPANS = "array<struct<kind:int,start:int,end:int,m:string,left:string,right:string>>"
JUDGED = "array<struct<kind:int,start:int,end:int,m:string,margin:double>>"


def _found(text: Column, pattern: str, kind: int) -> Column:
    """The pattern's matches in text: array<struct<kind, start, end, m, left, right>>, code points, end exclusive."""

    def place(s: Column) -> Column:
        # running sums in blocks, so that the work stays in proportion for texts with very many matches
        def with_steps(v: Column) -> Column:
            blocks = F.sequence(F.lit(0), F.size(v["sums"]) - 1)
            add = lambda a, b: a + b

            def block(b: Column) -> Column:
                before = F.aggregate(F.slice(v["sums"], 1, b), F.lit(0), add)

                def item(k: Column) -> Column:
                    at = b * BLOCK + k
                    start = before + F.aggregate(F.slice(v["steps"], b * BLOCK + 1, k), F.lit(0), add) + F.length(F.get(s["gaps"], at))
                    m = F.get(s["hits"], at)
                    return F.struct(
                        F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), m.alias("m"),
                        F.right(F.get(s["gaps"], at), F.lit(CONTEXT)).alias("left"), F.left(F.get(s["gaps"], at + 1), F.lit(CONTEXT)).alias("right"),
                    )

                return F.transform(F.sequence(F.lit(0), F.least(F.lit(BLOCK), F.size(v["steps"]) - b * BLOCK) - 1), item)

            return F.flatten(F.transform(blocks, block))

        steps = F.zip_with(F.slice(s["gaps"], 1, F.size(s["hits"])), s["hits"], lambda g, m: F.length(g) + F.length(m))

        def with_sums(t: Column) -> Column:
            starts = F.sequence(F.lit(1), F.size(t), F.lit(BLOCK))
            return F.transform(starts, lambda i: F.aggregate(F.slice(t, i, BLOCK), F.lit(0), lambda a, b: a + b))

        both = let(steps, lambda t: F.struct(t.alias("steps"), with_sums(t).alias("sums")))
        return let(both, with_steps)

    none = F.array().cast(SPANS)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("gaps")), lambda s: F.when(F.size(s["hits"]) > 0, place(s)).otherwise(none))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes: from the right, every second digit counts double, a sum over 9 less 9."""
    one = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, F.coalesce(c.try_cast("int"), F.lit(0))).otherwise(F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.coalesce(c.try_cast("int"), F.lit(0)))))
    return F.aggregate(one, F.lit(0), lambda a, b: a + b) % 10 == 0


def _small_parts(m: Column) -> Column:
    """Whether every run of digits is at most 255."""
    parts = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    return F.forall(parts, lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) <= 3) & (F.coalesce(q.try_cast("int"), F.lit(0)) <= 255)))


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return _small_parts(m)
    if kind == "card":
        return let(_digits(m), lambda d: F.length(d).between(13, 19) & luhn(d))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _passes(kind: str):
    return lambda c: _valid(kind, c["m"])


def _of_kind(kind: int):
    return lambda c: c["kind"] == kind


def base_spans(text: Column) -> dict[str, Column]:
    none = F.array().cast(SPANS)
    out = {}
    for i, kind in enumerate(KINDS):
        hint = F.contains(text, F.lit(HINT[kind])) if kind in HINT else text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else "[0-9][\\x20-]?[0-9]")
        out[kind] = F.when(hint, F.filter(_found(text, BASE[kind], i), _passes(kind))).otherwise(none)
    return out


def features(kind: Column, m: Column, left: Column, right: Column) -> list[Column]:
    """FEATURES of one candidate, as numbers."""
    count = lambda c: F.length(F.regexp_replace(m, f"[^{c}]", ""))
    yes = lambda c: c.cast("int")
    near = F.element_at(F.array(*[yes(left.rlike(NEAR[k])) for k in NAMES]), kind + 1)
    digits = _digits(m)
    return [
        kind, F.length(m), count("0-9"), count("A-Za-z"), count(r"\s"), count(r"\[\](){}<>"), count("."), count("_/-"), yes(F.contains(m, F.lit("@"))), yes(luhn(digits)), yes(_small_parts(m)),
        near, yes(left.rlike("|".join(x.removeprefix("(?i)") if i else x for i, x in enumerate(NEAR.values())))), yes(left.rlike(AGAINST)), yes(left.rlike("[A-Za-z0-9]$") | right.rlike("^[A-Za-z0-9]")), yes(m.startswith("0")), yes(digits.rlike(r"^([0-9])\1*$")),
        yes(m.startswith("+")), F.regexp_count(m, F.lit("[0-9]+")), yes(m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")), yes(left.rlike("[\"'`]$") & right.rlike("^[\"'`]")), F.size(F.array_distinct(F.split(m, ""))),
    ]


def training_examples(most: int = 4000, seed: int = 7) -> list[tuple[int, str, str, str, int]]:
    """(kind, match, left, right, label), made up by rule: at most `most` of them."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda n: "".join(str(int(d)) for d in rng.integers(0, 10, n))
    name = lambda: "".join(pick(["an", "er", "lo", "mi", "ta", "ri", "so", "ke"]) for _ in range(int(rng.integers(1, 4))))
    filler = lambda: " ".join(name() for _ in range(4))[-CONTEXT:] + " "
    cue = {0: ["email: ", "contact ", "e-mail me at ", "reply to "], 1: ["from ip ", "server address ", "login host ", "client IP: "], 2: ["card ", "visa no. ", "payment card: ", "mastercard "], 3: ["phone: ", "tel ", "call me on ", "mobile "], 4: ["token = ", "api_key: ", "password=", "secret ", "Authorization: Bearer "]}
    bad = {k: ["version ", "order ", "invoice no ", "serial ", "isbn ", "section ", "page ", "release "] for k in range(4)} | {4: ["commit ", "md5 ", "sha256 ", "file ", "checksum: ", "url ", "id "]}
    out = []
    for _ in range(most):
        kind, sep, quote = int(rng.integers(5)), pick([".", "-", " ", " - "]), ""
        if kind == 0:
            at, dot = pick([(" [at] ", " [dot] "), (" (at) ", "."), (" at ", " dot "), (" @ ", " . "), ("[at]", "[dot]"), (" at ", "."), ("@", " . ")])
            m = name() + pick(["", ".", "_"]) + name() + at + name() + dot + pick(["com", "org", "net", "de", "fr"])
            good = rng.random() < 0.9 and (at, dot) != (" at ", ".")
            if not good:
                m = name() + pick([" at ", " @ ", " @", "@"]) + name() + pick([" dot ", " . ", ".", ""]) + pick([name(), ""]) + name()
        elif kind == 1:
            parts = [str(int(x)) for x in rng.integers(0, 256, 4)]
            m, good = pick(["[.]", "(.)", " . ", "[dot]", "."]).join(parts), rng.random() < 0.6
            if not good:
                m = pick([".", ". "]).join(str(int(x)) for x in rng.integers(0, pick([12, 999]), 4))
        elif kind == 2:
            d = num(15)
            check = next(c for c in "0123456789" if sum(sum(divmod(2 * int(x), 10)) if i % 2 else int(x) for i, x in enumerate(reversed(d + c))) % 10 == 0)
            good = rng.random() < 0.5
            d += check if good else pick([c for c in "0123456789" if c != check])
            m = pick([".", "_", "/", "  ", " - ", ""]).join(d[k : k + 4] for k in range(0, 16, 4))
            if not good and rng.random() < 0.3:
                m = pick(["", " ", "."]).join(num(int(rng.integers(3, 5))) for _ in range(int(rng.integers(4, 6))))
        elif kind == 3:
            good = rng.random() < 0.5
            m = pick(["", "001 ", "0044 "]) + pick(["({})", "{}"]).format(num(3)) + sep[:2] + num(3) + sep[:2] + num(4)
            if not good and rng.random() < 0.7:
                m = pick([num(16), num(8), "20" + num(2) + "-0" + num(1) + "-1" + num(1), "20" + num(2) + " - 20" + num(2), num(2) + " " + num(3) + " " + num(3), num(4) + " " + num(4), num(3) + "." + num(3) + "." + num(3)])
        else:
            good = rng.random() < 0.5
            m = "".join(pick(pick(["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"])) for _ in range(int(rng.integers(20, 64))))
            quote = pick(["", '"', "'"])
            if not good and rng.random() < 0.5:
                m = pick(["-", "_", "/"]).join([*(name() for _ in range(int(rng.integers(3, 6)))), num(int(rng.integers(1, 5)))]).ljust(16, "0")
            if not good and rng.random() < 0.3:
                m = num(int(rng.integers(16, 24)))
        left = filler()
        if good and (kind >= 3 or rng.random() < 0.6):
            left = (filler() + pick(cue[kind]))[-CONTEXT:]
        elif not good and rng.random() < 0.6:
            left = (filler() + pick(bad[kind]))[-CONTEXT:]
        out.append((kind, m, left + quote, quote + " " + filler()[: CONTEXT - 1], int(good)))
    return out


def _bar(margin: np.ndarray, y: np.ndarray, n: np.ndarray, precision: float) -> float:
    """The margin from which on spans are selected: halfway between the least that keeps the precision and the next one below, over all margins if none keeps it. A row stands for n spans, y of them right."""
    least = boosting.threshold_at(margin, y, precision, n) if y.any() else np.inf
    if not y.any() or not (margin >= least).any():
        return float(margin.max()) + 1
    below = margin[margin < least]
    return (least + float(below.max())) / 2 if len(below) else -np.inf


def proposals(text: Column) -> Column:
    """All proposed spans of a text, by kind and start: array<struct<kind, start, end, m, left, right>>."""
    none = F.array().cast(SPANS)
    return F.flatten(F.array(*[F.when(text.rlike(PROPOSED_HINT[k]), _found(text, PROPOSED[k], i)).otherwise(none) for i, k in enumerate(NAMES)]))


def labelled_proposals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """kind, m, left, right, y (whether the span is right) and held: all proposed spans of all documents of whose form the base patterns say anything.

    Every fifth document, by the CRC of its id, is held out; a row without id isn't.
    """

    def labelled(text: Column) -> Column:
        def one(base: Column, c: Column) -> Column:
            # a card that stands in a longer run of digits is no base span, and still one by its checksum
            right = F.when(c["kind"] < len(KINDS), _meets(c, base, lambda b: b["kind"] == c["kind"]) | (c["kind"] == KINDS.index("card")) & c["m"].rlike("^[0-9]+$") & _valid("card", c["m"])).otherwise(c["left"].rlike(ASSIGNED))
            # whether the base patterns say anything of the form: they say nothing of spelled-out addresses, of cards parted by other marks, or of telephone numbers without a plus sign
            said = (
                F.when(c["kind"] == 0, c["m"].rlike(r"^\S+@\S+$")).when(c["kind"] == 1, c["m"].rlike("^[0-9.]+$")).when(c["kind"] == 2, ~_valid("card", c["m"]) | _meets(c, base))
                .when(c["kind"] == 3, c["m"].startswith("+") | ~_valid("phone", c["m"])).otherwise(F.lit(True))
            )
            return F.struct(c.alias("c"), right.alias("right"), said.alias("said"))

        base = _in_blocks(F.flatten(F.array(*base_spans(text).values())))
        return let(proposals(text), lambda proposed: F.when(F.size(proposed) > 0, let(base, lambda b: F.transform(proposed, lambda c: one(b, c)))))

    held = (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0) & F.col(id_col).isNotNull()
    spans = docs.where(F.col(text_col).isNotNull()).select(held.alias("held"), F.explode(let(F.col(text_col), labelled)).alias("s"))
    return spans.where("s.right or s.said").select(*[F.col("s")["c"][x].alias(x) for x in ("kind", "m", "left", "right")], F.col("s.right").cast("int").alias("y"), "held")


def _examples(spark: SparkSession, examples: int) -> DataFrame:
    """The examples made by rule, as labelled_proposals has the spans of texts; every fourth is held out."""
    return spark.createDataFrame([(*e, i % 4 == 0) for i, e in enumerate(training_examples(examples))], "kind int, m string, left string, right string, y int, held boolean")


def counted(spans: DataFrame) -> DataFrame:
    """x (`boosting.steps` of FEATURES), y, held, real, and n, the number of spans with these."""
    x = F.array(*[boosting.steps(f) for f in features(*(F.col(c) for c in ("kind", "m", "left", "right")))])
    return spans.select(x.alias("x"), "y", "held", "real").groupBy("x", "y", "held", "real").agg(F.count("*").alias("n"))


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: int = 4000, precision: float = 0.99) -> tuple[boosting.Forest, tuple[float, ...]]:
    """The trees, and the margin from which on spans of each kind are selected (infinite for a kind that nothing is known of)."""
    spans = labelled_proposals(docs, id_col, text_col).withColumn("real", F.lit(True)).union(_examples(docs.sparkSession, examples).withColumn("real", F.lit(False)))
    rows = materialise(counted(spans), "pii-rows").persist()
    try:
        n = {r.real: int(r.n) for r in rows.where("not held").groupBy("real").agg(F.sum("n").alias("n")).collect()}
        weight = max(1, n.get(True, 0) // max(n.get(False, 0), 1))
        forest = boosting.grow(rows.where("not held").select("x", "y", F.when(F.col("real"), F.col("n")).otherwise(F.col("n") * weight).alias("n")), trees=24, depth=3, rate=0.3)
        # a row for each margin, of which there are as many as the trees have, not the texts
        by_margin = rows.where("held").select("real", F.get("x", F.lit(0)).alias("kind"), forest.units().alias("margin"), "y", "n").groupBy("real", "kind", "margin").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("y"))
        real, kind, margin, n, y = (c.to_numpy() for c in by_margin.toArrow().columns)
    finally:
        rows.unpersist()
    bars = []
    for k in range(len(NAMES)):
        own = [(kind == k) & of for of in (real, ~real)]
        bars.append(max([_bar(margin[at] / boosting.UNIT, y[at], n[at], precision) for at in own if at.any()], default=np.inf))
    return forest, tuple(map(float, bars))


def _clash(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _in_blocks(spans: Column) -> Column:
    """Spans in blocks of BLOCK, each with the least start and the greatest end in it; of no spans, an empty block without them."""

    def block(i: Column) -> Column:
        part = F.slice(spans, i, BLOCK)
        return F.struct(F.array_min(F.transform(part, lambda s: s["start"])).alias("start"), F.array_max(F.transform(part, lambda s: s["end"])).alias("end"), part.alias("spans"))

    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(spans), F.lit(1)), F.lit(BLOCK)), block)


def _meets(c: Column, blocks: Column, of: Callable[[Column], Column] | None = None) -> Column:
    """Whether span c overlaps a span of the blocks (of those for which `of` holds): only blocks around it are searched."""
    return F.exists(blocks, lambda b: _clash(b, c) & F.exists(b["spans"], lambda s: _clash(s, c) & (of(s) if of else F.lit(True))))


def strongest(spans: Column) -> Column:
    """Of spans (kind, start, end, m, margin) that overlap, those of the larger margin (ties: the earlier kind, then start).

    A span goes only for one that stays. Spans of one kind don't overlap, so few
    spans are contested; those alone are taken one by one, strongest first.
    """
    ahead = lambda a, b: F.when((a["margin"] > b["margin"]) | ((a["margin"] == b["margin"]) & ((a["kind"] < b["kind"]) | ((a["kind"] == b["kind"]) & (a["start"] < b["start"])))), -1).otherwise(1)
    same = lambda a, b: (a["kind"] == b["kind"]) & (a["start"] == b["start"])

    def chosen(contested: Column) -> Column:
        none = F.filter(contested, lambda c: F.lit(False))
        return F.aggregate(F.array_sort(contested, lambda a, b: F.when(same(a, b), 0).otherwise(ahead(a, b))), none, lambda kept, c: F.when(F.exists(kept, lambda k: _clash(k, c)), kept).otherwise(F.concat(kept, F.array(c))))

    def resolved(blocks: Column) -> Column:
        met = F.transform(spans, lambda c: F.struct(c.alias("c"), _meets(c, blocks, lambda s: ~same(s, c)).alias("met")))
        part = lambda v, yes: F.transform(F.filter(v, lambda x: x["met"] if yes else ~x["met"]), lambda x: x["c"])
        return let(met, lambda v: F.when(F.exists(v, lambda x: x["met"]), F.concat(part(v, False), chosen(part(v, True)))).otherwise(spans))

    return let(_in_blocks(spans), resolved)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), examples: int = 4000, precision: float = 0.99) -> DataFrame:
    """docs' id and the columns in keep, with base and added: arrays of struct<kind, start, end, m>, by kind and start; and n_proposed, the proposed spans by kind.

    A null text is an empty one and has no spans; a null id is kept; repeated rows
    are found in each; an empty table gives an empty result. Texts are searched
    whole. A selected span of the kind of a base span that it overlaps is that
    span, and isn't added. Of other selected spans and base spans that overlap,
    `strongest` says which stay; base spans stay in any case. Columns not named
    are dropped, so they can't clash.
    """
    forest, margins = trained(docs, id_col, text_col, examples, precision)

    def judged(c: Column) -> Column:
        margin = let(F.array(*[f.cast("double") for f in features(c["kind"], c["m"], c["left"], c["right"])]), lambda f: forest.margin_column([F.get(f, i) for i in range(len(FEATURES))]))
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["m"].alias("m"), margin.alias("margin"))

    none = F.array().cast(JUDGED)
    judge = lambda c: F.when(F.size(c) > 0, F.transform(c, judged)).otherwise(none)
    enough = lambda c: c["margin"] >= F.element_at(F.array(*map(F.lit, margins)), c["kind"] + 1)
    # of a base span that is weighed; -1 stands before all kinds, so that it wins a tie
    marked = lambda c: F.struct(F.lit(-1).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["m"].alias("m"), c["margin"].alias("margin"))
    plain = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["m"].alias("m"))

    def weighed(base: Column, selected: Column) -> Column:
        other = let(_in_blocks(base), lambda blocks: F.filter(selected, lambda c: ~_meets(c, blocks, lambda b: b["kind"] == c["kind"])))
        met = lambda o: let(_in_blocks(o), lambda blocks: F.filter(base, lambda b: _meets(b, blocks)))
        return let(other, lambda o: F.when(F.size(o) > 0, F.filter(strongest(F.concat(F.transform(judge(met(o)), marked), o)), lambda c: c["kind"] >= 0)).otherwise(none))

    def chosen(base: Column, selected: Column) -> Column:
        return F.when((F.size(selected) > 0) & (F.size(base) > 0), weighed(base, selected)).when(F.size(selected) > 1, strongest(selected)).otherwise(selected)

    def counted(proposed: Column) -> Column:
        return F.array(*[F.size(F.filter(proposed, _of_kind(i))) for i in range(len(NAMES))])

    def found(text: Column) -> Column:
        both = F.struct(F.flatten(F.array(*base_spans(text).values())).alias("base"), proposals(text).alias("proposed"))
        return let(both, lambda v: F.struct(
            F.transform(v["base"], plain).alias("base"), counted(v["proposed"]).alias("n_proposed"),
            let(F.filter(judge(v["proposed"]), enough), lambda s: F.array_sort(F.transform(chosen(v["base"], s), plain))).alias("added"),
        ))

    # one expression, whose parts are bound to names: a filter on its result repeats it once, not each part in each other
    out = let(F.coalesce(F.col(text_col), F.lit("")), found)
    return docs.select(F.col(id_col).alias("doc_id"), *keep, out.alias("__found")).select("doc_id", *keep, "__found.base", "__found.added", "__found.n_proposed")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, by kind and start."""
    name = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with every span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    df = find_pii(docs.withColumn("__whole", F.coalesce(F.col(text_col), F.lit(""))), id_col, text_col, keep=("__whole",))
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    name = F.array(*map(F.lit, NAMES))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        new = s["start"] >= a["at"]
        gap = F.substr("__whole", a["at"] + 1, s["start"] - a["at"])
        out = F.when(new, F.concat(a["out"], gap, F.lit("["), F.element_at(name, s["kind"] + 1), F.lit("]"))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substr("__whole", a["at"] + 1, F.length("__whole"))))
    return df.select("doc_id", done.alias("text"))


def _one_more_of(kind: int):
    return lambda n, s: n + (s["kind"] == kind).cast("long")


def digest(docs: DataFrame) -> DataFrame:
    """A row per document: counts by kind of the base spans, their SHA-256, all spans, and for the method the number of proposed spans, of added ones and of secrets."""
    df = find_pii(docs)
    counts = [F.aggregate("base", F.lit(0).cast("long"), _one_more_of(i)).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    method = [F.aggregate("n_proposed", F.lit(0).cast("long"), lambda a, b: a + b).alias("n_proposed"), F.size("added").cast("long").alias("n_added"), F.aggregate("added", F.lit(0).cast("long"), _one_more_of(len(KINDS))).alias("n_secret")]
    return df.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"), *method)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(kind, proposed, base, added): how many spans of each kind were proposed, are base spans, and were added, over all documents."""
    df = find_pii(docs, id_col, text_col)
    of = lambda c, i: F.size(F.filter(c, _of_kind(i))).cast("long")
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.get("n_proposed", F.lit(i)).cast("long").alias("proposed"), of("base", i).alias("base"), of("added", i).alias("added")) for i, k in enumerate(NAMES)]))
    return df.select(rows.alias("r")).groupBy("r.kind").agg(*[F.sum(f"r.{c}").alias(c) for c in ("proposed", "base", "added")])
