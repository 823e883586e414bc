"""Personal data: candidates from high-recall generators, scored by gradient-boosted trees, selected by calibrated thresholds.

Base spans are what fixed patterns match and checks confirm; they are always kept. Looser generators of each kind propose
further spans, which may overlap: addresses with 'at' and 'dot' spelled out, numbers in other groupings. A candidate's format
and the words around it become small whole numbers; boosted trees of depth two over them give a margin, a logistic curve
fitted on rows that no tree saw turns it into a probability, and a threshold for each kind, the lowest at which the rows
that no tree saw are right often enough, selects. Of candidates that overlap, the likeliest stays; none overlaps a base span.

Nobody labels candidates: the model learns from all base spans as they stand, rewritten in the generators' forms (1) and the
same with their digits or letters spoilt (0), and from all candidates that no base span confirms (0), which count less where
they look right: they may be what the model is to find.

All of it is column expressions: a text is read once, in one row, for its candidates and their features; each level of a tree
is one aggregation of gradients over the distinct features, as whole multiples of a small step, so that no order of rows
changes a sum; trees become nested conditions.

Edge cases: a null or empty text has no spans. Repeated rows and rows without an id fare alike. Without any base span in the
table nothing is learned and nothing is added; an empty table gives no rows. Positions are code points, ends exclusive.
Columns besides the named ones are carried through; added columns replace columns of the same names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
ROUNDS, RATE, PRECISION = 12, 0.4, 0.95
#: What an unconfirmed candidate that looks right counts as against a row known to be wrong, and the least a branch must weigh.
UNSURE, BRANCH = 0.2, 2.0
#: Steps of a whole in sums of gradients, and decimals of leaves: margins are multiples of a thousandth.
STEPS, DECIMALS = 1 << 24, 3
#: Characters on either side that features see, and of a candidate at most, about.
CONTEXT, LONGEST = 40, 256
#: Places of the order by start within which spans of at most LONGEST characters can overlap: none is shorter than five.
REACH = 300
_BLOCK = 256

#: The base patterns. Loops never give back what they took, and addresses begin where their letters begin or where the last
#: match ended: that changes no match, and keeps long runs of letters or digits from being tried from each of their places.
_BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[ -]?[0-9])++",
    r"\+[0-9][ ().0-9-]+[0-9]",
)
_AT_SIGN, _AT_WORD = r"(?:\s{0,2}@\s{0,2}|\s{0,2}[(\[{<]\s?(?:[Aa][Tt]|@)\s?[)\]}>]\s{0,2})", r"\s[Aa][Tt]\s"
_DOT_SIGN, _DOT_WORD = r"(?:\s?\.\s?|\s{0,2}[(\[{<]\s?(?:[Dd][Oo][Tt]|\.)\s?[)\]}>]\s{0,2})", r"\s[Dd][Oo][Tt]\s"
_LABEL, _GAP = r"[A-Za-z0-9-]{1,30}", r"[ .\-/_\x{00A0}]"
#: Of each generator, its kind and pattern.
_LOOSE = (
    (0, rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+(?:{_AT_SIGN}{_LABEL}(?:(?:{_DOT_SIGN}|{_DOT_WORD}){_LABEL}){{1,4}}|{_AT_WORD}{_LABEL}(?:(?:{_DOT_WORD}|\.){_LABEL}){{1,4}})(?![A-Za-z0-9-])"),
    (1, r"(?<![0-9])[0-9]{1,3}(?:(?:\s?\.\s?|\s?\[\.\]\s?|\s?\(\.\)\s?|\s[Dd][Oo][Tt]\s)[0-9]{1,3}){3}(?![0-9])"),
    (2, rf"(?<![0-9])[0-9](?:{_GAP}{{0,2}}[0-9]){{12,18}}(?![0-9])"),
    (2, rf"(?<![0-9])(?:[0-9]{{13,19}}|[0-9]{{4}}(?:{_GAP}{{1,3}}[0-9]{{4}}){{3}})(?![0-9])"),
    (3, rf"(?<![0-9A-Za-z+])(?:\+\s?|00\s?)?\(?[0-9]{{1,4}}\)?(?:{_GAP}{{1,2}}\(?[0-9]{{1,4}}\)?){{2,6}}(?![0-9A-Za-z])"),
)
#: Words before a span that speak for its kind.
_CUES = (
    r"(?i)\b(?:e-?mails?|mail|contact|write|correo|courriel|kontakt|adresse)\b",
    r"(?i)\b(?:ip|ips|host|hosts|server|address|addr|serveur|servidor)\b",
    r"(?i)\b(?:cards?|visa|mastercard|amex|credit|karte|kreditkarte|carte|tarjeta|payment|cc)\b",
    r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|telefon|handy|teléfono|téléphone|appel|llamar|anrufen)\b",
)
FEATURES = 16
_SPAN = "array<struct<kind: int, start: int, end: int, x: array<int>, m: string, before: string, after: string>>"


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _running(values: Column, use: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """use(total), total(i) being the sum of an array's values up to place i; sums of blocks keep that cheap in long arrays."""
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    blocks = lambda vs: F.transform(F.sequence(F.lit(0), F.floor((F.size(vs) - 1) / _BLOCK).cast("int")), lambda b: add(F.slice(vs, b * _BLOCK + 1, F.lit(_BLOCK))))
    starts = lambda bs: F.transform(bs, lambda _, b: add(F.slice(bs, F.lit(1), b)))
    block = lambda i: F.floor(i / _BLOCK).cast("int")
    total = lambda vs, ss: lambda i: F.get(ss, block(i)) + add(F.slice(vs, block(i) * _BLOCK + 1, i % _BLOCK + 1))
    return _bind(values, lambda vs: _bind(blocks(vs), lambda bs: _bind(starts(bs), lambda ss: use(total(vs, ss)))))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches, one behind the other, as structs (start, end, m, before, after)."""

    def build(ms: Column) -> Column:
        size = lambda ps: F.transform(ms, lambda m, i: F.length(F.get(ps, i)) + F.length(m))
        span = lambda ps, total: F.transform(ms, lambda m, i: F.struct((total(i) - F.length(m)).alias("start"), total(i).alias("end"), m.alias("m"), F.right(F.get(ps, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(ps, i + 1), F.lit(CONTEXT)).alias("after")))
        found = _bind(F.split(text, pattern, -1), lambda ps: _running(size(ps), lambda total: span(ps, total)))
        return F.when(F.size(ms) > 0, found)

    return _bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), build)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether 13 to 19 digits pass the check of card numbers."""
    places = F.reverse(F.filter(F.split(_digits(m), ""), lambda c: c != ""))
    doubled = lambda c, i: F.when(i % 2 == 0, c).when(c > 4, 2 * c - 9).otherwise(2 * c)
    total = F.aggregate(F.transform(places, lambda c, i: doubled(c.cast("int"), i)), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(_digits(m)).between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def _parts_fit(m: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    parts = F.filter(F.split(m, "[^0-9]+"), lambda p: p != "")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: (F.length(part(p)) <= 3) & (F.left(part(p), F.lit(3)).cast("int") <= 255))


#: Whether a match of a kind is confirmed.
CHECKS: tuple[Callable[[Column], Column], ...] = (lambda m: F.lit(True), _parts_fit, luhn, lambda m: F.length(_digits(m)).between(9, 15))


def _plain_email(m: Column) -> Column:
    """An address with its signs in place of words and brackets."""
    m = F.regexp_replace(m, r"\s*[(\[{<]\s?(?:[Aa][Tt]|@)\s?[)\]}>]\s*|\s[Aa][Tt]\s|\s*@\s*", "@")
    return F.regexp_replace(m, r"\s*[(\[{<]\s?(?:[Dd][Oo][Tt]|\.)\s?[)\]}>]\s*|\s[Dd][Oo][Tt]\s|\s*\.\s*", ".")


def features(kind: int, m: Column, before: Column, after: Column) -> Column:
    """Numbers from 0 to 15: format and context of a candidate."""
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern))
    last = F.substring_index(_plain_email(m), ".", -1) if kind == 0 else m
    valid = F.rlike(_plain_email(m), F.lit(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$")) if kind == 0 else CHECKS[kind](m)
    whole = [
        valid.cast("int"),
        count(m, "[0-9]"),
        count(m, "[A-Za-z]"),
        count(m, "[^0-9A-Za-z]"),
        count(m, r"\s"),
        count(m, r"[(\[{<)\]}>]"),
        count(m, "[0-9]+"),
        F.array_max(F.transform(F.regexp_extract_all(F.concat(m, F.lit("0")), F.lit("[0-9]+"), F.lit(0)), lambda g: F.length(g))),
        F.when(F.startswith(m, F.lit("+")), 2).when(F.startswith(m, F.lit("00")), 1).otherwise(0),
        count(m, r"(?i)\s(?:at|dot)\s"),
        count(before, r"[0-9A-Za-z_@#&=/]$"),
        count(after, r"^[0-9A-Za-z_@#&=/]"),
        count(before, _CUES[kind]),
        count(before, "[0-9]") + count(after, "[0-9]"),
        F.length(F.regexp_extract(last, "[A-Za-z]*$", 0)),
        F.floor(F.length(m) / 4),
    ]
    return F.array(*(F.least(F.greatest(v.cast("int"), F.lit(0)), F.lit(15)) for v in whole))


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _near(ordered: Column, i: Column) -> Column:
    """The spans about place i of an order by start that may overlap the one there."""
    return F.slice(ordered, F.greatest(i - REACH, F.lit(0)) + 1, F.lit(2 * REACH + 1))


def _spans(kind: int, found: Column, scored: bool) -> Column:
    """Matches as spans of a kind: with features, or with the words themselves, from which training rows are made."""
    of = lambda s: (features(kind, s["m"], s["before"], s["after"]), *[F.lit(None).cast("string")] * 3) if scored else (F.lit(None).cast("array<int>"), s["m"], s["before"], s["after"])
    names = ("kind", "start", "end", "x", "m", "before", "after")
    out = F.transform(found, lambda s: F.struct(*(v.alias(n) for n, v in zip(names, (F.lit(kind), s["start"], s["end"], *of(s))))))
    return F.coalesce(out.cast(_SPAN), F.array().cast(_SPAN))


def candidates(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, __base and __loose: confirmed spans with their words, and candidates that overlap none of them with
    their features, by start. It is written once."""
    t = F.coalesce(F.col(text), F.lit(""))
    confirmed = lambda k: lambda s: CHECKS[k](s["m"])
    base = F.concat(*(_spans(k, F.filter(matches(t, p), confirmed(k)), False) for k, p in enumerate(_BASE)))
    loose = F.concat(*(_spans(k, matches(t, p), True) for k, p in _LOOSE))

    def clear(both: Column) -> Column:
        long = F.filter(both, lambda b: b["x"].isNull() & (b["end"] - b["start"] > LONGEST))
        taken = lambda ls, s, i: F.exists(ls, lambda b: _overlap(s, b)) | F.exists(_near(both, i), lambda b: b["x"].isNull() & _overlap(s, b))
        again = lambda s, o: (o["kind"] == s["kind"]) & (o["start"] == s["start"]) & (o["end"] == s["end"])
        first = lambda s, i: F.coalesce(~again(s, F.get(both, i - 1)), F.lit(True))  # no more than two generators are of one kind
        return _bind(long, lambda ls: F.filter(both, lambda s, i: s["x"].isNotNull() & first(s, i) & ~taken(ls, s, i)))

    by_start = lambda spans: F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))
    open_spans = lambda b, c: F.when(F.size(c) > 0, _bind(by_start(F.concat(b, c)), clear)).otherwise(c)
    both = _bind(base, lambda b: _bind(loose, lambda c: F.struct(b.alias("b"), open_spans(b, c).alias("c"))))
    out = docs.select(*keep, both.alias("__both")).select(*keep, F.col("__both.b").alias("__base"), F.col("__both.c").alias("__loose"))
    return written(out, "pii-candidates")


def _forms(kind: int, m: Column) -> list[Column]:
    """A confirmed match as it stands and as the generators may meet it."""
    swap = lambda c, *pairs: reduce(lambda v, p: F.replace(v, F.lit(p[0]), F.lit(p[1])), pairs, c)
    if kind == 0:
        return [m, swap(m, ("@", " at "), (".", " dot ")), swap(m, ("@", " (at) "), (".", " (dot) ")), swap(m, ("@", "[at]")), swap(m, ("@", " [at] "), (".", "[dot]")), swap(m, ("@", " @ "))]
    if kind == 1:
        return [m, swap(m, (".", "[.]")), swap(m, (".", "(.)")), swap(m, (".", " . ")), swap(m, (".", " dot "))]
    if kind == 2:
        fours = F.trim(F.regexp_replace(_digits(m), "([0-9]{4})", "$1 "))
        return [m, fours, *(swap(fours, (" ", s)) for s in (".", "/", "_", " - ", " "))]
    national = F.trim(F.regexp_replace(m, r"^\+[0-9]{1,2}", ""))
    return [m, F.concat(F.lit("00"), F.substr(m, F.lit(2))), national, F.regexp_replace(national, "[() -]+", "."), F.regexp_replace(F.trim(F.regexp_replace(national, "[()]", "")), "[ -]+", "/"), F.regexp_replace(m, "[() -]+", " ")]


def _spoilt(kind: int, m: Column) -> Column:
    """A match that can't be what it looks like."""
    if kind == 0:
        return F.regexp_replace(m, r"\.[A-Za-z]+$", ".0")
    if kind == 1:
        return F.regexp_replace(m, "^[0-9]+", "999")
    if kind == 2:
        return F.concat(F.regexp_replace(m, "[0-9]$", ""), ((F.right(_digits(m), F.lit(1)).cast("int") + 1) % 10).cast("string"))
    return F.regexp_replace(m, "[0-9]{3,}[^0-9]*$", "7")


@dataclass(frozen=True)
class Leaf:
    value: float

    def margin(self, x: Column) -> Column:
        return F.lit(self.value)


@dataclass(frozen=True)
class Split:
    feature: int
    most: int
    low: Split | Leaf
    high: Split | Leaf

    def margin(self, x: Column) -> Column:
        return F.when(F.get(x, F.lit(self.feature)) <= self.most, self.low.margin(x)).otherwise(self.high.margin(x))


@dataclass
class Model:
    """Of each kind, trees, the curve (slope, offset) from margins to probabilities, and the probability that selects; None
    where the rows couldn't teach it."""

    trees: dict[int, list[Split | Leaf]]
    curves: dict[int, tuple[float, float]]
    thresholds: dict[int, float | None]

    def margin(self, kind: int, x: Column) -> Column:
        return sum((t.margin(x) for t in self.trees.get(kind, [])), F.lit(0.0))

    def probability(self, kind: Column, x: Column) -> Column:
        out = F.lit(0.0)
        for k, (a, b) in self.curves.items():
            out = F.when(kind == k, 1 / (1 + F.exp(-(a * self.margin(k, x) + b)))).otherwise(out)
        return out

    def selects(self, kind: Column, p: Column) -> Column:
        known = [(kind == k) & (p >= t) for k, t in self.thresholds.items() if t is not None]
        return reduce(lambda a, b: a | b, known, F.lit(False))


def training_rows(found: DataFrame) -> DataFrame:
    """(kind, x, y, held_out, w): distinct features of all base spans and candidates, and the weight of the rows that have them."""
    spans = found.select(F.explode("__base").alias("s")).select("s.*")
    parts = []
    for k in range(len(KINDS)):
        rows = F.array(*(F.struct(f.alias("m"), F.lit(1).alias("y")) for f in _forms(k, F.col("m"))), *(F.struct(f.alias("m"), F.lit(0).alias("y")) for f in _forms(k, _spoilt(k, F.col("m")))))
        each = spans.filter(F.col("kind") == k).select("kind", F.pmod(F.xxhash64("m"), F.lit(3)).alias("fold"), F.explode(rows).alias("r"), "before", "after")
        parts.append(each.select("kind", "fold", "r.y", F.lit(True).alias("sure"), features(k, F.col("r.m"), F.col("before"), F.col("after")).alias("x")))
    loose = found.select(F.explode("__loose").alias("s"))
    parts.append(loose.select("s.kind", F.pmod(F.xxhash64("s.x", "s.start"), F.lit(3)).alias("fold"), F.lit(0).alias("y"), F.lit(False).alias("sure"), "s.x"))
    rows = reduce(DataFrame.unionByName, parts).groupBy("kind", "x", "y", "sure", (F.col("fold") == 0).alias("held_out")).agg(F.count("*").alias("n"))
    weight = F.when(F.col("sure") | (F.get("x", F.lit(0)) == 0), F.col("n")).otherwise(F.col("n") * UNSURE)
    return written(rows.select("kind", "x", "y", "held_out", weight.cast("double").alias("w")), "pii-training")


def _gain(g: float, h: float) -> float:
    return g * g / (h + 1)


def _best(bins: dict[int, dict[int, tuple[float, float]]]) -> tuple[float, int, int] | None:
    """(gain, feature, most) of the best split of one node, from its features' sums of gradients by value."""
    best = None
    for f, values in sorted(bins.items()):
        g, h = (sum(v[k] for v in values.values()) for k in (0, 1))
        low_g = low_h = 0.0
        for v in sorted(values)[:-1]:
            low_g, low_h = low_g + values[v][0], low_h + values[v][1]
            if min(low_h, h - low_h) < BRANCH:
                continue
            gain = round(_gain(low_g, low_h) + _gain(g - low_g, h - low_h) - _gain(g, h), 6)
            if gain > 1e-3 and (best is None or gain > best[0]):
                best = (gain, f, v)
    return best


def _curve(rows: list[tuple[float, int, float]]) -> tuple[float, float]:
    """Slope and offset of the logistic curve over (margin, label, weight), by Newton's method with a slight pull to the
    margins themselves."""
    a, b = 1.0, 0.0
    for _ in range(50):
        ga, gb, haa, hab, hbb = a - 1, b, 1.0, 0.0, 1.0
        for m, y, w in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * m + b))))
            q = w * p * (1 - p)
            ga, gb = ga + w * (p - y) * m, gb + w * (p - y)
            haa, hab, hbb = haa + q * m * m, hab + q * m, hbb + q
        d = haa * hbb - hab * hab
        a, b = a - (ga * hbb - gb * hab) / d, b - (gb * haa - ga * hab) / d
    return a, b


def _threshold(rows: list[tuple[float, int, float]], curve: tuple[float, float], precision: float) -> float | None:
    """The lowest probability from which on the rows are right with at least this share: halfway to what lies below, and a half
    at least."""
    best, right, total = None, 0.0, 0.0
    at: dict[float, list[float]] = {}
    for m, y, w in rows:
        p = round(1 / (1 + math.exp(-max(-30.0, min(30.0, curve[0] * m + curve[1])))), 9)
        at.setdefault(p, [0.0, 0.0])[y] += w
    for p in sorted(at, reverse=True):
        right, total = right + at[p][1], total + sum(at[p])
        if right >= precision * total:
            best = p
    return None if best is None else max(0.5, (best + max((p for p in at if p < best), default=0.0)) / 2)


def train(found: DataFrame, rounds: int = ROUNDS, rate: float = RATE, precision: float = PRECISION) -> Model:
    """Fit the trees of all kinds at once: each level of a tree is one aggregation over at most 2 nodes of each kind."""
    rows = training_rows(found)
    fit = rows.filter("NOT held_out")
    model = Model({k: [] for k in range(len(KINDS))}, {}, {})

    def level(nodes: dict[int, Split | None]) -> dict[tuple[int, int], dict[int, dict[int, tuple[float, float]]]]:
        by_kind = lambda make: reduce(lambda out, k: F.when(F.col("kind") == k, make(k)).otherwise(out), model.trees, F.lit(0.0))
        p = 1 / (1 + F.exp(-by_kind(lambda k: model.margin(k, F.col("x")))))
        node = reduce(lambda out, k: F.when((F.col("kind") == k) & (F.get("x", F.lit(nodes[k].feature)) > nodes[k].most), 1).otherwise(out), (k for k, n in nodes.items() if n), F.lit(0))
        graded = fit.select("kind", "x", "y", "w", p.alias("p"), node.alias("node"))
        steps = lambda c: F.round(c * STEPS).cast("long")
        graded = graded.select("kind", "node", F.posexplode("x").alias("f", "v"), steps(F.col("w") * (F.col("y") - F.col("p"))).alias("g"), steps(F.col("w") * F.col("p") * (1 - F.col("p"))).alias("h"))
        out: dict = {}
        for r in sorted(graded.groupBy("kind", "node", "f", "v").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()):  # at most 2 * 16 * 16 rows a kind
            out.setdefault((r.kind, r.node), {}).setdefault(r.f, {})[r.v] = (r.g / STEPS, r.h / STEPS)
        return out

    for _ in range(rounds):
        top = {key[0]: _best(bins) for key, bins in level({}).items()}
        firsts = {k: Split(b[1], b[2], Leaf(0.0), Leaf(0.0)) for k, b in top.items() if b}
        if not firsts:
            break
        below = level(firsts)
        for k, first in firsts.items():
            sides = []
            for side in (0, 1):
                bins = below[k, side]
                leaf = lambda some: Leaf(round(rate * sum(v[0] for v in some) / (sum(v[1] for v in some) + 1), DECIMALS))
                if b := _best(bins):
                    values = bins[b[1]]
                    sides.append(Split(b[1], b[2], leaf([values[v] for v in values if v <= b[2]]), leaf([values[v] for v in values if v > b[2]])))
                else:
                    sides.append(leaf(list(bins[first.feature].values())))
            model.trees[k].append(Split(first.feature, first.most, *sides))
    kept = [k for k, trees in model.trees.items() if trees]
    margin = reduce(lambda out, k: F.when(F.col("kind") == k, model.margin(k, F.col("x"))).otherwise(out), kept, F.lit(0.0))
    unseen = rows.filter("held_out").groupBy("kind", "y", F.round(margin, DECIMALS).alias("m")).agg(F.round(F.sum("w"), 6).alias("w")).collect()  # at most 1 000 rows for each whole of margin and label
    for k in kept:
        of_kind = sorted((r.m, r.y, r.w) for r in unseen if r.kind == k)
        if {y for _, y, _ in of_kind} == {0, 1}:
            model.curves[k] = _curve(of_kind)
            model.thresholds[k] = _threshold(of_kind, model.curves[k], precision)
    return model


def select(found: DataFrame, model: Model) -> DataFrame:
    """Of candidates(), the columns kept, base and spans: confirmed and selected spans (kind, start, end, p), by kind and start;
    base spans have no p."""
    keep = [c for c in found.columns if c not in ("__base", "__loose")]
    scored = F.transform("__loose", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), model.probability(s["kind"], s["x"]).alias("p")))
    likely = F.filter(scored, lambda s: model.selects(s["kind"], s["p"]))
    better = lambda a, b: (a["p"] > b["p"]) | ((a["p"] == b["p"]) & ((a["kind"] < b["kind"]) | ((a["kind"] == b["kind"]) & (a["start"] < b["start"]))))
    alone = _bind(likely, lambda ls: F.filter(ls, lambda s, i: ~F.exists(_near(ls, i), lambda o: _overlap(s, o) & better(o, s))))
    plain = F.transform("__base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(None).cast("double").alias("p")))
    return found.select(*(c for c in keep if c not in ("base", "spans")), plain.alias("base"), F.array_sort(F.concat(plain, alone)).alias("spans"))


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), **how) -> DataFrame:
    """The columns ``keep``, base and spans of each document; the model is fitted on these documents."""
    found = candidates(docs, text, keep)
    return select(found, train(found, **how))


def as_text(spans: Column) -> Column:
    """'kind:start:end' of spans, comma-joined."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with its spans replaced by their kinds in angle brackets; spans that overlap become one, of the kind of that
    which begins first, the longest of these."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    name = lambda s: F.concat(F.lit("<"), F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), F.lit(">"))
    before = lambda ss, i: F.coalesce(F.array_max(F.transform(F.slice(ss, F.lit(1), i), lambda s: -s["end"])), F.lit(0))
    piece = lambda ss: F.transform(ss, lambda s, i: F.when(s["start"] >= before(ss, i), F.concat(F.substring(text, before(ss, i) + 1, s["start"] - before(ss, i)), name(s))).otherwise(F.lit("")))
    return _bind(ordered, lambda ss: F.concat(F.array_join(piece(ss), ""), F.substring(text, before(ss, F.size(ss)) + 1, F.length(text))))
