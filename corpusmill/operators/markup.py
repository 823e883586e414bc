"""Elements of pages by selectors, as column expressions that stay in the JVM.

A page is cut into tokens: tags, comments, and texts between them. One fold over its tags keeps the open elements, each with the
parts of selectors that it and its ancestors have met, so that an element is known to match when it opens. Elements that match
are listed as they close. What an element holds is then one slice of that list, and its text one slice of the tokens.

An end tag closes the last open element of its name and all within it; one without such an element is skipped. What is open at
the end of a page closes there. Scripts and styles hold no elements and no text. Comments without an end reach to the page's end.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.repair import bind, references

_VOID = "area base br col embed hr img input link meta source track wbr".split()
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""
_TOKEN = r"""(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*+>.*?(?:</\1\s*+>|\z)|<(?:[!?]|/(?![a-z]))[^>]*+>""" \
    r"""|</?[a-z](?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>|(?:[^<]++|<(?![a-z/!?]))++|<"""
_PART = re.compile(r"([\w-]+|\*)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:([\^*$]?=)[\"']?([^\"'\]]*)[\"']?)?\]")
_OPEN = "array<struct<tag:string,reach:bigint,hits:bigint,at:int,since:int>>"
_DONE = "array<struct<at:int,until:int,since:int,hits:bigint>>"


@dataclass(frozen=True)
class FieldSpec:
    """What a field takes from the elements of a selector: their text, their html, or an attribute; of the first, or joined."""

    selector: str
    attr: str = "text"
    multi: bool = False
    join_with: str = "|"


def _chains(selector: str) -> list[list[str]]:
    return [s.split() for s in selector.split(",") if s.strip()]


def attribute(tag: Column, name: str) -> Column:
    """The first value of an attribute in a start tag, '' for one without a value, null where the tag lacks it."""
    end = r"(?=[\s=/>])"
    other = rf"[\s/]*+(?!{name}{end})[^\s/>][^\s=/>]*+(?:\s*+=\s*+{_VALUE})?+"
    pattern = rf"""(?is)^<[a-z][^\s/>]*+(?:{other})*+[\s/]*+{name}{end}(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+"""
    value = F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)))
    return F.when(F.rlike(tag, F.lit(pattern)), references(value, bare=True))


def _meets(tag: Column, name: Column, part: str) -> Column:
    """Whether a start tag meets one part of a selector, such as a.b[c=d]."""
    tests = []
    for element, cls, ident, attr, how, value in _PART.findall(part):
        if element and element != "*":
            tests.append(name == element.lower())
        if cls or ident:
            may = F.contains(tag, F.lit(cls or ident)) | F.contains(tag, F.lit("&"))
            tests.append(may & (F.rlike(attribute(tag, "class"), F.lit(rf"(?:^|\s){cls}(?:\s|$)")) if cls else attribute(tag, "id") == ident))
        if attr:
            test = {"=": lambda v: v == value, "^=": lambda v: F.startswith(v, F.lit(value)), "*=": lambda v: F.contains(v, F.lit(value)), "$=": lambda v: F.endswith(v, F.lit(value))}
            tests.append(test[how](attribute(tag, attr)) if how else attribute(tag, attr).isNotNull())
    return F.coalesce(reduce(Column.__and__, tests, F.lit(True)), F.lit(False))


def _bits(tests: list[tuple[Column, int]]) -> Column:
    return reduce(Column.bitwiseOR, (F.when(test, F.lit(1 << b).cast("long")).otherwise(F.lit(0).cast("long")) for test, b in tests), F.lit(0).cast("long"))


def _has(bits: Column, b: int) -> Column:
    return bits.bitwiseAND(F.lit(1 << b).cast("long")) != 0


def _elements(tokens: Column, selectors: list[str]) -> Column:
    """(at, until, since, hits) of the elements that match any selector, in the order in which they close.

    at is the start tag's token, until the token that closes the element (at for one that holds nothing), since the number of
    elements listed before it opened, and hits the numbers of the selectors as bits.
    """
    chains = [(k, c) for k, s in enumerate(selectors) for c in _chains(s)]
    parts = list(dict.fromkeys(p for _, c in chains for p in c))
    steps, first = [], []
    for _, chain in chains:
        first.append(len(steps))
        steps += [(parts.index(p), j) for j, p in enumerate(chain[:-1])]
    if max(len(parts), len(steps), len(selectors)) > 62:
        raise ValueError("selectors have more than 62 parts")

    def event(token: Column, at: Column) -> Column:
        name = F.lower(F.regexp_extract(token, r"^</?([A-Za-z][^\s/>]*)", 1))
        single = F.endswith(token, F.lit("/>")) | name.isin(*_VOID, "script", "style")
        kind = F.when(F.startswith(token, F.lit("</")), 1).when(single, 2).otherwise(0)
        met = lambda n: F.when(F.startswith(token, F.lit("</")), F.lit(0).cast("long")).otherwise(_bits([(_meets(token, n, p), b) for b, p in enumerate(parts)]))
        return bind(name, lambda n: F.struct(at.alias("at"), n.alias("tag"), kind.alias("kind"), met(n).alias("met")))

    def opened(state: Column, e: Column) -> Column:
        def placed(above: Column) -> Column:
            reached = _bits([(_has(above, b) | (_has(e["met"], p) & (_has(above, b - 1) if j else F.lit(True))), b) for b, (p, j) in enumerate(steps)])
            hits = _bits([(_has(e["met"], parts.index(c[-1])) & (_has(above, f + len(c) - 2) if len(c) > 1 else F.lit(True)), k) for (k, c), f in zip(chains, first)])
            node = F.struct(e["tag"].alias("tag"), reached.alias("reach"), hits.alias("hits"), e["at"].alias("at"), F.size(state["done"]).alias("since"))
            return bind(node, lambda n: F.when(e["kind"] == 0, F.struct(F.concat(state["open"], F.array(n)).alias("open"), state["done"].alias("done"))).when(n["hits"] == 0, state).otherwise(
                F.struct(state["open"].alias("open"), F.concat(state["done"], F.array(F.struct(n["at"].alias("at"), n["at"].alias("until"), n["since"].alias("since"), n["hits"].alias("hits")))).alias("done"))))

        return bind(F.coalesce(F.get(state["open"], F.size(state["open"]) - 1)["reach"], F.lit(0).cast("long")), placed)

    def listed(nodes: Column, until: Column) -> Column:
        matching = F.filter(F.reverse(nodes), lambda n: n["hits"] != 0)
        return F.transform(matching, lambda n: F.struct(n["at"].alias("at"), until.alias("until"), n["since"].alias("since"), n["hits"].alias("hits")))

    def closed(state: Column, e: Column) -> Column:
        def cut(n: Column) -> Column:
            rest = F.slice(state["open"], F.lit(1), F.size(state["open"]) - n)
            gone = F.slice(state["open"], F.size(state["open"]) - n + 1, n)
            return F.when(n == 0, state).otherwise(F.struct(rest.alias("open"), F.concat(state["done"], listed(gone, e["at"])).alias("done")))

        return bind(F.array_position(F.reverse(state["open"]["tag"]), e["tag"]).cast("int"), cut)

    tags = F.filter(F.transform(tokens, lambda t, i: F.when(F.rlike(t, F.lit("^</?[A-Za-z]")), event(t, i))), lambda e: e.isNotNull())
    start = F.struct(F.array().cast(_OPEN).alias("open"), F.array().cast(_DONE).alias("done"))
    return F.aggregate(tags, start, lambda s, e: F.when(e["kind"] == 1, closed(s, e)).otherwise(opened(s, e)), lambda s: F.concat(s["done"], listed(s["open"], F.size(tokens))))


def _texts(tokens: Column) -> Column:
    """Each token's text, '' for tags and comments."""
    return F.transform(tokens, lambda t: F.when(F.rlike(t, F.lit("^<[A-Za-z/!?]")), "").otherwise(tx.trim_space(references(t, bare=True))))


def _taken(tokens: Column, texts: Column, node: Column, attr: str) -> Column:
    """A node's text, html or attribute, null where it is empty."""
    if attr == "text":
        inside = F.slice(texts, node["at"] + 2, F.greatest(node["until"] - node["at"] - 1, F.lit(0)))
        return tx.nonempty(F.array_join(F.filter(inside, lambda t: t != ""), "\n"))
    tag = F.get(tokens, node["at"])
    if attr == "html":
        end = F.when(node["until"] > node["at"], F.concat(F.lit("</"), F.lower(F.regexp_extract(tag, r"^<([^\s/>]+)", 1)), F.lit(">"))).otherwise("")
        return F.concat(F.array_join(F.slice(tokens, node["at"] + 1, F.greatest(node["until"] - node["at"], F.lit(1))), ""), end)
    return tx.nonempty(attribute(tag, attr))


def _read(html: Column, selectors: list[str], attrs: set[str], use: Callable[[Column, Column, Column], Column]) -> Column:
    """use(tokens, texts, elements), each computed once; texts are null where no attribute asks for them."""
    texts = lambda ts: _texts(ts) if "text" in attrs else F.lit(None).cast("array<string>")
    tokens = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_TOKEN), 0)
    return bind(tokens, lambda ts: bind(texts(ts), lambda xs: bind(_elements(ts, selectors), lambda ns: use(ts, xs, ns))))


def records(html: Column, record: str, fields: dict[str, FieldSpec]) -> Column:
    """An array of the fields of each element that the record selector matches, in page order, without those where all fields
    are empty. Fields are looked for below the element; empty ones are null. A null page has none."""
    selectors = [record, *(spec.selector for spec in fields.values())]

    def field(tokens: Column, texts: Column, inside: Column, k: int, spec: FieldSpec) -> Column:
        found = F.array_sort(F.filter(inside, lambda n: _has(n["hits"], k)))
        if not spec.multi:
            return bind(F.get(found, 0), lambda n: F.when(n.isNotNull(), _taken(tokens, texts, n, spec.attr)))
        return tx.nonempty(F.array_join(F.filter(F.transform(found, lambda n: _taken(tokens, texts, n, spec.attr)), lambda v: v.isNotNull()), spec.join_with))

    def taken(tokens: Column, texts: Column, nodes: Column) -> Column:
        named = lambda inside: F.struct(*(field(tokens, texts, inside, k, spec).alias(name) for k, (name, spec) in enumerate(fields.items(), 1)))
        places = F.filter(F.transform(nodes, lambda n, i: F.when(_has(n["hits"], 0), F.struct(n["at"].alias("at"), n["since"].alias("since"), (i - n["since"]).alias("inside")))), lambda r: r.isNotNull())
        rows = F.transform(F.array_sort(places), lambda r: bind(F.slice(nodes, r["since"] + 1, r["inside"]), named))
        return F.filter(rows, lambda r: reduce(Column.__or__, (r[name].isNotNull() for name in fields)))

    return _read(html, selectors, {spec.attr for spec in fields.values()}, taken)


def values(html: Column, selector: str, attr: str) -> Column:
    """An array of what the elements of a selector have as an attribute, text or html, in page order, without empty ones."""
    taken = lambda ts, xs, ns: F.filter(F.transform(F.array_sort(ns), lambda n: _taken(ts, xs, n, attr)), lambda v: v.isNotNull())
    return _read(html, [selector], {attr}, taken)
