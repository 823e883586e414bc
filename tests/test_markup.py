"""Records of pages by column expressions against a plain tree of each page."""

import random
from html.parser import HTMLParser

import pytest
from corpusmill.operators import markup, pages
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string"
VOID = "area base br col embed hr img input link meta source track wbr".split()
BITS = """<div>|</div>|<p class='a b'>|<p class=b>|</p>|<br>|<br/>|<a href="x&amp;y" id=k>|</a>|<span data-k='1' CLASS="a">|</SPAN>|<!-- c <p> -->|<script>var a='<p>';</script>|text |&lt;p&gt;| &eacute &notit; &#65;&#x42 &nope; |
|é|<td a=1 b>|<img class=a src=q>|<div/>|<li class=b>|& b|<p title=it's>""".split("|")
SPECS = {
    "t": pages.FieldSpec("p"),
    "m": pages.FieldSpec(".a, .b", "text", True),
    "h": pages.FieldSpec("div span a, p .b", "href", True),
    "k": pages.FieldSpec("[data-k]", "class"),
    "i": pages.FieldSpec("div .a", "src"),
}


class Tree(HTMLParser):
    """Each node is [tag, attributes, parent, children]; nodes in page order."""

    def __init__(self, html):
        super().__init__()
        self.nodes, self.at = [], ["", {}, None, []]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, {k: v or "" for k, v in attrs}, self.at, []]
        self.at[3].append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node[2] and node[0] != tag:
            node = node[2]
        self.at = node[2] or self.at

    def handle_data(self, data):
        self.at[3].append(data)


def meets(node, part):
    tag, attrs = node[0], node[1]
    if part.startswith("["):
        return part[1:-1] in attrs
    name, _, cls = part.partition(".")
    return name in ("", tag) and (not cls or cls in attrs.get("class", "").split())


def matches(node, selector):
    def one(chain):
        rest, up = chain[:-1], node[2]
        while rest and up:
            if meets(up, rest[-1]):
                rest = rest[:-1]
            up = up[2]
        return not rest and meets(node, chain[-1])

    return any(one(c.split()) for c in selector.split(","))


def within(node, root):
    while node := node[2]:
        if node is root:
            return True
    return False


def text(node):
    return "\n".join(t for c in node[3] if (t := c.strip() if isinstance(c, str) else "" if c[0] in ("script", "style") else text(c)))


def plain(html, record):
    tree = Tree(html)
    rows = []
    for root in (n for n in tree.nodes if matches(n, record)):
        row = []
        for spec in SPECS.values():
            found = [n for n in tree.nodes if within(n, root) and matches(n, spec.selector)]
            values = [text(n) if spec.attr == "text" else n[1].get(spec.attr) for n in (found if spec.multi else found[:1])]
            row.append(spec.join_with.join(v for v in values if v) or None)
        if any(row):
            rows.append(tuple(row))
    return rows


@pytest.mark.parametrize("record", ["div", "p.b", "div p, span"])
def test_records_are_those_of_a_plain_tree(spark, record):
    """Elements without ends, ends without elements, crossing ones, references of all kinds."""
    pick = random.Random(record)
    rows = [(i, "u", "".join(pick.choice(BITS) for _ in range(pick.randint(0, 40)))) for i in range(300)]
    got = {}
    for r in pages.extract_records(spark.createDataFrame(rows, SCHEMA), record, SPECS).orderBy("page_id", "record_no").collect():
        got.setdefault(r.page_id, []).append(tuple(r[f] for f in SPECS))
    assert sum(map(len, got.values())) > 100
    for i, _, html in rows:
        assert got.get(i, []) == plain(html, record), html


def test_odd_pages(spark):
    """Null and empty pages, no markup, what never ends, deep nesting, and a long text between two tags."""
    long = "x " * 500_000
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "a < b"), (4, "u", "<p>a<!-- b</p>"), (5, "u", "<p>a<b"), (6, "u", "<p>" * 500 + "a"), (7, "u", f"<p title='{long}'>{long}</p>")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", record_no string")
    got = {(r.page_id, r.record_no): r.t for r in pages.extract_records(frame, "p", {"t": pages.FieldSpec("p")}).collect()}
    assert len(got) == 499 and set(got.values()) == {"a"}
    whole = frame.select("page_id", F.explode(markup.values(F.col("html"), "p", "text")).alias("t")).filter("page_id <> 6").collect()
    assert {r.page_id: r.t for r in whole} == {4: "a", 5: "a\n<\nb", 7: long.strip()}


def test_more_than_62_parts_are_refused():
    with pytest.raises(ValueError):
        markup.values(F.lit(""), ", ".join(f".c{k}" for k in range(63)), "text")
