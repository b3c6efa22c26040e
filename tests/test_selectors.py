"""Selectors against a plain matcher over a materialised tree."""

import random

import pytest

from weblens.functions import dom
from weblens.functions.selectors import Matcher
from weblens.operators import navigation as nav

TAGS = ["div", "ul", "span", "section", "em"]


def tree(page):
    """Every element with its parent, as the walk sees them: (node, parent, place among siblings)."""
    nodes = dom.select(page, lambda n, _: True)
    parents = {id(n): n.around.node for n in nodes}
    children = {}
    for n in nodes:
        children.setdefault(id(parents[id(n)]), []).append(n)
    return nodes, parents, children


class Plain:
    """Selectors as nested tuples, matched by looking at the whole tree."""

    def __init__(self, page):
        self.nodes, self.parents, self.children = tree(page)

    def siblings(self, n):
        return self.children[id(self.parents[id(n)])] if id(n) in self.parents else [n]

    def place(self, n, of_type=False):
        same = [s for s in self.siblings(n) if not of_type or s.tag == n.tag]
        return 1 + next(i for i, s in enumerate(same) if s is n)

    def simple(self, n, test):
        kind, *rest = test
        get = n.attributes.get
        if kind == "tag":
            return n.tag == rest[0]
        if kind == "any":
            return True
        if kind == "class":
            return rest[0] in get("class", "").split()
        if kind == "id":
            return get("id") == rest[0]
        if kind == "attr":
            name, op, value = rest
            own = get(name)
            if own is None:
                return False
            return {
                "": True, "=": own == value, "~=": value in own.split(), "|=": own == value or own.startswith(value + "-"),
                "^=": bool(value) and own.startswith(value), "$=": bool(value) and own.endswith(value), "*=": bool(value) and value in own,
            }[op]
        if kind == "not":
            return not self.complex(n, rest[0])
        if kind == "is":
            return any(self.complex(n, c) for c in rest[0])
        root = id(n) not in self.parents
        if kind == "first":
            return not root and self.place(n) == 1
        a, b, of_type = rest
        place = self.place(n, of_type)
        return not root and any(a * k + b == place for k in range(0, 200))

    def complex(self, n, steps):
        """steps: [(combinator, [simple, ...]), ...], the first combinator None."""
        combinator, tests = steps[-1]
        if not all(self.simple(n, t) for t in tests):
            return False
        if combinator is None:
            return True
        rest, parent = steps[:-1], self.parents.get(id(n))
        if combinator == ">":
            return parent is not None and self.complex(parent, rest)
        if combinator == " ":
            while parent is not None:
                if self.complex(parent, rest):
                    return True
                parent = self.parents.get(id(parent))
            return False
        before = self.siblings(n)[: self.place(n) - 1]
        return any(self.complex(s, rest) for s in (before[-1:] if combinator == "+" else before))


def random_page(draw, depth=0):
    out = []
    for _ in range(draw.randint(0, 4 if depth < 4 else 0)):
        tag = draw.choice(TAGS)
        attributes = ""
        if draw.random() < 0.5:
            attributes += f' class="{" ".join(draw.choice("abc") for _ in range(draw.randint(1, 2)))}"'
        if draw.random() < 0.3:
            attributes += f' id="{draw.choice("xy")}"'
        if draw.random() < 0.4:
            attributes += f' data-k="{draw.choice(["en", "en-GB", "a en", "", "zen"])}"'
        out.append(f"<{tag}{attributes}>t{random_page(draw, depth + 1)}</{tag}>")
    return "".join(out)


def random_simple(draw, level):
    kind = draw.choice(["class", "id", "attr", "first", "nth", "not", "is"] if level < 2 else ["class", "attr", "nth"])
    if kind == "class":
        c = draw.choice("abc")
        return ("class", c), f".{c}"
    if kind == "id":
        i = draw.choice("xy")
        return ("id", i), f"#{i}"
    if kind == "attr":
        op, value = draw.choice(["", "=", "~=", "|=", "^=", "$=", "*="]), draw.choice(["en", "e", "GB", "a en", "n"])
        return ("attr", "data-k", op, value), f'[data-k{op}"{value}"]' if op else "[data-k]"
    if kind == "first":
        return ("first",), ":first-child"
    if kind == "nth":
        a, b, of_type = draw.randint(-2, 3), draw.randint(-1, 3), draw.random() < 0.5
        name = "nth-of-type" if of_type else "nth-child"
        return ("nth", a, b, of_type), f":{name}({a}n{b:+d})" if a else f":{name}({b})"
    if kind == "not":
        steps, text = random_complex(draw, level + 1)
        return ("not", steps), f":not({text})"
    some = [random_complex(draw, level + 1) for _ in range(draw.randint(1, 2))]
    return ("is", [s for s, _ in some]), f":is({' , '.join(t for _, t in some)})"


def random_complex(draw, level=0):
    steps, text = [], ""
    for n in range(draw.randint(1, 3 - level)):
        combinator = draw.choice([" ", ">", "+", "~"]) if n else None
        tag = draw.choice([*TAGS, "*"])
        tests, own = [("any",) if tag == "*" else ("tag", tag)], tag
        for _ in range(draw.randint(0, 2)):
            test, shown = random_simple(draw, level)
            tests.append(test)
            own += shown
        text += (f" {combinator} " if combinator and combinator != " " else combinator or "") + own
        steps.append((combinator, tests))
    return steps, text


def test_against_the_whole_tree():
    draw = random.Random(11)
    hits = 0
    for _ in range(250):
        page = random_page(draw)
        asked = [random_complex(draw) for _ in range(8)]
        plain = Plain(page)
        matcher = Matcher([t for _, t in asked])
        masks = [n.matched for n in dom.select(page, lambda n, s: matcher(n, s) | 1 << 8)]
        assert len(masks) == len(plain.nodes)
        for k, (steps, text) in enumerate(asked):
            want = [plain.complex(n, steps) for n in plain.nodes]
            assert [bool(m >> k & 1) for m in masks] == want, (text, page)
            hits += sum(want)
    assert hits > 500


@pytest.mark.parametrize(
    "selector,want",
    [
        ("ul > li", ["1", "2", "3"]),
        ("li:first-child", ["1"]),
        ("li:nth-child(odd)", ["1", "3"]),
        ("li:nth-child( -n + 2 )", ["1", "2"]),
        ("li + li", ["2", "3"]),
        ("li.x ~ li", ["3"]),
        ("li:not(.x)", ["1", "3"]),
        ("li:not(.x, :first-child)", ["3"]),
        ("a[href^='https:']", ["s"]),
        ("a[href$='.PDF' i], #n", ["p", "n"]),
        ("body > a , ul li.x", ["2", "s", "p", "n"]),
        (":root > body > a[data-q~=two]", ["p"]),
        ("A[HREF*=\"/d\"]", ["p"]),
        (r"#w\31 2", ["q"]),
        ("p:first-of-type", ["q"]),
    ],
)
def test_forms(spark, selector, want):
    page = """<ul><li>1<li class="y x">2<li>3</ul><a href="https://a/">s</a><a data-q="one two" href="/d.pdf">p</a><a id=n>n</a>
    <div><p id="w12">q</p><p>r</p></div>"""
    pages = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert [r.text for r in nav.extract_by_selector(pages, selector).orderBy("pos").collect()] == want


@pytest.mark.parametrize("bad", ["", "a >", "> a", "a,,b", "a:last-child", "a:has(b)", "a:nth-child(x)", "a:not(b", "[", "a[b=", "a::before", "p:hover"])
def test_refused(bad):
    with pytest.raises(ValueError):
        Matcher([bad])


def test_many_selectors_in_one_pass(spark):
    pages = spark.createDataFrame([(1, "<p>a<b>c</b></p>"), (2, None), (3, "")], "page_id long, html string")
    out = nav.extract_by_selectors(pages, {"paragraphs": "p", "bold": "p > b", "none": "i"}).collect()
    assert sorted(tuple(r) for r in out) == [(1, "bold", 0, "c"), (1, "paragraphs", 0, "ac")]
