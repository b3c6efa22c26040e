"""A small tree walk over one HTML page, for questions that need ancestors.

It tracks open elements, optional end tags, raw-text elements, and formatting
left open, which HTML carries on into the elements that follow. Content misplaced
in tables stays where it is written.
"""

import html as _html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/][^>]*>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_ATTRIBUTE_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*(?:;|(?![A-Za-z0-9=])))")

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style noscript iframe noembed noframes xmp textarea title".split())
_HEAD = set("base link meta noscript script style template title".split())
_FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
_CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table "
    "ul li dd dt".split()
)
# Opening the key closes an open element of the first set, looking no further than the second.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody"}, {"table"}),
}
_TABLE_PARTS = set("caption col colgroup tbody td tfoot th thead tr".split())
# Elements before which open formatting is not carried on, and those that fence it in.
_PLAIN_START = (
    _CLOSES_P | _TABLE_PARTS | _HEAD | _RAW | set("frame frameset param rb rp rt rtc source track".split())
)
_FENCE = set("applet caption marquee object td template th".split())
_P_SCOPE = {"button", "table", "td", "th", "caption", "html"}


@dataclass(slots=True)
class Link:
    """An open element and what was open around it; shared by all that is inside."""

    node: "Node"
    up: "Link | None"
    depth: int
    marks: tuple | None = None


@dataclass(slots=True)
class Node:
    tag: str
    attributes: dict[str, str]
    text: list[str] | None = None
    has_img: bool = False
    is_open: bool = False
    serial: int = 0
    link: Link | None = None
    #: The innermost open element around this one.
    around: Link | None = None
    #: What a selector keeps of the element.
    facts: object = None
    matched: object = None

    @property
    def ancestors(self) -> list["Node"]:
        """The elements around this one, outermost first."""
        chain, link = [], self.around
        while link is not None:
            chain.append(link.node)
            link = link.up
        return chain[::-1]


def _serial(node: Node) -> int:
    return node.serial


def _take(nodes: list[Node], node: Node) -> int:
    """Remove ``node`` from a list in the order of opening; where it was."""
    index = len(nodes) - 1
    if nodes[index] is not node:
        index = bisect_left(nodes, node.serial, key=_serial)
    del nodes[index]
    return index


def _look(node: Node) -> tuple:
    return node.tag, frozenset(node.attributes.items())


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for match in _ATTRIBUTE.finditer(text):
        value = match[2] or ""
        if value[:1] in ('"', "'") and value:
            value = value[1:-1]
        if "&" in value:
            value = _ATTRIBUTE_REFERENCE.sub(lambda m: _html.unescape(m[0]), value)
        found.setdefault(match[1].lower(), value)
    return found


def select(page: str, wanted) -> list[Node]:
    """Elements for which ``wanted(element, ancestors)`` holds, in page order, with their text."""
    root = Node("html", {})
    root.link = Link(root, None, 1)
    stack = [root]
    open_tags: dict[str, list[Node]] = defaultdict(list)
    pushed = 0
    body = None
    selected: list[Node] = []
    collecting: list[Node] = []
    formatting: list[Node | None] = []  # None is a fence
    kept_tags: Counter = Counter()  # what ``formatting`` holds, by tag and by look
    kept_looks: Counter = Counter()

    def push(node: Node, keep_open: bool = True) -> None:
        nonlocal pushed
        pushed += 1
        node.serial, node.around = pushed, stack[-1].link
        node.matched = wanted(node, stack)
        if node.matched:
            node.text = []
            selected.append(node)
            if keep_open:
                collecting.append(node)
        if keep_open:
            node.is_open = True
            node.link = Link(node, node.around, len(stack) + 1)
            stack.append(node)
            open_tags[node.tag].append(node)
            if node.tag in _FENCE:
                formatting.append(None)

    def drop(node: Node) -> None:
        for above in range(_take(stack, node), len(stack)):
            # what comes into elements left open is no longer inside the dropped one
            stack[above].link = Link(stack[above], stack[above - 1].link, above + 1)
        node.is_open = False
        _take(open_tags[node.tag], node)
        if node.text is not None:
            _take(collecting, node)
        if node.tag in _FENCE:
            while formatting and formatting[-1] is not None:
                forget(len(formatting) - 1)
            if formatting:
                formatting.pop()

    def forget(index: int) -> None:
        node = formatting.pop(index)
        kept_tags[node.tag] -= 1
        kept_looks[_look(node)] -= 1

    def carry_on_formatting() -> None:
        first = len(formatting)
        while first and formatting[first - 1] is not None and not formatting[first - 1].is_open:
            first -= 1
        for index in range(first, len(formatting)):
            again = Node(formatting[index].tag, formatting[index].attributes)
            formatting[index] = again
            push(again)

    def open_formatting(node: Node) -> None:
        alike, look = [], _look(node)
        for index in range(len(formatting) - 1, -1, -1) if kept_looks[look] >= 3 else ():
            other = formatting[index]
            if other is None:
                break
            if (other.tag, other.attributes) == (node.tag, node.attributes):
                alike.append(index)
        # At most three alike are carried on.
        if len(alike) >= 3:
            forget(alike[-1])
        formatting.append(node)
        kept_tags[node.tag] += 1
        kept_looks[look] += 1

    def close_formatting(tag: str) -> bool:
        for index in range(len(formatting) - 1, -1, -1) if kept_tags[tag] else ():
            node = formatting[index]
            if node is None:
                break
            if node.tag == tag:
                forget(index)
                if node.is_open:
                    drop(node)
                return True
        return False

    def innermost(tags: set[str]) -> int:
        return max((open_tags[t][-1].serial for t in tags if open_tags.get(t)), default=0)

    def close_from(serial: int) -> None:
        while len(stack) > 1 and stack[-1].serial >= serial:
            drop(stack[-1])

    def close_open(tags: set[str], limit: set[str]) -> None:
        found = innermost(tags)
        if found and found > innermost(limit):
            close_from(found)

    def add_text(text: str) -> None:
        for node in collecting:
            node.text.append(text)

    def enter_body(attributes: dict[str, str]) -> None:
        nonlocal body
        if body is None:
            close_from(1)
            body = Node("body", attributes)
            push(body)
        else:
            for name, value in attributes.items():
                body.attributes.setdefault(name, value)

    position = 0
    while True:
        match = _TOKEN.search(page, position)
        text = page[position : match.start() if match else len(page)]
        if text:
            if body is None and text.strip():
                enter_body({})
            if body is not None and formatting:
                carry_on_formatting()
            if collecting:
                add_text(_html.unescape(text))
        if match is None:
            break
        position = match.end()
        if not match[2]:
            continue
        tag = match[2].lower()
        if match[1]:
            if tag in ("html", "body") or (tag == "head" and body is not None):
                continue
            if tag in _FORMATTING and close_formatting(tag):
                continue
            if open_tags.get(tag):
                close_from(open_tags[tag][-1].serial)
            continue
        attributes = _attributes(match[3])
        if tag == "html":
            for name, value in attributes.items():
                root.attributes.setdefault(name, value)
            continue
        if tag == "body":
            enter_body(attributes)
            continue
        if tag == "head":
            if body is None and len(stack) == 1:
                push(Node("head", attributes))
            continue
        if body is None:
            if tag in _HEAD:
                if len(stack) == 1:
                    push(Node("head", {}))
            elif not open_tags.get("template"):
                enter_body({})
        if tag in _CLOSES_P:
            close_open({"p"}, _P_SCOPE)
        if tag in _IMPLIED:
            close_open(*_IMPLIED[tag])
        if tag == "a":
            close_formatting("a")
        if formatting and tag not in _PLAIN_START:
            carry_on_formatting()
        node = Node(tag, attributes)
        if tag == "img":
            for open_node in collecting:
                open_node.has_img = True
        foreign = bool(open_tags.get("svg") or open_tags.get("math"))
        if tag in _VOID or (foreign and match[3].rstrip().endswith("/")):
            push(node, keep_open=False)
        elif tag in _RAW and not foreign:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(page, position)
            content = page[position : end.start()]
            push(node)
            if collecting:
                add_text(_html.unescape(content) if tag in ("title", "textarea") else content)
            drop(node)
            position = end.end()
        else:
            push(node)
            if tag in _FORMATTING and not foreign:
                open_formatting(node)
    return selected
