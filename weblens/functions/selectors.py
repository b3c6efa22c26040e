"""CSS selectors as one automaton over the open elements of a page.

Every step of every selector is one bit. A set bit says that the selector up to this step
ends in the element; it depends on the element itself and on bits of its parent, of the
elements around it, of its last sibling or of all siblings before it. So elements are
decided as they open, in one pass for any number of selectors, with four bit sets kept
for each open element.

Supported: tag, ``*``, ``#id``, ``.class``, ``[a]``, ``[a=v]`` and the operators ``~= |= ^= $= *=``
(with ``i`` for any case), descendant, child ``>``, next sibling ``+`` and later sibling ``~``,
groups with ``,``, ``:not(...)``, ``:is(...)`` and ``:where(...)`` of any selectors, ``:root``, ``:first-child``,
``:first-of-type``, ``:nth-child(...)`` and ``:nth-of-type(...)``. What looks ahead in the page
(``:last-child``, ``:has`` and the like) is refused.
"""

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

_NAME = re.compile(r"(?:[\w-]|[^\x00-\x7F]|\\[0-9a-fA-F]{1,6}[ \t\r\n\f]?|\\[^\r\n\f0-9a-fA-F])+")
_ESCAPE = re.compile(r"\\([0-9a-fA-F]{1,6})[ \t\r\n\f]?|\\(.)", re.S)
_SPACE = re.compile(r"[ \t\r\n\f]*")
_COMBINATOR = re.compile(r"[ \t\r\n\f]*([>+~])[ \t\r\n\f]*|[ \t\r\n\f]+")
_ATTRIBUTE = re.compile(
    r"""\[[ \t\r\n\f]*(?P<name>(?:[\w:-]|[^\x00-\x7F]|\\.)+)[ \t\r\n\f]*
    (?:(?P<op>[~|^$*]?=)[ \t\r\n\f]*(?P<value>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|(?:[\w-]|[^\x00-\x7F]|\\.)+)
    [ \t\r\n\f]*(?P<flag>[iIsS])?[ \t\r\n\f]*)?\]""",
    re.X | re.S,
)
_NTH = re.compile(r"(?:(?P<word>odd|even)|(?P<a>[+-]?[0-9]*)n(?:[ \t]*(?P<sign>[+-])[ \t]*(?P<b>[0-9]+))?|(?P<only>[+-]?[0-9]+))$", re.I)


def _plain(name: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else m[2], name)


@dataclass(slots=True)
class Facts:
    """What the automaton keeps of an element while it is open."""

    mask: int = 0  # steps that end in the element
    above: int = 0  # ... in it or an element around it
    last: int = 0  # ... in its last child so far
    before: int = 0  # ... in any child so far
    children: int = 0
    types: dict[str, int] = field(default_factory=dict)
    #: place among its siblings, and among those of its tag
    place: int = 1
    type_place: int = 1
    is_root: bool = False


@dataclass(slots=True)
class _Step:
    test: Callable
    combinator: str | None
    previous: int


class Matcher:
    """All the given selectors; ``matcher(element, open elements)`` is the set of those that match, as bits."""

    def __init__(self, selectors: Iterable[str]):
        self.steps: list[_Step] = []
        self.ends: list[int] = []
        for text in selectors:
            at, mask = self._group(text, _SPACE.match(text).end(), text)
            if at != len(text):
                raise ValueError(f"unsupported selector: {text!r} at {text[at:]!r}")
            self.ends.append(mask)

    # -- compiling -----------------------------------------------------------

    def _group(self, text: str, at: int, whole: str) -> tuple[int, int]:
        """The selectors between commas from ``at`` on: (where they end, the bits of their last steps)."""
        mask = 0
        while True:
            at, bit = self._complex(text, at, whole)
            mask |= 1 << bit
            at = _SPACE.match(text, at).end()
            if at >= len(text) or text[at] != ",":
                return at, mask
            at = _SPACE.match(text, at + 1).end()

    def _complex(self, text: str, at: int, whole: str) -> tuple[int, int]:
        combinator, previous = None, -1
        while True:
            at, tests = self._compound(text, at, whole)
            # bits of selectors inside :not() were given out before; this step's comes after them
            self.steps.append(_Step(lambda node, facts, mask, tests=tuple(tests): all(t(node, facts, mask) for t in tests), combinator, previous))
            previous = len(self.steps) - 1
            m = _COMBINATOR.match(text, at)
            if not m or m.end() >= len(text) or (not m[1] and text[m.end()] in ",)"):
                return at, previous
            combinator, at = m[1] or " ", m.end()

    def _compound(self, text: str, at: int, whole: str) -> tuple[int, list[Callable]]:
        tests: list[Callable] = []
        first = at
        if at < len(text) and text[at] == "*":
            at += 1
            tests.append(lambda node, facts, mask: True)
        elif m := _NAME.match(text, at):
            tag, at = _plain(m.group()).lower(), m.end()
            tests.append(lambda node, facts, mask: node.tag == tag)
        while at < len(text) and text[at] in "#.[:":
            kind = text[at]
            if kind == "[":
                m = _ATTRIBUTE.match(text, at)
                if not m:
                    break
                tests.append(_attribute(m))
                at = m.end()
                continue
            m = _NAME.match(text, at + 1)
            if not m:
                break
            name, at = _plain(m.group()), m.end()
            if kind == "#":
                tests.append(lambda node, facts, mask, i=name: node.attributes.get("id") == i)
            elif kind == ".":
                tests.append(lambda node, facts, mask, c=name: c in node.attributes.get("class", "").split())
            else:
                at, test = self._pseudo(name.lower(), text, at, whole)
                tests.append(test)
        if at == first:
            raise ValueError(f"unsupported selector: {whole!r} at {text[at:]!r}")
        return at, tests

    def _pseudo(self, name: str, text: str, at: int, whole: str) -> tuple[int, Callable]:
        if name == "root":
            return at, lambda node, facts, mask: facts.is_root
        if name == "first-child":
            return at, lambda node, facts, mask: facts.place == 1 and not facts.is_root
        if name == "first-of-type":
            return at, lambda node, facts, mask: facts.type_place == 1 and not facts.is_root
        if at < len(text) and text[at] == "(":
            inside = _SPACE.match(text, at + 1).end()
            if name in ("not", "is", "where"):
                end, bits = self._group(text, inside, whole)
                end = _SPACE.match(text, end).end()
                if end < len(text) and text[end] == ")":
                    if name == "not":
                        return end + 1, lambda node, facts, mask: not mask & bits
                    return end + 1, lambda node, facts, mask: bool(mask & bits)
            elif name in ("nth-child", "nth-of-type"):
                end = text.find(")", inside)
                m = _NTH.match(text[inside:end].strip()) if end >= 0 else None
                if m:
                    a, b = _nth(m)
                    of_type = name == "nth-of-type"
                    return end + 1, lambda node, facts, mask: not facts.is_root and _is_nth(facts.type_place if of_type else facts.place, a, b)
        raise ValueError(f"unsupported selector: {whole!r} at ':{name}'")

    # -- running -------------------------------------------------------------

    def __call__(self, node, stack) -> int:
        parent = stack[-1]
        if parent.facts is None:  # the root is open before anything is asked
            parent.facts = Facts(is_root=True)
            parent.facts.mask = parent.facts.above = self._mask(parent, parent.facts, None)
        around = parent.facts
        around.children += 1
        around.types[node.tag] = around.types.get(node.tag, 0) + 1
        facts = node.facts = Facts(place=around.children, type_place=around.types[node.tag])
        facts.mask = self._mask(node, facts, around)
        facts.above = facts.mask | around.above
        around.last = facts.mask
        around.before |= facts.mask
        return sum(1 << n for n, end in enumerate(self.ends) if facts.mask & end)

    def _mask(self, node, facts: Facts, around: Facts | None) -> int:
        mask = 0
        for bit, step in enumerate(self.steps):
            if step.combinator is not None:
                if around is None:
                    continue
                seen = {" ": around.above, ">": around.mask, "+": around.last, "~": around.before}[step.combinator]
                if not seen >> step.previous & 1:
                    continue
            if step.test(node, facts, mask):
                mask |= 1 << bit
        return mask


def _attribute(m: re.Match) -> Callable:
    name, op = _plain(m["name"]).lower(), m["op"]
    if op is None:
        return lambda node, facts, mask: name in node.attributes
    value = _plain(m["value"][1:-1] if m["value"][0] in "'\"" else m["value"])
    fold = (lambda s: s.lower()) if (m["flag"] or "").lower() == "i" else (lambda s: s)
    value = fold(value)
    compare = {
        "=": lambda own: own == value,
        "~=": lambda own: value in own.split(),
        "|=": lambda own: own == value or own.startswith(value + "-"),
        "^=": lambda own: bool(value) and own.startswith(value),
        "$=": lambda own: bool(value) and own.endswith(value),
        "*=": lambda own: bool(value) and value in own,
    }[op]
    return lambda node, facts, mask: name in node.attributes and compare(fold(node.attributes[name]))


def _nth(m: re.Match) -> tuple[int, int]:
    """(a, b) of an + b."""
    if m["word"]:
        return 2, 1 if m["word"].lower() == "odd" else 0
    if m["only"]:
        return 0, int(m["only"])
    a = int(m["a"]) if m["a"] not in ("", "+", "-") else int(f"{m['a']}1")
    return a, int(f"{m['sign']}{m['b']}") if m["b"] else 0


def _is_nth(place: int, a: int, b: int) -> bool:
    if a == 0:
        return place == b
    n, rest = divmod(place - b, a)
    return rest == 0 and n >= 0
