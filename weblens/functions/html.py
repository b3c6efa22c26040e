"""HTML extraction as SQL expressions: no DOM, no Python.

``clean`` blanks everything a tag search must not look into (comments and the
bodies of raw-text elements); tags are then found by regular expression and
read attribute by attribute. Position in the page decides the order of results.
"""

import json
import re
from html.entities import html5

from weblens.functions.core import Sql, each, each_indexed, keep, let, lit, variable
from weblens.functions.urls import normalize_in, normalize_urls, split_base, trim_space

# Marks of pages that only fill in under JavaScript.
JS_SHELL_MARKS = [
    '<div id="root"></div>',
    '<div id="app"></div>',
    "<noscript>You need to enable JavaScript",
    "JavaScript is required",
    "Please enable JavaScript",
    "__NEXT_DATA__",
    "ng-app",
    "v-app",
    "data-reactroot",
]
JS_SHELL_BYTES = 500

_ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_RAW_ELEMENTS = "script|style|noscript|iframe|noembed|noframes|xmp|textarea"
_RAW_BLOCK = (
    r"<!--(?:-?>|.*?(?:--!?>|\z))"
    rf"|(<({_RAW_ELEMENTS})(?=[\s/>]){_ATTRS}>).*?(?:</\2(?=[\s/>])[^>]*>|\z)"
)
_TITLE = rf"<title(?=[\s/>]){_ATTRS}>(.*?)(?:</title(?=[\s/>])[^>]*>|\z)"
_SPACE = " \t\r\n\f"


def _map_literal(table: dict[str, str]) -> Sql:
    """Map from one JSON literal; folded to a constant at planning time."""
    return f"from_json({lit(json.dumps(table))}, 'map<string,string>')"


# The standard library's HTML entity table, with and without the closing semicolon.
_NAMED = _map_literal({name: text for name, text in html5.items() if name.endswith(";")})
_NAMED_BARE = _map_literal({name: text for name, text in html5.items() if not name.endswith(";")})


def _c1_replacements() -> dict[str, str]:
    """Numeric references 128..159 mean windows-1252 characters where that has one."""
    table = {}
    for code in range(0x80, 0xA0):
        try:
            table[str(code)] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            pass
    return table


_C1 = _map_literal(_c1_replacements())


def _code_point(n: Sql) -> Sql:
    character = f"decode(unhex(lpad(hex({n}), 8, '0')), 'UTF-32')"
    return f"""case
        when {n} is null or {n} = 0 or {n} > {0x10FFFF} or {n} between {0xD800} and {0xDFFF}
        then decode(unhex('EFBFBD'), 'UTF-8')
        when {n} between 128 and 159
        then coalesce(element_at({_C1}, cast({n} as string)), {character})
        else {character} end"""


def unescape(text: Sql, attribute: bool = False) -> Sql:
    """Decode character references. In attributes, a bare name before ``=`` is left alone."""

    def decode(piece):
        def by_reference(ref):
            after = f"substr({piece}, length({ref}) + 1)"
            bare = f"element_at({_NAMED_BARE}, {ref})"
            if attribute:
                bare = f"if(startswith({after}, '='), null, {bare})"
            digits = f"regexp_extract({ref}, '^#[xX]?0*([0-9a-fA-F]{{1,8}})', 1)"
            number = (
                f"if({ref} rlike '^#[xX]', try_cast(conv({digits}, 16, 10) as bigint), "
                f"try_cast({digits} as bigint))"
            )
            decoded = f"""case
                when {ref} = 'amp;' then '&'
                when {ref} = '' then null
                when startswith({ref}, '#') then {let(number, _code_point)}
                when endswith({ref}, ';') then element_at({_NAMED}, {ref})
                else {bare} end"""
            return f"coalesce(concat({decoded}, {after}), concat('&', {piece}))"

        reference = lit(r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)")
        return let(f"regexp_extract({piece}, {reference}, 1)", by_reference)

    pieces = each_indexed(
        f"split({text}, '&', -1)", lambda p, i: f"if({i} = 0, {p}, {decode(p)})"
    )
    return f"if(contains({text}, '&'), array_join({pieces}, ''), {text})"


def clean(html: Sql) -> Sql:
    """HTML without comments and without the bodies of raw-text elements; their tags stay."""
    return f"regexp_replace({html}, {lit(f'(?is){_RAW_BLOCK}')}, '$1')"


def _title_aside(pattern: str) -> str:
    """Search pattern that steps over a title element, whose text is no markup."""
    return rf"(?is){_TITLE}|{pattern}"


def _found(cleaned: Sql, pattern: str) -> Sql:
    return keep(
        f"regexp_extract_all({cleaned}, {lit(_title_aside(pattern))}, 0)",
        lambda t: f"lower(left({t}, 6)) <> '<title'",
    )


def tags(cleaned: Sql) -> Sql:
    """Start tags that carry links, assets or metadata, in page order: one scan for all of them."""
    return _found(cleaned, rf"<(?:a|img|link|meta|script)(?=[\s/>]){_ATTRS}>")


def _named(tags: Sql, name: str) -> Sql:
    # No two of the names ``tags`` finds begin alike.
    return keep(tags, lambda t: f"lower(left({t}, {len(name) + 1})) = '<{name}'")


def attributes(tag: Sql) -> Sql:
    """Raw attributes of a start tag, in order: one search per attribute, so any number is safe."""
    one = r"""(?s)\G[\s/]*+([^\s"'>/=][^\s>/=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)"""
    name_end = lit(r"(?i)^<[a-z][^\s/>]*+")
    return f"regexp_extract_all(regexp_replace({tag}, {name_end}, ''), {lit(one)}, 1)"


def value_of(raw_attributes: Sql, name: str) -> Sql:
    """Decoded value of the first attribute ``name``; NULL if absent, empty if valueless."""
    named = lit(rf"(?is)^{re.escape(name)}(?:[\s=]|$)")

    def value(raw):
        after_name = f"ltrim({lit(_SPACE)}, substr({raw}, {len(name) + 1}))"
        given = f"ltrim({lit(_SPACE)}, substr({after_name}, 2))"
        return f"if({raw} is not null, {let(given, lambda g: let(unquote(g), decode))}, null)"

    def unquote(given):
        return f"if(left({given}, 1) in ('\"', '\\''), substr({given}, 2, length({given}) - 2), {given})"

    def decode(plain):
        return unescape(plain, attribute=True)

    return let(f"get({keep(raw_attributes, lambda r: f'{r} rlike {named}')}, 0)", value)


def attribute(tag: Sql, name: str) -> Sql:
    """Decoded value of the tag's first attribute ``name``; NULL if absent, empty if valueless."""
    return value_of(attributes(tag), name)


def _attributes(tags: Sql, name: str) -> Sql:
    return keep(each(tags, lambda t: attribute(t, name)), lambda v: f"{v} is not null")


def title(cleaned: Sql) -> Sql:
    """Text of the first title element, untrimmed; empty when there is none."""
    return let(f"regexp_extract({cleaned}, {lit(f'(?is){_TITLE}')}, 1)", unescape)


def anchor_hrefs(tags: Sql) -> Sql:
    """href values of the anchors, in page order, not resolved."""
    return _attributes(_named(tags, "a"), "href")


def _link_hrefs(tags: Sql, *rels: str) -> Sql:
    wanted = ", ".join(lit(r) for r in rels)
    matching = keep(_named(tags, "link"), lambda t: f"{attribute(t, 'rel')} in ({wanted})")
    return _attributes(matching, "href")


def anchors(cleaned: Sql, base: Sql) -> Sql:
    """Array of (url, anchor_text) for every anchor that resolves, in page order, with repeats."""
    opening = lit(rf"(?is)^<a(?=[\s/>]){_ATTRS}>")

    def read(token, tag, page_base):
        inner = f"regexp_replace(substr({token}, length({tag}) + 1), '<[^>]*>', '')"
        text = let(inner, unescape)
        return (
            f"named_struct('url', {let(attribute(tag, 'href'), lambda h: normalize_in(h, page_base))}, "
            f"'anchor_text', {trim_space(text)})"
        )

    tokens = _found(cleaned, rf"<a(?=[\s/>]){_ATTRS}>.*?(?=</a[\s>]|<a[\s>]|\z)")
    return let(
        split_base(base),
        lambda b: keep(
            each(
                tokens,
                lambda t: let(f"regexp_extract({t}, {opening}, 0)", lambda tag: read(t, tag, b)),
            ),
            lambda a: f"{a}.url is not null",
        ),
    )


def page_links(tags: Sql, base: Sql) -> Sql:
    """Distinct normalised links: anchors first, then alternate and canonical link tags."""
    hrefs = f"concat({anchor_hrefs(tags)}, {_link_hrefs(tags, 'alternate', 'canonical')})"
    return f"array_distinct({normalize_urls(hrefs, base)})"


def anchor_links(tags: Sql, base: Sql) -> Sql:
    """Distinct normalised links of the anchors alone."""
    return f"array_distinct({normalize_urls(anchor_hrefs(tags), base)})"


def images(tags: Sql, base: Sql) -> Sql:
    return normalize_urls(_attributes(_named(tags, "img"), "src"), base)


def scripts(tags: Sql, base: Sql) -> Sql:
    return normalize_urls(_attributes(_named(tags, "script"), "src"), base)


def stylesheets(tags: Sql, base: Sql) -> Sql:
    return normalize_urls(_link_hrefs(tags, "stylesheet"), base)


def meta_entries(tags: Sql) -> Sql:
    """Array of (name, content) in writing order: per tag, ``name`` before ``property``."""

    def read(tag):
        return let(attributes(tag), entries)

    def entries(found):
        keys = f"array({value_of(found, 'name')}, {value_of(found, 'property')})"
        return let(
            value_of(found, "content"),
            lambda content: each(
                keys, lambda key: f"named_struct('name', {key}, 'content', {content})"
            ),
        )

    return keep(
        f"flatten({each(_named(tags, 'meta'), read)})",
        lambda e: f"{e}.name is not null and {e}.content is not null",
    )


def meta_map(tags: Sql) -> Sql:
    """Map from meta name to content; the last writer of a name wins.

    Sorting by (name, latest first) keeps the cost at n log n per page and
    does not depend on the session's map-key policy.
    """
    ordered = each_indexed(
        meta_entries(tags),
        lambda e, i: f"named_struct('name', {e}.name, 'late', -{i}, 'content', {e}.content)",
    )

    def last_writers(entries):
        e, i = variable(), variable()
        kept = (
            f"filter({entries}, ({e}, {i}) -> "
            f"{i} = 0 or {e}.name <> get({entries}, {i} - 1).name)"
        )
        pairs = each(kept, lambda k: f"named_struct('name', {k}.name, 'content', {k}.content)")
        return f"map_from_entries({pairs})"

    return let(f"array_sort({ordered})", last_writers)


def jsonld(html: Sql) -> Sql:
    """Raw text of every ``application/ld+json`` script, in page order."""
    tag = rf"(?is)^<script(?=[\s/>]){_ATTRS}>"
    whole = lit(rf"{tag}(.*?)(?:</script(?=[\s/>])[^>]*>)?\z")
    matching = keep(
        f"regexp_extract_all({html}, {lit(f'(?is){_RAW_BLOCK}')}, 0)",
        lambda b: f"{b} rlike {lit(r'(?i)^<script[\s/>]')} and coalesce("
        + attribute(f"regexp_extract({b}, {lit(tag)}, 0)", "type")
        + " = 'application/ld+json', false)",
    )
    return each(matching, lambda b: f"regexp_extract({b}, {whole}, 1)")


def needs_js_render(html: Sql) -> Sql:
    """True for pages under 500 bytes or with a JavaScript-shell mark, whatever its case."""
    marks = " or ".join(f"contains(lower({html}), {lit(m.lower())})" for m in JS_SHELL_MARKS)
    return f"(octet_length({html}) < {JS_SHELL_BYTES} or {marks})"
