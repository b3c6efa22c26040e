"""URL functions as SQL expressions.

A URL is split once into a struct, resolved against the split base, and
written out again, all inside the JVM. Rare work (dot segments, percent
escaping, query sorting) sits behind a cheap test, so an ordinary link pays
only for the split.
"""

from weblens.functions.core import Sql, each, each_indexed, keep, let, lit

# Href prefixes that are never links.
SKIPPED_PREFIXES = ["#", "javascript:", "mailto:", "tel:"]

# Query parameters that only track the visitor.
TRACKING_PARAMS = [
    "utm_source",
    "utm_medium",
    "utm_campaign",
    "utm_term",
    "utm_content",
    "fbclid",
    "gclid",
    "msclkid",
    "mc_cid",
    "mc_eid",
]

_BAD_ESCAPE = "%(?![0-9A-Fa-f]{2})"
_CONTROL = r"[\x00-\x1f\x7f]"
_AUTHORITY = (
    r"^(?:[A-Za-z0-9\-._:~!$&'()*+,;=%@]*@)?"
    r"(?:\[[0-9A-Fa-f:.%]*\]|(?:[^\x00-\x20:@\[\]\\^`{|}#?/%]|%[89A-Fa-f][0-9A-Fa-f])*)(?::[0-9]*)?$"
)
_PLAIN_PATH = r"^[A-Za-z0-9\-_.~!$&'()*+,;=:@\[\]%/]*$"
_PLAIN_FRAGMENT = r"^[A-Za-z0-9\-_.~!$&'()*+,;=:@\[\]%/?]*$"
_DOT_SEGMENT = r"(?:^|/)\.\.?(?:/|$)"
_KEEP_IN_PATH = r"A-Za-z0-9\-_.~$&+,/:;=@"
_KEEP_IN_HOST = r"\x00-\x7f"
_KEEP_IN_FRAGMENT = r"A-Za-z0-9\-_.~$&+,/:;=?@!()*"
# Segments that are neither empty nor begin with a dot, in characters that stay as they are.
_PLAIN_SEGMENTS = r"(?:/[A-Za-z0-9\-_~][A-Za-z0-9\-_.~]*+)"
_PLAIN_ROOTED = rf"^{_PLAIN_SEGMENTS}++/?$"
_PLAIN_ABSOLUTE = rf"^https?://[A-Za-z0-9.\-]++(?::[0-9]+)?{_PLAIN_SEGMENTS}*+/?$"
_SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*):"


def _percent_encode(text: Sql, kept: str) -> Sql:
    """UTF-8 percent encoding of every run of characters outside the class ``kept``."""
    runs = f"regexp_extract_all({text}, {lit(f'[{kept}]+|[^{kept}]+')}, 0)"
    encoded = each(
        runs,
        lambda r: f"if({r} rlike {lit(f'^[{kept}]')}, {r}, "
        f"replace(replace(url_encode({r}), '+', '%20'), '*', '%2A'))",
    )
    return f"array_join({encoded}, '')"


def _percent_decode(text: Sql) -> Sql:
    return f"try_url_decode(replace({text}, '+', '%2B'))"


def _escape_path(path: Sql) -> Sql:
    """A path that is already valid stays as written; any other is decoded and escaped anew."""
    escaped = _percent_encode(_percent_decode(path), _KEEP_IN_PATH)
    return f"if({path} rlike {lit(_PLAIN_PATH)}, {path}, {escaped})"


def split_url(url: Sql) -> Sql:
    """Struct of scheme, authority, path, query, fragment, opaque and valid.

    ``authority`` and ``query`` are NULL when absent, so ``a?`` (empty query)
    and ``a`` differ. ``opaque`` marks ``scheme:rest`` without a slash.
    """

    def with_scheme(bare, scheme):
        rest = f"if({scheme} <> '', substr({bare}, length({scheme}) + 2), {bare})"
        return let(
            rest,
            lambda r: let(
                f"substring_index({r}, '?', 1)", lambda hier: build(bare, scheme, r, hier)
            ),
        )

    def build(bare, scheme, rest, hier):
        has_authority = (
            f"startswith({hier}, '//') and ({scheme} <> '' or not startswith({hier}, '///'))"
        )
        authority = f"if({has_authority}, regexp_extract({hier}, '^//([^/]*)', 1), null)"
        return let(
            authority,
            lambda auth: f"""named_struct(
                'scheme', lower({scheme}),
                'authority', {auth},
                'path', if({auth} is null, {hier}, substr({hier}, length({auth}) + 3)),
                'query', if(contains({rest}, '?'), substr({rest}, length({hier}) + 2), null),
                'fragment', substr({url}, length({bare}) + 2),
                'opaque', {scheme} <> '' and not startswith({hier}, '/'),
                'valid', not {url} rlike {lit(f"{_CONTROL}|#.*{_BAD_ESCAPE}")}
                    and not ({scheme} = '' and {hier} rlike '^[^/]*:')
                    and (({scheme} <> '' and not startswith({hier}, '/'))
                         or not {hier} rlike {lit(_BAD_ESCAPE)})
                    and coalesce({auth} rlike {lit(_AUTHORITY)}, true))""",
        )

    return let(
        f"substring_index({url}, '#', 1)",
        lambda bare: let(
            f"regexp_extract({bare}, {lit(_SCHEME)}, 1)",
            lambda scheme: with_scheme(bare, scheme),
        ),
    )


def _remove_dot_segments(path: Sql) -> Sql:
    def walk(segments):
        kept = f"""aggregate({segments}, cast(array() as array<string>), (done, seg) -> case
            when seg = '.' then done
            when seg = '..' then slice(done, 1, greatest(size(done) - 1, 0))
            else array_append(done, seg) end)"""
        ending = f"if(element_at({segments}, -1) in ('.', '..'), '/', '')"
        joined = f"concat('/', array_join({kept}, '/'), {ending})"
        return let(joined, lambda j: f"if(startswith({j}, '//'), substr({j}, 2), {j})")

    return f"""case
        when {path} rlike {lit(_DOT_SEGMENT)} then {let(f"split({path}, '/')", walk)}
        when {path} = '' or startswith({path}, '/') then {path}
        else concat('/', {path}) end"""


def _resolve(ref: Sql, base: Sql) -> Sql:
    """Struct of head (everything before the query), query and fragment; NULL if unparseable."""

    def build(absolute):
        # Sides are escaped before dot segments are removed, as these live in escaped text.
        merged = f"""case
            when {absolute} or startswith({ref}.path, '/') then {ref}.path
            when {ref}.path = '' then {base}.path
            else concat(regexp_extract({base}.path, '^(.*/)', 1), {ref}.path) end"""
        path = let(merged, lambda p: let(_escape_path(p), _remove_dot_segments))
        authority = f"if({absolute}, {ref}.authority, {base}.authority)"
        same = f"(not {absolute} and {ref}.path = '' and {ref}.query is null)"
        return f"""named_struct(
            'head', if({ref}.opaque,
                concat({ref}.scheme, ':', {ref}.path),
                concat(
                    {let(
                        f"if({ref}.scheme <> '', {ref}.scheme, {base}.scheme)",
                        lambda s: f"if({s} <> '', concat({s}, ':'), '')",
                    )},
                    coalesce(concat('//', {let(
                        authority, lambda a: _percent_encode(a, _KEEP_IN_HOST)
                    )}), ''),
                    {path})),
            'query', if({same}, {base}.query, {ref}.query),
            'fragment', if({same} and {ref}.fragment = '', {base}.fragment, {ref}.fragment))"""

    absolute = f"{ref}.scheme <> '' or coalesce({ref}.authority, '') <> ''"
    return f"if({ref}.valid and {base}.valid, {let(absolute, build)}, null)"


def _query_escape(text: Sql) -> Sql:
    return f"replace(replace(url_encode({text}), '*', '%2A'), '%7E', '~')"


def clean_query(query: Sql) -> Sql:
    """Query string without tracking parameters, sorted by key and re-encoded."""
    pairs = keep(f"split({query}, '&')", lambda p: f"not {p} rlike {lit('^$|;|' + _BAD_ESCAPE)}")
    decoded = each_indexed(
        pairs,
        lambda p, i: let(
            f"substring_index({p}, '=', 1)",
            lambda k: f"named_struct('key', try_url_decode({k}), 'idx', {i}, "
            f"'value', try_url_decode(substr({p}, length({k}) + 2)))",
        ),
    )
    tracking = lit(f"^(?:{'|'.join(TRACKING_PARAMS)})$")
    kept = keep(decoded, lambda e: f"not {e}.key rlike {tracking}")
    written = each(
        f"array_sort({kept})",
        lambda e: f"concat({_query_escape(f'{e}.key')}, '=', {_query_escape(f'{e}.value')})",
    )
    return f"array_join({written}, '&')"


def _with_query(head: Sql, query: Sql) -> Sql:
    """``head`` plus the cleaned query; a lone ``?`` is kept, a query cleaned away is not."""
    cleaned = let(clean_query(query), lambda q: f"if({q} = '', '', concat('?', {q}))")
    return f"""case
        when {query} is null then {head}
        when {query} = '' then concat({head}, '?')
        else concat({head}, {cleaned}) end"""


def is_link(href: Sql) -> Sql:
    """True for hrefs worth resolving: not empty, no fragment-only, script, mail or phone link."""
    return f"(not {href} rlike {lit('^(?:$|' + '|'.join(SKIPPED_PREFIXES) + ')')})"


def resolve_url(href: Sql, base: Sql) -> Sql:
    """``href`` resolved against ``base`` (RFC 3986), query and fragment kept; NULL if malformed."""

    def write(p):
        fragment = let(
            f"{p}.fragment",
            lambda f: f"if({f} rlike {lit(_PLAIN_FRAGMENT)}, {f}, "
            f"{_percent_encode(_percent_decode(f), _KEEP_IN_FRAGMENT)})",
        )
        return (
            f"concat({p}.head, coalesce(concat('?', {p}.query), ''), "
            f"if({p}.fragment = '', '', concat('#', {fragment})))"
        )

    return let(
        split_url(base),
        lambda b: let(split_url(href), lambda r: let(_resolve(r, b), write)),
    )


def split_base(base: Sql) -> Sql:
    """A page URL prepared for many ``normalize_in``: its split form and its origin as text."""
    return let(
        split_url(base),
        lambda b: f"""named_struct('url', {b}, 'origin',
            if({b}.valid and {b}.scheme <> '' and not {b}.authority rlike '[^\\x00-\\x7f]',
               concat({b}.scheme, '://', {b}.authority), null))""",
    )


def normalize_in(href: Sql, base: Sql) -> Sql:
    """``normalize_url`` against a base from ``split_base``.

    Plain paths and plain absolute URLs, which most links are, need no parsing:
    nothing in them can be escaped, merged or dropped.
    """
    parsed = let(
        split_url(href),
        lambda r: let(
            _resolve(r, f"{base}.url"), lambda p: _with_query(f"{p}.head", f"{p}.query")
        ),
    )
    return f"""case
        when {base}.origin is not null and {href} rlike {lit(_PLAIN_ROOTED)}
        then concat({base}.origin, {href})
        when {base}.url.valid and {href} rlike {lit(_PLAIN_ABSOLUTE)} then {href}
        when {is_link(href)} then {parsed} end"""


def normalize_url(href: Sql, base: Sql) -> Sql:
    """Absolute, fragment-free, tracking-free form of ``href``; NULL when it is no link."""
    return let(split_base(base), lambda b: let(href, lambda h: normalize_in(h, b)))


def normalize_urls(hrefs: Sql, base: Sql) -> Sql:
    """``normalize_url`` over an array; the base is split once, non-links are dropped."""
    return let(
        split_base(base),
        lambda b: keep(
            each(hrefs, lambda h: normalize_in(h, b)), lambda u: f"{u} is not null"
        ),
    )


def strip_fragment(url: Sql) -> Sql:
    return f"substring_index({url}, '#', 1)"


def strip_tracking(url: Sql) -> Sql:
    """Delete tracking parameters and re-encode the query; an unparseable URL is returned as is."""

    def write(s):
        head = f"substring_index(substring_index({url}, '#', 1), '?', 1)"
        return (
            f"if({s}.valid, concat({_with_query(head, f'{s}.query')}, "
            f"if({s}.fragment = '', '', concat('#', {s}.fragment))), {url})"
        )

    return let(split_url(url), write)


def url_scheme(url: Sql) -> Sql:
    """Lower-case scheme, or the empty string."""
    return f"lower(regexp_extract({url}, {lit(_SCHEME)}, 1))"


def url_host(url: Sql) -> Sql:
    """Host with its port, case kept; empty when the URL has no authority."""
    pattern = lit("^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#]*)")
    return f"regexp_extract({url}, {pattern}, 1)"


def domain_no_port(url: Sql) -> Sql:
    return f"substring_index({url_host(url)}, ':', 1)"


def url_origin(url: Sql) -> Sql:
    """``scheme://host``."""
    return f"concat({url_scheme(url)}, '://', {url_host(url)})"


def url_path(url: Sql) -> Sql:
    """Decoded path without query and fragment."""
    pattern = lit("^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)")
    return let(
        f"regexp_extract({url}, {pattern}, 1)",
        lambda raw: f"if(contains({raw}, '%'), {_percent_decode(raw)}, {raw})",
    )


def robots_url(url: Sql) -> Sql:
    return f"concat({url_origin(url)}, '/robots.txt')"


def strip_wildcard(name: Sql) -> Sql:
    """Trimmed host name without a leading ``*.``."""
    return f"regexp_replace({trim_space(name)}, {lit(r'^\*\.')}, '')"


def trim_space(text: Sql) -> Sql:
    """Trim Unicode white space at both ends."""
    pattern = lit(r"^[\s\x85\p{Z}]+|[\s\x85\p{Z}]+$")
    return f"regexp_replace({text}, {pattern}, '')"
