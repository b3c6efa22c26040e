"""robots.txt: parsing and URL filtering.

A robots file is parsed into one array of rules, inside its row. URLs meet
their host's rules by one equi join and are decided in place, so the URL table
is neither multiplied by the rules nor grouped again afterwards.
"""

from pyspark.sql import DataFrame, functions as F

from weblens.functions.core import Sql, each, keep, let, lit, variable
from weblens.functions.urls import robots_url, url_path

_BREAK = "\u0001"


def _directive(line: Sql) -> Sql:
    """``u:agent``, ``a:path``, ``d:path`` or ``x:`` for the lines that shape groups, else empty."""
    value = f"trim(substr({line}, length(substring_index({line}, ':', 1)) + 2))"
    return f"""case lower(trim(substring_index({line}, ':', 1)))
        when 'user-agent' then concat('u:', lower({value}))
        when 'allow' then concat('a:', {value})
        when 'disallow' then concat('d:', {value})
        when 'crawl-delay' then 'x:'
        else '' end"""


def rules_for(body: Sql, agent: str) -> Sql:
    """Array of (allow, pattern, parts, ends) of the group that applies to ``agent``.

    The group with the longest matching agent prefix applies, ``*`` being the
    weakest; groups naming the same agent are read together.
    """
    plain = rf"regexp_replace({body}, {lit(r'#[^\r\n]*')}, '')"
    lines = f"split({plain}, {lit(r'\r\n|\n|\r')})"
    directives = keep(
        each(lines, lambda n: let(f"trim({lit(chr(9) + ' ' + chr(0xFEFF))} from {n})", _directive)),
        lambda d: f"{d} <> ''",
    )
    # A user-agent line after a rule line opens a new group.
    marked = (
        f"regexp_replace(array_join({directives}, '\\n'), "
        f"{lit(r'(?m)(^[adx]:[^\n]*)\nu:')}, {lit('$1' + _BREAK + 'u:')})"
    )
    name = lit(agent.lower())

    def weights(group):
        return each(
            f"regexp_extract_all({group}, {lit('(?m)^u:(.*)$')}, 1)",
            lambda a: f"""case when {a} = '*' then 3
                when {a} <> '' and startswith({name}, {a}) then 2 * length({a}) else 0 end""",
        )

    def read(groups):
        weighed = each(
            groups,
            lambda g: f"""named_struct('w', coalesce(array_max({weights(g)}), 0),
                'rules', regexp_extract_all({g}, {lit('(?m)^[ad]:.+$')}, 0))""",
        )

        def best(found):
            top = f"array_max({each(found, lambda g: f'{g}.w')})"
            return let(
                top,
                lambda t: each(
                    "flatten("
                    + each(
                        keep(found, lambda g: f"{g}.w > 0 and {g}.w = {t}"),
                        lambda g: f"{g}.rules",
                    )
                    + ")",
                    _rule,
                ),
            )

        return let(weighed, best)

    return let(f"split({marked}, {lit(_BREAK)})", read)


def _rule(text: Sql) -> Sql:
    """The literal parts of a pattern between its ``*``, and whether a ``$`` ends it."""

    def build(pattern):
        body = f"regexp_replace({pattern}, '[$]$', '')"
        return f"""named_struct('allow', startswith({text}, 'a:'), 'pattern', {pattern},
            'parts', split({body}, '[*]'), 'ends', endswith({pattern}, '$'))"""

    return let(f"substr({text}, 3)", build)


def pattern_matches(path: Sql, rule: Sql) -> Sql:
    """Whether a path matches a rule, in one pass over the path.

    The first part must begin the path; every other is looked for from where the one before
    ended, and the first place is always the best one, so nothing is ever tried again. With
    ``$`` the last part must be the path's end, at or after that place.
    """
    at, part = variable(), variable()
    first, last = f"{rule}.parts[0]", f"element_at({rule}.parts, -1)"
    middle = f"slice({rule}.parts, 2, size({rule}.parts) - 1 - if({rule}.ends, 1, 0))"
    # The place (from 1) after the parts found so far; 0 when one was not found.
    place = f"""aggregate({middle}, length({first}) + 1, ({at}, {part}) ->
        if({at} = 0 or {part} = '', {at}, {let(f"locate({part}, {path}, {at})", lambda p: f"if({p} = 0, 0, {p} + length({part}))")}))"""
    room = f"length({path}) - length({last}) + 1"
    wild = let(place, lambda p: f"{p} > 0 and (not {rule}.ends or ({room} >= {p} and endswith({path}, {last})))")
    return f"""(startswith({path}, {first}) and
        case when size({rule}.parts) > 1 then {wild} when {rule}.ends then {path} = {first} else true end)"""


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """(robots_url, rules) of every robots file that exists; a 404 means no rules."""
    return robots.where("status <> 404").selectExpr(
        "robots_url", f"{rules_for('body', agent)} as rules"
    )


def robots_decisions(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """Every URL with ``allowed`` and the ``rule`` that decided, NULL if none did.

    Longest matching pattern wins, allow wins ties; without a robots file or a
    matching rule a URL is allowed.
    """
    rules = robots_rules(robots, agent)
    matches = keep("rules", lambda r: pattern_matches("path", r))
    ranked = each(
        matches,
        lambda r: f"named_struct('n', length({r}.pattern), 'allow', {r}.allow, 'p', {r}.pattern)",
    )
    path = let(url_path("url"), lambda p: f"if({p} = '', '/', {p})")
    return (
        urls.withColumn("robots_url", F.expr(robots_url("url")))
        .join(rules, "robots_url", "left")
        .withColumn("path", F.expr(path))
        .withColumn("decided", F.expr(f"array_max({ranked})"))
        .select(
            *urls.columns,
            F.coalesce("decided.allow", F.lit(True)).alias("allowed"),
            F.col("decided.p").alias("rule"),
        )
    )


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """The URLs ``agent`` may fetch."""
    return robots_decisions(urls, robots, agent).where("allowed").select(*urls.columns)
