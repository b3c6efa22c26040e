"""Small helpers shared by the expression modules.

The expression modules write Spark SQL text. Every function takes SQL
expressions (usually column names) and returns one, to be used with
``F.expr``, ``selectExpr`` or inside ``spark.sql``. A long expression is thus
parsed in one step; built from ``Column`` calls it costs thousands of
round trips to the JVM.
"""

from collections.abc import Callable
from itertools import count

Sql = str
_fresh = count()


def lit(text: str) -> Sql:
    """SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    escaped = escaped.replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return f"'{escaped}'"


def variable() -> Sql:
    """A lambda variable name not used elsewhere."""
    return f"v{next(_fresh)}"


def let(value: Sql, body: Callable[[Sql], Sql]) -> Sql:
    """Evaluate ``value`` once and use it any number of times inside ``body``.

    A one-element array transform binds the value; without it, every use of a
    long expression would repeat the whole expression.
    """
    v = variable()
    return f"transform(array({value}), {v} -> {body(v)})[0]"


def each(array: Sql, body: Callable[[Sql], Sql]) -> Sql:
    v = variable()
    return f"transform({array}, {v} -> {body(v)})"


def each_indexed(array: Sql, body: Callable[[Sql, Sql], Sql]) -> Sql:
    v, i = variable(), variable()
    return f"transform({array}, ({v}, {i}) -> {body(v, i)})"


def keep(array: Sql, test: Callable[[Sql], Sql]) -> Sql:
    v = variable()
    return f"filter({array}, {v} -> {test(v)})"


def uniform(*parts: Sql) -> Sql:
    """Repeatable uniform number in [0, 1) from the md5 of the given columns."""
    text = ", ".join(f"cast({p} as string)" for p in parts)
    return f"(cast(conv(substr(md5(concat_ws('|', {text})), 1, 8), 16, 10) as double) / 4294967296D)"


def percent_of(*parts: Sql) -> Sql:
    """Repeatable whole number 0..99 from the md5 of the given columns."""
    text = ", ".join(f"cast({p} as string)" for p in parts)
    return f"(cast(conv(substr(md5(concat_ws('|', {text})), 1, 8), 16, 10) as bigint) % 100)"


def rfc3339(ts: Sql) -> Sql:
    """Timestamp as RFC 3339 text in the session time zone."""
    return f"""date_format({ts}, "yyyy-MM-dd'T'HH:mm:ssXXX")"""


def parse_rfc3339(text: Sql) -> Sql:
    """RFC 3339 text, with or without fractional seconds, as a timestamp; NULL if malformed."""
    return f"try_to_timestamp({text})"
