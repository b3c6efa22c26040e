"""Retry rules as SQL expressions."""

from weblens.functions.core import Sql

# Retryable answers and the default backoff.
RETRYABLE_STATUS = [429, 500, 502, 503, 504]
RATE_LIMITED = 429
MAX_RETRIES = 3
INITIAL_BACKOFF_MS = 1000
MAX_BACKOFF_MS = 30000
JITTER = 0.2
#: The last second that a timestamp of four-digit years holds; no wait ends later.
LATEST_US = 253_402_300_799_000_000


def retryable(status: Sql = "status_code", error: Sql = "error") -> Sql:
    """True for a network error or a retryable status."""
    codes = ", ".join(str(c) for c in RETRYABLE_STATUS)
    return f"({error} is not null or coalesce({status} in ({codes}), false))"


def nominal_backoff_ms(attempt: Sql, status: Sql | None = None) -> Sql:
    """Initial wait doubled per attempt, up to the maximum; doubled again for rate limits."""
    # Five doublings already exceed the maximum.
    base = (
        f"least({INITIAL_BACKOFF_MS} * shiftleft(1L, cast(least({attempt}, 5) as int)), "
        f"{MAX_BACKOFF_MS}L)"
    )
    if status is None:
        return base
    return f"({base} * if({status} = {RATE_LIMITED}, 2L, 1L))"


def backoff_ms(attempt: Sql, status: Sql, percent: Sql) -> Sql:
    """Backoff with jitter; ``percent`` 0..99 spreads it over -20 % to +20 %."""
    factor = f"(1 + {JITTER}D * (2 * {percent} / 100D - 1))"
    waited = f"cast(round({nominal_backoff_ms(attempt)} * {factor}) as bigint)"
    return f"({waited} * if({status} = {RATE_LIMITED}, 2L, 1L))"


def nominal_us(fails: int) -> int:
    """The wait after a host's n-th failure in a row, in microseconds."""
    return min(INITIAL_BACKOFF_MS * 2 ** min(fails, 5), MAX_BACKOFF_MS) * 1000


def backoff_step(fails: int, until: int, ts: int, status: int, failed: bool) -> tuple[int, int]:
    """New (fails, backoff_until) of a host after one answer; times in microseconds, 0 for none.

    A failure inside a running backoff waits for what remains of it, otherwise
    for the nominal time; a rate limit doubles the wait. 200 clears the state.
    """
    if failed:
        fails += 1
        wait = until - ts if ts < until else nominal_us(fails)
        return fails, min(ts + wait * (2 if status == RATE_LIMITED else 1), LATEST_US)
    if status == 200:
        return 0, 0
    return fails, until
