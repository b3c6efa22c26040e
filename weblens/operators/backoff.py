"""Backoff of every host over a whole fetch log, by the rule that a running crawl follows.

A host's state is its number of failures and the moment until which it waits. An answer
changes it by ``functions.retry.backoff_step``: a failure inside a wait keeps what remains of
it (a rate limit doubles that), any other waits for the nominal time, 200 clears the state.

A busy host is not walked through by one task. What a chunk of its log does is a function of
the state before it, and is summed up without knowing that state: with a 200 in the chunk the
result is fixed; without one the failures add up, and the new wait is a function of the old
one that is constant on some intervals (the old wait ends before the next failure, and a
nominal one begins) and linear above them (it outlasts the chunk). The constants depend on
the number of failures before, of which only 0 to 4 and "more" differ, and on that only for a
chunk's first failures. A summary has at most one interval a failure since the chunk's begin,
two numbers each. Summaries are put together host by host in order of time, streamed and not
held, and every chunk then takes its rows through the state it begins with.
"""

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weblens.functions.retry import LATEST_US, RATE_LIMITED, backoff_step, nominal_us, retryable
from weblens.operators.chunks import with_chunks, with_unplaced
from weblens.shipping import ship_package
from weblens.workspace import Workspace

_ORDER = ["ts", "url", "attempt"]
_NEUTRAL, _FAILED, _LIMITED, _OK = 0, 1, 2, 3
_CLASSES = 6  # failures before a chunk: 0 to 4, and 5 or more

_SUMMARY = "host string, chunk long, fails long, until long, breaks array<long>, ends array<long>, doublings int, minus string"
_ENTRY = "host string, chunk long, fails_0 long, until_0 long"


def kind_of_answer() -> str:
    """SQL for the kind of an attempt's answer."""
    return f"""cast(case when {retryable()} then if(coalesce(status_code = {RATE_LIMITED}, false), {_LIMITED}, {_FAILED})
        when status_code = 200 then {_OK} else {_NEUTRAL} end as int)"""


def step(state: tuple[int, int], ts: int, kind: int) -> tuple[int, int]:
    """The state after one answer."""
    if kind == _NEUTRAL:
        return state
    if kind == _OK:
        return 0, 0
    return backoff_step(*state, ts, RATE_LIMITED if kind == _LIMITED else 500, True)


def summarise(times: list[int], kinds: list[int]) -> tuple:
    """(fails, until, breaks, ends, doublings, minus) of a chunk's answers in order.

    With a 200 in the chunk, ``until`` is set, and it and ``fails`` are the state after it.
    Without one, ``fails`` is added; a wait u becomes the end of the first interval whose
    break is not below u (the first few intervals have one for each class of failures before,
    the others one), or, above all breaks, 2 ** doublings * u - minus, no later than the last
    moment there is.
    """
    if _OK in kinds:
        last = len(kinds) - 1 - kinds[::-1].index(_OK)
        fails, until, breaks, ends, doublings, minus = summarise(times[last + 1 :], kinds[last + 1 :])
        return fails, after(0, 0, (fails, None, breaks, ends, doublings, minus))[1], [], [], 0, "0"
    failed = [(t, k) for t, k in zip(times, kinds) if k != _NEUTRAL]
    t, limited = [x for x, _ in failed], [k == _LIMITED for _, k in failed]
    n = len(t)
    following = [n] * (n + 1)  # the next rate limit from each place on
    for j in reversed(range(n)):
        following[j] = j if limited[j] else following[j + 1]

    def outcome(u: int, j: int, done: list[int]) -> int:
        """The wait after the chunk, if it is u after failure j."""
        at = j + 1
        while True:
            limit = following[at] if at <= n else n
            met = bisect_left(t, u, at, min(limit + 1, n))
            if met < min(limit + 1, n):
                return done[met]
            if limit >= n:
                return u
            u, at = min(2 * u - t[limit], LATEST_US), limit + 1

    per_class: list[list[int]] = []
    for before in reversed(range(_CLASSES)):
        # From the sixth failure of a host on, every wait is the longest one.
        done = list(per_class[0]) if per_class else [0] * n
        for j in reversed(range(n if not per_class else min(n, _CLASSES))):
            wait = nominal_us(before + j + 1) * (2 if limited[j] else 1)
            done[j] = outcome(min(t[j] + wait, LATEST_US), j, done)
        per_class.insert(0, done)

    breaks, early, late, doublings, minus = [], [], [], 0, 0
    for j in range(n):
        bound = (t[j] + minus) >> doublings  # a wait above it outlasts failure j
        if not breaks or bound > breaks[-1]:
            mine = [done[j] for done in per_class]
            if late and set(mine) == {late[-1]}:
                breaks[-1] = bound
            else:
                breaks.append(bound)
                if j < _CLASSES:
                    early += mine
                else:
                    late.append(mine[0])
        if limited[j]:
            doublings, minus = doublings + 1, 2 * minus + t[j]
            if doublings > 64:  # what outlasted so many has no end
                break
    return n, None, breaks, early + late, doublings, str(minus)


def after(fails: int, until: int, summary: tuple) -> tuple[int, int]:
    """The state after a chunk that begins with (fails, until)."""
    added, fixed, breaks, ends, doublings, minus = summary
    if fixed is not None:
        return added, fixed
    if not added:
        return fails, until
    at = bisect_left(breaks, until)
    if at < len(breaks):
        early = (len(ends) - len(breaks)) // (_CLASSES - 1)  # intervals with an end for each class
        place = at * _CLASSES + min(fails, _CLASSES - 1) if at < early else early * _CLASSES + at - early
        return fails + added, ends[place]
    return fails + added, min((until << doublings) - int(minus), LATEST_US)


def _summaries(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["us", "url", "attempt"])
    found = summarise(rows["us"].tolist(), rows["kind"].tolist())
    out = pd.DataFrame({"host": [rows["host"].iloc[0]], "chunk": [rows["chunk"].iloc[0]], "fails": [found[0]]})
    return out.assign(until=pd.array([found[1]], "Int64"), breaks=[found[2]], ends=[found[3]], doublings=found[4], minus=found[5])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before each chunk, from summaries in order of host and time."""
    host, state = None, (0, 0)
    for batch in batches:
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        before = []
        for n, name in enumerate(columns["host"]):
            if name != host:
                host, state = name, (0, 0)
            before.append(state)
            state = after(*state, tuple(columns[c][n] for c in ("fails", "until", "breaks", "ends", "doublings", "minus")))
        arrays = [batch.column("host"), batch.column("chunk"), *(pa.array(x, pa.int64()) for x in (zip(*before) if before else ((), ())))]
        yield pa.RecordBatch.from_arrays(arrays, names=["host", "chunk", "fails_0", "until_0"])


def _walk(rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["us", "url", "attempt"])
    state = (int(entry["fails_0"].iloc[0]), int(entry["until_0"].iloc[0]))
    states = []
    for us, kind in zip(rows["us"].tolist(), rows["kind"].tolist()):
        state = step(state, us, kind)
        states.append(state)
    fails, until = zip(*states)
    return rows.assign(fails=fails, until=until).drop(columns=["chunk", "kind"])


def host_backoff(log: DataFrame, chunk_seconds: int = 86_400) -> DataFrame:
    """``log`` with the host's ``fails`` and ``backoff_until`` after each attempt.

    Attempts count in order of ts, url, attempt. Rows without host or time stay, with null
    results; a host that does not wait has a null ``backoff_until``. A wait that rate limits
    double without end stops at ``LATEST_US``.
    """
    ship_package()
    chunked = with_chunks(log, "host", _ORDER, chunk_seconds, "backoff")
    rest = [f"`{c}`" for c in log.columns if c != "ts"]
    rows = chunked.select(*rest, "chunk", F.unix_micros("ts").alias("us"), F.expr(kind_of_answer()).alias("kind"))
    summaries = rows.select("host", "chunk", "us", "url", "attempt", "kind").groupBy("host", "chunk").applyInPandas(_summaries, _SUMMARY)
    ordered = summaries.repartition("host").sortWithinPartitions("host", "chunk")
    entries = Workspace(log.sparkSession, "backoff-states").table("entries", ordered.mapInArrow(_entries, _ENTRY))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema.fields if f.name != "ts")
    walked = rows.groupBy("host", "chunk").cogroup(entries.groupBy("host", "chunk")).applyInPandas(_walk, f"{kinds}, us long, fails long, until long")
    ts, end = F.timestamp_micros("us").alias("ts"), F.when(F.col("until") > 0, F.timestamp_micros("until")).alias("backoff_until")
    columns = [ts if c == "ts" else F.col(f"`{c}`") for c in log.columns]
    return with_unplaced(walked.select(*columns, "fails", end), log, "host")
