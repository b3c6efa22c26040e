"""Personal data in documents: four base patterns and a character LSTM with CRF transitions.

Base patterns give e-mail, IP, card and phone spans by rule. A tagger (``char_lstm``) is
trained on the driver from labelled spans: windows of a bounded sample of the documents
with their base spans, windows into which spans in formats that the rules do not know
were put, and windows without any. It then reads every text in windows of ``WIDTH`` that
overlap by half. Each window is decoded by itself; spans cut by a window's edge are left to
the neighbour that holds them whole. A text's windows are reconciled together: a span's
weight is its mean certainty over the windows that hold it (a window that did not find it
counts as 0), and of all spans of the text the set without overlaps that has the greatest
total weight stays. Base spans stay in any case; what the tagger adds lies outside them.

A span must hold a digit or an @, so windows without either cannot hold one and are not
decoded. An added span has at most ``WIDTH / 2 - 1`` characters and must be possible: a card
passes Luhn, IP parts are at most 255, phones have 7 to 15 digits, an address an @.

A null text counts as empty. Rows are independent: repeated rows give repeated results,
an empty table an empty one, other columns are ignored; a null doc_id stays null. Texts of
any length are read whole, window by window. The patterns are linear in the text's length.
"""

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weblens.llm import char_lstm
from weblens.llm.common import slices, workspace
from weblens.shipping import ship_package

KINDS = ("email", "ip", "card", "phone")
SHOWN = (*KINDS, *[f"learned_{k}" for k in KINDS])

#: The rules' patterns; possessive, and begun only where a match can begin, so that none runs twice over a text.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
_DIGIT = frozenset("0123456789")
_DIALLED = frozenset("0123456789 ().-")
_TRIGGER = re.compile(r"[0-9@]+")

WIDTH = 96
STRIDE = WIDTH // 2
CERTAIN = 0.5
SAMPLE = 16_384  # documents read for training
EXAMPLES = 160  # windows of each kind and of each source of examples

SPAN = "array<struct<kind:int,start:int,end:int>>"
FOUND = f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, all_spans {SPAN}, n_learned long"
_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


# --- base spans ---------------------------------------------------------------


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(v if n % 2 == 0 else v * 2 - 9 * (v > 4) for n, v in enumerate(values)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def _phones(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("+")
    while at >= 0:
        end = at + 1
        if text[end : end + 1] in _DIGIT:
            end += 1
            while end < len(text) and text[end] in _DIALLED:
                end += 1
            while text[end - 1] not in _DIGIT:
                end -= 1
        if end > at + 3:  # a first digit, one character or more, a last digit
            yield at, end
        at = text.find("+", max(end, at + 1))


def raw_spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, whether its checks hold) of every match, by kind, then start."""
    if not _TRIGGER.search(text):
        return []
    out = [(0, a, b, True) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        out.append((1, *m.span(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))))
    for m in _CARD.finditer(text):
        # a run longer than 19 digits with as many blanks is no card, and is not looked at again
        digits = _digits(m.group()) if m.end() - m.start() <= 37 else ""
        out.append((2, *m.span(), 13 <= len(digits) <= 19 and luhn(digits)))
    out += [(3, a, b, 9 <= len(_digits(text[a:b])) <= 15) for a, b in (_phones(text) if "+" in text else ())]
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every base span, by kind, then start."""
    return [(k, a, b) for k, a, b, good in raw_spans(text) if good]


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


# --- training ------------------------------------------------------------------


def variant(kind: int, draw: np.random.Generator) -> str:
    """A span of a kind in one of the usual formats, known to the rules or not."""

    def number(n: int) -> str:
        return "".join(str(d) for d in draw.integers(0, 10, n))

    def word(least: int, most: int) -> str:
        return "".join(chr(97 + c) for c in draw.integers(0, 26, draw.integers(least, most + 1)))

    form = int(draw.integers(0, 6))
    if kind == 0:
        local = word(2, 9) + ("." + word(2, 7) if form % 2 else "") + (number(2) if form > 3 else "")
        mark = ("@", "@", " @ ", "@ ", "[@]", "(@)")[form]
        return local + mark + word(3, 8) + "." + (word(3, 6) + "." if draw.random() < 0.3 else "") + ("com", "org", "net", "de", "io", "edu")[int(draw.integers(0, 6))]
    if kind == 1:
        mark = (".", ".", "[.]", " . ", "-", "(.)")[form]
        return mark.join(str(int(x)) for x in draw.integers(0, 256, 4))
    if kind == 2:
        body = number(15)
        body += next(d for d in "0123456789" if luhn(body + d))
        mark = ("", " ", "-", ".", "/", "_")[form]
        return mark.join(body[i : i + 4] for i in range(0, 16, 4))
    a, b, c = number(3), number(3), number(4)
    return (f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{int(draw.integers(1, 90))} {a} {b} {c}", f"+{int(draw.integers(1, 90))} {a}/{b}{c}")[form]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows with a base span (source: its kind), without one (4) and without digits (5)."""
    schema = pa.schema([("source", pa.int32()), ("window", pa.string()), ("spans", _SPAN)])
    for batch in slices(batches, "text"):
        rows = []
        for text in batch["text"].to_pylist():
            raw = raw_spans(text or "")
            whole = [(k, a, b) for k, a, b, good in raw if good]
            # a match that failed its checks is neither personal data nor surely not
            unclear = [(a, b) for k, a, b, good in raw if not good and b - a > 8 and not any(a < y and x < b for _, x, y in whole)]
            starts = {max(0, a - (7919 * a + b) % max(WIDTH - (b - a), 1)) for _, a, b in whole}
            starts |= {max(0, m.start() - STRIDE) for m, _ in zip(_TRIGGER.finditer(text or ""), range(8))} | {0, len(text or "") // 2}
            for start in sorted(starts):
                end = min(start + WIDTH, len(text or ""))
                if any(a < end and start < b for a, b in unclear) or any(a < start < b or a < end < b for _, a, b in whole):
                    continue
                window = text[start:end] if text else ""
                spans, last = [], -1
                for k, a, b in sorted((x for x in whole if start <= x[1] and x[2] <= end), key=lambda s: s[1]):
                    if a - start >= last:
                        spans.append({"kind": k, "start": a - start, "end": b - start})
                        last = b - start
                source = spans[0]["kind"] if spans else 4 if _TRIGGER.search(window) else 5
                rows.append((source, window, spans))
        columns = list(zip(*rows)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def tags_of(spans: list[tuple[int, int, int]], length: int) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for k, a, b in spans:
        tags[a:b] = 2 * k + 2
        tags[a] = 2 * k + 1
    return tags


def training_set(rows: list[tuple[int, str, list[tuple[int, int, int]]]], examples: int = EXAMPLES, seed: int = 3):
    """(windows, tags) of drawn examples and of clear windows with variants put in."""
    draw = np.random.default_rng(seed)
    windows, tags = [w for _, w, _ in rows], [tags_of(s, len(w)) for _, w, s in rows]
    clear = [w for source, w, _ in rows if source == 5]
    for n in range(examples * len(KINDS) if clear else 0):
        text, window, spans = clear[int(draw.integers(0, len(clear)))], "", []
        at = int(draw.integers(0, STRIDE))
        window = text[:at].rstrip() + " " if at else ""
        for kind in [n % len(KINDS), *draw.integers(0, len(KINDS), int(draw.random() < 0.3))]:
            span = variant(int(kind), draw)
            spans.append((int(kind), len(window), len(window) + len(span)))
            window += span + (" ", " ", ", ", ". ", "\n", ") ")[int(draw.integers(0, 6))]
        window = (window + text[at:].lstrip())[:WIDTH]
        windows.append(window)
        tags.append(tags_of([s for s in spans if s[2] <= len(window)], len(window)))
    return windows, tags


def fit(docs: DataFrame, sample: int = SAMPLE, examples: int = EXAMPLES) -> char_lstm.Tagger:
    """Train on at most ``examples`` windows of each source from about ``sample`` documents."""
    space = workspace(docs.sparkSession, "personal")
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, sample / max(docs.count(), 1)) * (1 << 30))
    found = texts.where(share).select("text").mapInArrow(_examples, f"source int, window string, spans {SPAN}")
    found = space.table("examples", found.dropDuplicates(["source", "window"]))
    drawn = []
    for source in range(len(KINDS) + 2):  # a top list each, which no task collects whole
        rows = found.where(F.col("source") == source).orderBy(F.xxhash64("window"), "window").limit(examples).collect()
        drawn += [(r["source"], r["window"], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in rows]
    windows, tags = training_set(sorted(drawn), examples)
    return char_lstm.train(windows, tags, len(KINDS), WIDTH)


# --- decoding and reconciling ---------------------------------------------------


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an @."""
    numbers: set[int] = set()
    for m in _TRIGGER.finditer(text):
        numbers.update(range(max(m.start() // STRIDE - 1, 0), (m.end() - 1) // STRIDE + 1))
    return [n * STRIDE for n in sorted(numbers)]


def possible(kind: int, text: str) -> bool:
    """Whether a found span can be of its kind at all."""
    digits = _digits(text)
    if kind == 0:
        local, mark, domain = text.partition("@")
        return bool(mark) and any(c.isalnum() for c in local) and "." in domain and any(c.isalpha() for c in domain)
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search(r"[A-Za-z]", text)
    if re.search(r"[A-Za-z@]", text):
        return False
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15 and len(digits) * 3 >= len(text)


def _holds(start: int, length: int, a: int, b: int) -> bool:
    """Whether the window that begins at ``start`` holds a span with a character to spare, or the text ends there."""
    return (start < a or start == 0) and (b < start + WIDTH or b == length) and b <= start + WIDTH


def reconcile(text: str, found: list[tuple[int, list[tuple[int, int, int, float]]]], certain: float = CERTAIN) -> list[tuple[int, int, int]]:
    """(kind, start, end): of all windows' spans the heaviest set without overlaps.

    ``found`` holds (start of a window, its spans in the window's own places).
    """
    votes: dict[tuple[int, int, int], float] = {}
    starts = {start for start, _ in found}
    for start, spans in found:
        for kind, a, b, sure in spans:
            if _holds(start, len(text), start + a, start + b) and possible(kind, text[start + a : start + b]):
                key = (start + b, start + a, kind)
                votes[key] = votes.get(key, 0.0) + sure
    weights = []
    for (b, a, kind), total in votes.items():
        near = range(max((b - WIDTH) // STRIDE, 0), a // STRIDE + 1)
        held = sum(n * STRIDE in starts and _holds(n * STRIDE, len(text), a, b) for n in near)
        weights.append((b, a, kind, total / max(held, 1)))
    weights = sorted(w for w in weights if w[3] >= certain)
    best: list[tuple[float, int, bool]] = [(0.0, 0, False)]  # total, spans before this one that fit, taken
    ends = [w[0] for w in weights]
    for n, (b, a, kind, weight) in enumerate(weights):
        before = int(np.searchsorted(ends[:n], a, "right"))
        with_it = best[before][0] + weight
        best.append((with_it, before, True) if with_it > best[n][0] else (best[n][0], n, False))
    out, n = [], len(weights)
    while n:
        _, before, taken = best[n]
        if taken:
            b, a, kind, _ = weights[n - 1]
            out.append((kind, a, b))
        n = before
    return sorted(out)


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], net: char_lstm.Tagger) -> list[list[tuple[int, int, int]]]:
    """Per text, the tagger's spans that no base span touches, by kind, then start."""
    owners, starts = [], []
    for number, text in enumerate(texts):
        own = window_starts(text)
        owners += [number] * len(own)
        starts += own
    found: list[list] = [[] for _ in texts]
    for first in range(0, len(starts), 1024):
        some = range(first, min(first + 1024, len(starts)))
        spans = net.spans([texts[owners[i]][starts[i] : starts[i] + WIDTH] for i in some], WIDTH)
        for i, s in zip(some, spans):
            found[owners[i]].append((starts[i], s))
    out = []
    for text, own, windows in zip(texts, base, found):
        new = reconcile(text, windows) if windows else []
        taken = united(own)
        ends = [b for _, b, _ in taken]
        out.append([(k, a, b) for k, a, b in new if (n := bisect_right(ends, a)) == len(taken) or taken[n][0] >= b])
    return out


def united(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kind) by start; spans that overlap are one, of the first one's kind."""
    out: list[tuple[int, int, int]] = []
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b), out[-1][2])
        else:
            out.append((a, b, k))
    return out


def scan(docs: DataFrame, net: char_lstm.Tagger) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text).

    Columns: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, all_spans
    (array of kind, start, end by kind, then start; kinds from 4 on are the tagger's), n_learned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch["text"].to_pylist()]
            base = [base_spans(t) for t in texts]
            added = added_spans(texts, base, net)
            counts = [[sum(k == kind for k, _, _ in spans) for spans in base] for kind in range(len(KINDS))]
            every = [[*own, *[(k + len(KINDS), a, b) for k, a, b in new]] for own, new in zip(base, added)]
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in every]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *[pa.array(c, pa.int64()) for c in counts], pa.array([digest(s) for s in base]), pa.array(rows, _SPAN), pa.array([len(a) for a in added], pa.int64())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "all_spans", "n_learned"],
            )

    workspace(docs.sparkSession, "personal")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, FOUND)


def shown(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in SHOWN])
    return F.concat_ws(
        ",",
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))),
    )


def redact(docs: DataFrame, net: char_lstm.Tagger) -> DataFrame:
    """``docs`` with every found span of a text replaced by its kind in brackets; all columns stay, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch["text"].to_pylist()
            plain = [t or "" for t in texts]
            base = [base_spans(t) for t in plain]
            out = []
            for text, own, new in zip(texts, base, added_spans(plain, base, net)):
                for a, b, kind in reversed(united([*own, *new])):
                    text = f"{text[:a]}[{KINDS[kind].upper()}]{text[b:]}"
                out.append(text)
            at = batch.schema.get_field_index("text")
            columns = list(batch.columns)
            columns[at] = pa.array(out, batch.schema.field("text").type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    ship_package()
    return docs.mapInArrow(run, docs.schema)
