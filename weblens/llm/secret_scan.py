"""Secrets in documents: three base patterns and a battery of randomness tests.

Base patterns give spans by rule. Of every run of 20 or more key characters, what
the base spans leave is a candidate, and so are its parts: those between separators
(/ _ - +, by each choice of them, as keys may hold some themselves) and the stretches
of pieces between words. A candidate's encoding is inferred, and three tests ask whether
its characters could be uniform draws from that alphabet (chi-squared frequencies, runs
about the median, lag-one serial correlation). A candidate that fails any of them is no
secret. For the rest the null hypothesis is ordinary text: a chi-squared value too
small for text's letter frequencies and too many changes of character class give a
p-value, and Benjamini-Hochberg within each length class decides over all candidates of
the corpus, so that short ones, of which there are many, need stronger evidence.
Accepted candidates that overlap are one span.

A null text counts as empty. Rows are independent: repeated rows give repeated
results, an empty table an empty one, and other columns are ignored.
"""

import hashlib
import itertools
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weblens.llm.common import as_row, emit, released, text_key, workspace

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # 16 characters or more in all
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
MIN_LENGTH = 20
SEPARATORS = "/_-+"
#: For each choice of separators the parts between them.
PARTS = {
    chosen: re.compile(f"[^{re.escape(''.join(chosen))}]{{{MIN_LENGTH},}}")
    for n in range(1, len(SEPARATORS) + 1)
    for chosen in itertools.combinations(SEPARATORS, n)
}
PIECE = re.compile(r"[^/_+-]+")
#: Words and numbers as in paths and names; random pieces of three characters or more are rarely so.
#: Possessive over whole runs of one case, so that a piece is read once: runs of small letters have three or
#: more, runs of capitals three or more, or one before small letters.
WORDLIKE = re.compile(r"(?=[A-Za-z])(?:(?:[A-Z]{3,}+|[A-Z])?[a-z]{3,}+)*+(?:[A-Z]{3,}+)?[0-9]{0,3}|[0-9]{2,8}|v[0-9]{1,3}")
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE = 8

#: Alphabets in order of inference, smallest first: fixed values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Letter shares of English text in percent, a to z: fixed values, used as a prior.
LETTERS = dict(
    zip(
        "abcdefghijklmnopqrstuvwxyz",
        (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074),
    )
)
PRIOR_LETTERS = 1000  # weight of that prior in letters
OTHER_SHARE = 0.03  # share of text's characters that are digits or marks
CAPITAL_SHARE = 0.05
SWITCH_SHARE = 0.08  # chance that a word's next character is of another class
ALPHA = 0.001  # level of the randomness tests
LENGTHS = (20, 28, 40, 64)  # lower ends of the length classes
BINS_PER_DECADE = 10
MAX_BIN = 3000

SPAN = "array<struct<start:int,kind:int,end:int>>"
SCAN = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_key", pa.int64()),
        ("n_assign", pa.int64()),
        ("n_access", pa.int64()),
        ("n_hex", pa.int64()),
        ("base_sha256", pa.string()),
        ("base", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))),
        ("found", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("token", pa.string())]))),
    ]
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every base match, by start, then kind."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= MIN_VALUE]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (start, end) with those that overlap made one, by start."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _left(start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What the united spans ``taken`` leave of a run."""
    at = max(bisect_right(taken, (start, end)) - 1, 0)
    for i in range(at, len(taken)):
        s, e = taken[i]
        if s >= end:
            break
        if start < s:
            yield start, s
        start = max(start, e)
    if start < end:
        yield start, end


def parts(run: str) -> set[tuple[int, int]]:
    """(start, end) of a run without padding and of all its parts of 20 characters or more."""
    out = {(0, len(run))}
    held = set(SEPARATORS).intersection(run)
    for chosen, pattern in PARTS.items():
        if held.issuperset(chosen):
            out.update(m.span() for m in pattern.finditer(run))
    first, last = 0, 0
    for m in PIECE.finditer(run) if held else ():
        if WORDLIKE.fullmatch(m.group()):
            out.add((first, last))
            first, last = m.end(), m.end()
        else:
            first, last = (m.start() if first == last else first), m.end()
    return {(a, b) for a, b in out | {(first, last)} if b - a >= MIN_LENGTH}


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of every candidate outside the base spans, with its padding."""
    out, taken = [], united([(s, e) for s, _, e in spans])
    for m in CANDIDATE.finditer(text):
        for start, end in _left(*m.span(), taken):
            run = text[start:end].rstrip("=")
            out += [(start + a, end if b == len(run) else start + b) for a, b in sorted(parts(run))]
    return out


@released
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part, rows = batch.slice(start, 256), []
            for doc_id, text_key, value in zip(part["doc_id"].to_pylist(), part["text_key"].to_pylist(), part["text"]):
                text = value.as_py() or ""
                spans = base_spans(text)
                found = [{"start": s, "end": e, "token": text[s:e]} for s, e in candidates(text, spans)]
                counts = [sum(k == kind for _, k, _ in spans) for kind in range(3)]
                base = [{"start": s, "kind": k, "end": e} for s, k, e in spans]
                rows.append((doc_id, text_key, *counts, digest(spans), base, found))
            if rows:
                yield emit(rows, SCAN)


# --- the tests of one candidate -------------------------------------------


def _upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _upper_chi2(x: float, mean: float, variance: float) -> float:
    """Upper tail of a gamma with that mean and variance, by the cube-root normal approximation."""
    shape = mean * mean / variance
    z = ((x / mean) ** (1 / 3) - (1 - 1 / (9 * shape))) * math.sqrt(9 * shape)
    return _upper_normal(z)


def encoding(token: str) -> str:
    """The smallest alphabet that holds every character (padding aside)."""
    used = set(token.rstrip("="))
    return next((name for name, symbols in ALPHABETS.items() if used <= set(symbols)), "base64")


def chi_squared(token: str, alphabet: str) -> float:
    n, k = len(token), len(alphabet)
    return k / n * sum(token.count(c) ** 2 for c in set(token)) - n


def is_random(token: str, alphabet: str) -> bool:
    """Whether no test of the battery rejects uniform draws from the alphabet."""
    n, k = len(token), len(alphabet)
    at = {c: i for i, c in enumerate(alphabet)}
    values = [at.get(c, 0) for c in token]
    p = [_upper_chi2(max(chi_squared(token, alphabet), 1e-9), k - 1, 2 * (k - 1) * (n - 1) / n)]
    above = [v >= k / 2 for v in values]
    a, b = sum(above), n - sum(above)
    if a and b:
        runs = 1 + sum(x != y for x, y in zip(above, above[1:]))
        mean = 1 + 2 * a * b / n
        variance = 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        p.append(2 * _upper_normal(abs(runs - mean) / math.sqrt(max(variance, 1e-9))))
    else:
        p.append(2 * 0.5 ** n)
    mean = sum(values) / n
    spread = sum((v - mean) ** 2 for v in values)
    if spread:
        r = sum((x - mean) * (y - mean) for x, y in zip(values, values[1:])) / spread
        p.append(2 * _upper_normal(abs(r + 1 / n) * math.sqrt(n)))
    else:
        p.append(0.0)
    return min(p) * len(p) >= ALPHA


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2


def text_p(token: str, alphabet: str, letters: dict[str, float]) -> float:
    """p-value of the candidate if it were ordinary text."""
    n, k = len(token), len(alphabet)
    capitals = any(c.isupper() for c in token)
    shares, others = {}, [c for c in alphabet if not c.isalpha()]
    both = any(c.islower() for c in alphabet) and any(c.isupper() for c in alphabet)
    for c in alphabet:
        if c.isalpha():
            part = letters[c.lower()] * (1 - OTHER_SHARE if others else 1)
            shares[c] = part * ((CAPITAL_SHARE if c.isupper() else 1 - CAPITAL_SHARE) if both else 1)
        else:
            shares[c] = OTHER_SHARE / len(others)
    total = sum(shares.values())
    moment = [sum((s / total) ** j for s in shares.values()) for j in (2, 3)]
    mean = k * (1 + (n - 1) * moment[0]) - n
    variance = 2 * k * k * (n - 1) / n * (moment[0] - moment[0] ** 2 + 2 * (n - 2) * (moment[1] - moment[0] ** 2))
    p_chi = _upper_normal((mean - chi_squared(token, alphabet)) / math.sqrt(max(variance, 1e-9)))
    switches = sum(_class(x) != _class(y) for x, y in zip(token, token[1:])) if capitals or others else 0
    p_switch = sum(
        math.comb(n - 1, i) * SWITCH_SHARE**i * (1 - SWITCH_SHARE) ** (n - 1 - i) for i in range(switches, n)
    ) if n <= 200 else _upper_normal((switches - 0.5 - (n - 1) * SWITCH_SHARE) / math.sqrt((n - 1) * SWITCH_SHARE * (1 - SWITCH_SHARE)))
    x = max(p_chi, 1e-300) * max(min(p_switch, 1.0), 1e-300)
    return min(1.0, x * (1 - math.log(x)))  # Fisher's combination of two tests


def length_class(n: int) -> int:
    return sum(n >= low for low in LENGTHS) - 1


def p_bin(p: float) -> int:
    """Bin of a p-value by its order of magnitude; each bin counts as its largest value."""
    return min(MAX_BIN, int(-BINS_PER_DECADE * math.log10(max(p, 1e-300))))


TESTED = pa.schema(
    SCAN.remove(SCAN.get_field_index("found")).append(
        pa.field("tested", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.int32()), ("bin", pa.int32())])))
    )
)


def _tester(letters: dict[str, float]):
    @released
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tested = []
            for found in batch["found"].to_pylist():
                rows = []
                for f in found:
                    token = f["token"].rstrip("=")
                    alphabet = ALPHABETS[encoding(token)]
                    p = text_p(token, alphabet, letters) if is_random(token, alphabet) else 1.0
                    rows.append({"start": f["start"], "end": f["end"], "stratum": length_class(len(token)), "bin": p_bin(p)})
                tested.append(rows)
            kept = [batch[name] for name in TESTED.names[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(tested, TESTED.field("tested").type)], schema=TESTED)

    return test


def _letter_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = dict.fromkeys(LETTERS, 0)
    for batch in batches:
        for found in batch["found"].to_pylist():
            for f in found:
                if f["token"].isalpha() and f["token"][1:].islower():
                    for c in f["token"].lower():
                        counts[c] += 1
    yield emit(list(counts.items()), pa.schema([("letter", pa.string()), ("n", pa.int64())]))


def thresholds(counts: dict[int, dict[int, int]], q: float) -> dict[int, int]:
    """Smallest accepted bin of each length class, by Benjamini-Hochberg on binned p-values."""
    out = {}
    for stratum, bins in counts.items():
        m, seen, best = sum(bins.values()), 0, MAX_BIN + 1
        for b in sorted(bins, reverse=True):
            seen += bins[b]
            if 10 ** (-b / BINS_PER_DECADE) * m <= q * seen:
                best = b
        out[stratum] = best
    return out


def scan(docs: DataFrame, q: float = 0.001) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text).

    Columns: doc_id, text_key, n_assign, n_access, n_hex, base_sha256, all_spans (array
    of start, kind, end by start, then kind), n_random. Three passes over
    narrow rows follow one pass over the texts; the driver sees 26 letter counts
    and the counts of at most 3,000 bins for each of four length classes.
    """
    spark = docs.sparkSession
    space = workspace(spark, "secrets")
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key().alias("text_key"),
        F.col("text").cast("string").alias("text"),
    )
    found = space.table("found", texts.mapInArrow(_scan, f"doc_id long, text_key long, n_assign long, n_access long, n_hex long, base_sha256 string, base {SPAN}, found array<struct<start:int,end:int,token:string>>"))
    seen = found.select("found").where(F.size("found") > 0).mapInArrow(_letter_counts, "letter string, n long")
    counted = {r["letter"]: r["n"] for r in seen.groupBy("letter").agg(F.sum("n").alias("n")).collect()}
    weights = {c: counted.get(c, 0) + PRIOR_LETTERS * share / 100 for c, share in LETTERS.items()}
    letters = {c: w / sum(weights.values()) for c, w in weights.items()}
    schema = f"doc_id long, text_key long, n_assign long, n_access long, n_hex long, base_sha256 string, base {SPAN}, tested array<struct<start:int,end:int,stratum:int,bin:int>>"
    tested = space.table("tested", found.mapInArrow(_tester(letters), schema))
    counts: dict[int, dict[int, int]] = {}
    for r in tested.select(F.explode("tested").alias("t")).groupBy("t.stratum", "t.bin").count().collect():
        counts.setdefault(r["stratum"], {})[r["bin"]] = r["count"]
    least = thresholds(counts, q)
    out = tested.mapInArrow(lambda it: _decided(it, least), f"doc_id long, text_key long, n_assign long, n_access long, n_hex long, base_sha256 string, all_spans {SPAN}, n_random long")
    return out.withColumn("all_spans", F.array_sort("all_spans"))


def _decided(batches: Iterator[pa.RecordBatch], least: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """The base spans and the united spans of accepted candidates."""
    kind = TESTED.field("base").type
    for batch in batches:
        spans, counts = [], []
        for base, tested in zip(batch["base"].to_pylist(), batch["tested"].to_pylist()):
            found = united([(t["start"], t["end"]) for t in tested if t["bin"] >= least[t["stratum"]]])
            spans.append(base + [{"start": s, "kind": 3, "end": e} for s, e in found])
            counts.append(len(found))
        kept = [batch[name] for name in TESTED.names[:-2]]
        names = [*TESTED.names[:-2], "all_spans", "n_random"]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(spans, kind), pa.array(counts, pa.int64())], names=names)


def shown(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(
        ",",
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))),
    )


def _masked(batches: Iterator[pa.RecordBatch], mark: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The documents (struct ``row``) with the spans of their texts marked."""
    for batch in batches:
        columns = batch["row"].flatten()
        at = schema.get_field_index("text")
        texts = columns[at].to_pylist()
        for n, spans in enumerate(batch["spans"].to_pylist()):
            for start, end in reversed(united([(s["start"], s["end"]) for s in spans or []])):
                texts[n] = texts[n][:start] + mark + texts[n][end:]
        columns[at] = pa.array(texts, columns[at].type)
        yield pa.RecordBatch.from_arrays(columns, names=schema.names)


def mask(docs: DataFrame, scanned: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of a text replaced by ``mark``; the columns stay, whatever their names.

    Texts with spans are few: their (doc_id, digest) keys are written first, so a
    short list joins by broadcast and a long one by shuffle. Overlapping spans
    become one mark. ``n_chars``, where present, follows the new text.
    """
    space = workspace(docs.sparkSession, "mask")
    keys = scanned.where(F.size("all_spans") > 0).groupBy("doc_id", "text_key").agg(F.first("all_spans").alias("spans"))
    hits = space.table("hits", keys).select(F.col("doc_id").alias("h_id"), F.col("text_key").alias("h_key"), "spans")
    rows = as_row(docs, F.col("doc_id").alias("id"), text_key().alias("key"))
    joined = rows.join(hits, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("key") == F.col("h_key")), "left").select("row", "spans")
    schema = pa.schema([(c, pa.null()) for c in docs.columns])
    out = joined.mapInArrow(lambda it: _masked(it, mark, schema), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
