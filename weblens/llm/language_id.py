"""Language identification by Bayesian fusion of text, markup, address and host evidence.

1. Text: hashed byte trigrams of the whole lower-cased text. Their counts per
   declared language come from every document, summed per task before the shuffle;
   add-one smoothing gives log likelihoods. Trigrams overlap, so the sum is divided
   by three, and by more when a text is long, which keeps other evidence in play.
2. Declared markup language and address suffix: likelihoods of the value given the
   language, from grouped counts of the language the text alone points to.
3. Host prior: the share of each language among the host's documents, smoothed
   towards that of the host's parent domain, which is smoothed towards the whole
   corpus. The document's own vote is taken out of its host's counts.

The languages are the declared values of at least ``LEAST_DOCS`` documents, found by a
grouped count, the most frequent ``MAX_LANGUAGES`` of them. Any other text is for the model
"other": the mean of all languages' trigrams, and a small share spread evenly over all
trigrams, less ``MARGIN``. A text of a modelled language is likelier under its own model than
under their mean, one in several of them not much less likely; both stay. One of no modelled
language is far less likely under any of them. Smoothing hides that in a small corpus, so a trigram
of no text that declares a language speaks for "other" by ``MARGIN`` at least. "other" takes
part in all evidence like a language.

The posterior is the normalised product. A document is rejected when it has no
letters, when "other" is the best, or when the best language stays below ``least`` posterior.
A null or empty text has no text evidence and is rejected; null declared values, suffixes and
hosts are a value of their own, apart from empty ones. Repeated rows give repeated results; an
empty table gives an empty one.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weblens.llm.common import emit, released, workspace

OTHER = "other"
LEAST_DOCS = 20  # documents that declare a language, for it to be modelled
MAX_LANGUAGES = 64
EVEN_SHARE = 0.01  # of the model "other"
MARGIN = 1.0  # by which "other" must be likelier than a language, per trigram, in nats
BUCKET_BITS = 14
LEAST_POSTERIOR = 0.5
FULL_GRAMS = 300  # beyond this many trigrams a longer text counts no more
PRIOR_ROWS = 20.0  # weight of the parent's prior in documents
SMOOTHING = 1.0

#: Bytes that take part: ASCII letters in lower case and all bytes of other characters.
_FOLD = np.zeros(256, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray) -> np.ndarray:
    """Buckets of the byte trigrams that hold at least one letter; other bytes count as one blank."""
    folded = _FOLD[data]
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 0) | (folded[:-1] != 0)
    folded = np.concatenate([[0], folded[keep], [0]]).astype(np.uint32)
    if len(folded) < 3 or not folded.any():
        return np.zeros(0, np.uint32)
    code = (folded[:-2] << np.uint32(16)) | (folded[1:-1] << np.uint32(8)) | folded[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)


def _bytes(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint8) if value.is_valid else np.zeros(0, np.uint8)


def _counter(languages: tuple[str, ...]):
    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(languages) + 1, 1 << BUCKET_BITS), np.int64)  # the last: of any other declared value
        for batch in batches:
            for language, value in zip(batch["declared"].to_pylist(), batch["text"]):
                if language:
                    grams = trigrams(_bytes(value))
                    code = languages.index(language) if language in languages else -1
                    totals[code] += np.bincount(grams, minlength=1 << BUCKET_BITS)
        rows = [(code, totals[code].astype("<i8").tobytes()) for code in range(len(totals))]
        yield emit(rows, pa.schema([("language", pa.int32()), ("counts", pa.binary())]))

    return count


def _likelihoods(docs: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """Log likelihood of each bucket per language, from all documents.

    Each task sends one fixed-size row per language and one more; the rows are added in a
    tree of tasks, and one table of languages x 16,384 numbers reaches the driver.
    """
    parts = docs.select("declared", "text").mapInArrow(_counter(languages), "language int, counts binary")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(languages) + 1, 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            for code, counts in zip(batch["language"].to_pylist(), batch["counts"]):
                totals[code] += np.frombuffer(counts.as_buffer(), "<i8")
        rows = [(code, totals[code].astype("<i8").tobytes()) for code in range(len(totals))]
        yield emit(rows, pa.schema([("language", pa.int32()), ("counts", pa.binary())]))

    parts = parts.repartition(16).mapInArrow(add, parts.schema)
    totals = np.zeros((len(languages) + 1, 1 << BUCKET_BITS))
    for row in parts.collect():  # 16 rows per language, and 16 more
        totals[row["language"]] += np.frombuffer(row["counts"], "<i8")
    unseen = ~totals.any(axis=0)
    totals = totals[:-1] + SMOOTHING
    shares = totals / totals.sum(axis=1, keepdims=True)
    even = np.full(shares.shape[1], 1 / shares.shape[1])
    other = (1 - EVEN_SHARE) * shares.mean(axis=0) + EVEN_SHARE * even if len(shares) else even
    likeliest = shares.max(axis=0, initial=0)
    other = np.where(unseen, np.maximum(other, likeliest * np.exp(2 * MARGIN)), other)
    return np.vstack([np.log(shares), np.log(other) - MARGIN]).astype(np.float32)


def _scorer(table: np.ndarray, carried: list[str], schema: pa.Schema):
    turned = np.ascontiguousarray(table.T)

    @released
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, lengths = [], []
            for value in batch["text"]:
                grams = trigrams(_bytes(value))
                total = np.zeros(turned.shape[1])
                for start in range(0, len(grams), 1 << 16):
                    total += turned[grams[start : start + (1 << 16)]].sum(axis=0, dtype=np.float64)
                n = len(grams)
                scores.append((total / 3 * min(1.0, FULL_GRAMS / max(n, 1))).tolist())
                lengths.append(n)
            columns = [batch[c] for c in carried] + [pa.array(scores, pa.list_(pa.float64())), pa.array(lengths, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema)

    return score


def _counts_by(rows: DataFrame, key: str, n: int) -> DataFrame:
    """One row per key: array of document counts per language, by partial sums."""
    sums = [F.sum((F.col("text_language") == i).cast("double")).alias(f"c{i}") for i in range(n)]
    return rows.groupBy(key).agg(*sums).select(key, F.array(*[f"c{i}" for i in range(n)]).alias("counts"))


def _lists(batch: pa.RecordBatch, name: str, n: int) -> np.ndarray:
    return batch[name].flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def _fuser(names: list[str], id_column: str, least: float):
    """Posteriors of a batch from its text scores and the counts of its host, domain and values."""

    @released
    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(names)
        for batch in batches:
            if not batch.num_rows:
                continue
            found = batch["text_language"].to_numpy(zero_copy_only=False)
            has = batch["n_grams"].to_numpy() > 0
            at = np.where(has, np.nan_to_num(found.astype(float)), 0).astype(int)
            others = _lists(batch, "host_counts", n).copy()
            others[np.flatnonzero(has), at[has]] -= 1
            prior = (others + PRIOR_ROWS * _lists(batch, "parent", n)) / (others.sum(axis=1) + PRIOR_ROWS)[:, None]
            logs = _lists(batch, "scores", n) + np.log(prior) + _lists(batch, "declared_log", n) + _lists(batch, "suffix_log", n)
            weights = np.exp(logs - logs.max(axis=1, keepdims=True))
            posteriors = weights / weights.sum(axis=1, keepdims=True)
            best, top = posteriors.argmax(axis=1), posteriors.max(axis=1)
            rejected = ~has | (top < least) | (best == n - 1)
            columns = [
                batch[id_column], batch["text_key"],
                pa.array(np.array(names, object)[best], pa.string(), mask=~has), pa.array(top, mask=~has),
                pa.array(np.array(names, object)[at], pa.string(), mask=~has), batch["n_grams"],
                pa.array(rejected), pa.array(list(posteriors), pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[id_column, "text_key", "language", "posterior", "text_language", "n_grams", "rejected", "posteriors"])

    return fuse


def declared_languages(docs: DataFrame, declared: str = "declared") -> tuple[str, ...]:
    """The languages to model, by name: primary subtags that enough documents declare.

    A table so small that none reaches ``LEAST_DOCS`` is modelled by all it declares.
    """
    value = F.lower(F.substring_index(F.substring_index(F.col(declared).cast("string"), "-", 1), "_", 1))
    counts = docs.groupBy(value.alias("value")).count().where(F.col("value").rlike("^[a-z]{2,3}$"))
    top = counts.orderBy(F.desc("count"), "value").limit(MAX_LANGUAGES).collect()
    enough = [r["value"] for r in top if r["count"] >= LEAST_DOCS]
    return tuple(sorted(enough or [r["value"] for r in top]))


def identify(
    docs: DataFrame,
    declared: str = "declared",
    suffix: str = "suffix",
    host: str = "host",
    domain: str = "domain",
    id_column: str = "doc_id",
    languages: tuple[str, ...] | None = None,
    least: float = LEAST_POSTERIOR,
) -> DataFrame:
    """One row per row of ``docs`` (id, text, declared, suffix, host, domain).

    Columns: the id, text_key, language (null without letters), posterior, text_language,
    n_grams, rejected, posteriors (array in the order of ``languages`` and "other"). Without
    ``languages`` they are those that the documents declare.
    """
    spark = docs.sparkSession
    space = workspace(spark, "language")
    languages = languages if languages is not None else declared_languages(docs, declared)
    n = len(languages) + 1
    rows = docs.select(
        F.col(id_column).alias(id_column),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
        F.lower(F.substring_index(F.substring_index(F.col(declared).cast("string"), "-", 1), "_", 1)).alias("declared"),
        F.col(suffix).cast("string").alias("suffix"),
        F.col(host).cast("string").alias("host"),
        F.col(domain).cast("string").alias("domain"),
        F.col("text").cast("string").alias("text"),
    )
    table = _likelihoods(rows, languages)
    carried = [id_column, "text_key", "declared", "suffix", "host", "domain"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carried) + ", scores array<double>, n_grams long"
    scored = rows.mapInArrow(_scorer(table, carried, [*carried, "scores", "n_grams"]), schema)
    best = F.when(F.col("n_grams") > 0, F.array_position("scores", F.array_max("scores")) - 1).cast("int")
    scored = scored.withColumn("text_language", best)
    scored = scored.withColumns({c: F.coalesce(c, F.lit("\0")) for c in ("declared", "suffix", "host", "domain")})  # a null is a value
    narrow = space.table("scored", scored)

    whole = narrow.agg(*[F.sum((F.col("text_language") == i).cast("long")).alias(f"c{i}") for i in range(n)]).first()
    shares = np.array([(whole[f"c{i}"] or 0) + SMOOTHING for i in range(n)], float)
    whole_share = [float(x) for x in shares / shares.sum()]
    total = F.aggregate("counts", F.lit(0.0), lambda s, x: s + x)
    smoothed = [(F.element_at("counts", i + 1) + PRIOR_ROWS * w) / (total + PRIOR_ROWS) for i, w in enumerate(whole_share)]
    parents = _counts_by(narrow, "domain", n).select("domain", F.array(*smoothed).alias("parent"))
    hosts = _counts_by(narrow, "host", n).withColumnRenamed("counts", "host_counts")
    totals = [float(x) for x in shares]

    def given(key: str) -> DataFrame:
        """log P(value | language), smoothed by one document per language."""
        parts = [F.log((F.element_at("counts", i + 1) + SMOOTHING) / F.lit(totals[i] + SMOOTHING)) for i in range(n)]
        return _counts_by(narrow, key, n).select(key, F.array(*parts).alias(f"{key}_log"))

    joined = narrow
    for right, key in ((hosts, "host"), (parents, "domain"), (given("declared"), "declared"), (given("suffix"), "suffix")):
        joined = joined.join(space.table(f"by-{key}", right), key)
    names = [*languages, OTHER]
    out = f"`{id_column}` {kinds[id_column]}, text_key long, language string, posterior double, text_language string, n_grams long, rejected boolean, posteriors array<double>"
    return joined.mapInArrow(_fuser(names, id_column, least), out)


def document_evidence(docs: DataFrame) -> DataFrame:
    """Evidence columns of the documents table: its declared language, its source as host.

    Documents carry no address; the suffix is missing for all, and every source is
    its own parent, so its prior is smoothed towards the corpus.
    """
    return docs.select(
        "doc_id", "text",
        F.col("lang").alias("declared"),
        F.lit(None).cast("string").alias("suffix"),
        F.col("source").alias("host"),
        F.lit(None).cast("string").alias("domain"),
    )


def page_evidence(pages: DataFrame) -> DataFrame:
    """Evidence columns of web pages: html lang, public suffix, host and parent domain."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    plain = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return pages.select(
        "page_id",
        F.regexp_replace(F.regexp_replace(plain, r"<[^>]*>", " "), r"&[a-zA-Z#0-9]+;", " ").alias("text"),
        F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z_-]+)", 1).alias("declared"),
        F.substring_index(host, ".", -1).alias("suffix"),
        host.alias("host"),
        F.substring_index(host, ".", -2).alias("domain"),
    )
