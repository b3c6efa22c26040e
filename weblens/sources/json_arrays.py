"""Files that are one JSON array of objects, read by many tasks each.

Spark's text source cuts a file at every ``}`` and hands byte ranges of it to tasks, whether a
brace stands between records, inside a record or inside a string. What a range does is summed up
without knowing how it begins: for both cases, inside a string or not, how it ends and by how
much it changes the nesting. Composed in order of a file's ranges, these rows say how every
range begins; then each range gives out the records that lie in it, and only the pieces of a
record that a border cuts, one record a border, are put together afterwards.

Braces, brackets, quotes and escapes may stand in strings, records may be nested. An empty file
or array gives no rows. A file that is no array of objects, or ends before the array does, fails
the job. A record that does not fit the schema has nulls, as in Spark's own reader.
"""

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from weblens.shipping import ship_package
from weblens.workspace import Workspace

RANGES_AT_ONCE = 50_000  # ranges whose beginnings are sent to the tasks of one job
_MARK = re.compile(r'["{}\[\]]')
_QUOTED = re.compile(r'(?:[^"\\]++|\\.)*+', re.S)  # the rest of a string up to its closing quote

_SUMMARY = "file string, start long, quoted_0 boolean, depth_0 long, quoted_1 boolean, depth_1 long"
_FOUND = "file string, start long, part int, record string"
_RECORD, _END, _WHOLE, _BEGIN = 0, 1, 2, 3  # a record, or the end, the middle or the beginning of one that is cut


def walk(text: str, quoted: bool, depth: int) -> tuple[bool, int]:
    """(inside a string?, nesting) behind ``text``."""
    at, n = 0, len(text)
    while True:
        if quoted:
            at = _QUOTED.match(text, at).end()
            if at >= n:
                return True, depth
            quoted, at = False, at + 1
        m = _MARK.search(text, at)
        if not m:
            return False, depth
        at = m.end()
        if m.group() == '"':
            quoted = True
        else:
            depth += 1 if m.group() in "{[" else -1


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    """((file, start of the range), text up to and with a brace) in the order of the file."""
    for batch in batches:
        for file, start, text in zip(batch["file"].to_pylist(), batch["start"].to_pylist(), batch["value"].to_pylist()):
            # The source takes the brace away; behind a file's last bracket there is none, see ``_begins``.
            yield (file, start), text + "}"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How each range ends, for both ways to begin."""
    rows: dict[tuple[str, int], list[tuple[bool, int]]] = {}
    for key, text in _pieces(batches):
        rows[key] = [walk(text, *state) for state in rows.get(key, [(False, 0), (True, 0)])]
    columns = [[*key, *ends[0], *ends[1]] for key, ends in rows.items()]
    names = ["file", "start", "quoted_0", "depth_0", "quoted_1", "depth_1"]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in columns], k) for i, k in enumerate(kinds)], names=names)


def _begins(ranges: pd.DataFrame) -> pd.DataFrame:
    """How each range of one file begins; the file must be an array and whole."""
    ranges, quoted, depth, out = ranges.sort_values("start"), False, 0, []
    for r in ranges.itertuples():
        out.append((r.file, r.start, quoted, depth))
        quoted, depth = (r.quoted_1, depth + r.depth_1) if quoted else (r.quoted_0, depth + r.depth_0)
    # All brackets are closed, and the brace that ``_pieces`` adds at the file's end is one too many.
    if quoted or depth != -1:
        raise ValueError(f"{ranges['file'].iloc[0]} is not one whole JSON array of objects")
    return pd.DataFrame(out, columns=["file", "start", "quoted", "depth"])


def _records(begins: dict[tuple[str, int], tuple[bool, int]]):
    """The records of each range, and what its borders leave of those that are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        key, held, cut = None, [], False
        quoted, depth = False, 0

        def left() -> None:
            if key and held:
                rows.append((*key, _WHOLE if cut else _BEGIN, "".join(held)))

        for own, text in _pieces(batches):
            if own != key:
                left()
                key, held = own, []
                quoted, depth = begins[own]
                cut = quoted or depth > 1
            if not held and not cut:
                # Between records: a comma, or the array's brackets.
                text = text[text.index("{") :] if "{" in text else ""
                depth = 1
                if not text:  # the array's end, or its beginning and end
                    continue
            held.append(text)
            quoted, depth = walk(text, quoted, depth)
            if not quoted and depth == 1:
                rows.append((*key, _END if cut else _RECORD, "".join(held)))
                held, cut = [], False
            if len(rows) >= 4096:
                yield _batch(rows)
                rows = []
        left()
        yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "start", "part", "record"])


def _joined(parts: pd.DataFrame) -> pd.DataFrame:
    """The records of one file that its ranges' borders cut."""
    out, held = [], []
    for r in parts.sort_values(["start", "part"]).itertuples():
        held.append(r.record)
        if r.part == _END:
            out.append("".join(held))
            held = []
    return pd.DataFrame({"record": out})


def read_json_arrays(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The objects of the arrays in the files of ``path``, as rows of ``schema``."""
    ship_package()
    space = Workspace(spark, "json-arrays")
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    ranges = space.table("ranges", pieces.mapInArrow(_summaries, _SUMMARY))
    begins = space.table("begins", ranges.groupBy("file").applyInPandas(_begins, "file string, start long, quoted boolean, depth long"))
    turns = max(1, -(-begins.count() // RANGES_AT_ONCE))
    found = None
    for turn in range(turns):  # one, but for tens of thousands of ranges: then files in turn, by hash
        own = F.pmod(F.xxhash64("file"), F.lit(turns)) == turn
        known = {(r["file"], r["start"]): (r["quoted"], r["depth"]) for r in begins.where(own).collect()}
        part = pieces.where(own).mapInArrow(_records(known), _FOUND)
        found = part if found is None else found.union(part)
    found = space.table("found", found)
    cut = found.where(F.col("part") != _RECORD).groupBy("file").applyInPandas(_joined, "record string")
    records = found.where(F.col("part") == _RECORD).select("record").union(cut)
    return records.select(F.from_json("record", schema).alias("row")).select("row.*")
