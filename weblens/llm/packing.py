"""Best-fit packing of token sequences, improved by a swap-based local search.

A document's ids (its text's and a closing 0) are cut into pieces of ``capacity``
only where they are longer. Pieces are dealt by hash into groups of bounded size,
so that any number of them is packed by as many tasks; a group wastes less than one
sequence more than a whole would. In a group, pieces go by falling length into the
fullest sequence that holds them. Then pieces of sequences that are not full are moved
(one or two) or exchanged, one for one or two for one (of one sequence or of two), wherever
that raises the sum of squared fills. Rounds go on until the open sequences could not be
fewer or no exchange helps; the sum rises with every exchange, so they end.

A null text is an empty one: its single id 0 makes one piece. Repeated rows are
packed as often as they occur; an empty table gives an empty one; long texts are
cut, never dropped.
"""

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weblens.llm.common import gathered, released, slices, workspace
from weblens.llm.tokens import WordTokenizer

CAPACITY = 2048
GROUP = 8192
#: Bytes of texts tokenized at a time: word tables and ids of a chunk are many times as large.
CHUNK_BYTES = 1 << 19

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _rows(tokenizer: WordTokenizer, batch: pa.RecordBatch, capacity: int, salt: int) -> pa.RecordBatch:
    """The pieces of a batch of documents; their salts count on from ``salt``."""
    ids, offsets = tokenizer.texts(batch["text"])
    rows: list[tuple] = []
    for doc, a, b in zip(batch["doc_id"].to_pylist(), offsets[:-1], offsets[1:]):
        own = np.append(ids[a:b], 0).astype("<u4")
        for number, start in enumerate(range(0, len(own), capacity)):
            part = own[start : start + capacity]
            rows.append((doc, number, start, len(part), zlib.crc32(part.tobytes()), salt + len(rows)))
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _pieces(path: str, capacity: int):
    @released
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, salt = WordTokenizer(path), 0
        for batch in gathered(slices(batches, "text", CHUNK_BYTES), CHUNK_BYTES):
            cut_up = _rows(tokenizer, batch, capacity, salt)
            salt += cut_up.num_rows
            yield cut_up

    return cut


# --- one group ------------------------------------------------------------


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: by falling length, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect_left(rooms, (lengths[item], -1))
        if at < len(rooms):
            room, number = rooms.pop(at)
            bins[number].append(item)
        else:
            room, number = capacity, len(bins)
            bins.append([item])
        if room > lengths[item]:
            insort(rooms, (room - lengths[item], number))
    return bins


def _by_length(items: list[int], lengths: list[int]) -> dict[int, list[int]]:
    held: dict[int, list[int]] = {}
    for i in items:
        held.setdefault(lengths[i], []).append(i)
    return held


class _Offers:
    """What the open bins can give in a round: a piece, two of one bin, or two of two bins."""

    def __init__(self, open_bins: list[int], bins: list[list[int]], fill: list[int], lengths: list[int], capacity: int):
        self.held = {n: _by_length(bins[n], lengths) for n in open_bins}
        self.holders: dict[int, list[int]] = {}
        pairs: dict[int, list[int]] = {}
        for n in sorted(open_bins, key=lambda n: (fill[n], n)):  # the emptiest first
            sizes = sorted(self.held[n])
            for a, size in enumerate(sizes):
                self.holders.setdefault(size, []).append(n)
                sums = [size + other for other in sizes[:a]] + [2 * size] * (len(self.held[n][size]) > 1)
                for total in set(sums):
                    pairs.setdefault(total, []).append(n)
        self.pairs = pairs
        self.largest = self._at_most(self.holders, capacity)
        self.largest_pair = self._at_most(pairs, capacity)
        self.known, self.below = np.array(sorted(self.holders)), np.array(self.largest)
        self.across: dict[int, tuple[int, int]] = {}

    @staticmethod
    def _at_most(sizes, capacity: int) -> list[int]:
        """For every limit the largest size that is not above it, or 0."""
        table, last = [0] * (capacity + 1), 0
        for limit in range(capacity + 1):
            last = limit if limit in sizes else last
            table[limit] = last
        return table

    def used(self, changed) -> None:
        """Bins that took part in an exchange give nothing more in this round."""
        for n in changed:
            del self.held[n]

    def first(self, of: dict[int, list[int]], size: int, *but: int) -> int | None:
        """The emptiest bin of a list that is left, other than some."""
        bins = of.get(size, [])
        while bins and bins[0] not in self.held:
            bins.pop(0)
        return next((n for n in bins if n in self.held and n not in but), None)

    def most(self, of: dict[int, list[int]], table: list[int], limit: int, target: int) -> tuple[int, int | None]:
        """(size, bin) of the largest size up to ``limit`` that a bin other than ``target`` still has."""
        size = table[limit]
        while size:
            giver = self.first(of, size, target)
            if giver is not None:
                return size, giver
            size = table[size - 1]
        return 0, None

    def two(self, limit: int) -> tuple[int, int]:
        """The two lengths that fill ``limit`` best, the longer one first."""
        if limit not in self.across:
            ones = self.known[self.known < limit]
            others = self.below[limit - ones] if len(ones) else ones
            totals = np.where(others > 0, ones + others, 0)
            at = int(totals.argmax()) if len(totals) else -1
            self.across[limit] = (0, 0) if at < 0 or not totals[at] else (int(max(ones[at], others[at])), int(min(ones[at], others[at])))
        return self.across[limit]

    def pair_of(self, bin_: int, total: int) -> tuple[int, int]:
        held = self.held[bin_]
        for size, items in held.items():
            if 2 * size == total and len(items) > 1:
                return items[0], items[1]
            if 2 * size != total and total - size in held:
                return items[0], held[total - size][0]
        raise KeyError(total)


def _exchange(target: int, fill: list[int], offers: _Offers, capacity: int):
    """The exchange with ``target`` that raises the squared fills most: (rise, {bin: (pieces out, pieces in)})."""
    best, held, room = (0, None), offers.held[target], capacity - fill[target]

    def consider(changes: dict[int, tuple[list[int], list[int], int]]) -> None:
        nonlocal best
        rise = sum((fill[n] + by) ** 2 - fill[n] ** 2 for n, (_, _, by) in changes.items())
        if rise > best[0] and all(fill[n] + by <= capacity for n, (_, _, by) in changes.items()):
            best = rise, {n: (out, into) for n, (out, into, _) in changes.items()}

    for out, taken in [(0, []), *((size, items[:1]) for size, items in held.items())]:
        limit = min(out + room, capacity)
        size, giver = offers.most(offers.holders, offers.largest, limit, target)
        if size > out:
            put = offers.held[giver][size][:1]
            consider({target: (taken, put, size - out), giver: (put, taken, out - size)})
        size, giver = offers.most(offers.pairs, offers.largest_pair, limit, target)
        if size > out:
            put = list(offers.pair_of(giver, size))
            consider({target: (taken, put, size - out), giver: (put, taken, out - size)})
        one, two = offers.two(limit)
        if two and one + two > out:
            first = offers.first(offers.holders, one, target)
            second = offers.first(offers.holders, two, target, first)
            if first is not None and second is not None:
                a, b = offers.held[first][one][:1], offers.held[second][two][:1]
                consider({target: (taken, a + b, one + two - out), first: (a, taken, out - one), second: (b, [], -two)})
    return best


class _Search:
    """Bins under a local search; every exchange raises the sum of squared fills."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.bins, self.lengths, self.capacity = [list(b) for b in bins], lengths, capacity
        self.fill = [sum(lengths[i] for i in b) for b in bins]

    def open(self) -> list[int]:
        return [n for n, f in enumerate(self.fill) if 0 < f < self.capacity]

    def least(self) -> bool:
        """Whether even without a gap the open bins could not be fewer."""
        open_bins = self.open()
        return len(open_bins) < 2 or sum(self.fill[n] for n in open_bins) > (len(open_bins) - 1) * self.capacity

    def offers(self) -> _Offers:
        return _Offers(self.open(), self.bins, self.fill, self.lengths, self.capacity)

    def change(self, changes: dict[int, tuple[list[int], list[int]]]) -> None:
        for n, (out, into) in changes.items():
            self.bins[n] = [i for i in self.bins[n] if i not in out] + into
            self.fill[n] += sum(self.lengths[i] for i in into) - sum(self.lengths[i] for i in out)

    def steepest(self) -> bool:
        """A round of the exchanges that raise the squares most, the steepest first, each bin once."""
        offers, moved = self.offers(), False
        rises = {n: _exchange(n, self.fill, offers, self.capacity)[0] for n in offers.held}
        for target in sorted(rises, key=lambda n: (-rises[n], n)):
            if rises[target] and target in offers.held:
                changes = _exchange(target, self.fill, offers, self.capacity)[1]  # with what is left by now
                if changes:
                    self.change(changes)
                    offers.used(changes)
                    moved = True
        return moved

    def fullest(self) -> bool:
        """A round in which every bin, the fullest first, takes what fills it most from less full ones."""
        offers, moved = self.offers(), False
        for target in sorted(offers.held, key=lambda n: (-self.fill[n], n)):
            if target not in offers.held:
                continue
            offers.used([target])
            while self.fill[target] < self.capacity and (best := self._filler(target, offers)):
                self.change({target: (best[2], best[1]), best[0]: (best[1], best[2])})
                offers.used([best[0]])
                moved = True
        return moved

    def _filler(self, target: int, offers: _Offers) -> tuple[int, list[int], list[int]] | None:
        best, gain, room = None, 0, self.capacity - self.fill[target]
        for out, taken in [(0, []), *((size, items[:1]) for size, items in _by_length(self.bins[target], self.lengths).items())]:
            for of, table in ((offers.holders, offers.largest), (offers.pairs, offers.largest_pair)):
                size, giver = offers.most(of, table, min(out + room, self.capacity), target)
                # the giver is no fuller and loses what the target gains, so squares rise
                if size - out > gain and self.fill[giver] < self.fill[target] + size - out:
                    put = offers.held[giver][size][:1] if of is offers.holders else list(offers.pair_of(giver, size))
                    best, gain = (giver, put, taken), size - out
        return best


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search over the bins that are not full; never returns more bins.

    Two orders of the exchanges lead to different ends, so both are followed until no exchange
    helps, and the one that leaves fewer bins counts.
    """
    ends = []
    for orders in (("fullest", "steepest"), ("steepest", "fullest")):
        search, resting, turn = _Search(bins, lengths, capacity), 0, 0
        while resting < 2 and not search.least():
            if getattr(search, orders[turn % 2])():
                resting = 0
            else:
                resting, turn = resting + 1, turn + 1
        ends.append([b for b in search.bins if b])
        if search.least():
            break
    return min(ends, key=len)


def _packer(capacity: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "salt"]).reset_index(drop=True)
        lengths = group["length"].tolist()
        bins = improve(best_fit(lengths, capacity), lengths, capacity)
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for number, items in enumerate(bins):
            at = 0
            for i in items:
                sequence[i], offset[i] = number, at
                at += lengths[i]
        first = int(group["group"].iloc[0]) << 32
        out = group[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
        return out.assign(sequence_id=first + sequence, offset=offset)

    return pack


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text); ``tokenizer`` is the vocabulary file's path on every node."""
    space = workspace(docs.sparkSession, "packing")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = space.table("pieces", texts.mapInArrow(_pieces(tokenizer, capacity), PIECES))
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(_packer(capacity), PACKED)
