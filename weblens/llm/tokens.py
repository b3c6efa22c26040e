"""Token ids of whole texts by a word-end BPE vocabulary file, fast for repeated words.

Texts are cut at blanks and line breaks, where no token crosses. Distinct words of
plain Latin letters, digits and marks go through a byte-pair encoder of the same
merges; any other word goes to the vocabulary's own library, one by one. A word's
last byte is a symbol of its own in such a vocabulary, so bytes are written as
two-byte characters of two ranges, inner and last, whose ids are the vocabulary's.
"""

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

_INNER, _LAST = 0x100, 0x200
_END = "</w>"
#: Words left to the library: controls, other blanks, and characters past Latin.
_UNUSUAL = r"[\x00-\x1F\x7F-\xA0\xAD]|[^\x00-\x{24F}]|<\|"
#: A piece in coded bytes, or a line's end.
_CODED = r"[\x{100}-\x{1FF}]*[\x{200}-\x{2FF}]|\n"
_LIMIT = 1 << 17  # words kept from one chunk of texts to the next
_SLICE = 1 << 14  # distinct words split and encoded at a time
_LETTER, _MARK, _ALONE = 1, 2, 3  # kinds of characters; runs of the first two are pieces


def _byte_names() -> dict[str, int]:
    """Printable character of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _kinds() -> np.ndarray:
    """Kind of each character of lower-cased usual words, as the pre-tokenizer cuts them."""
    found = {*"".join(map(chr, range(0x250))).lower(), "\u0307"}
    kinds = np.full(ord(max(found)) + 1, _ALONE, np.uint8)
    for c in found:
        if not regex.match(r"[\p{N}\s]", c):
            kinds[ord(c)] = _LETTER if regex.match(r"\p{L}", c) else _MARK
    return kinds


class WordTokenizer:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        names, ranks = _byte_names(), {}
        inner, last = ({ord(c): chr(b + first) for c, b in names.items()} for first in (_INNER, _LAST))
        for token, rank in vocabulary.items():
            body = token.removesuffix(_END)
            if body and names.keys() >= set(body):
                end = last if token.endswith(_END) else inner
                ranks[(body[:-1].translate(inner) + body[-1].translate(end)).encode()] = rank
        above = max(vocabulary.values()) + 1
        self.separator = above + ord("\n")
        for byte in range(256):  # a byte alone never stays, but must have a rank
            ranks.setdefault(bytes([byte]), above + byte)
        self.encoder = tiktoken.Encoding("words", pat_str=_CODED, mergeable_ranks=ranks, special_tokens={})
        self.kinds = _kinds()
        self.memo: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.memo.clear()
        self.flat, self.starts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]

    def _cut(self, text: str) -> str:
        """Lower-cased words, one a line, as coded bytes; the last byte of each piece is coded as such.

        The vocabulary's pre-tokenizer, a fixed value, cuts them into pieces:
        's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+
        """
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kinds = self.kinds[chars]
        first = np.ones(len(chars) + 3, bool)  # whether a piece begins at a place; lines end all
        first[1 : len(chars)] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _ALONE)
        marks = np.flatnonzero((chars == ord("'")) & first[: len(chars)])
        one, two = (chars[np.minimum(marks + n, len(chars) - 1)] for n in (1, 2))
        short = marks[np.isin(one, [ord(c) for c in "stmd"])]
        long = marks[np.isin(one * 0x10000 + two, [ord(a) * 0x10000 + ord(b) for a, b in ("re", "ve", "ll")])]
        first[short + 1] = first[long + 1] = False
        first[short + 2] = first[long + 3] = True
        sizes = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800)
        until = np.cumsum(sizes)
        codes = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
        lines = codes == ord("\n")
        codes += _INNER
        codes[until[np.flatnonzero(first[1 : len(chars) + 1])] - 1] += _LAST - _INNER
        codes[lines] = ord("\n")
        return codes.astype("<u4").tobytes().decode("utf-32-le")

    def _learn(self, words: list[str]) -> None:
        """Encode new words and append them to the flat table."""
        text = "\n".join(words).replace("İ", "i̇").lower() + "\n"
        ids = np.array(self.encoder.encode_ordinary(self._cut(text)), np.int32)
        breaks = np.flatnonzero(ids == self.separator)
        known = len(self.memo)
        self.memo.update(zip(words, range(known, known + len(words))))
        self.flat.append(np.delete(ids, breaks))
        before = self.starts[-1][-1]
        self.starts.append(before + breaks - np.arange(len(breaks)))

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets) of distinct words without blanks or line breaks."""
        if len(self.memo) > _LIMIT:
            self._clear()
        fresh = [w for w in words if w not in self.memo]
        if fresh:
            self._learn(fresh)
        self.flat, self.starts = [np.concatenate(self.flat)], [np.concatenate(self.starts)]
        numbers = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        flat, starts = self.flat[0], self.starts[0]
        lengths = starts[numbers + 1] - starts[numbers]
        return flat[spread(starts[numbers], lengths)], np.concatenate([[0], np.cumsum(lengths)])

    @staticmethod
    def _coded(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(word number of each place, distinct words, where each text ends); what lies between is freed on return."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        column = pc.replace_substring(column, "\n", " ")
        lists = pc.split_pattern(column, " ")
        del column
        ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary, ends

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets) of a column of texts; null counts as empty."""
        index, names, ends = self._coded(column)
        odd = pc.match_substring_regex(names, _UNUSUAL).to_numpy(zero_copy_only=False)
        plain = names.filter(pa.array(~odd))
        tables, lengths = [], np.zeros(len(names), np.int64)
        starts = np.zeros(len(names), np.int64)
        places, size = np.flatnonzero(~odd), 0
        for at in range(0, len(plain), _SLICE):
            ids, offsets = self.words(plain.slice(at, _SLICE).to_numpy(zero_copy_only=False).tolist())
            own = places[at : at + _SLICE]
            lengths[own], starts[own] = np.diff(offsets), size + offsets[:-1]
            tables.append(ids)
            size += len(ids)
        for at in np.flatnonzero(odd):
            own = self.library.encode(names[int(at)].as_py(), add_special_tokens=False).ids
            tables.append(np.array(own, np.int32))
            starts[at], lengths[at] = size, len(own)
            size += len(own)
        table = np.concatenate([np.zeros(0, np.int32), *tables])
        each = lengths[index]
        until = np.concatenate([[0], np.cumsum(each)])
        return table[spread(starts[index], each)], until[ends]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    out = np.repeat(starts - before, lengths)
    out += np.arange(total)
    return out
