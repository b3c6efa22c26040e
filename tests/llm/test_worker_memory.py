"""Tokenizing for packing: few texts at a time, with the library's ids."""

import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa

from weblens.llm import packing, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def batches(texts, rows=500):
    for at in range(0, len(texts), rows):
        some = texts[at : at + rows]
        yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(some)), pa.int64()), pa.array(some, pa.string())], names=["doc_id", "text"])


def some_texts(number, words, seed=5):
    draw = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    return [" ".join("".join(draw.choices(letters, k=draw.randint(2, 9))) for _ in range(words)) for _ in range(number)]


def test_few_bytes_are_tokenized_at_a_time(monkeypatch):
    """Chunks stay near a limit, whatever the batches; rows longer than that go alone."""
    seen, texts_of = [], tokens.WordTokenizer.texts
    monkeypatch.setattr(tokens.WordTokenizer, "texts", lambda self, column: seen.append((len(column), column.nbytes)) or texts_of(self, column))
    texts = some_texts(700, 600)
    texts[350] = " ".join(texts[:300])
    out = list(packing._pieces(PATH, 2048)(batches(texts)))
    assert sum(n for n, _ in seen) == 700
    assert all(size <= 1 << 21 for n, size in seen if n > 1), seen
    assert sorted({i for b in out for i in b["doc_id"].to_pylist()}) == list(range(700))


def test_chunks_and_slices_change_no_ids(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CHUNK_BYTES", 1 << 10)
    monkeypatch.setattr(tokens, "_SLICE", 7, raising=False)
    monkeypatch.setattr(tokens, "_LIMIT", 50)
    texts = [None, "", " ", "\n\n", "Ünïcode naïve's  İstanbul", "日本語 text — mixed\tand\r\nbroken", "it's we'll 'S don't 1234 a1b2", *some_texts(40, 60), None, "", *some_texts(3, 3000, 6)]
    library, want = Tokenizer.from_file(PATH), []
    for doc, text in enumerate(texts):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(doc, n, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for n, a in enumerate(range(0, len(ids), 64))]
    rows = [r for b in packing._pieces(PATH, 64)(batches(texts, 9)) for r in b.to_pylist()]
    assert [tuple(r.values())[:5] for r in rows] == want
    assert [r["salt"] for r in rows] == list(range(len(rows)))


def test_known_words_are_not_cut_again():
    """A second pass over the same words makes no call for each of them."""
    tokenizer = tokens.WordTokenizer(PATH)
    column = pa.array(some_texts(20, 400, 7), pa.string())
    first, calls = tokenizer.texts(column), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        again = tokenizer.texts(column)
    finally:
        sys.setprofile(None)
    assert all((a == b).all() for a, b in zip(first, again))
    assert calls < 2000, calls  # for 8,000 distinct words


def test_ids_of_marks_and_letters_are_the_librarys():
    from tokenizers import Tokenizer

    library, draw = Tokenizer.from_file(PATH), random.Random(9)
    signs = [chr(c) for c in range(0x21, 0x250) if not 0x7F <= c <= 0xA0 and c != 0xAD]
    parts = ["'s", "'t", "'RE", "'ve", "'m", "'LL", "'d", "'r", "'l", "'v", "'", "''", "a", "re", "12", "İ", "Ⱥ", "½", "²", "-", '"', "don", *signs]
    words = ["'", "'s", "''s", "!'s", "'s's", "1's", "'really", "'story", "don't've", "x'", "x'r", "x're", "x'l", "İ", "Iİ's", "ȺȾ'd"]
    words += signs + [a + "'" + b for a in ("x", "7", "!", "é") for b in ("s", "st", "re", "r", "vex", "llé", "d1", "é")]
    words += ["".join(draw.choices(parts, k=draw.randint(1, 8))) for _ in range(4000)]
    ids, offsets = tokens.WordTokenizer(PATH).texts(pa.array(words, pa.string()))
    for word, a, b in zip(words, offsets, offsets[1:], strict=False):
        assert ids[a:b].tolist() == library.encode(word, add_special_tokens=False).ids, word
