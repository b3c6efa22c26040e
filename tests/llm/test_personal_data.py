"""Personal data: base spans against the plain patterns, the tagger on formats that no rule knows."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from weblens.llm import char_lstm, personal_data as personal

SCHEMA = "doc_id long, text string, lang string, spans string, all_spans string"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for n, d in enumerate(reversed(digits)):
        d = int(d) * (1 + n % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_base_spans_equal_the_patterns():
    draw = random.Random(1)
    pieces = ["a", "é", "@", ".", "-", " ", "+", "(", ")", "1", "22", "255", "256", "4", "4572801887383181", "+1 (826) 555-4081", "x.y@z-1.de", "10.0.0.1", "%", "\n", "０"]
    for _ in range(6000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(0, 14)))
        assert personal.base_spans(text) == brute(text), text


@pytest.mark.parametrize("text", ["a" * 1_000_000, "1" * 1_000_000, "1." * 500_000, "1 " * 500_000, "+1" + " " * 1_000_000, "a@" * 300_000, "+" * 1_000_000, "a." * 300_000 + "@"])
def test_linear_on_long_runs(text):
    start = time.time()
    personal.base_spans(text)
    assert time.time() - start < 20


def numbers(draw, forms):
    return "".join(draw.choice("0123456789") if c == "0" else c for c in forms)


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(5)
    words = "the a river house of green bird walks on night and slowly under tree by day".split()
    rows = []
    for i in range(700):
        text = " ".join(draw.choice(words) for _ in range(draw.randint(20, 60)))
        if i % 7 == 1:
            text += f" write {draw.choice(words)}.{draw.choice(words)}@mail{i % 9}.example.com today " + text
        if i % 7 == 2:
            text += " call " + numbers(draw, "+1 (000) 000-0000") + " now " + text
        if i % 7 == 3:
            text += " host " + ".".join(str(draw.randrange(256)) for _ in range(4)) + " is up " + text
        if i % 7 == 4:
            body = numbers(draw, "0" * 15)
            text += " paid by " + body + next(d for d in "0123456789" if luhn(body + d)) + " last " + text
        if i % 7 == 5:
            text += " in version 2.0 of " + str(1900 + i % 120) + " or " + hashlib.sha256(str(i).encode()).hexdigest()[:24] + " " + text
        rows.append((i, text, "en", "x", "y"))
    return rows


@pytest.fixture(scope="module")
def net(spark, table):
    return personal.fit(spark.createDataFrame(table, SCHEMA))


def test_scan_keeps_base_spans_and_leaves_clean_texts_alone(spark, table, net):
    awkward = [(900, None, None, None, None), (901, "", None, None, None), (None, "call +1 (234) 567-8901 now", None, None, None), (3, table[3][1], None, None, None)]
    rows = table + awkward + [(902, "x " * 400_000 + "mail me@here.example.org " + "y " * 400_000, None, None, None)]
    out = personal.scan(spark.createDataFrame(rows, SCHEMA), net).withColumn("spans", personal.shown("all_spans")).collect()
    assert len(out) == len(rows)
    want = sorted((i is None, i or 0, digest(brute(t or ""))) for i, t, *_ in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.base_sha256) for r in out) == want
    for r in out:
        base = [s for s in r.all_spans if s["kind"] < 4]
        assert [sum(s["kind"] == k for s in base) for k in range(4)] == [r.n_email, r.n_ip, r.n_card, r.n_phone]
        assert r.spans.count(":") == 2 * len(r.all_spans)
    clean = [r for r in out if r.doc_id is not None and r.doc_id < 700 and r.doc_id % 7 in (0, 5, 6)]
    assert sum(len(r.all_spans) > 0 for r in clean) <= 0.02 * len(clean)


def digest(spans):
    names = ("email", "ip", "card", "phone")
    return hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_tagger_finds_formats_without_a_rule(table, net):
    draw, found, asked = np.random.default_rng(77), 0, 0
    for n in range(240):
        kind, words = n % 4, table[7 * (n % 90)][1]
        span = personal.variant(kind, draw)
        text = f"{words[:150]} {span} {words[150:260]}"
        base = personal.base_spans(text)
        if base:
            continue
        asked += 1
        start = len(words[:150]) + 1
        found += (kind, start, start + len(span)) in personal.added_spans([text], [base], net)[0]
    assert asked > 100 and found >= 0.85 * asked


def test_windows_are_reconciled_over_the_whole_text(net):
    text = "walks on night " * 40 + "(234) 567-8901 " + "under tree by day " * 30
    start = text.index("(234)")
    for shift in range(0, 96, 7):  # wherever the windows' edges fall, the span is found once and whole
        moved = "z" * shift + " " + text
        spans = personal.added_spans([moved], [[]], net)[0]
        assert spans == [(3, start + shift + 1, start + shift + 15)]


def test_heaviest_set_without_overlaps():
    text = "0" * 40 + "12.34.56.78 " + "9" * 10
    one = (0, [(1, 40, 51, 0.9), (3, 40, 45, 0.6)])
    assert personal.reconcile(text, [one]) == [(1, 40, 51)]
    assert personal.reconcile("", []) == []
    assert personal.window_starts("a" * 100 + "1") == [48, 96]


def test_redaction_keeps_columns(spark, net):
    rows = [(1, "mail a.b@c.example now", "en", "s", "t"), (2, None, None, None, None), (3, "nothing", "en", "s", "t")]
    out = {r.doc_id: r for r in personal.redact(spark.createDataFrame(rows, SCHEMA), net).collect()}
    assert out[1].text == "mail [EMAIL] now" and out[2].text is None and out[3].text == "nothing"
    assert out[1].spans == "s" and out[1].all_spans == "t"


def test_empty_table_and_untrained_tagger(spark):
    rows = spark.createDataFrame([], SCHEMA)
    assert personal.scan(rows, personal.fit(rows)).count() == 0
    assert char_lstm.train([], [], 4, 96).spans(["call 234-567-8901"], 96) == [[]]


def test_crf_marginals_and_best_path_against_all_paths():
    import itertools

    net = char_lstm.Tagger(1)
    draw = np.random.default_rng(0)
    net.trans[:] = draw.normal(0, 1, net.trans.shape)
    e = draw.normal(0, 1, (1, 4, 3))
    pairs, opening = net.pairs().astype(float), net.opening().astype(float)

    def score(path):
        return opening[path[0]] + sum(e[0, t, y] for t, y in enumerate(path)) + sum(pairs[a, b] for a, b in zip(path, path[1:]))

    paths = {p: score(p) for p in itertools.product(range(3), repeat=4)}
    total = np.log(sum(np.exp(s) for s in paths.values()))
    single, pair, norm = net.marginals(e)
    assert abs(norm[0] - total) < 1e-6
    assert tuple(net.best(e)[0]) == max(paths, key=paths.get)
    for t, y in itertools.product(range(4), range(3)):
        assert abs(single[0, t, y] - sum(np.exp(s - total) for p, s in paths.items() if p[t] == y)) < 1e-6
    assert abs(pair[0, 1] - sum(np.exp(s - total) * sum(p[i : i + 2] == (0, 1) for i in range(3)) for p, s in paths.items())) < 1e-6
