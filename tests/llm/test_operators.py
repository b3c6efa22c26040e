"""The operators against brute force and on awkward rows."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
from weblens.llm import byte_network, hilbert_search, language_id, licences, mixing, ngram_join, packing, secret_scan, voronoi, warc
from weblens.llm.packing import best_fit, improve

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, root string, key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "r", "k") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


@pytest.mark.parametrize("name", ["op1_warc_segments", "op3_pareto_mixing", "op5_ngram_join", "op6_voronoi_join"])
def test_matches_sql(spark, con, name):
    assert check.compare(spark, con, SF, name).startswith("ok")


AWKWARD = [(1, None, "a"), (2, "", None), (None, "one two three four five six", "a"), (4, "x " * 60_000, "b"), (4, "x " * 60_000, "b"), (5, " \t\n ", "b"), (6, "one Two three four five SIX", "a")]


def test_awkward_rows(spark):
    rows = docs(spark, AWKWARD)
    assert secret_scan.scan(rows).count() == 7
    assert mixing.mix(rows).count() == 7
    assert language_id.identify(language_id.document_evidence(rows)).where("rejected").count() == 3
    joined = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(rows).collect()}
    assert joined == {(1, 0, 1), (2, 0, 2), (None, 2, None), (4, 1, 4), (5, 0, 5), (6, 2, 6)}
    assert licences.scan(licences.document_files(rows)).count() == 7
    net = byte_network.learn([], np.zeros(0), np.zeros(0))
    assert {r.score for r in byte_network.score(rows, net).collect()} == {0.5}


def test_empty_tables(spark):
    rows = docs(spark, [])
    vectors = spark.createDataFrame([], "vec_id long, vector array<long>")
    real = spark.createDataFrame([], "vec_id long, vector array<double>")
    pages = spark.createDataFrame([], "page_id long, url string, payload binary")
    for out in (
        secret_scan.scan(rows), mixing.mix(rows), language_id.identify(language_id.document_evidence(rows)), ngram_join.join(rows),
        licences.scan(licences.document_files(rows)), voronoi.knn_join(vectors, F.lit(True), 5),
        hilbert_search.search(real, F.lit(True), 5), warc.round_trip(pages),
    ):
        assert out.count() == 0


def test_jaccard_against_all_pairs(spark):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(12):
        base = [draw.choice(words) for _ in range(draw.choice([3, 8, 40, 150]))]
        for _ in range(draw.choice([1, 3, 90])):
            text = list(base)
            for _ in range(draw.randint(0, 4)):
                text[draw.randrange(len(text))] = draw.choice(words)
            rows.append((len(rows), " ".join(text), "s"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs(spark, rows)).collect()}
    sets = []
    for _, text, _ in rows:
        w = text.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))})
    label = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    assert got == {i: (len(s), label[i]) for i, s in enumerate(sets)}


def test_secret_spans(spark):
    key = "q7Zk2LmX9vB4nT8sW1yR6cD3fG5hJ0pK"
    texts = [f'Api_Key = "abc.def/12" and {key} end', "AKIA" + "A1" * 6 + " AKIA12", "f" * 32 + " " + "e" * 31, "token=secret:abcdefgh", "é password: 12345678"]
    out = {r.doc_id: r for r in secret_scan.scan(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), q=0.01).collect()}
    kinds = {i: [(s["kind"], s["start"], s["end"]) for s in r.all_spans] for i, r in out.items()}
    assert kinds[0] == [(0, 0, 21), (3, 27, 59)]
    assert kinds[1] == [(1, 0, 16)] and kinds[2] == [(2, 0, 32)]
    assert kinds[3] == [] and kinds[4] == [(0, 2, 20)]
    assert out[1].base_sha256 == hashlib.sha256(b"access:0:16").hexdigest()
    assert secret_scan.text_p("internationalization"[:20], secret_scan.ALPHABETS["base36"], {c: s / 100 for c, s in secret_scan.LETTERS.items()}) > 1e-3


def test_masking_keeps_rows(spark):
    rows = docs(spark, [(1, "token = abcdefghijk and more", "s"), (2, "clean", "s"), (3, None, "s")])
    out = {r.doc_id: r.text for r in secret_scan.mask(rows, secret_scan.scan(rows)).collect()}
    assert out == {1: "[SECRET] and more", 2: "clean", 3: None}


def test_mixing_reaches_targets(spark):
    draw = random.Random(2)
    rows = [(i, "w " * draw.choice([1, 20, 300]), draw.choice(["a", "b", "c", None])) for i in range(400)]
    mixed = mixing.mix(docs(spark, rows)).cache()
    assert mixed.where("taken > 3 * size").count() == 0
    for r in mixed.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n")).collect():
        assert abs(r.n - r.t) <= 150  # at most half the size of a document
    assert sorted(mixed.select("doc_id", "taken").collect()) == sorted(mixing.mix(docs(spark, rows)).select("doc_id", "taken").collect())


def test_packing_is_tight_and_whole(spark):
    out = entry.queries()["op9_swap_packing"](spark, SF).toPandas()
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and (g.offset.to_numpy() == np.concatenate([[0], g.length.cumsum()[:-1]])).all()
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 2048) + 2
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        parts = out[out.doc_id == r.doc_id].sort_values("piece")
        assert parts.ids_crc32.tolist() == [zlib.crc32(ids[i : i + 2048].tobytes()) for i in range(0, len(ids), 2048)]


def test_local_search_saves_bins():
    lengths = [60, 60, 40, 40, 35, 35, 30]
    bins = [[0, 4], [1, 5], [2, 3], [6]]
    assert len(improve(bins, lengths, 100)) == 3
    assert sorted(i for b in best_fit(lengths, 100) for i in b) == list(range(7))


def test_warc_framing_and_order(spark, tmp_path):
    tricky = b"a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nb" + bytes(range(256)) * 300
    rows = [(1, "http://a/ b\r\n", tricky), (2, None, b""), (3, "u", None), (4, "u", tricky), (None, "u", b"z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, payload binary")
    out = {r.page_id: r for r in warc.round_trip(pages, segment_bytes=1000).collect()}
    assert out[1].payload_bytes == out[4].payload_bytes == len(tricky) and out[1].n_segments > 50
    assert (out[4].record_type, out[4].refers_to, out[3].refers_to, out[2].record_type) == ("revisit", 1, 2, "response")
    assert out[None].payload_bytes == 1 and out[2].payload_bytes == 0
    parts = [(3, 7, b"e"), (1, None, b"abc"), (2, None, b"def")]
    assert warc.assemble(parts) == b"abcdefe"
    with pytest.raises(ValueError):
        warc.assemble(parts[:2])
    one, two = (b"WARC-Type: response\r\nContent-Length: %d\r\n\r\n%b" % (len(b), b) for b in (b"x\r\n\r\n", b"y" + warc.SEPARATOR.encode() + b"z"))
    cut = two.split(warc.SEPARATOR.encode())
    joined = [b"WARC/1.1\r\n" + one + warc.SEPARATOR.encode() + cut[0], cut[1] + b"\r\n\r\n"]
    assert [b for _, b in warc.split_records(iter(joined))] == [b"x\r\n\r\n", b"y" + warc.SEPARATOR.encode() + b"z"]


def test_hilbert_recall(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    out = entry.queries()["op7_hilbert_search"](spark, "/root/testdata/sf0.01").toPandas()
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").toPandas()
    x, ids, hits = np.stack(table.embedding).astype(float), table.vec_id.to_numpy(), []
    for query, found in out.groupby("query_id"):
        own = int(np.flatnonzero(ids == query)[0])
        scores = x @ x[own]
        scores[own] = -9
        hits.append(len(set(ids[np.argsort(-scores, kind="stable")[:20]]) & set(found.vec_id)) / 20)
    assert np.mean(hits) >= 0.9


def test_network_learns():
    draw = np.random.default_rng(1)
    good = [np.frombuffer(" ".join(draw.choice(["the", "of", "and", "tion"], 80)).encode(), np.uint8) for _ in range(60)]
    bad = [np.frombuffer(" | ".join(draw.choice(["the", "of", "and", "tion"], 80)).encode(), np.uint8) for _ in range(60)]
    net = byte_network.learn(good[:40] + bad[:40], np.repeat([1.0, 0.0], 40), np.ones(80), epochs=8)
    assert net.score(good[40:]).min() > 0.7 > net.score(bad[40:]).max()


def test_language_evidence(spark):
    rows = [(i, "le chat est dans la maison avec une fleur " * 3, "fr", "fr", "h.fr", "fr") for i in range(30)]
    rows += [(100 + i, "the cat is in the house with one flower " * 3, "en", "uk", "h.uk", "uk") for i in range(30)]
    rows += [(200, "xq", "fr", "fr", "h.fr", "fr"), (201, "xq", "en", "uk", "h.uk", "uk"), (202, "12 34", "en", "uk", "h.uk", "uk")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string, host string, domain string")
    out = {r.doc_id: r for r in language_id.identify(frame, languages=("en", "fr")).collect()}
    assert all(out[i].language == "fr" for i in range(30)) and out[200].language == "fr" and out[201].language == "en"
    assert out[202].rejected and out[202].language is None


def test_licence_inheritance(spark):
    mit = "Released under the MIT License."
    rows = [(1, "r", "LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "r", "a/b/x.py", "code"), (3, "r", "a/COPYING", mit), (4, "r", "y.py", "code"), (5, "q", "a/b/x.py", "code"), (6, "r", "a/z.py", "x\nThis work is licensed under the GNU General Public License, version 3.\ny")]
    out = {r.doc_id: (r.licence, r.basis) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, repo string, path string, text string")).collect()}
    assert out == {1: ("Apache-2.0", "own"), 2: ("MIT", "inherited"), 3: ("MIT", "own"), 4: ("Apache-2.0", "inherited"), 5: (None, "none"), 6: ("GPL-3.0", "own")}


def test_pipeline_stages(spark):
    import corpus_pipeline

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.columns == frame.columns, name
    near = corpus_pipeline.drop_near_duplicates(spark, docs(spark, [(1, "a b c d e f", "s"), (2, "A b c d e f", "s"), (3, None, "s"), (1, "a b c d e f", "s")]), SF)
    assert sorted(r.doc_id for r in near.collect()) == [1, 3]
