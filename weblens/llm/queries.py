"""Registered queries of this folder, with their production parameters."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from weblens.llm import (
    byte_network, coordinate_mining, hilbert_search, language_id, licences, lookup_clustering, mixing, ngram_join, packing, personal_data, secret_scan, voronoi, warc,
)
from weblens.llm.common import table
from weblens.llm.sql import ORACLES


def op1_warc_segments(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    return warc.round_trip(pages).drop("n_segments")


def op2_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    found = secret_scan.scan(table(spark, d, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", secret_scan.shown(F.col("all_spans")).alias("spans"), "n_random"
    )


def length_weight(text) -> object:
    """Odds factor of a document in the mix: longer texts are somewhat likelier."""
    words = mixing.word_count(text)
    return F.when(words >= 1000, 2.0).when(words >= 100, 1.5).otherwise(1.0)


def op3_pareto_mixing(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, weight=length_weight(F.col("text")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = language_id.document_evidence(table(spark, d, "documents"))
    return language_id.identify(docs).drop("text_key", "posteriors")


def language_id_pages(spark: SparkSession, d: str) -> DataFrame:
    """The same operator over web pages, where markup, suffix and host all speak."""
    pages = language_id.page_evidence(table(spark, d, "pages"))
    return language_id.identify(pages, id_column="page_id").drop("text_key", "posteriors")


def op5_ngram_join(spark: SparkSession, d: str) -> DataFrame:
    return ngram_join.join(table(spark, d, "documents"))


def op6_voronoi_join(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").where(voronoi.usable(F.col("embedding")))
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), voronoi.quantize(F.col("embedding")).alias("vector"))
    return voronoi.knn_join(vectors, F.col("vec_id") % 50 == 0, 5)


def op7_hilbert_search(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return hilbert_search.search(vectors, F.col("vec_id") % 20 == 0, 20)


def op8_byte_network(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    net = byte_network.fit(docs, table(spark, d, "labels"), ~held_out)
    scored = byte_network.score(docs, net)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_swap_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_licence_scan(spark: SparkSession, d: str) -> DataFrame:
    return licences.scan(licences.document_files(table(spark, d, "documents")))


def op11_lookup_clustering(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").where(voronoi.usable(F.col("embedding")) & (F.size("embedding") == 64))
    return lookup_clustering.cluster(rows.select("vec_id", voronoi.quantize(F.col("embedding"), 64).alias("vector")))


def op12_personal_data(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    found = personal_data.scan(docs, personal_data.fit(docs))
    return found.withColumn("spans", personal_data.shown(F.col("all_spans"))).drop("all_spans")


def op13_coordinate_mining(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").where(voronoi.usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = rows.select("vec_id", label.alias("label"), voronoi.quantize(F.col("embedding")).alias("vector"))
    return coordinate_mining.mine(vectors, F.col("vec_id") % 100 == 0)


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_segments, op2_secret_scan, op3_pareto_mixing, op4_language_id, language_id_pages,
        op5_ngram_join, op6_voronoi_join, op7_hilbert_search, op8_byte_network, op9_swap_packing,
        op10_licence_scan, op11_lookup_clustering, op12_personal_data, op13_coordinate_mining, pipeline,
    )
}

__all__ = ["ORACLES", "QUERIES"]
