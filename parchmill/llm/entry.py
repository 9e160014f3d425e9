"""The registered queries of this subpackage: each applies one operator, with its production
parameters, to the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.llm import decontaminate, fertility, gam_quality, jaccard_forest, line_dedup, piece_codec, shards, storage, token_planes, toxic_crf, vocabularies, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo ``n``: what training and held-out rows are told apart by."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = token_planes.write(docs, vocabularies.public("word_bpe_49k.json"), storage.new_path(spark, "planes"))
    return token_planes.read(manifest)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hit_spans")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(table(spark, sf_dir, "pages"), storage.new_path(spark, "warc"))
    return warc.read(manifest).drop("url")


def op4_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_forest.join(table(spark, sf_dir, "documents"))


def op5_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "start")


def op8_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fertility.measure(docs, vocabularies.public("piece_bpe_32k.model"), vocabularies.public("byte_bpe_50k.tiktoken"))


def op6_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxic_crf.train(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    scored = toxic_crf.tag(docs, model)
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= toxic_crf.THRESHOLD).cast("int").alias("predicted"), "n_toxic_words", "toxic_spans")


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode(table(spark, sf_dir, "documents"), vocabularies.public("piece_bpe_32k.model"), digests=True)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.clean(table(spark, sf_dir, "documents"), F.col("source"), report=True)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op10_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = gam_quality.train(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    scored = gam_quality.score(docs, model)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= gam_quality.THRESHOLD).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_planes, op2_decontamination, op3_warc, op4_jaccard_forest, op5_byte_shards, op6_toxic_crf, op7_piece_codec, op8_fertility_rules, op9_line_dedup, op10_gam_quality)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from parchmill.llm import oracles

    return dict(oracles.ORACLES)
