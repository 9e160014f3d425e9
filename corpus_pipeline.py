"""The corpus pipeline: documents to encoded training texts, in five written stages.

Each stage reads what its predecessor kept, whole, and its decisions take effect:
quality rules reject documents, line dedup drops boilerplate lines, the n-gram Jaccard join
keeps one document of each group, decontamination removes documents that hold benchmark
passages, and the last stage encodes what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.llm import decontaminate, fertility, jaccard_forest, line_dedup, piece_codec, storage, vocabularies

PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fertility bands."""
    return fertility.keep(docs, vocabularies.public(PIECES), vocabularies.public(BYTES))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; n_chars follows the text."""
    cleaned = line_dedup.clean(docs, F.col("source"))
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return jaccard_forest.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), action="documents")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, n_byte_pieces, round_trip."""
    return piece_codec.encode(docs, vocabularies.public(PIECES))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", encoding),
]

#: Tokenisers take part in the first and last stages: tests/llm/test_pipeline.py holds every stage
#: and the whole run against versions in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again.
    What a stage wrote on its way, and the result before the last, are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with storage.scratch(spark) as made:
            after = storage.keep(made, storage.materialise(stage(spark, docs, sf_dir), f"stage-{k}"))
        if before is not None:
            storage.discard(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)
