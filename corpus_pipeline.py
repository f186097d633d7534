"""The corpus pipeline: stages that read documents and hand documents on, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import line_dedup, mixing, near_dedup, pieces, toxicity
from docsieve.session import checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier, fitted on the labelled ones, holds to be toxic go; labels themselves decide nothing."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, model).filter("score < 0.5").select("doc.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five or more documents share stay in one of them; every document stays, if only with an empty text."""
    cut = line_dedup.drop_repeated_lines(docs)
    return cut.select(F.col("doc").withField("text", F.col("kept_text")).alias("doc")).select("doc.*")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 % of their shingles of five words, directly or by way of others, one stays."""
    return near_dedup.drop_near_duplicates(docs, words=5, percent=80).select("doc.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in training order; a document that the mix takes twice comes twice."""
    return mixing.mix(docs).select("doc.*")


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as pieces, after a check that they decode to the same text."""
    return pieces.encode_pieces(docs).select("doc.*", "n_pieces", "piece_ids", "round_trip")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("sentence_pieces", piece_stage),
]

#: The stages aren't expressible in SQL (a trained classifier, a tokenizer); tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{spark.sql('select uuid()').first()[0]}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
