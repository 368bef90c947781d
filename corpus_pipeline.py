"""From documents to a token corpus: toxic documents go, repeated lines go, one document of each near-duplicate group stays,
sources are mixed to their weights, and the mix is encoded.

Each stage takes (spark, docs, sf_dir) and returns a table that the next one reads as docs. Nulls, empty texts and repeated rows
are treated as each operator says; empty tables pass through.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafpress.llm import bpe, lines, mixing, shingles, toxicity
from leafpress.llm.base import documents, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fitted scorer gives 0.5 or more go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.with_toxicity(docs, model).filter("toxic_score < 0.5").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with an equal or nearly equal earlier line go; a document without a line left stays as an empty one."""
    return _counted(lines.drop_repeated_lines(docs)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 0.8 or more of their five-word shingles the one with the smallest id stays."""
    return shingles.keep_one(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; at each source's cut one document gives its first words."""
    return _counted(mixing.draw(mixing.mix_sources(docs))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, decoded for each row of the mix."""
    coded = bpe.with_ids(docs.select("doc_id", "source", "text"), bpe.default_path())
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_duplicates), ("mix", mix), ("bpe", encode)]

#: SQL has neither the merges of a tokenizer nor the fitted scorer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, top = documents(spark, sf_dir), f"{shared_dir(spark)}/pipeline-{uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}_{name}")
        docs = spark.read.parquet(f"{top}/{k}_{name}")
    return docs
