"""Corpus pipeline: quality filter, near-duplicate removal, repeated passages, benchmark leaks, source mix."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.decontaminate import without_leaks
from cohortry.llm.mixing import mix, output_shards
from cohortry.llm.quality import good_documents
from cohortry.llm.simhash import one_of_each_group
from cohortry.llm.suffixes import without_repeats
from cohortry.llm.text import read
from cohortry.session import checkpoint_dir


#: texts sent to a Python worker at once: long ones make a batch of the default 10,000 rows too large for small executors
BATCH_ROWS = 1_000


def _bounded(spark: SparkSession) -> SparkSession:
    """The session, with batches of bounded size for what it runs from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return good_documents(docs, read(_bounded(spark), sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: Jaccard 0.8 on five-word runs, which goes beyond SimHash links."""
    return one_of_each_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has as well; a document of which nothing is left goes."""
    cut = without_repeats(docs, as_text=True).where("n_removed = 0 or n_removed < n_bytes")
    new = {"text": F.when(F.col("had_text"), F.col("kept"))}
    new["n_chars"] = F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length("kept"))
    return cut.select(*[(new[c].cast(kind) if c in new else F.col(f"row.`{c}`")).alias(c) for c, kind in docs.dtypes])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return without_leaks(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, a row per copy, with its output shard and place."""
    return output_shards(mix(docs)).select("row.*", "shard", "place")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("mixture", mixture),
]

ORACLE_SQL = None  # the classifier and SimHash aren't expressible; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written to the shared folder and read again."""
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
