"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorsift.llm.common import keep, shared_folder, table
from mirrorsift.llm.line_dedup import dedup_lines
from mirrorsift.llm.mixing import mix_documents
from mirrorsift.llm.ngram_join import ngram_jaccard_components
from mirrorsift.llm.packing import pack_documents
from mirrorsift.llm.queries import tokenizer_file
from mirrorsift.llm.toxicity import drop_toxic

#: How often a source's documents repeat at most in the mixture; each is used at least once.
REPETITION_LIMIT = 1.25
#: Near duplicates up to which their ids are sent to all executors (8 bytes each) rather than texts shuffled.
BROADCAST_IDS = 500_000


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat or nearly repeat an earlier one go; documents stay."""
    return dedup_lines(docs, percent=80)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; those without words all stay."""
    found = ngram_jaccard_components(docs, shingle=5, percent=80)
    gone = keep(found.where("doc_id <> component_id").select("doc_id").distinct())
    # from the plan alone Spark can't tell that they are few, and would shuffle all texts
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(side, "doc_id", "left_anti").select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of small sources repeat so that weights are nearer to one another."""
    return mix_documents(docs, repetition_limit=REPETITION_LIMIT)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of 4096 tokens."""
    return pack_documents(docs, tokenizer_file(), capacity=4096, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("ngram_join", one_of_each_group),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: The classifier and the tokenizer can't be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
