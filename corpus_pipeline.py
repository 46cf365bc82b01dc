"""The corpus pipeline. Each stage takes all that its predecessor kept and reads it back from a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parqsieve.llm.common import read_table, scratch, scratch_path, written
from parqsieve.llm.decontaminate import decontaminate
from parqsieve.llm.minhash import keep_one
from parqsieve.llm.packing import pack
from parqsieve.llm.suffixes import remove_repeats
from parqsieve.llm.toxicity import train, without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from all labelled documents, and documents of a grade above 0 go."""
    model = train(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that are found twice go, wherever they are; the documents stay."""
    return remove_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]
ORACLE_SQL = None  # a trained model, hashes of shingles and packing aren't SQL; tests/llm/test_pipeline.py holds run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stages' operators write on their way is removed after each stage; the stages' own tables stay."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name.replace(' ', '-')}")
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), "stage", path)
    return docs
