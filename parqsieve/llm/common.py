"""What the operators share: column picking, scratch tables, Arrow iteration."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parqsieve.sources.scratch import delete_path, scratch, scratch_path, shared_dir, written

__all__ = ["delete_path", "join_hot", "limit_threads", "map_rows", "pick", "read_table", "scratch", "scratch_path", "shared_dir", "shuffle_partitions", "slices", "written"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Columns by their exact names, as new names; any others may bear any name, even one that differs in case only."""
    missing = [c for c in columns.values() if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; there are {df.columns}")
    places = {new: f"_c{df.columns.index(old)}" for new, old in columns.items()}
    by_place = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return by_place.select(*[F.col(p).alias(new) for new, p in places.items()])


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *added: T.StructField) -> DataFrame:
    """df after run over its batches, whose columns go by place; any names come back as they were, with those of the added columns."""
    kinds = [T.StructField(f"_c{i}", f.dataType, f.nullable) for i, f in enumerate([*df.schema.fields, *added])]
    inner = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return inner.mapInArrow(run, T.StructType(kinds)).toDF(*df.columns, *[f.name for f in added])


def join_hot(many: DataFrame, one: DataFrame, keys: list[str], copies: str, total: int, how: str = "inner") -> DataFrame:
    """many joined with one, whose keys are unique and whose column ``copies`` says how often many has a key; without that column.

    Keys with more than a share of 1 / (4 * partitions) of the ``total`` rows of many are hot. There are at most 4 * partitions of
    them, so these are broadcast and their rows stay where they are; the others are joined by a shuffle.
    """
    spark = many.sparkSession
    share = max(1, total // (4 * shuffle_partitions(spark)))
    hot = F.broadcast(one.where(F.col(copies) > share).drop(copies))
    cold = many.join(hot.select(*keys), keys, "left_anti").join(one.where(F.col(copies) <= share).drop(copies), keys, how)
    return cold.unionByName(many.join(hot, keys))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Small pieces of each batch, so that few texts are Python objects at one time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def limit_threads() -> None:
    """One thread for each task, as Spark plans its cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("OMP_NUM_THREADS", "1")
