"""Who knows which values a row group holds. Users give their own by deriving from Evidence."""

from __future__ import annotations

import uuid
from abc import ABC
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parqsieve.sources import footers

KEYS = ("file", "length", "modified", "rg")
SHARES = 16
BATCH_VALUES = 100_000  # about as many values are handed on at a time


class Evidence(ABC):
    """Of many row groups at once, as DataFrames; what isn't known is null."""

    def absent(self, groups: DataFrame, asked: dict[int, tuple[T.DataType, tuple]]) -> DataFrame:
        """groups with absent_i (array of booleans) for the values of each asked column."""
        return groups.select("*", *[F.lit(None).cast("array<boolean>").alias(f"absent_{i}") for i in asked])

    def dictionaries(self, groups: DataFrame, column: str, kind: T.DataType) -> DataFrame:
        """file, length, modified, rg, values: all distinct values of a leaf, or null."""
        return groups.select(*KEYS, F.lit(None).cast(T.ArrayType(kind)).alias("values"))

    def with_values(self, groups: DataFrame, name: str, column: str, kind: T.DataType) -> DataFrame:
        """groups with what dictionaries() knows as ``name``."""
        found = self.dictionaries(groups.select(*KEYS), column, kind)
        return groups.join(found.withColumnRenamed("values", name), list(KEYS), "left")


class FooterEvidence(Evidence):
    """Bloom filters as the files hold them; dictionaries unknown."""

    def __init__(self, opener: footers.Opener = footers.open_file):
        self.opener = opener

    def absent(self, groups: DataFrame, asked: dict[int, tuple[T.DataType, tuple]]) -> DataFrame:
        return footers.absent_values(groups, asked, self.opener)


class ScannedEvidence(FooterEvidence):
    """Also dictionaries, from the one column of each row group; null beyond ``most`` values. For columns of few values, with a cache."""

    def __init__(self, opener: footers.Opener = footers.open_file, most: int = 10_000):
        super().__init__(opener)
        self.most = most

    def dictionaries(self, groups: DataFrame, column: str, kind: T.DataType) -> DataFrame:
        opener, most, held = self.opener, self.most, footers.arrow_type(kind)
        if "." in column or held is None:
            return super().dictionaries(groups, column, kind)

        def values(file: pq.ParquetFile, rg: int) -> list | None:
            seen: set = set()
            for batch in file.iter_batches(row_groups=[rg], columns=[column]):
                seen.update(batch.column(0).unique().cast(held).to_pylist())
                if len(seen) > most + 1:
                    return None
            seen.discard(None)
            return list(seen) if len(seen) <= most else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, file, parsed = None, None, None
            try:
                for b in batches:
                    found, at, size = [], 0, 0
                    for r, (path, rg) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True), 1):
                        if path != last:
                            if file is not None:
                                file.close()
                            file, last = opener(path), path
                            parsed = pq.ParquetFile(file)
                            known = column in parsed.schema_arrow.names
                        found.append(values(parsed, rg) if known else None)
                        size += len(found[-1] or ())
                        if r == b.num_rows or size > BATCH_VALUES:
                            yield pa.RecordBatch.from_arrays([*b.slice(at, r - at).columns, pa.array(found, pa.list_(held))], names=[*KEYS, "values"])
                            found, at, size = [], r, 0
            finally:
                if file is not None:
                    file.close()

        keys = by_file(groups.select(*KEYS))
        return keys.mapInArrow(run, T.StructType([*keys.schema.fields, T.StructField("values", T.ArrayType(kind))]))


def by_file(keys: DataFrame) -> DataFrame:
    """Row groups of a file one after the other, so that a task parses a footer once, however many row groups it lists.

    To a stated number of tasks: by the few bytes of the keys, adaptive planning would put them all into one. At most SHARES tasks open the same file."""
    spark = keys.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return keys.repartition(tasks, "file", F.col("rg") % SHARES).sortWithinPartitions("file", "rg")


class CachedEvidence(Evidence):
    """Keeps the known dictionaries of another in a table below ``store`` (a folder that all machines see), by version of file; loads only what is missing."""

    def __init__(self, inner: Evidence, store: str):
        self.inner, self.store, self.kinds = inner, store.rstrip("/"), {}
        self.parts: dict[str, list[str]] = {}

    def absent(self, groups: DataFrame, asked: dict[int, tuple[T.DataType, tuple]]) -> DataFrame:
        return self.inner.absent(groups, asked)

    def held(self, spark: SparkSession, column: str) -> DataFrame:
        schema = T.StructType.fromDDL("file string, length long, modified timestamp, rg int").add("values", T.ArrayType(self.kinds[column]))
        return spark.read.schema(schema).parquet(*self.parts[column]) if self.parts.get(column) else spark.createDataFrame([], schema)

    def load(self, groups: DataFrame, column: str, kind: T.DataType) -> None:
        """Keeps what the other knows of the row groups that aren't held yet."""
        self.kinds[column] = kind
        missing = groups.select(*KEYS).join(self.held(groups.sparkSession, column), list(KEYS), "left_anti")
        part = f"{self.store}/dictionaries-{uuid.uuid4().hex}"
        self.inner.dictionaries(missing, column, kind).where("values is not null").write.parquet(part)
        self.parts.setdefault(column, []).append(part)

    def dictionaries(self, groups: DataFrame, column: str, kind: T.DataType) -> DataFrame:
        self.load(groups, column, kind)
        return groups.select(*KEYS).join(self.held(groups.sparkSession, column), list(KEYS), "left")

    def with_values(self, groups: DataFrame, name: str, column: str, kind: T.DataType) -> DataFrame:
        """Joins what is held at once, so that the footers behind groups aren't read a second time for its keys."""
        self.load(groups, column, kind)
        return groups.join(self.held(groups.sparkSession, column).withColumnRenamed("values", name), list(KEYS), "left")

    def entries(self, spark: SparkSession) -> int:
        return sum(self.held(spark, c).count() for c in self.parts)

    def clear(self) -> None:
        """Forgets all; the files are the store's owner's to delete."""
        self.parts.clear()

    def retarget(self, inner: Evidence) -> None:
        self.inner = inner
        self.clear()
