"""Reads given row groups and stretches of rows, and nothing else."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parqsieve.sources import footers

BATCH = 8192
TASK_BYTES = 128 << 20
MOST_TASKS = 20_000


def read_ranges(groups: DataFrame, schema: T.StructType, opener: footers.Opener = footers.open_file, tasks: int = 200) -> DataFrame:
    """The rows of groups (file, rg, num_rows, ranges: array of first, n; null: the whole group), with the columns of schema.

    A column that a file lacks is null. Row groups are dealt out one by one to a stated number of tasks: by the few bytes that
    name them, adaptive planning would put them all into one. Batches without a selected row
    are dropped before they leave the reader.
    """
    arrow, names = to_arrow_schema(schema), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, rg, rows, ranges in zip(*(c.to_pylist() for c in b.columns), strict=True):
                chosen = np.zeros(rows, bool)
                for r in [{"first": 0, "n": rows}] if ranges is None else ranges:
                    chosen[r["first"] : r["first"] + r["n"]] = True
                with opener(path) as file:
                    yield from picked(pq.ParquetFile(file), rg, chosen)

    def picked(file: pq.ParquetFile, rg: int, chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
        held, at = [n for n in names if n in file.schema_arrow.names], 0
        if not held:
            n = int(chosen.sum())
            yield pa.RecordBatch.from_arrays([pa.nulls(n, f.type) for f in arrow], schema=arrow)
            return
        for batch in file.iter_batches(BATCH, row_groups=[rg], columns=held):
            mask = chosen[at : at + batch.num_rows]
            at += batch.num_rows
            if not mask.any():
                continue
            part = batch if mask.all() else batch.filter(pa.array(mask))
            yield pa.RecordBatch.from_arrays([part.column(f.name).cast(f.type) if f.name in held else pa.nulls(part.num_rows, f.type) for f in arrow], schema=arrow)

    wanted = groups.select("file", "rg", "num_rows", "ranges")
    return wanted.repartition(tasks).mapInArrow(run, schema)


def tasks_for(files: DataFrame) -> int:
    """By the listed lengths: one for 128 MB, at least as many as there are cores; beyond 20,000 tasks each has more to read, in turn."""
    total = files.agg(F.sum("length")).first()[0] or 0
    return min(MOST_TASKS, max(files.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES)))
