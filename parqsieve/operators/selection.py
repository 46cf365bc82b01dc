"""Selections of rows: runs that skip or select, row ids, and bitmaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A bitmap holds row ids of 32 bits.
MOST_ROWS = (1 << 32) - 1
BUCKET = 32_768


def fits_bitmap(total_rows: int) -> bool:
    return 0 <= total_rows <= MOST_ROWS


def runs(groups: DataFrame) -> DataFrame:
    """file, run, start, n, skip: the runs over the kept row groups of each file, in order, as if these were all there is.

    groups: file, rg, num_rows, ranges (array of first, n; null: the whole group). Partitioned by file.
    """
    before = Window.partitionBy("file").orderBy("rg").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("base", F.coalesce(F.sum("num_rows").over(before), F.lit(0)))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("num_rows").cast("long").alias("n")))
    cuts = placed.select("file", "base", "num_rows", F.coalesce("ranges", whole).alias("ranges"))
    selected = cuts.select("file", F.explode(F.transform("ranges", lambda r: F.struct((F.col("base") + r["first"]).alias("start"), r["n"].alias("n"), F.lit(False).alias("skip")))).alias("x")).select("file", "x.*")
    total = cuts.groupBy("file").agg(F.max(F.col("base") + F.col("num_rows")).alias("total"))
    order = Window.partitionBy("file").orderBy("start")
    ended = selected.withColumn("end", F.col("start") + F.col("n"))
    joined = ended.withColumn("fresh", F.coalesce(F.lag("end").over(order) != F.col("start"), F.lit(True)).cast("int")).withColumn("island", F.sum("fresh").over(order))
    islands = joined.groupBy("file", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    gaps = islands.join(total, "file").select("file", F.col("end").alias("start"), F.coalesce(F.lead("start").over(Window.partitionBy("file").orderBy("start")), F.col("total")).alias("end"))
    lead_in = islands.groupBy("file").agg(F.min("start").alias("end")).select("file", F.lit(0).cast("long").alias("start"), "end")
    skipped = gaps.unionByName(lead_in).where("end > start").withColumn("skip", F.lit(True))
    every = islands.select("file", "start", "end", F.lit(False).alias("skip")).unionByName(skipped)
    return every.select("file", F.row_number().over(order).alias("run"), "start", (F.col("end") - F.col("start")).alias("n"), "skip")


def row_ids(made: DataFrame) -> DataFrame:
    """file, row_id of the selected rows of runs."""
    return made.where("not skip").select("file", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("row_id"))


def runs_of_ids(ids: DataFrame) -> DataFrame:
    """file, start, n of the runs that the row ids make up."""
    order = Window.partitionBy("file").orderBy("row_id")
    islands = ids.withColumn("island", F.col("row_id") - F.row_number().over(order))
    return islands.groupBy("file", "island").agg(F.min("row_id").alias("start"), F.count("*").alias("n")).drop("island")


def bitmaps(ids: DataFrame) -> DataFrame:
    """file, bucket, bits: bitmaps of 32,768 row ids each."""
    one_based = F.col("row_id") + 1
    return ids.groupBy("file", F.bitmap_bucket_number(one_based).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one_based)).alias("bits"))


def bitmaps_of_runs(made: DataFrame) -> DataFrame:
    """The same of the selected rows of runs, without a row for each id: a run is cut at the buckets, and a bucket's bits are set stretch by stretch."""
    size = F.lit(BUCKET)
    cut = made.where("not skip").select("file", "start", (F.col("start") + F.col("n")).alias("end"), F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("n") - 1) / size))).alias("k"))
    stretch = F.struct((F.greatest("start", F.col("k") * size) - F.col("k") * size).cast("int").alias("first"), (F.least("end", (F.col("k") + 1) * size) - F.col("k") * size).cast("int").alias("last"))
    held = cut.groupBy("file", (F.col("k") + 1).alias("bucket")).agg(F.collect_list(stretch).alias("stretches"))  # at most half as many as a bucket has rows

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for stretches in b.column(2).to_pylist():
                step = np.zeros(BUCKET + 1, np.int32)
                for s in stretches:
                    step[s["first"]] += 1
                    step[s["last"]] -= 1
                out.append(np.packbits(np.cumsum(step[:-1]) > 0, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["file", "bucket", "bits"])

    return held.mapInArrow(bits, "file string, bucket long, bits binary")


def ids_of_bitmaps(maps: DataFrame) -> DataFrame:
    """file, row_id of the bits that are set."""
    byte: Column = F.conv(F.hex(F.substring("bits", F.col("at") + 1, 1)), 16, 10).cast("int")
    bytes_ = maps.select("file", "bucket", "bits", F.explode(F.sequence(F.lit(0), F.length("bits") - 1)).alias("at")).select("file", "bucket", "at", byte.alias("byte")).where("byte <> 0")
    bits = bytes_.select("file", "bucket", "at", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit")).where("(byte >> bit) & 1 = 1")
    return bits.select("file", ((F.col("bucket") - 1) * 32768 + F.col("at") * 8 + F.col("bit")).alias("row_id"))
