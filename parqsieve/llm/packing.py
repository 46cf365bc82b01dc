"""Packing of token pieces into sequences by patterns fitted with non-negative least squares.

A document's tokens and one end token are cut into pieces of ``CAPACITY`` tokens from the end, so that the first piece
holds the rest; a document that fits is one piece. Pieces of full length are sequences of their own. For the others the
histogram of lengths (at most CAPACITY rows, however large the corpus) goes to the driver. Patterns are enumerated: for
each length the fullest companies of two, three and four lengths. Non-negative least squares fits how often each
pattern is used, the counts are rounded down and never exceed what is there, and the rest of the histogram is packed by
best fit, decreasing, on counts. So the plan doesn't grow with the corpus. Each piece finds its place from its rank
among the pieces of its length, which comes from counts of each (task, length) and not from a global sort.

Null and empty texts are the end token alone. Repeated rows are documents of their own; a null doc_id stays null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from parqsieve.llm.common import pick, read_table, slices, written
from parqsieve.llm.tokens import encoder

CAPACITY = 1024
END = 2
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
Pattern = tuple[int, ...]


def patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, near: int = 3, common: int = 48) -> list[Pattern]:
    """Companies of up to four of the lengths there are, each filled up to the capacity as far as can be."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    fits = np.maximum.accumulate(np.where(have, np.arange(capacity + 1), 0))  # the longest length of at most so much
    found: set[Pattern] = set()

    def close(base: Pattern) -> None:
        room = capacity - sum(base)
        for _ in range(near):
            last = int(fits[room]) if room > 0 else 0
            if not last:
                break
            found.add(tuple(sorted((*base, last), reverse=True)))
            room = last - 1

    often = [int(x) for x in lengths[np.argsort(-counts, kind="stable")[:common]]]
    for a in lengths.tolist():
        found.add((a,))
        close((a,))
        for b in often:
            if a + b < capacity:
                close((a, b))
                for c in often[:8]:
                    if c <= b and a + b + c < capacity:
                        close((a, b, c))
    return sorted(found, reverse=True)


def non_negative_least_squares(pats: list[Pattern], lengths: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that makes sum of x[p] * (how often p holds each length) close to counts, in weighted squares: multiplicative steps, which keep x non-negative and never raise the error."""
    row = np.searchsorted(lengths, np.array([x for p in pats for x in p]))
    column = np.repeat(np.arange(len(pats)), [len(p) for p in pats])
    weight = 1 / np.maximum(counts, 1.0)
    fill = np.array([sum(p) for p in pats], float)
    x = (fill / fill.max()) ** 64 * counts.sum() / len(pats) + 1e-9  # begin with the full patterns
    target = np.bincount(column, weights=(weight * counts)[row], minlength=len(pats))
    for _ in range(rounds):
        made = np.bincount(row, weights=x[column], minlength=len(lengths))
        x *= target / np.maximum(np.bincount(column, weights=(weight * made)[row], minlength=len(pats)), 1e-12)
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """(pattern, times) that use up the histogram exactly."""
    left = {k: n for k, n in histogram.items() if n > 0}
    out: list[tuple[Pattern, int]] = []

    def use(p: Pattern, times: int) -> None:
        times = min([times, *(left.get(x, 0) // p.count(x) for x in set(p))])
        if times > 0:
            out.append((p, times))
            for x in p:
                left[x] -= times

    if capacity in left:
        use((capacity,), left[capacity])
    lengths = np.array(sorted(k for k, n in left.items() if n), np.int64)
    if len(lengths) > 1:
        counts = np.array([left[int(k)] for k in lengths], float)
        pats = patterns(lengths, counts, capacity)
        x = non_negative_least_squares(pats, lengths, counts)
        slack = np.array([capacity - sum(p) for p in pats])
        for k in np.lexsort((-x, slack)):
            if slack[k] <= capacity // 128 and x[k] >= 1:
                use(pats[k], int(x[k]))
    rest = sorted(k for k, n in left.items() if n)
    while rest:  # best fit, decreasing, as many times as the counts allow
        p, room = [], capacity
        for k in reversed(rest):
            while k <= room and left[k] > p.count(k):
                p.append(k)
                room -= k
        use(tuple(p), 1 << 62)
        rest = [k for k in rest if left[k]]
    return out


class Places:
    """For each length, stretches of ranks: first rank, first sequence, offset."""

    def __init__(self, made: list[tuple[Pattern, int]]):
        used: dict[int, int] = {}
        rows: dict[int, list[tuple[int, int, int]]] = {}
        sequence = 0
        for p, times in made:
            offset = 0
            for x in p:
                rows.setdefault(x, []).append((used.get(x, 0), sequence, offset))
                used[x] = used.get(x, 0) + times
                offset += x
            sequence += times
        self.rows = {x: np.array(r, np.int64) for x, r in rows.items()}
        self.sequences = sequence

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for x in np.unique(length).tolist():
            mine, at = np.flatnonzero(length == x), self.rows[x]
            k = np.searchsorted(at[:, 0], rank[mine], side="right") - 1
            sequence[mine], offset[mine] = at[k, 1] + rank[mine] - at[k, 0], at[k, 2]
        return sequence, offset


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """The pieces of docs (doc_id, text), with their rank among the pieces of equal length of the same task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, task, seen = encoder(vocabulary, ranks), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for part in slices(batches):
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = np.concatenate([*coder.pieces(text or ""), np.array([end], np.uint32)]).astype("<u4")
                first = len(ids) % capacity or capacity
                for k, at in enumerate([0, *range(first, len(ids), capacity)]):
                    n = first if k == 0 else capacity
                    rows.append((doc_id, k, at, n, zlib.crc32(ids[at : at + n].tobytes()), task, int(seen[n])))
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return pick(docs, doc_id="doc_id", text="text").mapInArrow(cut, PIECE)


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs (doc_id, text)."""
    cut = written(pieces(docs, capacity, end, vocabulary, ranks), "pieces")
    counts = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "bases")
    places = Places(plan({r.length: r.n for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity))
    held = cut.sparkSession.sparkContext.broadcast(places)  # bounded by capacity, see above

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = held.value.find(b.column(3).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(bases.select("task", "length", "base"), ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
