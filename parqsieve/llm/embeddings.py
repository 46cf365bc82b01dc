"""Near-duplicate embeddings by collision-counting projections.

Each unit vector is projected on ``LINES`` random directions. Two vectors collide on a line if either lies in the window
around the other. For a pair of the least cosine their difference has the length d = sqrt(2 - 2 * cosine), and its
projections spread by d / sqrt(dimension), so that a window of ``SPREAD`` times that holds a known share of such pairs. From
the share follows the count of collisions that all but ``MISS`` of those pairs reach (``least_count``); pairs reaching it
are verified by their cosine in double precision.

Equal vectors become one class, aggregated before the shuffle. Classes are sorted by one more projection and dealt out in
blocks; a block meets only those whose range touches its window, ``SORT_SPREAD`` times the spread, which no pair that
counts leaves but for one in millions. Blocks meet twice. First only their projections do: each line of either block is
sorted, each vector's window is a stretch of the other's order, and a pair collides on a line if the one's rank lies in the
other's stretch. Pairs that can't reach the count any more are dropped after ``FIRST`` lines. What leaves a task are the
numbers of the rows that have a candidate at all. Then just the vectors of these rows meet, and candidates are verified.
No pair becomes a row; a second task sends each class's number of links and a forest of them.

Null ids, null vectors, and vectors that are zero, empty or hold a null or non-finite component link with nothing: n_links
is 0, component_id the own id. Vectors of different dimensions don't link. Each input row gives one row; rows that repeat
link with each other as two vectors do.
"""

from __future__ import annotations

import bisect
import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parqsieve.llm.common import join_hot, pick, read_table, written
from parqsieve.llm.components import Sets, components

COSINE = 0.95
LINES = 24
FIRST = 16
SPREAD = 3.0
SORT_SPREAD = 5.5
MISS = 1e-6
TILE, WIDE = 512, 2048
BLOCK_BYTES = 1 << 22
TASK_PAIRS, TASK_BYTES = 1 << 25, 1 << 25


def least_count(lines: int = LINES, spread: float = SPREAD, miss: float = MISS) -> int:
    """The largest count that a pair at the threshold falls short of with a probability of at most miss."""
    p = math.erf(spread / math.sqrt(2))
    below, k = 0.0, 0
    while k < lines and below + (now := math.comb(lines, k) * p**k * (1 - p) ** (lines - k)) <= miss:
        below, k = below + now, k + 1
    return k


@functools.lru_cache(maxsize=8)
def directions(dimension: int, lines: int = LINES) -> np.ndarray:
    """lines + 1 unit vectors; the last one is for sorting."""
    made = np.random.default_rng([dimension, 97]).standard_normal((dimension, lines + 1))
    return made / np.linalg.norm(made, axis=0)


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def windows(queries: np.ndarray, points: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By line (rows): the points' ranks in their order, and for each query the first rank in its window and the number of ranks there."""
    order = np.argsort(points, axis=1, kind="stable")
    ranks = np.empty_like(order)
    np.put_along_axis(ranks, order, np.arange(points.shape[1])[None, :].repeat(len(points), 0), axis=1)
    ordered = np.take_along_axis(points, order, axis=1)
    low = np.stack([np.searchsorted(o, q - width, "left") for o, q in zip(ordered, queries, strict=True)])
    high = np.stack([np.searchsorted(o, q + width, "right") for o, q in zip(ordered, queries, strict=True)])
    return tuple(x.astype(np.uint16) for x in (ranks, low, high - low))


def candidates(left: np.ndarray, right: np.ndarray, same: bool, dimension: int, cosine: float = COSINE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in left, in right) of pairs with enough collisions, tile by tile, from projections (lines by vectors); of one block with itself, each pair once."""
    lines = len(left)
    width = SPREAD * math.sqrt(2 - 2 * cosine) / math.sqrt(dimension) * (1 + 1e-4) + 1e-6  # projections come in single precision
    need, first = least_count(lines), min(FIRST, lines)
    for b in range(0, right.shape[1], WIDE):
        ranks, low, many = windows(left, right[:, b : b + WIDE], width)
        for a in range(0, min(left.shape[1], b + WIDE) if same else left.shape[1], TILE):
            count = np.zeros((min(TILE, left.shape[1] - a), ranks.shape[1]), np.uint8)
            for k in range(first):
                count += (ranks[k, None, :] - low[k, a : a + TILE, None]) < many[k, a : a + TILE, None]
            x, y = np.nonzero(count >= max(0, need - (lines - first)))
            if same and a + TILE > b:
                once = a + x < b + y
                x, y = x[once], y[once]
            total = count[x, y].astype(np.int64)
            for k in range(first, lines):
                total += (ranks[k, y] - low[k, a + x]) < many[k, a + x]
            x, y = x[total >= need], y[total >= need]
            if len(x):
                yield a + x, b + y


def compare(left: np.ndarray, right: np.ndarray, same: bool, cosine: float = COSINE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in left, in right) of linked pairs of unit vectors: candidates, verified."""
    for x, y in candidates(projected(left), projected(right), same, left.shape[1], cosine):
        for at in range(0, len(x), 1 << 15):
            u, v = x[at : at + (1 << 15)], y[at : at + (1 << 15)]
            close = np.einsum("ij,ij->i", left[u], right[v]) >= cosine
            yield u[close], v[close]


def projected(vectors: np.ndarray) -> np.ndarray:
    """LINES projections of unit vectors: lines by vectors."""
    return np.ascontiguousarray((vectors @ directions(vectors.shape[1])[:, :-1]).T.astype(np.float32))


def meetings(ends: list, reach: float) -> tuple[list[tuple[int, int, int]], int]:
    """For each block, ordered by dimension and low: its place, its name, and the last place that it meets, since these are
    neighbours; and the number of tasks, so that a task's vectors fit in memory and its pairs take about a second."""
    spans, sums, pairs, size, count = [], [0], 0, 0, 0
    for e in ends:
        sums.append(sums[-1] + e.n)
    keys = [(e.dimension, e.low) for e in ends]
    for k, e in enumerate(ends):
        last = max(k, bisect.bisect_right(keys, (e.dimension, e.high + reach / math.sqrt(e.dimension))) - 1)
        met, number = sums[last + 1] - sums[k], last + 1 - k
        spans.append((k, e.block, last))
        pairs, size, count = pairs + e.n * met, size + (e.n * number + met) * 4 * LINES, count + number
    return spans, max(1, min(count, max(-(-pairs // TASK_PAIRS), -(-size // TASK_BYTES))))


def link(vectors: DataFrame, cosine: float = COSINE, block: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding)."""
    vectors = pick(vectors, vec_id="vec_id", embedding="embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    valid = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))
    good = vectors.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double"))).where(valid)
    classes = written(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vectors")
    n = classes.count()
    size = block or max(1024, min(8192, n // 12))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(0).to_pylist()
            sizes = [len(x) for x in rows]
            at = [float(unit(np.array([x]))[0] @ directions(len(x))[:, -1]) for x in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes, pa.int32()), pa.array(at, pa.float64())], names=[*b.schema.names, "dimension", "at"])

    placed = written(classes.mapInArrow(project, "embedding array<double>, rep long, copies long, dimension int, at double"), "projected")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, number, rows = TaskContext.get().partitionId() << 32, 0, []
        schema = pa.schema([("block", pa.int64()), ("dimension", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("reps", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary()), ("lines", pa.binary())])

        def made() -> pa.RecordBatch:
            whole = np.array([r[0] for r in rows], np.float64)
            return pa.RecordBatch.from_pylist([{"block": base + number, "dimension": rows[0][3], "low": rows[0][4], "high": rows[-1][4], "reps": np.array([r[1] for r in rows], np.int64).tobytes(), "copies": np.array([r[2] for r in rows], np.int64).tobytes(), "vectors": whole.tobytes(), "lines": projected(unit(whole)).tobytes()}], schema=schema)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if rows and (len(rows) >= min(size, max(64, BLOCK_BYTES // (8 * row[3]))) or row[3] != rows[0][3]):
                    yield made()
                    number, rows = number + 1, []
                rows.append(row)
        if rows:
            yield made()

    parts = max(1, n // size)
    blocks = written(placed.repartitionByRange(parts, "dimension", "at").sortWithinPartitions("dimension", "at").mapInArrow(gather, "block long, dimension int, low double, high double, reps binary, copies binary, vectors binary, lines binary"), "blocks")
    reach = SORT_SPREAD * math.sqrt(2 - 2 * cosine)
    ends = blocks.select("dimension", "low", "block", "high", (F.length("reps") / 8).cast("long").alias("n")).orderBy("dimension", "low", "block").collect()  # a row for each block of vectors
    spans, tasks = meetings(ends, reach)
    spark = vectors.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                i, j, d, li, lj = (c[at].as_py() for c in batch.columns)
                li, lj = (np.frombuffer(x, np.float32).reshape(LINES, -1) for x in (li, lj))
                mine, other = np.zeros(li.shape[1], bool), np.zeros(lj.shape[1], bool)
                for x, y in candidates(li, lj, i == j, d, cosine):
                    mine[x], other[y] = True, True
                if mine.any():
                    if i == j:
                        mine |= other
                    sides = [(i, 0, mine)] if i == j else [(i, 0, mine), (j, 1, other)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[(i, j, side, of, np.flatnonzero(rows).astype(np.int32).tobytes()) for of, side, rows in sides], strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["i", "j", "side", "block", "rows"])

    def chosen(_: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        d = held.column("dimension")[0].as_py()
        parts = [np.frombuffer(held.column(c)[0].as_py(), t) for c, t in (("reps", np.int64), ("copies", np.int64), ("vectors", np.float64))]
        wanted = [np.frombuffer(x, np.int32) for x in asked.column("rows").to_pylist()]
        columns = [[x.reshape(-1, d)[w].tobytes() if x is parts[2] else x[w].tobytes() for w in wanted] for x in parts]
        return pa.table([asked.column("i"), asked.column("j"), asked.column("side"), pa.array([d] * len(wanted), pa.int32()), *[pa.array(c, pa.binary()) for c in columns]], names=["i", "j", "side", "d", "reps", "copies", "vectors"])

    def meet(sides: pa.Table) -> pa.Table:
        rows = sorted(zip(*(sides.column(c).to_pylist() for c in ("side", "d", "reps", "copies", "vectors")), strict=True))
        same = len(rows) == 1
        (ri, ci, left), (rj, cj, right) = ((np.frombuffer(r, np.int64), np.frombuffer(c, np.int64), unit(np.frombuffer(v, np.float64).reshape(-1, d))) for _, d, r, c, v in (rows[0], rows[-1]))
        li, lj, sets, edges = np.zeros(len(ri), np.int64), np.zeros(len(rj), np.int64), Sets(len(ri) + len(rj)), []
        for x, y in compare(left, right, same, cosine):
            np.add.at(li, x, cj[y])
            np.add.at(lj, y, ci[x])
            for a, b in zip(x.tolist(), (y if same else y + len(ri)).tolist(), strict=True):
                if sets.join(a, b):
                    edges.append((int(ri[a]), int(ri[b] if same else rj[b - len(ri)])))
        out = [(int(r), int(k), None, None) for r, k in [*zip(ri, li, strict=True), *zip(rj, lj, strict=True)] if k] + [(None, None, a, b) for a, b in edges]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], names=["rep", "links", "a", "b"])

    order = spark.createDataFrame(spans or [(-1, -1, -1)], "k long, i long, last long")
    pairs = order.select("i", F.explode(F.sequence("k", "last")).alias("k")).join(order.select("k", F.col("i").alias("j")), "k").select("i", "j")
    first = blocks.select(F.col("block").alias("i"), F.col("dimension").alias("d"), F.col("lines").alias("li"))
    second = blocks.select(F.col("block").alias("j"), F.col("lines").alias("lj"))
    met = pairs.join(first, "i").join(second, "j").select("i", "j", "d", "li", "lj")
    rows = written(met.repartition(tasks, "i", "j").mapInArrow(count, "i long, j long, side int, block long, rows binary"), "candidates")
    some = rows.groupBy("block").cogroup(blocks.join(rows.select("block").distinct(), "block", "left_semi").select("block", "dimension", "reps", "copies", "vectors").groupBy("block"))
    taken = some.applyInArrow(chosen, "i long, j long, side int, d int, reps binary, copies binary, vectors binary")
    found = written(taken.groupBy("i", "j").applyInArrow(meet, "rep long, links long, a long, b long"), "links")
    totals = found.where("rep is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.where("a is not null").select("a", "b"), "vector-groups")
    per_class = classes.join(totals, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("embedding", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = join_hot(good, per_class, ["embedding"], "copies", good.count()).select("vec_id", "n_links", "component_id")
    alone = vectors.where(~F.coalesce(valid, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read_table(spark, sf_dir, "embeddings"))


OP8_SQL = f"""
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, row_number() OVER () AS k FROM embeddings),
g AS (SELECT vec_id, k, list_transform(x, lambda c: c / sqrt(list_sum(list_transform(x, lambda d: d * d)))) AS x FROM e
 WHERE vec_id IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND list_sum(list_transform(x, lambda d: CASE WHEN d IS NULL OR NOT isfinite(d) THEN 1 ELSE 0 END)) = 0 AND list_sum(list_transform(x, lambda d: abs(d))) > 0),
l AS (SELECT a.k AS a, b.k AS b, b.vec_id AS other FROM g AS a JOIN g AS b ON a.k <> b.k AND len(a.x) = len(b.x) AND list_dot_product(a.x, b.x) >= {COSINE}),
r(k, component) AS (SELECT k, vec_id FROM g UNION SELECT l.b, r.component FROM r JOIN l ON l.a = r.k),
c AS (SELECT k, min(component) AS component FROM r GROUP BY k),
n AS (SELECT a AS k, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id IS NOT DISTINCT FROM coalesce(component, vec_id) AS kept
FROM e LEFT JOIN c USING (k) LEFT JOIN n USING (k)
"""
