"""Connected components of a graph held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parqsieve.llm.common import delete_path, join_hot, scratch_path, written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (its smallest node) for each node of edges (a, b); nodes are longs.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until nothing changes. Minima are aggregated
    before each shuffle; rows of hubs aren't shuffled but meet their minimum by broadcast (see join_hot); each round is
    written in the shared folder and the round before is removed. Loops and null ends are left out.
    """
    spark = edges.sparkSession
    path, size, print_of = scratch_path(spark, name), 0, None
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name, path)
    size = now.count()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large_path, next_path = scratch_path(spark, name), scratch_path(spark, name)
        large = written(join_hot(both.where("v > u"), least, ["u"], "n", 2 * size).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name, large_path)
        root = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_hot(large, root, ["u"], "n", size).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct(), name, next_path)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for old in (path, large_path):
            delete_path(spark, old)
        path, size = next_path, new[0]
        if new == print_of:
            break
        print_of = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


class Sets:
    """Union-find within a task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
