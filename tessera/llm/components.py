"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import remove, staged


def _least(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node").agg(F.min("to").alias("to"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long): root is the component's smallest node.

    Rounds of contraction: each node goes to its smallest neighbour if that is
    smaller, edges follow, and those that fall together vanish.  Smaller is what has
    the smaller hash (a permutation of longs), so no order of the numbers, such as
    that of a path, makes rounds many: about log2 of the nodes.  Each round's tables
    are written to the shared folder.  Null ends are left out; loops give single nodes.
    """
    whole = staged(edges.where("a is not null and b is not null").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct(), "edges")
    hashed = whole.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    left = hashed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left.staged_path = whole.staged_path
    where = staged(whole.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("at", F.xxhash64("node")), "nodes")
    while True:
        pairs = left.where("a < b")
        if pairs.isEmpty():
            least = where.groupBy("at").agg(F.min("node").alias("root"))
            return where.join(least, "at").select("node", "root")
        # b's smallest neighbour is below it; a keeps its place unless it is some other pair's b
        step = staged(_least(pairs.select(F.col("b").alias("node"), F.col("a").alias("to"))), "step")
        moved = pairs
        for end in ("a", "b"):
            to = step.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
            moved = moved.join(to, F.col(end) == F.col("_n"), "left").withColumn(end, F.coalesce("_t", end)).drop("_n", "_t")
        moved = moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        to = step.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
        gone = where.join(to, F.col("at") == F.col("_n"), "left").select("node", F.coalesce("_t", "at").alias("at"))
        old = (left, where, step)
        left, where = staged(moved, "edges"), staged(gone, "nodes")
        for table in old:
            remove(table.sparkSession, table.staged_path)


class Forest:
    """Union by smallest member over 0..n-1, in one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
