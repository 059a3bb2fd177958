"""Connected components of a graph given as links, with DataFrame functions only.

Each round, every node points to its smallest neighbour (or itself), the pointers are followed to their ends, and the
links are rewritten to these ends; what stays are links between ends, at most half as many nodes. A hub needs nothing
special in the first step (its smallest neighbour is a minimum, combined before the shuffle); in the lookups a table
of at most BROADCAST_ROWS rows is broadcast, a larger one is joined by a shuffle whose skewed side Spark may split.
Links as few as that are in one partition from then on: no step of a round shuffles them, however many partitions a shuffle
has. More stay dealt. Links are computed once, each for both its directions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Rows of two longs: 3 MB at most.
BROADCAST_ROWS = 200_000


def _lookup(df: DataFrame, column: str, pointers: DataFrame, n: int) -> DataFrame:
    """df with column replaced by what pointers (node, to) have for it, itself where they have nothing."""
    side = pointers.select(F.col("node").alias("_node"), F.col("to").alias("_to"))
    side = F.broadcast(side) if n <= BROADCAST_ROWS else side
    return df.join(side, F.col(column) == F.col("_node"), "left").withColumn(column, F.coalesce("_to", column)).drop("_node", "_to")


def _ends(pointers: DataFrame) -> tuple[DataFrame, int]:
    """pointers (node, to) followed until to is a node that points to itself."""
    while True:
        pointers = checkpointed(pointers)
        n = pointers.count()
        aims = pointers.select(F.col("to").alias("aim")).distinct()
        steps = aims.join(pointers, F.col("aim") == F.col("node")).filter(F.col("aim") != F.col("to")).select(F.col("aim").alias("node"), "to")
        steps = checkpointed(steps)
        left = steps.count()
        if not left:
            return pointers, n
        pointers = _lookup(pointers, "to", steps, left)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that has a link to another; component is the smallest node reachable.

    links: (a, b) longs, in any direction, repeats and self-links allowed. Null ends link nothing.
    """
    ways = links.filter(F.col("a") != F.col("b"))
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("way")
    found: DataFrame | None = None
    while True:
        ways = checkpointed(ways.select(both).select("way.a", "way.b").distinct())
        many = ways.count()
        if not many:
            break
        ways = ways.coalesce(1) if many <= BROADCAST_ROWS else ways
        pointers = ways.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        ends, n = _ends(pointers)
        found = ends if found is None else checkpointed(_lookup(found, "to", ends, n))
        ways = _lookup(_lookup(ways, "a", ends, n), "b", ends, n).filter(F.col("a") != F.col("b"))
    if found is None:
        found = ways.select(F.col("a").alias("node"), F.col("b").alias("to"))
    return found.select("node", F.col("to").alias("component"))
