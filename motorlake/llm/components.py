"""Connected components of a large graph by alternating large-star and small-star steps.

A giant component's least node has most edges of the graph. Counting and the least
neighbour are combined before the shuffle; the join of edges with least neighbours is
between two stored tables, so that adaptive execution splits such a node's edges over
several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorlake.llm.common import stored

MAX_ROUNDS = 60


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest of them: the larger ones (both=True), or the smaller ones and the node itself."""
    pairs = edges.select("u", "v")
    if both:
        pairs = pairs.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("u", "m").alias("m")), "least")
    joined = pairs.join(least, F.col("u") == F.col("at"))
    if both:
        linked = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("at").alias("u"), F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is the smallest node reachable.

    Each round is written to the shared folder, so lineage stays short; the number of
    rounds grows with the logarithm of the longest path. Loops and repeated edges are fine.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    state = mark(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        now = stored(_star(_star(now, True), False), "edges")
        before, state = state, mark(now)
        if before == state:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
