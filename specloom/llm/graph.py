"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm._common import discard, materialise


def _least_beside(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each row with the least v of its u.

    The rows of a hub may be split over several tasks of the join; to its minimum they come summed up.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(dealt_anew("u").alias("_u"), "m")
    return pairs.join(least.hint("merge"), F.col("u") == F.col("_u")).select("u", "v", "m")


def dealt_anew(column: str) -> Column:
    """A copy of a column of which the optimizer does not know that it is one: a join by it shuffles both sides, and may split a hot key's rows."""
    return F.element_at(F.array(F.col(column)), 1)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least_beside(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return _least_beside(down).select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """From rows (u, v): (node, root) for each node of an edge; the root is the component's least node.

    Each round's edges are a table in the shared folder; the round before is then deleted.
    Loops and repeated edges don't matter.
    """
    edges = materialise(edges.select("u", "v").filter("u != v").distinct(), "edges")
    for _ in range(most_rounds):
        before, edges = edges, materialise(_small_star(_large_star(edges)), "edges")
        discard(before)
        tied = edges.select("u", F.lit(1).alias("n")).unionByName(edges.select(F.col("v").alias("u"), F.lit(2).alias("n")).distinct())
        # stars alone are left when each node is tied once and none both is tied and has others tied to it
        if tied.groupBy("u").agg(F.sum("n").alias("n"), F.max("n").alias("most")).filter("n > most").isEmpty():
            break
    else:
        raise RuntimeError("components: not settled after the rounds allowed")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
