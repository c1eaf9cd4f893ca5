"""Connected components over links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rillgrid.llm.scratch import small, written


def smallest_reachable(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for each id on a link (a, b): component is the smallest id that it reaches.

    Large-star and small-star rounds, each pre-aggregated before its two shuffles and written to the
    shared folder. A component of n ids settles in O(log n) rounds, whatever its shape; a star of
    a third of all ids costs rows in proportion to its links, since a node passes on its smallest
    neighbour alone. Repeated links stay until they are loops, at most a row more for each id and
    round. The first shuffle of a round tells whether the links are stars already; it has the
    result then. Nulls and loops are no links; no links give an empty table.
    """
    edges = written(links.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "links")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    # A centre has no smaller neighbour; a leaf has one, and no larger one. All else still moves.
    below, above = F.max(F.when(F.col("v") < F.col("u"), F.col("v"))), F.max(F.col("v") > F.col("u"))
    moves = F.coalesce(F.col("above") | (F.col("below") != F.col("m")), F.lit(False)) & F.col("below").isNotNull()
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, the small side of each join is a plain scan: broadcast while it is short, else a hot node's rows can be split.
        low = written(both.groupBy("u").agg(F.min("v").alias("m"), below.alias("below"), above.alias("above")).select("u", F.least("u", "m").alias("m"), moves.alias("moves")), "low")
        if not low.agg(F.max("moves")).first()[0]:
            return low.select(F.col("u").alias("id"), F.col("m").alias("component"))
        large = both.where("v > u").join(small(low.select("u", "m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = written(large.groupBy("u").agg(F.min("v").alias("m")), "down")
        flat = large.join(small(down), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = written(flat.unionByName(down.select("u", F.col("m").alias("v"))), "stars")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
