"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.tables import written

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Rows (id, label) for every id of `edges` (a, b): label is the smallest id of its component.

    Every step reduces neighbours to a minimum with map-side combining and joins it back on a unique key, so a hub
    with many neighbours is never gathered in one task; rounds grow with the logarithm of the longest chain. Each
    round is written to the shared folder. Edges with a null end and loops are left out.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges = written(edges, "components")
    state = None
    for _ in range(max_rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(smallest.select("u", F.col("m").alias("v"))).distinct(), "components")
        before, state = state, edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            roots = edges.select("v").distinct()
            return edges.union(roots.select("v", F.col("v").alias("w"))).toDF("id", "label")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
