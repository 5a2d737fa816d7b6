"""Connected components of an edge table, by alternating neighbour minima and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.store import keep


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every end of ``edges`` (a, b long): component is the smallest node reachable.

    Each round points the larger end of every edge, and its own label, to the smallest label seen in the neighbourhood
    (the large-star and small-star steps), so rounds grow with the logarithm of a component's diameter. Labels are written to
    the shared folder each round. A hub's edges are only ever aggregated with map-side combining, or joined.
    """
    links = keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    for _ in range(max_rounds):
        # large star: the larger neighbours of a node move to its smallest neighbour
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        # small star: the smaller neighbours of a node, and itself, move to its smallest neighbour
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("m"), F.col("a"), "b")
        moved = small.select(F.col("m").alias("a"), "b").unionByName(small.select(F.col("m").alias("a"), F.col("a").alias("b")))
        new = keep(moved.filter("a < b").distinct(), "links")
        state = new.agg(F.count("*").alias("n"), F.countDistinct("b").alias("ends"), F.sum(F.hash("a", "b").cast("long")).alias("h")).unionByName(
            links.agg(F.count("*").alias("n"), F.countDistinct("b").alias("ends"), F.sum(F.hash("a", "b").cast("long")).alias("h"))
        )
        after, before = state.collect()
        links = new
        if after == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
