"""Connected components of a graph of links, as DataFrame joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """(v, component) for every vertex of ``links`` (a, b): the smallest one reachable.

    Rounds of large-star and small-star hooking.  A vertex's least neighbour comes from
    an aggregation with a map-side part and is joined back, so no neighbourhood is ever
    gathered in one task.  What is joined back is a table of its own: a small one is broadcast
    by the optimizer, a large one is shuffled with its hot centres split.  That table also
    tells when all that is left are stars, and then is the result: a vertex with a smaller
    neighbour has no other.  The rounds are logarithmic in the vertices.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.union(edges.select("b", "a"))
        smaller = F.count_if(F.col("b") < F.col("a"))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), smaller.alias("n_smaller"), F.count("*").alias("n")), "least")
        if not least.agg(F.max((F.col("n_smaller") > 0) & (F.col("n") > 1))).first()[0]:
            return least.select(F.col("a").alias("v"), F.col("m").alias("component"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # a row for each edge at most, so repeats may stay until the round's end
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        hooked = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = stored(hooked.where("a <> b").distinct(), "stars")
