"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needledrop.scratch import materialise


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """(u, v) with m, the least of u and all its neighbours; counted per task before the shuffle."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    return _least_neighbour(_both_ways(edges)).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    stars = _least_neighbour(down)
    return stars.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stars.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node of the component, for each node of an edge.

    Null ends and self-loops link nothing. Each round is written to the shared folder; the number
    of rounds grows with the logarithm of the longest chain. The order of edges does not matter.
    """
    loops = edges.select(F.col(a).alias("node")).unionByName(edges.select(F.col(b).alias("node"))).filter("node is not null").distinct()
    now = materialise(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen == (state["n"], state["s"]):
            break
        seen = (state["n"], state["s"])
        now = materialise(_small_star(_large_star(now).distinct()))
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return loops.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
