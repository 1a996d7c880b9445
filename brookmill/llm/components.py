"""Connected components of a graph of links, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """node, component (the smallest node reachable) for every node of the links (a, b).

    Every round joins the links once from either end with the smallest neighbour of a node;
    lineage is cut by a checkpoint after each. Links to oneself and nulls are left out.
    """
    ordered = links.where("a is not null and b is not null and a != b")
    edges = saved(ordered.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(edges)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a != b")
        edges = saved(small.union(low.select("a", F.col("low").alias("b"))).distinct())
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    else:
        raise RuntimeError(f"the components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
