"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over symmetric neighbourhoods: each node hands its neighbours (the larger ones, or the smaller ones and
    itself) the least node it knows. The least nodes are a table, so that Spark broadcasts it if it is small, and else has a
    plain shuffle on either side and can split the centre of a large star."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
        least = written(down.groupBy("a").agg(F.min("b").alias("m")), "least")
        out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    done = written(out.where("a <> b").distinct(), "edges")
    discard(least)
    return done


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, label): of every node that has an edge to another the least node of its component.

    Each round is a table in the shared folder, so that lost executors cost one round at most and plans stay short. The
    number of rounds grows with the logarithm of the components' diameters. Nulls and loops are ignored."""
    now = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").distinct(), "edges")
    mark = None
    for _ in range(most):
        half = _star(now, True)
        old, now = now, _star(half, False)
        discard(old, half)
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    else:
        raise RuntimeError(f"the components haven't settled after {most} rounds")
    # stars: every a points to its label
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()).groupBy("node").agg(F.min("label").alias("label"))
