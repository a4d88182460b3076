"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import exchange as X


#: Links that a task handles on average; tables of few links so stay in few tasks.
LINKS = 50_000


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one link to a smaller node, or only links to larger ones."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected(links: DataFrame, rounds: int = 100) -> DataFrame:
    """node, root for every node of ``links`` (a, b); root is the smallest node
    of its component. Nodes of any orderable type.

    Large-star and small-star in turn (Kiveris and others, 2014): every round
    joins a node's links to the smallest neighbour, which the first step finds
    by an aggregation with map-side combining, so a node with very many links
    costs one row per task before the shuffle. The smallest neighbours are written
    down before they meet the links, so both sides of that join are plain shuffles
    and Spark can split the links of a node that very many others point to. The
    rounds end when every component is a star; their number grows with the
    logarithm of the nodes."""
    edges = X.cut(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    parts = -(-edges.count() // LINKS) + 1
    edges = edges.coalesce(parts)
    for _ in range(rounds):
        if _all_stars(edges):
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = X.cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")).coalesce(parts))
        # larger neighbours go to the smallest
        large = X.cut(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).coalesce(parts))
        # of those, every node and its smaller neighbours go to the smallest
        small = X.cut(large.groupBy("a").agg(F.min("b").alias("low")).coalesce(parts))
        ends = F.explode(F.array(F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b"))))
        edges = large.join(small, "a").select(ends.alias("e")).select("e.a", "e.b").filter("a != b")
        edges = X.cut(edges.coalesce(parts).distinct().coalesce(parts))
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
