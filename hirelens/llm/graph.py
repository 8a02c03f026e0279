"""Connected components of a links table, by rounds of star contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.shared import shared_dir

MAX_ROUNDS = 60
#: Links that a round keeps in one partition: a small table isn't spread over as many files as a large one.
PART_LINKS = 100_000


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in `links` (a, b: long); root: the smallest node that can be reached.

    Each round links a node's larger neighbours to its smallest one, then its smaller neighbours likewise, which
    turns every component into a star in about log(n) rounds. Only minima are gathered, by an aggregation that
    starts before the shuffle; a node with very many links is a skewed side of an equi-join, which Spark splits.
    Null or self links are ignored.
    """
    shared_dir(links.sparkSession)
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    before = None
    for _ in range(MAX_ROUNDS):
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct().coalesce(-(-now[0] // PART_LINKS) or 1).checkpoint()
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
