"""Joins of documents with lists of ids, and connected components, at any size."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.session import cut_lineage

#: Ids of 8 bytes that may be sent to every executor; longer lists are joined by shuffle.
BROADCAST_IDS = 500_000


def by_ids(docs: DataFrame, ids: DataFrame, how: str, key: str | list[str] = "doc_id") -> DataFrame:
    """Semi or anti join of documents with a materialised list of distinct ids.

    The list is counted first. A short one is broadcast, so that texts stay where
    they are; a long one is left to Spark's own shuffle join.
    """
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, key, how)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of ``edges``: every node that has an edge, with the smallest node it reaches.

    Alternates two steps until nothing changes: each node hangs its larger neighbours
    on its smallest neighbour, then its smaller ones. Every step groups by node with
    partial aggregation and is written to the shared folder; links stay distributed.
    Loops and repeated edges are ignored.
    """
    links = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct()
    links = cut_lineage(links)
    before = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).withColumn("m", F.least("hi", "m"))
        big = both.filter("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        kept = least.filter("m < hi").select("hi", F.col("m").alias("lo"))
        large = big.unionByName(kept).filter("hi <> lo").distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi")
        links = small.select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()
        links = cut_lineage(links)
        state = links.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the components did not settle")
    roots = links.select(F.col("lo").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)
