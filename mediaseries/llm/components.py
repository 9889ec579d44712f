"""Connected components of a graph given as a table of links, by alternating star steps.

Every step is an aggregate with map-side combine and an equi-join on a node; nodes with many links meet theirs without a
shuffle. The links of each step are written to the shared folder, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stage

#: A node with more than one in so many of all links is hot.
HOT = 500


def _fingerprint(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"] or 0


def _beside(rows: DataFrame, least: DataFrame, links: int) -> DataFrame:
    """``rows`` with the least neighbour ``m`` of their node ``a``.

    A node that holds more than one in ``HOT`` of all links meets its rows where they lie: there are at most 2 * ``HOT`` such
    nodes, as each link has two ends, so they may be broadcast. The other nodes' rows are shuffled.
    """
    hot = F.broadcast(least.where(F.col("n") * HOT > links).select("a", "m"))
    cold = least.where(F.col("n") * HOT <= links).select("a", "m")
    return rows.join(hot, "a").unionByName(rows.join(hot.select("a"), "a", "left_anti").join(cold, "a"))


def _large_star(links: DataFrame, n: int) -> DataFrame:
    """Each node's greater neighbours are linked with its smallest one (itself included)."""
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "a"))
    return _beside(both.where("b > a"), least, n).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame, n: int) -> DataFrame:
    """Each node and its smaller neighbours are linked with the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    others = _beside(links, least, n).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component: for every node of ``links(a, b)`` the smallest node it is connected with.

    Nodes are longs; links may be given in either direction and repeatedly. Links of a node with itself and links with
    NULL are ignored. No links, no rows.
    """
    now = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while (seen := _fingerprint(now)) != before:
        before = seen
        now = stage(_large_star(now, seen[0]), "links")
        now = stage(_small_star(now, now.count()), "links")
    # every link now leads from a node to the smallest of its component
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
