"""Connected components of a table of links, by alternating stars.

Every round first hangs the larger neighbours of each node on its least neighbour (large star), then each node's lesser
neighbours and itself (small star). Rounds are written to shared storage, so none is computed twice, and the number of
rounds grows with the logarithm of the longest path. Links stay distributed; only a count and a checksum reach the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    return row["n"], row["x"] or 0


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of links (a, b); nodes without a link aren't listed."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialize(links, "links")
    state = _state(links)
    while state[0]:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = materialize(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        before, state = state, _state(links)
        if before == state:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
