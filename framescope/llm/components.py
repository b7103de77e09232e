"""Connected components of links between integer identifiers, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.llm.common import attach
from framescope.session import materialize


def _lowest(links: DataFrame, total: int) -> DataFrame:
    """(u, v) with the least of u and its v as ``low``; ``total`` is at least the number of links.

    A member with very many links is no hot key of a join: its least is sent to all tasks.
    """
    least = links.groupBy("u").agg(F.least("u", F.min("v")).alias("low"), F.count("*").alias("links"))
    return attach(links, least, "u", "links", total).drop("links")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest identifier reachable, for every identifier with a link.

    ``edges`` has columns u and v. Large and small stars take turns (Kiveris et al., 2014) until the
    links are stars around the smallest member, which takes a number of rounds that grows with the
    logarithm of the longest path. Each round is written to the shared scratch folder, so a lost
    executor costs one round at most; nothing but counts comes to the driver.
    """
    links = materialize(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    before = None
    while True:
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if state == before:
            break
        before, total = state, 2 * state[0]
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both, total).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = _lowest(large, total)
        small = low.select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v")))
        links = materialize(small.filter("u <> v").distinct(), "links")
    roots = links.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
