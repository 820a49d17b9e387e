"""Connected components by alternating large-star and small-star.

Both steps are a grouped minimum and a join back to it; a hub with a third of
all edges is joined by broadcast (see ``attach_unique``), the rest by shuffle.
Edges never leave the executors; the driver sees a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import Scratch, attach_unique


def _least(links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """links (u, v) with m, the smallest of u's neighbours v."""
    side = scratch.keep(links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), tag)
    return attach_unique(links, side, "u", "n", "inner").drop("n")


def large_star(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """Link every larger neighbour of a node to the least of it and its neighbours."""
    both = scratch.keep(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), tag)
    out = _least(both, scratch, tag + "m").where("v > u").select(
        F.col("v").alias("u"), F.least("m", "u").alias("v"))
    return out.where("u <> v").distinct()


def small_star(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the least of them."""
    down = scratch.keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), tag)
    starred = _least(down, scratch, tag + "m")
    return (starred.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(starred.select("u", F.col("m").alias("v"))).where("u <> v").distinct())


def components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(u, v): every node that is not the least of its component, and that least.

    ``edges``: long columns u and v; direction, repeats and loops do not matter.
    """
    now = scratch.keep(edges.where("u <> v").distinct(), f"{tag}0")
    mark, turn = None, 0
    while True:
        n, check = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if n == 0 or (n, check) == mark:
            return now
        mark, turn = (n, check), turn + 1
        wide = scratch.keep(large_star(now, scratch, f"{tag}{turn}l"), f"{tag}{turn}ls")
        now = scratch.keep(small_star(wide, scratch, f"{tag}{turn}s"), f"{tag}{turn}")
        for old in (f"{turn - 1}", f"{turn}l", f"{turn}lm", f"{turn}ls", f"{turn}s", f"{turn}sm"):
            scratch.drop(tag + old)
