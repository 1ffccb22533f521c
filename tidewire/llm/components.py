"""Connected components of a distributed table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import BROADCAST_ROWS, materialize


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """Links (``u``, ``v``) to (``node``, ``root``): each node of a link and the least node that it reaches.

    Alternating large-star and small-star rounds: each keeps the components and
    moves links towards the least node, until they are stars.  A round is joins
    and minima by node (one row a node on the other side, so that skewed joins
    can split a node with many links) and ends in a written table.
    """
    links = materialize(links.select("u", "v").where("u <> v").distinct(), name)
    state = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A table of its own: a join with what is aggregated above its shuffle could not be split at a node with many links.
        least = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), name)
        if least.count() <= BROADCAST_ROWS:
            least = F.broadcast(least)
        # Large star: neighbours above a node go to the least of its neighbours and itself.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its neighbours below go to the least of them; links point down here.
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(below, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        links = materialize(small, name)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
