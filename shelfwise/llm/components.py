"""Connected components of a table of links, by contraction.

Each round every node takes the smallest node it is linked with (itself included), chains of such choices are followed to
their ends by doubling, and the links are rewritten between the ends. A round at least halves the nodes that still have links,
so the number of rounds grows with the logarithm of the number of nodes. All tables stay distributed; lineage is cut by tables
in the shared folder. Keys that many rows share (the centre of a star) occur in plain joins only, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.frames import empty, stored



def _ends(up: DataFrame) -> DataFrame:
    """(node, up) with every ``up`` followed to the end of its chain; nodes that are no node of the table are ends."""
    while True:
        above = up.select(F.col("node").alias("_node"), F.col("up").alias("_up"))
        further = up.join(above, up["up"] == above["_node"], "left").select(
            "node", F.coalesce("_up", "up").alias("up"), (F.col("_up") < F.col("up")).alias("moved")
        )
        further = stored(further, up)
        up = further.select("node", "up")
        up.stored_at = further.stored_at
        if empty(further.filter("moved")):
            return up


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b); component is the smallest node reachable."""
    links = stored(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    result: DataFrame | None = None
    while not empty(links):
        both = links.union(links.select("b", "a"))
        smallest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))
        up = _ends(stored(smallest.select("node", F.least("node", "up").alias("up"))))
        left = up.select(F.col("node").alias("a"), F.col("up").alias("a_up"))
        right = up.select(F.col("node").alias("b"), F.col("up").alias("b_up"))
        between = links.join(left, "a").join(right, "b").filter("a_up <> b_up")
        links = stored(between.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), links)
        if result is None:
            result = up.select("node", F.col("up").alias("component"))
        else:
            above = up.select(F.col("node").alias("_node"), F.col("up").alias("_up"))
            joined = result.join(above, result["component"] == above["_node"], "left")
            result = stored(joined.select("node", F.coalesce("_up", "component").alias("component")), result)
    if result is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return result
