"""Connected components of a graph of links, by minimum labels that jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that links (a, b) lead to, for every node of a link.

    In each round a node takes the smallest label among its neighbours, then the label of that
    label, so labels travel twice as far each time.  Every state is written to the shared folder
    and read again; joins then shuffle both sides and a node with very many links is split.
    """
    both = store(links.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("to"))).distinct(), "links")
    state = store(both.groupBy("node").agg(F.min("to").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(state.select(F.col("node").alias("to"), F.col("component").alias("c")), "to").groupBy("node").agg(F.min("c").alias("c"))
        lower = state.join(near, "node").select("node", F.least("component", "c").alias("component"), F.col("component").alias("old"))
        lower = store(lower, "lower")
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("c"))
        state = store(lower.join(jump, "component", "left").select("node", F.coalesce("c", "component").alias("component"), "old"), "labels")
        if state.where("component <> old").isEmpty():
            return state.select("node", "component")
        state = state.select("node", "component")
    raise RuntimeError("labels did not settle")
