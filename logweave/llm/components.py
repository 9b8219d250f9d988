"""Connected components of links, as rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import common


def components(links: DataFrame) -> DataFrame:
    """node, root of all nodes of ``links`` (a, b).

    In each round every node joins the neighbour (or itself) that comes first in a fresh random order, and the
    links are redrawn between those; chains and stars alike shrink by a constant factor, so the rounds grow with the
    logarithm of the largest component.  Each round is written to the shared folder.
    """
    edges = common.written(links.filter("a <> b").select("a", "b"), "component-links")
    known = None
    turn = 0
    while not edges.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), c), c)  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = common.written(
            both.groupBy("a").agg(F.min_by("b", order(F.col("b"))).alias("near"))
            .select(
                F.col("a").alias("node"),
                F.when(order(F.col("near")) < order(F.col("a")), F.col("near")).otherwise(F.col("a")).alias("root"),
            ),
            "component-parents",
        )
        moved = parents.select(F.col("node").alias("root"), F.col("root").alias("next"))
        known = parents if known is None else common.written(
            known.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root")),
            "component-roots",
        )
        step = (
            edges.join(parents.select(F.col("node").alias("a"), F.col("root").alias("to_a")), "a")
            .join(parents.select(F.col("node").alias("b"), F.col("root").alias("to_b")), "b")
            .filter("to_a <> to_b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        )
        edges = common.written(step, "component-links")
        turn += 1
    if known is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return known
