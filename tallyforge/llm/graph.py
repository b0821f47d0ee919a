"""Connected components of links, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import discarded, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b); nodes have the same root if links connect them.

    In each round every node goes to the lowest of itself and its neighbours, in an order drawn anew from a
    hash, and links are drawn between where their ends went. A constant share of nodes goes in each round,
    whatever the shape of the links. Each round's tables are written, so that lineage stays short, and those of the round before are removed. Links of a
    node with itself, repeated links and null ends are ignored.
    """
    links = written(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots: DataFrame | None = None
    turn = 0
    while not links.isEmpty():
        turn += 1
        place = lambda c, turn=turn: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("p"), F.col(c).alias("n"))
        ends = links.union(links.select("b", "a"))
        step = written(ends.groupBy(F.col("a").alias("node")).agg(F.min(place("b")).alias("low")).select("node", F.least(place("node"), "low")["n"].alias("root")))
        moved = links.join(step.toDF("a", "ra"), "a").join(step.toDF("b", "rb"), "b").filter("ra <> rb")
        before = links
        links = written(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        discarded(before)
        if roots is None:
            roots = step
        else:
            before = roots
            roots = written(roots.join(step.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root")))
            discarded(before, step)
    return roots if roots is not None else links.toDF("node", "root")
