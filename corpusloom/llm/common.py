"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import discard, scratch, shared_dir, stash

__all__ = ["UPPER", "ascii_lower", "components", "discard", "scratch", "shared_dir", "stash"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: str | Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else; the JVM's quick way where all is ASCII."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, component)``.

    The component is the smallest node.  Each round hooks every node of the
    contracted graph to its smallest neighbour, shortens the chains by pointer
    jumping and contracts; hubs are met by partial minima before the shuffle,
    and all joins are between written tables, so that skewed ones are split.
    Nodes without edges do not appear.
    """
    both = edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b"))
    graph = stash(both.distinct(), name)
    labels = None
    while not graph.isEmpty():
        up = graph.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up"))
        up = stash(up, name)
        while True:
            above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            up = stash(up.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), (F.coalesce("top", "up") != F.col("up")).alias("moved")), name)
            if up.where("moved").isEmpty():
                break
            up = up.drop("moved")
        up = up.select("node", F.col("up").alias("root"))
        if labels is None:
            labels = up.select("node", F.col("root").alias("component"))
        else:
            step = up.select(F.col("node").alias("component"), "root")
            labels = stash(labels.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component")), name)
        ends = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        graph = graph.join(ends, "a").select(F.col("ra").alias("a"), "b")
        ends = up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        graph = stash(graph.join(ends, "b").select("a", F.col("rb").alias("b")).where("a <> b").distinct(), name)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0) if labels is None else labels
