"""Connected components of a table of links, by labels that spread and jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import measured, salted_join


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, label): the least node of its component, for every node in a link.

    Each round a node takes the least label among itself and its neighbours, and then its label's label; star-shaped
    links settle in two or three rounds.  Labels are checkpointed each round, never collected.  A node with very many
    neighbours, and a label of very many nodes, are dealt to several tasks.
    """
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))
    both = links.select(F.explode(ends).alias("x")).select("x.node", "x.other")
    first = both.groupBy("node").agg(F.least(F.min("node"), F.min("other")).alias("label"), F.count("*").alias("n"))
    labels, seen = measured(first.select("node", "label", "n"), ends=F.sum("n"))
    degrees = labels.select(F.col("node").alias("other"), "n")
    while True:
        near = salted_join(both, labels.select(F.col("node").alias("other"), "label"), ["other"], seen["ends"], counts=degrees).groupBy("node").agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = salted_join(spread, jump, ["label"], seen["ends"], salt=["node"])
        new = jumped.select("node", F.least("label", "next").alias("label"), "old")
        labels, moved = measured(new.select("node", "label", (F.col("label") != F.col("old")).alias("moved")), n=F.sum(F.col("moved").cast("int")))
        if not moved["n"]:
            return labels.select("node", "label")
        labels = labels.select("node", "label")
