"""Connected components of a link table, by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches, from links (a, b); nodes without a link are absent.

    Every round takes the smallest label among a node's neighbours, then jumps to that label's own label, so labels
    travel twice as far each round. Labels stay in tables; the driver only sees how many changed.
    """
    both = cut(links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("m"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("m", "root")).alias("root"))
        step = cut(step)
        to = step.select(F.col("node").alias("via"), F.col("root").alias("far"))
        step = cut(step.join(to, step["root"] == to["via"], "left").select("node", "old", F.coalesce("far", "root").alias("root")))
        labels = step.select("node", "root")
        if step.where("root <> old").isEmpty():
            return labels
