"""Connected components of a table of links, by rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relcheck.llm.common import saved


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, label (the least node of its component) for links (u, v).

    A round takes the least label among a node and its neighbours, then the label of that label, so that a component's
    diameter matters by its logarithm only. Each round's labels are a saved table.
    """
    links = links.where("u <> v")
    both = saved(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = saved(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")))
    for _ in range(rounds):
        near = both.join(labels, both["v"] == labels["node"]).groupBy(F.col("u").alias("n2")).agg(F.min("label").alias("m"))
        lower = labels.join(near, F.col("node") == F.col("n2")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        onward = labels.select(F.col("node").alias("n3"), F.col("label").alias("l3"))
        lower = saved(lower.join(onward, F.col("label") == F.col("n3")).select("node", "old", F.least("label", "l3").alias("label")))
        labels = lower.select("node", "label")
        if not lower.where("label <> old").limit(1).count():
            break
    else:
        raise RuntimeError(f"components: no end after {rounds} rounds")
    return labels
