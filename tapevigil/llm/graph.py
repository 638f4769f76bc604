"""Who is linked with whom: components inside a cell and across all cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapevigil.llm.common import stored


def least_linked(near: np.ndarray) -> np.ndarray:
    """For each node of a symmetric adjacency matrix, the smallest node of its component."""
    label = np.arange(len(near))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1, initial=len(near)))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links(a, b): the smallest node that links lead to.

    The smallest label goes over each link, then labels are followed once, until
    nothing changes; rounds grow with the logarithm of a component's length.
    """
    links = links.select("a", "b").filter("a <> b")
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("c")).select("node", F.least("node", "c").alias("c")))
    while True:
        sent = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), "c", F.lit(None).cast(labels.schema["c"].dataType).alias("was"))
        spread = labels.select("node", "c", F.col("c").alias("was")).unionByName(sent)
        spread = stored(spread.groupBy("node").agg(F.min("c").alias("c"), F.max("was").alias("was")))
        ahead = spread.select(F.col("node").alias("n"), F.col("c").alias("next"))
        labels = stored(spread.join(ahead, spread.c == ahead.n).select("node", F.least("c", "next").alias("c"), "was"))
        if not labels.filter("c <> was").limit(1).count():
            return labels.select("node", F.col("c").alias("component"))
        labels = labels.drop("was")
