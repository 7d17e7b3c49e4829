"""Connected components of a link table, by smallest labels and pointer jumping, each round written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    A round takes each node's smallest neighbouring label, then the label's own label, so paths
    shorten by more than half. Rounds end when the sum of the labels stays. Only joins and grouped
    minima: a hub's links are pre-aggregated before they are shuffled. A round's tables go when the next
    are written. Repeated links are one; a link with a null end joins nothing; no links: no rows.
    """
    links = links.where("a is not null and b is not null")
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    total = F.sum(F.col("component").cast("decimal(38,0)"))
    last = labels.agg(total).first()[0]
    while last is not None:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("component", "m").alias("component"))
        lower = written(lower, "labels")
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("next"))
        done, labels = labels, written(lower.join(jump, "component").select("node", F.col("next").alias("component")), "labels")
        discard(done, lower)
        now = labels.agg(total).first()[0]
        if now == last:
            break
        last = now
    discard(both)
    return labels
