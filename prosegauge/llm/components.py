"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links(a long, b long); root is the smallest node reachable.

    Every round takes the smallest label among a node and its neighbours, then
    the label of that label, so labels travel in doubling steps. Rounds stop
    when none changes; only that count reaches the driver. Nulls and self-links
    are ignored; repeated links are harmless; no links give no rows. A node
    with very many neighbours, and a root of very many nodes, are dealt over
    many tasks where their label is asked for, and minima are partly taken before
    their shuffle.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
    labels = labels.checkpoint()
    while True:
        near = lookup(both.withColumnRenamed("b", "node"), "node", labels, "inner").groupBy("a").agg(F.min("root").alias("m"))
        step = labels.join(near.hint("merge"), labels.node == near.a, "left").select("node", F.col("root").alias("old"), F.least("root", "m").alias("mid")).checkpoint()
        nxt = lookup(step, "mid", step.select(F.col("node").alias("mid"), F.col("mid").alias("up")), "inner")
        nxt = nxt.select("node", "old", F.least("mid", "up").alias("root")).checkpoint()
        moved = nxt.where("root <> old").limit(1).count()
        labels = nxt.select("node", "root")
        if not moved:
            return labels
