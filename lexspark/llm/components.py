"""Connected components of a link table, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(node, comp): the least node that each linked node reaches.

    ``links`` has long columns a and b, ``start`` earlier labels of the same kind that
    the links extend. Every round takes the least label of the neighbours, then the
    label's own label, so stars and chains of stars settle in a few rounds. All of it
    is joins and aggregates; the driver sees one count a round.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("comp"))
    if start is not None:
        labels = labels.unionByName(start).groupBy("node").agg(F.min("comp").alias("comp"))
        both = both.unionByName(start.filter(F.col("node") != F.col("comp")).select(F.col("node").alias("a"), F.col("comp").alias("b")))
        both = both.unionByName(start.filter(F.col("node") != F.col("comp")).select(F.col("comp").alias("a"), F.col("node").alias("b")))
    both, labels = materialize(both, "links"), materialize(labels, "labels")
    while True:
        offered = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("least"))
        lower = labels.join(offered, labels.node == offered.a, "left").select("node", "comp", F.least("comp", "least").alias("low"))
        roots = labels.select(F.col("node").alias("root"), F.col("comp").alias("above"))
        stepped = materialize(
            lower.join(roots, lower.low == roots.root, "left").select("node", "comp", F.least("low", "above").alias("next")), "labels"
        )
        moved = stepped.filter(F.col("next") != F.col("comp")).limit(1).count()
        labels = stepped.select("node", F.col("next").alias("comp"))
        if not moved:
            return labels
