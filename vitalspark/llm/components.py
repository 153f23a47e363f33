"""Connected components of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspark.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for the nodes of ``links(a, b)``.

    Every round gives each node the smallest label of its neighbours and jumps to that label's
    own label; it ends when no label changes. Each round is written, so a lost executor repeats
    one round at most. Labels combine on the map side, so a node with very many links is no
    burden for one task.
    """
    edges = saved(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(),
                  "component-edges")
    labels = saved(edges.groupBy(F.col("a").alias("node"))
                   .agg(F.least(F.min("b"), F.first("a")).alias("component")), "component-labels")
    while True:
        lowest = (edges.join(labels.withColumnRenamed("node", "b"), "b")
                  .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        # the label of a label: where the current representative itself points
        far = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        stepped = (labels.join(lowest, "node").join(far, "component", "left")
                   .select("node", F.col("component").alias("old"),
                           F.least("component", "near", "far").alias("component")))
        stepped = saved(stepped, "component-labels")
        labels = stepped.select("node", "component")
        if not stepped.filter("old <> component").limit(1).count():
            return labels
