"""Connected components of a table of links, by the core's search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.graph import min_labels
from lodestar.sources.lineage import checkpointed


def components(links: DataFrame, labels: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """links(a, b) -> (node, label): the smallest node that a node is linked to.

    ``labels`` may hold labels found before: links between their classes are added to
    the given ones. ``rows`` bounds the links, both ways, where it is known. An empty
    table has no components.
    """
    edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    if labels is not None:
        edges = edges.unionByName(labels.where("node <> label").select(F.col("node").alias("src"), F.col("label").alias("dst")))
    return min_labels(edges, checkpointed, rows)
