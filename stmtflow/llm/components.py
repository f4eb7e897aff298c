"""Connected components of link tables, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtflow.llm.common import Scratch


def components(links: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for every node of a link; component is the smallest node that can be reached.

    Each round every node takes the smallest label beside it, then the label of its label, so labels cross long
    chains in a logarithmic number of rounds in practice. Each round is written and read again.
    """
    keep = scratch or Scratch(links.sparkSession, "components")
    links = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = keep(links.union(links.select(F.col("v"), F.col("u"))).distinct(), "links")
    labels = keep(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "labels")
    while True:
        beside = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("near"))
        nearer = keep(labels.join(beside, labels.node == beside.u).select("node", "label", F.least("label", "near").alias("new")), "nearer")
        of = nearer.select(F.col("node").alias("at"), F.col("new").alias("further"))
        jumped = keep(nearer.join(of, nearer.new == of.at).select("node", "label", F.least("new", "further").alias("new")), "jumped")
        moved = jumped.filter("label <> new").limit(1).count()
        keep.drop(labels, nearer)
        labels = jumped.select("node", F.col("new").alias("label"))
        if not moved:
            found = labels.select("node", F.col("label").alias("component"))
            return found if scratch else keep.finish(found)
