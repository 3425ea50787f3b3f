"""Connected components by label propagation with pointer jumping, on tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b: long); comp is the component's least node.

    Each round a node takes the least label among its own, its neighbours' and
    its label's label.  All joins are plain equi-joins of written tables, so a
    node with very many neighbours is split by the skew join; minima are
    aggregated before they are shuffled.
    """
    rows = 2 * edges.count()
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "cc-edges", rows)
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")).withColumn("comp", F.least("node", "comp")), "cc-labels", rows)
    for _ in range(max_rounds):
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = materialize(labels.join(near, "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("was")), "cc-step", rows)
        of = step.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        step = materialize(step.join(of, "comp").select("node", F.least("comp", "next").alias("comp"), (F.least("comp", "next") < F.col("was")).alias("moved")), "cc-labels", rows)
        labels = step.select("node", "comp")
        if not step.filter("moved").head(1):
            return labels
    raise RuntimeError("labels still move after all rounds")
