"""Connected components by the smallest label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfold.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node it is connected with) of every node of ``links``
    (columns a and b). Every round is a staged table; rounds grow with the logarithm of the
    longest path. No links give no rows; rows with a null end are left out."""
    both = links.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    edges = stage(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label"))
    labels = stage(labels, "labels")
    while True:
        seen = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(seen, F.col("node") == F.col("a")).select(
            "node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        moved = stage(lower.join(jump, F.col("low") == F.col("to")).select(
            "node", F.least("low", "further").alias("label"), (F.least("low", "further") < F.col("label")).alias("moved")), "labels")
        labels = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return labels
