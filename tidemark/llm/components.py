"""Connected components of links, by repeated minima and jumps; tables only, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``label``, the smallest node it reaches, for every node of a link.

    Each round takes the smallest label of a node's neighbours (a partial aggregate, so a hub with very many links is no
    task of its own) and then the label's own label, which halves the distance that is left.  Every round is written to
    the shared folder; the rounds end when no label moves.
    """
    both = links.where(F.col(a) != F.col(b)).select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = materialise(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = materialise(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = materialise(moved.join(jump, "label").select("node", "was", F.least("label", "next").alias("label")), "labels")
        if moved.where("label < was").isEmpty():
            return moved.select("node", "label")
        labels = moved.select("node", "label")
