"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.storage import forget, stored


def components(links: DataFrame) -> DataFrame:
    """(node, label): every node of ``links`` (a, b) with the smallest node of its component.

    Each round a node takes the smallest label around it and then the label of that label, which shortens paths by
    half; rounds end when nothing changes. Labels stay in tables; one truth value a round reaches the driver.
    """
    ways = F.array(*[F.struct(F.col(x).alias("node"), F.col(y).alias("other")) for x, y in (("a", "b"), ("b", "a"))])
    both = links.select(F.explode(ways).alias("way")).select("way.*")
    edges = stored(both.where("node <> other").distinct(), "component-links")
    labels = stored(
        edges.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")), "component-labels"
    )
    while True:
        near = edges.join(labels.select(F.col("node").alias("other"), F.col("label").alias("near")), "other")
        least = near.groupBy("node").agg(F.min("near").alias("near"))
        taken = labels.join(least, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        new = stored(
            taken.join(jump, F.col("label") == F.col("at"), "left").select(
                "node", F.least("label", F.coalesce("far", "label")).alias("label"), "old"
            ), "component-labels",
        )
        changed = not new.where("label <> old").isEmpty()
        forget(labels)
        labels = new
        if not changed:
            return labels.select("node", "label")
