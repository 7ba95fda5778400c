"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node reachable) of all nodes that have an edge.

    Minimum labels travel along the edges and then jump to their label's label, so chains shrink by
    halves. Minima are pre-aggregated, so a node with very many edges makes no large group. Each round is written to the
    shared folder, the one before deleted; nothing but a count of changed rows comes to the driver. Empty edges: no rows.
    """
    one = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    both = written(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("n"))
        lower = labels.join(near, "u").select("u", F.col("c").alias("was"), F.least("c", "n").alias("c"))
        jump = labels.select(F.col("u").alias("c"), F.col("c").alias("up"))
        lower = written(lower.join(jump, "c", "left").select("u", "was", F.least("c", F.coalesce("up", "c")).alias("c")), "labels")
        changed = lower.where("c <> was").limit(1).count()
        discard(labels)
        labels = lower
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    discard(both)
    return labels.select(F.col("u").alias("node"), F.col("c").alias("component"))
