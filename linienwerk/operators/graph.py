"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from linienwerk.shared import Stash


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, max_rounds: int = 60, tidy: bool = False) -> DataFrame:
    """``(src, dst) edges → (id, component)``; the label is the smallest member.

    Each round takes the smallest label next to a vertex and then the label of
    that label, so a path of n vertices needs about log n rounds. Minima are
    combined before the shuffle, so a vertex with very many edges is no hot
    spot. Each round is written to the shared folder. Loops and repeated edges
    are harmless; edges with a null end are ignored. Vertices without an edge
    come back as their own component when ``vertices(id)`` is given. With
    ``tidy`` the shuffle files of edges and rounds go as soon as those are written.
    """
    spark = edges.sparkSession
    stash = Stash(spark, "components", merge=True, tidy=tidy)
    e = edges.select("src", "dst").where("src is not null and dst is not null and src <> dst")
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = stash.put(e.select(F.explode(ways).alias("e")).select("e.*").distinct())
    labels = stash.put(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m")).select("id", F.least("id", "m").alias("component")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("id").alias("src"), "component"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("m"))
        lower = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = stash.put(lower.join(jump, "component", "left").select("id", "old", F.least("component", F.coalesce("up", "component")).alias("component")))
        changed = new.where("old <> component").limit(1).count()
        stash.drop(labels)
        labels = new.select("id", "component")
        if not changed:
            stash.drop(both)
            break
    else:
        raise RuntimeError("components did not settle")
    if vertices is None:
        return labels
    return vertices.select("id").distinct().join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
