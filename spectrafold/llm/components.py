"""Connected components of a link table, in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafold.llm._store import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str = "components", rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every id of ``links(a, b)``: the smallest id reachable.

    Each round an id takes the least label among its own, its neighbours' and
    its label's label, so labels travel twice as far each round.  Both the
    neighbour step and the jump are an equi-join and a minimum with map-side
    combination; each round is cut off by a table in the shared folder.
    Null ends and self-links are ignored.
    """
    links = links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = links.union(links.select("b", "a")).distinct()
    both = scratch.put(both, f"{name}-links")
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label"))
    labels = scratch.put(labels, f"{name}-0")
    for k in range(1, rounds + 1):
        near = both.join(labels, both.b == labels.id).select(both.a.alias("id"), "label")
        least = near.union(labels).groupBy("id").agg(F.min("label").alias("label"))
        jump = least.select(F.col("id").alias("at"), F.col("label").alias("further"))
        moved = least.join(jump, least.label == jump["at"], "left").join(labels.select(F.col("id").alias("old_id"), F.col("label").alias("old")), F.col("id") == F.col("old_id"))
        moved = moved.select("id", F.least("label", "further").alias("label"), (F.least("label", "further") != F.col("old")).alias("changed"))
        moved = scratch.put(moved, f"{name}-{k}")
        changed = not moved.where("changed").isEmpty()
        scratch.drop(f"{name}-{k - 1}")
        labels = moved.select("id", "label")
        if not changed:
            break
    else:
        raise RuntimeError(f"labels still move after {rounds} rounds")
    scratch.drop(f"{name}-links")
    return labels.withColumnRenamed("label", "component")
