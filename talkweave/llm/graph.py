"""Connected components of a large sparse graph by randomized contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.llm import storage

#: Rounds that share an order of the ids: in the second one the neighbours of a contracted hub follow it, so stars end in two rounds.
SAME_ORDER = 2


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that edges (a, b) reach, for every id with an edge.

    Each round sends an id to the first of itself and its neighbours in a random order (a salted
    hash, so that it doesn't follow the ids), and keeps the edges between what is then
    still different. The last id in the order is sent to by none, so ids get fewer in every round
    whatever the graph, and by a constant share in expectation under each new order: rounds are
    logarithmic, of long chains with any ids too, and go on until no edge is left. Edges and steps go
    to the shared folder after each round; only whether edges are left reaches the driver.
    """
    left = storage.staged(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "graph-edges")
    none = left.select(F.col("a").alias("id"), F.col("b").alias("component")).where("false")
    steps: list[DataFrame] = []
    while left.limit(1).count():
        salt = len(steps) // SAME_ORDER

        def place(c: str, salt: int = salt) -> Column:
            return F.struct(F.xxhash64(F.lit(salt), c).alias("by"), F.col(c).alias("id"))

        first = left.groupBy("a").agg(F.min(place("b")).alias("first"))
        step = storage.staged(first.select(F.col("a").alias("id"), F.least("first", place("a"))["id"].alias("to")), "graph-steps")
        ends = left.join(step.select(F.col("id").alias("a"), F.col("to").alias("_a")), "a").join(step.select(F.col("id").alias("b"), F.col("to").alias("_b")), "b")
        left = storage.staged(ends.where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), "graph-edges")
        steps.append(step)
    if not steps:
        return none
    # the steps from the last to the first: where each id ends; ids without a further step stay where they are
    end = steps.pop().select("id", F.col("to").alias("end"))
    while steps:
        later = end.select(F.col("id").alias("to"), "end")
        end = storage.staged(steps.pop().join(later, "to", "left").select("id", F.coalesce("end", "to").alias("end")), "graph-ends")
    least = end.groupBy("end").agg(F.min("id").alias("component"))
    return storage.staged(end.join(least, "end").select("id", "component"), "graph-labels")
