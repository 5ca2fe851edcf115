"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (columns a, b); component is the least id reachable.

    Each round every node moves to the neighbour (or itself) with the least hash of that round, and the
    edges follow; loops and repeats go. Random priorities shrink any graph geometrically, so the number
    of rounds is logarithmic whatever the diameter. Minima are combined before the shuffle, so a hub
    costs no more than its partitions; joins read written tables, so that AQE can split a hub's rows.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    left = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    moves = []
    while left.limit(1).count():
        prio = lambda c, k=len(moves): F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("p"), F.col(c).alias("v"))
        both = left.select(F.col("a").alias("id"), prio("b").alias("n")).unionByName(left.select(F.col("b").alias("id"), prio("a").alias("n")))
        near = both.groupBy("id").agg(F.min(F.col("n")).alias("n"))
        move = written(near.select("id", F.least("n", prio("id"))["v"].alias("to")), "moves")
        moves.append(move)
        at = left.join(move.withColumnRenamed("id", "a").withColumnRenamed("to", "x"), "a").join(move.withColumnRenamed("id", "b").withColumnRenamed("to", "y"), "b")
        at = at.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        before, left = left, written(at, "edges")
        dropped(before)
    if not moves:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    dropped(left)
    label = moves[0]
    for move in moves[1:]:
        step = move.select(F.col("id").alias("to"), F.col("to").alias("next"))
        label = label.join(step, "to", "left").select("id", F.coalesce("next", "to").alias("to"))
    label = written(label, "labels")
    dropped(*moves)
    least = written(label.groupBy("to").agg(F.min("id").alias("component")), "least")
    return label.join(least, "to").select("id", "component")
