"""Connected components over an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import Staging


def components(edges: DataFrame, staging: Staging) -> DataFrame:
    """(node, label) for each end of ``edges`` (a, b); label is the smallest node reachable.

    Rounds of contraction: each node hooks onto the first of itself and its
    neighbours in an order drawn by hash, takes one more step along the hooks,
    and the edges are rewritten to the nodes hooked onto.  Edges inside a
    merged node vanish, so the table shrinks by a constant factor a round in
    expectation, whatever the shape of the graph.  Rounds are written to the
    shared folder; nothing is collected.
    """
    drawn = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("node"))
    left = staging.put(edges.select("a", "b").distinct())
    roots = None
    while roots is None or not left.isEmpty():
        both = left.select("a", "b").union(left.select("b", "a"))
        hooks = staging.put(both.groupBy("a").agg(F.min(drawn("b")).alias("near")).select(F.col("a").alias("node"), F.least("near", drawn("a"))["node"].alias("to")))
        on = hooks.select(F.col("node").alias("at"), F.col("to").alias("next"))
        steps = staging.put(hooks.join(on, hooks["to"] == on["at"]).select("node", F.col("next").alias("to")))
        if roots is None:
            moved = staging.put(steps.select("node", F.col("to").alias("root")))
        else:
            moved = staging.put(roots.join(steps.select(F.col("node").alias("at"), "to"), F.col("root") == F.col("at"), "left").select("node", F.coalesce("to", "root").alias("root")))
            staging.drop(roots)
        roots = moved
        a, b = steps.select(F.col("node").alias("a"), F.col("to").alias("x")), steps.select(F.col("node").alias("b"), F.col("to").alias("y"))
        rest = staging.put(left.join(a, "a").join(b, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        staging.drop(left, hooks, steps)
        left = rest
    staging.drop(left)
    return roots.join(roots.groupBy("root").agg(F.min("node").alias("label")), "root").select("node", "label")
