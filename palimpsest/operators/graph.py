"""Connected parts of a graph in a logarithmic number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from palimpsest.sources.storage import Scratch, materialize


def parts(edges: DataFrame) -> DataFrame:
    """(node, part) of every node of edges(a, b): ``part`` is the least node that it is joined to.

    Every node points to a node of its part that is not greater. In each round nodes look at where the targets of their neighbours
    point; their own targets, and they themselves, take the least of these, and pointers are doubled. A path of n nodes takes
    some log n rounds. A round is a handful of joins on nodes and ends in a table; tables of earlier rounds are deleted at the end.
    """
    with Scratch(edges.sparkSession) as tmp:
        both = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
        both = tmp.write(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        # to: where a node points; far: where that one points
        near = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("to"))
        state, seen = _written(tmp, _doubled(near))
        before = None
        while seen != before:
            before = seen
            met = both.join(state, both["b"] == state["node"]).groupBy("a").agg(F.min("far").alias("met"))
            own = state.join(met, state["node"] == met["a"]).select("node", "to", "far", "met")
            hooks = own.groupBy(F.col("to").alias("hook")).agg(F.min("met").alias("low"))
            moved = own.join(hooks, own["node"] == hooks["hook"], "left")
            state, seen = _written(tmp, _doubled(moved.select("node", F.least("to", "far", "met", "low").alias("to"))))
        return materialize(state.select("node", F.col("far").alias("part")))


def _written(tmp: Scratch, state: DataFrame) -> tuple[DataFrame, object]:
    """The table of a state, and a sum that changes with it, seen while it is written."""
    seen = Observation()
    out = tmp.write(state.observe(seen, F.sum(F.xxhash64("node", "far").cast("decimal(38,0)")).alias("sum")))
    return out, seen.get["sum"]


def _doubled(rows: DataFrame) -> DataFrame:
    other = rows.select(F.col("node").alias("n"), F.col("to").alias("far"))
    return rows.join(other, rows["to"] == other["n"]).select("node", "to", "far")
