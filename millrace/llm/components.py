"""Connected components by contraction, on links of any number and shape.

In each round every node maps to the first of itself and its neighbours in a hashed order, and links are
redrawn between what their ends map to.  Hashing keeps long paths from shrinking by one node a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """links: a, b (long).  Returns (node, root): each linked node and one node of its component."""
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct()
    edges = materialize(both(links), "edges")
    out = None
    while out is None or not edges.isEmpty():
        first = F.least(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("v"))), F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("v")))
        to = materialize(edges.groupBy("a").agg(first.alias("m")).select(F.col("a").alias("node"), F.col("m.v").alias("root")), "map")
        if out is None:
            out = to
        else:
            step = to.select(F.col("node").alias("root"), F.col("root").alias("__next"))
            out = materialize(out.join(step, "root", "left").select("node", F.coalesce("__next", "root").alias("root")), "roots")
        half = edges.join(to.select(F.col("node").alias("a"), F.col("root").alias("__a")), "a").select("b", "__a")
        whole = half.join(to.select(F.col("node").alias("b"), F.col("root").alias("__b")), "b")
        edges = materialize(whole.filter("__a != __b").select(F.col("__a").alias("a"), F.col("__b").alias("b")).distinct(), "edges")
    return out
