"""Connected components by contraction, all of it in joins and sums.

Each round hooks every node to the least of itself and its neighbours, follows
these pointers a few steps, and contracts the edges to the nodes found; rounds go on until no edge
is left.  Every table is written before it is joined, so that the join may split a node with very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cyclewise.llm.common import materialise

JUMPS = 2


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """node, root (least node of its component) of all nodes of ``edges`` (a, b)."""
    edges = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        hooks = materialise(hooks, f"{name}-hooks")
        for _ in range(JUMPS):
            up = hooks.select(F.col("u").alias("p"), F.col("p").alias("q"))
            hooks = materialise(hooks.join(up, "p").select("u", F.col("q").alias("p")), f"{name}-hooks")
        if labels is None:
            labels = hooks.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            step = hooks.select(F.col("u").alias("root"), "p")
            labels = materialise(labels.join(step, "root", "left").select("node", F.coalesce("p", "root").alias("root")),
                                 f"{name}-labels")
        left = edges.join(hooks.select("u", F.col("p").alias("x")), "u").join(
            hooks.select(F.col("u").alias("v"), F.col("p").alias("y")), "v")
        left = left.where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
        edges = materialise(left, f"{name}-edges")
        if edges.isEmpty():
            return labels
