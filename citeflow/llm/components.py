"""Connected components by alternating stars, entirely as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeflow.llm.tables import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; a component is named by its least node.

    Union-find as rounds of joins: a large star hangs a node's greater neighbours on its least
    neighbour, a small star its lesser ones, until every node hangs on its root. Rounds grow with the
    logarithm of the longest chain. A hub's least neighbour is found with map-side aggregation, and the
    join that hands it out is one adaptive execution can split, so a hub needs no task of its own.

    Links in either direction, repeated links and self links are fine. An empty table of links gives an
    empty result. Null ends are ignored.
    """
    ends = links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = scratch.write(
        ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}0"
    )
    state, step = _state(edges), 0
    while True:
        step += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = hung.unionByName(root.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.write(small, f"{name}{step}")
        scratch.drop(f"{name}{step - 1}")
        edges, last, state = after, state, _state(after)
        if state == last:
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
