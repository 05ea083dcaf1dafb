"""Connected components of an edge table, on Spark from end to end.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014): each step points neighbours at the
least neighbour, which halves the depth of a component and never grows the edge
table. Neighbourhoods are reduced by a minimum (partial aggregation) and joined
back, so no node's neighbours are gathered in one place, and adaptive execution
can split the join of a node with very many edges. Each round is a reliable
checkpoint; nothing reaches the driver but two numbers per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import checkpoint_dir


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v), v < u. Large star: a node's larger neighbours go to its
    least neighbour or itself. Small star: its smaller neighbours and itself do."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = (edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(least.select("u", F.col("m").alias("v"))))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is
    named by its least node. Loops, repeated edges and either direction are
    allowed; edges with a null end are ignored."""
    checkpoint_dir(edges.sparkSession)
    cur = (edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint())
    mark = None
    while True:
        seen = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or seen[0] == 0:
            break
        mark = seen
        cur = _star(_star(cur, True), False).checkpoint()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def spanning_edges(links: list[tuple], size: int):
    """Edges (i, j) of a spanning forest of numpy index pairs over ``size``
    nodes: the same components with fewer edges than nodes."""
    import numpy as np
    label = np.arange(size)
    a, b = links
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    node = np.flatnonzero(label != np.arange(size))
    return node, label[node]
