"""Connected components of an edge table, without gathering anything on the driver.

Each round hooks every node to its smallest neighbour, shortens the pointers twice, and contracts the
edges by them, so the number of edges falls fast and rounds grow with the logarithm of the longest
path. A hook edge (x, p(x)) contracts to (p(x), p(p(x))), hence contracting by pointers that are not
fully shortened loses no connection. Lineage is cut in every round by a staged table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.staging import stage_table, unstage

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``: equal roots for connected nodes.

    The root is some node of the component. Loops and repeated edges are allowed; a node whose only edges
    are loops is not returned, and an empty table gives an empty result.
    """
    links = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = stage_table(links, "links")
    labels: DataFrame | None = None
    for _ in range(MAX_ROUNDS):
        if labels is not None and links.isEmpty():
            return labels
        both = links.unionAll(links.select("b", "a"))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("parent"))
        parents = stage_table(parents, "parents")
        for _ in range(2):
            above = parents.select(F.col("node").alias("n"), F.col("parent").alias("p"))
            shorter = parents.join(above, F.col("parent") == F.col("n"), "left").select("node", F.coalesce("p", "parent").alias("parent"))
            longer, parents = parents, stage_table(shorter, "parents")
            unstage(longer)
        above = parents.select(F.col("node").alias("n"), F.col("parent").alias("p"))
        before = labels
        if before is None:
            labels = stage_table(parents.select("node", F.col("parent").alias("root")), "labels")
        else:
            labels = stage_table(before.join(above, F.col("root") == F.col("n"), "left").select("node", F.coalesce("p", "root").alias("root")), "labels")
            unstage(before)
        moved = links.join(above, F.col("a") == F.col("n")).select(F.col("p").alias("a"), "b")
        moved = moved.join(above, F.col("b") == F.col("n")).select("a", F.col("p").alias("b")).where("a <> b")
        old, links = links, stage_table(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        unstage(old, parents)
    raise RuntimeError("components did not settle")
