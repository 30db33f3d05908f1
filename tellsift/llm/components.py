"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tellsift.llm.common import written


def _jumped(parents: DataFrame) -> DataFrame:
    """Follow ``parent`` to its root, doubling the steps; a node without a row is a root."""
    while True:
        nxt = parents.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
        parents = written(
            parents.join(nxt, F.col("parent") == F.col("_n"), "left").select(
                "node", F.coalesce("_p", "parent").alias("parent"), F.col("_p").isNotNull().alias("_moved")
            )
        )
        if parents.where("_moved").limit(1).count() == 0:
            return parents.select("node", "parent")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in ``links`` (a, b); the root is the smallest node reachable.

    Each round hangs every node that has a smaller neighbour under the smallest one, follows the
    pointers to their ends and replaces links by links of ends. Nothing is gathered per component:
    all steps are joins and minima, and hot nodes are only ever aggregated.
    """
    links = links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = written(links)
    roots = None
    while links.limit(1).count():
        hung = _jumped(written(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))))
        if roots is None:
            roots = hung
        else:
            again = hung.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
            roots = roots.join(again, F.col("parent") == F.col("_n"), "left").select("node", F.coalesce("_p", "parent").alias("parent"))
            known = roots.select("node")
            roots = written(roots.unionByName(hung.join(known, "node", "left_anti")))
        up = lambda side: hung.select(F.col("node").alias(side), F.col("parent").alias(f"_{side}"))
        links = (
            links.join(up("a"), "a", "left").join(up("b"), "b", "left")
            .select(F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y"))
            .where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        links = written(links)
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    tops = roots.select(F.col("parent").alias("node")).distinct()
    return roots.select("node", F.col("parent").alias("root")).unionByName(tops.select("node", F.col("node").alias("root")))
