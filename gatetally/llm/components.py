"""Connected components of a table of links, by alternating stars, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatetally.llm.common import written


def _both_ways(links: DataFrame) -> DataFrame:
    turned = links.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return links.unionAll(turned)


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Links from each node's neighbours to the least node among them and itself.

    ``links`` (u, v); of a node's neighbours only the larger, or only the smaller and the node itself,
    are linked anew. The least is found before the shuffle ends, so a node with many neighbours is cheap.
    """
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = links.join(least, "u")
    if larger:
        new = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = least.select("u", F.col("m").alias("v"))
        new = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(own)
    return new.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """id, component: the least node that a node is linked to, through others or not.

    ``links`` has u and v; nulls and links to oneself are ignored. Only nodes with a link are returned.
    """
    # Each link goes from the larger to the smaller node.
    links = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    links = written(links.distinct(), "components")
    while True:
        large = written(_star(_both_ways(links), larger=True), "components")
        small = written(_star(large, larger=False), "components")
        # The same links again: every node is linked to its component's least, and to no other.
        same = small.count() == links.count() and small.exceptAll(links).isEmpty()
        links = small
        if same:
            break
    linked = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = linked.select(F.col("component").alias("id"), "component").distinct()
    return linked.unionAll(roots)
