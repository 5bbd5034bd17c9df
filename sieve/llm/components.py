"""Connected components of a table of links, by alternating large-star and small-star contraction.

Each round moves links towards the smallest neighbour; both steps are a minimum with map-side combining and a
join, so a node with a huge number of neighbours is never one task's list (AQE splits its join). Rounds end when the links are
stars: no node has two smaller neighbours, and none that has one is another's. One aggregate of the nodes tells, so links that
are stars from the start take no round, and no round only confirms the one before. Each round is written to the shared folder.

Defined cases: links of a node with itself and repeated links change nothing; links with a null end are left out; no
links give no nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.llm.common import cut


def _stars(edges: DataFrame) -> bool:
    """Whether distinct links (v, u), v > u, are stars around their smallest nodes."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("v").alias("node"), F.lit(1).alias("up")), F.struct(F.col("u").alias("node"), F.lit(0).alias("up")))))
    nodes = ends.groupBy("col.node").agg(F.sum("col.up").alias("ups"), F.min("col.up").alias("least"))
    return not nodes.filter("ups > 1 OR (ups = 1 AND least = 0)").limit(1).count()


def components(links: DataFrame, left: str, right: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node that has a link: the smallest node it is connected with, itself included."""
    a, b = F.col(left), F.col(right)
    # v > u throughout: a link goes from the larger node to the smaller.
    edges = links.filter(a != b).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct()
    edges = cut(edges, "components")
    rounds = 0
    while not _stars(edges):
        if rounds == most_rounds:
            raise RuntimeError(f"links didn't contract in {most_rounds} rounds")
        rounds += 1
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).withColumn("m", F.least("m", "v"))
        # A row a link at most: repeated ones go with those of the second step.
        large = both.filter("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        small = small.filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u")))
        edges = cut(small.distinct(), "components")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )
