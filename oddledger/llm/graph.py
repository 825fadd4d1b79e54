"""Connected components over tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddledger.session import staged


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); component is its smallest node.

    Alternates large-star and small-star rounds: every round rewires links to the
    smallest neighbour, so links never grow in number and no group is collected.
    Null ends are left out, a link of a node to itself makes a component of one.
    Every step is written to the shared folder, so a lost executor costs one step.

    The smallest neighbours are a stored table: a small one is broadcast by its size, and
    a large one meets the links in a plain join of two tables, in which Spark splits the
    links of a node that has very many.
    """
    known = staged(
        links.filter("a is not null and b is not null")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    edges = known.filter("u <> v")
    while True:
        # u > v in every link
        both = edges.union(edges.select("v", "u"))
        low = staged(
            both.groupBy("u").agg(
                F.least("u", F.min("v")).alias("m"),
                F.sum((F.col("v") < F.col("u")).cast("long")).alias("down"),
                F.sum((F.col("v") > F.col("u")).cast("long")).alias("up"),
            ),
            "lows",
        )
        # all links are stars: a node has one smaller neighbour, or larger ones only
        if low.filter("down > 1 or (down > 0 and up > 0)").isEmpty():
            break
        near = low.select(F.col("u").alias("v"), "m")
        star = edges.join(near, "v").select("u", F.col("m").alias("v"))
        least = staged(star.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = star.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(moved.union(least).distinct(), "links")
    alone = known.filter("u = v").join(low, "u", "left_anti")
    return low.select(F.col("u").alias("node"), F.col("m").alias("component")).union(alone)
