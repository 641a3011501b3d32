"""Connected components: smallest node id reachable over links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node in ``links`` (columns a, b; any direction, repeats allowed).

    Alternates two steps until nothing changes. Large star: each node tells its larger neighbours
    the smallest node it knows of. Small star: each node hands its smaller neighbours over to the
    smallest of them. The number of rounds grows with the logarithm of the longest path, the number of
    links never grows, and a node's neighbours are never gathered: the smallest comes from an
    aggregate and is joined back. Each round is written to the shared folder.
    """
    edges = settle(
        links.where(F.col("a") != F.col("b")).select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        ).distinct(), name)
    while True:
        flipped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        both = edges.unionByName(flipped)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = settle(
            flipped.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a != b").distinct(), name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a")
        small = settle(
            moved.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                         F.col("m").alias("b")).where("a != b").distinct(), name)
        if small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty():
            break
        edges = small
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
