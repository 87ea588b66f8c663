"""Connected components of an edge table, without bringing edges or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnline.workspace import stored


def components(edges: DataFrame) -> DataFrame:
    """(node long, label long): for each node of edges (a long, b long), the smallest node that it is connected with.

    Each round has two steps: every node's larger neighbours are hung on the smallest of itself and its neighbours, then
    every node and its smaller neighbours on the smallest of these. Neither step adds edges or changes what is connected,
    and an edge that changes gets smaller ends, so that the rounds end, with a star around each smallest node. In
    simulations, chains in the worst known and in random orders took 12 rounds at 1,000 nodes, 19 at 100,000. Rounds are written to the shared folder; the driver
    sees only whether any edge has changed.
    """
    spark = edges.sparkSession
    rows = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    rows = stored(spark, rows, "edges")  # v > u
    while True:
        both = rows.union(rows.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy(F.col("v").alias("u")).agg(F.min("u").alias("near")).select("u", F.least("u", "near").alias("m"))
        large = rows.join(least, "u").select("v", F.col("m").alias("u"), (F.col("m") < F.col("u")).alias("changed"))
        large = stored(spark, large.groupBy("v", "u").agg(F.max("changed").alias("changed")), "edges")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select("v", "u", "m", (F.col("changed") | (F.col("u") > F.col("m"))).alias("changed"))
        hung = small.select("v", F.col("m").alias("u"), "changed").union(small.where("u > m").select(F.col("u").alias("v"), F.col("m").alias("u"), "changed"))
        hung = stored(spark, hung.groupBy("v", "u").agg(F.max("changed").alias("changed")), "edges")
        rows = hung.select("v", "u")
        if hung.where("changed").isEmpty():
            return rows.select(F.col("v").alias("node"), F.col("u").alias("label")).union(rows.select("u", "u").distinct())


def roots(links: DataFrame) -> DataFrame:
    """node and root: where the chain of parents ends, of links (node long, parent long) with one parent a node and no cycle.

    Each round doubles the steps that a link spans, so that a chain of n links takes log n rounds. What is no node is an end.
    """
    spark = links.sparkSession
    rows = stored(spark, links.select("node", F.col("parent").alias("root")), "roots")
    while True:
        after = rows.select(F.col("node").alias("root"), F.col("root").alias("_after"))
        rows = rows.join(after, "root", "left").select("node", F.coalesce("_after", "root").alias("root"), F.col("_after").isNotNull().alias("_moved"))
        rows = stored(spark, rows, "roots")
        if rows.where("_moved").isEmpty():
            return rows.select("node", "root")
