"""Connected components by alternating stars; no link or label reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passledger.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b); the root is the smallest node.

    Large stars hang the greater neighbours of a node on the smallest one around it,
    small stars the others; rounds go on until every node hangs on its root. A node of
    any degree is an aggregate and a join that adaptive execution can split. Each round
    is cut by a reliable checkpoint.
    """
    edges = cut_lineage(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        edges = cut_lineage(small.distinct())
        hanging = edges.groupBy("u").agg(F.count("*").alias("n"))
        open_ = edges.join(hanging.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        if not open_ and not hanging.where("n > 1").limit(1).count():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
