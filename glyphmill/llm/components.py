"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persisted


def components(links: DataFrame) -> DataFrame:
    """(u, root): the least node of the component of every node of the links (u, v).

    Each round hangs every node's neighbours on the least of them, first the larger ones, then
    the smaller ones, until nothing changes: about log(longest path) rounds, each of joins and
    aggregates over the links alone, with a checkpoint.  Nothing is collected but a count and a checksum.
    """
    pairs = links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, mark = persisted(pairs), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark or not now[0]:
            return edges.select("u", F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
        mark = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = persisted(small.unionByName(low.withColumnRenamed("m", "v")).where("u != v").distinct())
