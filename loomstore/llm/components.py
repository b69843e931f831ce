"""Connected components of an edge list, by star contraction over DataFrames.

Each round alternates two steps over (u, v) edges.  The large step links every
larger neighbour of a node to the smallest node around it, the small step every
smaller-or-equal one; edges never grow in number, and the rounds needed grow
with the logarithm of the longest chain.  A node with many neighbours costs one
row an edge: minima are aggregated before the shuffle, and the join that hands
them out is split by adaptive execution where a key is hot.  No join is a broadcast: files
of links are far smaller than their rows are in memory, so Spark would let the driver
hold too many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v); component is the smallest node that is reachable.

    Self-links, repeated links and either direction are allowed; rows with a null end are no links.
    No links give no rows.  A round that changes anything links some node to a smaller one than before,
    and nodes are finite, so the rounds end.
    """
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = materialize(small, "links")
        # Stars are left when nothing changes any more: as many links as nodes that point down, and the same sum
        state = edges.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        before = state
