"""Connected components of an edge table, by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirewarden.llm.common import checkpoint


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.union(edges.select("v", "u")) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) long pairs -> (id, component), component the smallest id of the component; only ids that have an edge to
    another id. Null and self edges are ignored. Each round groups by node with partial aggregation, so that a hub's
    edges never meet in one task, and is checkpointed."""
    now = checkpoint(edges.select("u", "v").filter("u <> v").distinct())
    last = None
    while True:
        now = checkpoint(_star(_star(now, large=True), large=False))
        state = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if state == last or not state[0]:
            break
        last = state
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
