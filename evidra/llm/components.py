"""Connected components of a graph given as edges: alternating large-star and small-star.

Every round is a pre-aggregated minimum per node and a join; stars with hot centres are split by
Spark's skew join. Each round's edges are written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm._common import discard, materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One half of a round. edges: u, v."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    if large:
        near = edges.unionAll(turned)
    else:
        near = edges.where("v < u").unionAll(turned.where("v < u"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = near.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node of an edge that isn't the least of its component, with that least node."""
    now = materialize(edges.where("u != v").distinct())
    state = _state(now)
    while True:
        new = materialize(_stars(_stars(now, True), False))
        discard(now)
        now, before, state = new, state, _state(new)
        if state == before:
            return now
