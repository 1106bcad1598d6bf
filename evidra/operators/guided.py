"""Search guided by a graph: nodes near a query's seeds restrict what is scored, and rank fusion adds the open search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.vectors import cosine
from evidra.operators.ranking import fuse_ranks, nearest, top_k
from evidra.tables import forget, written


def reached(edges: DataFrame, seeds: DataFrame, depth: int, enough: int | None = None) -> DataFrame:
    """query_id, node, hops: nodes that a query's seeds reach over at most `depth` edges, by the fewest hops.

    edges: source, target, walked both ways; seeds: query_id, node. Each step joins the newest nodes
    only. With `enough`, a query whose nodes are that many is not walked further. A node with many
    edges is one side of a join that Spark splits; every step's frontier is distinct before it grows.
    """
    both = edges.select("source", "target").unionAll(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).where("source <> target").distinct()
    seen = written(seeds.where("node IS NOT NULL").select("query_id", "node").distinct().withColumn("hops", F.lit(0)))
    for hop in range(1, depth + 1):
        newest = seen.where(F.col("hops") == hop - 1)
        if enough:
            full = seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= enough)
            newest = newest.join(full, "query_id", "left_anti")
        grown = newest.join(both, newest["node"] == both["source"]).select("query_id", F.col("target").alias("node")).distinct()
        grown = written(grown.join(seen, ["query_id", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if grown.isEmpty():
            break
        before, seen = seen, written(seen.unionByName(grown))
        forget(before)
        forget(grown)
    return seen


def guided_search(vectors: DataFrame, queries: DataFrame, scopes: DataFrame, pinned: DataFrame, k: int, candidates: int, least: int = 1, constant: int = 60) -> DataFrame:
    """query_id, vec_id, rank, score, n_lists: pinned rows, the best inside a query's scope and the best of all, fused by rank.

    vectors: vec_id, node, embedding; queries: vec_id (the query's id), embedding; scopes: query_id, node;
    pinned: query_id, vec_id, place. Rows of the scope are found by a join of nodes before anything is
    scored, so the search space is restricted first. A scope with fewer than `least` rows falls back to
    the open search alone. The query's own row never counts. Ties go to the smaller id.
    """
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
    inside = scopes.select("query_id", "node").distinct().join(vectors.select("vec_id", "node", "embedding"), "node").where("vec_id <> query_id")
    wide = inside.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("query_id")
    scored = inside.join(wide, "query_id", "left_semi").join(asked, "query_id").select("query_id", "vec_id", F.round(cosine(F.col("embedding"), F.col("asked")), 6).alias("score"))
    best = top_k(scored, [F.desc("score"), F.asc("vec_id")], candidates, ["query_id"]).select("query_id", "vec_id", "rank")
    everywhere = nearest(vectors, queries, candidates, digits=6).select("query_id", "vec_id", "rank")
    held = pinned.where("vec_id <> query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "vec_id"))).select("query_id", "vec_id", "rank")
    fused = fuse_ranks([held, best, everywhere], "vec_id", ["query_id"], constant)
    return top_k(fused.withColumn("score", F.round("score", 6)), [F.desc("score"), F.asc("vec_id")], k, ["query_id"])
