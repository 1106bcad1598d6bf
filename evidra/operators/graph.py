"""Relationship graphs as DataFrames: edges, co-occurrence, expansion, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.tables import written

#: Tasks that count the pairs of one seed.
SHARES = 8


def edge_id(source: Column, kind: Column, target: Column) -> Column:
    """rel_ and 16 hex digits of SHA-1 over source|kind|target."""
    text = F.concat_ws("|", source.cast("string"), kind.cast("string"), target.cast("string"))
    return F.concat(F.lit("rel_"), F.substring(F.sha1(text.cast("binary")), 1, 16))


def edges(rows: DataFrame, source: Column, kind: str, target: Column) -> DataFrame:
    """relationship_id, source_id, relationship_type, target_id without repeated edges; null ends have none."""
    e = rows.select(source.cast("string").alias("source_id"), F.lit(kind).alias("relationship_type"), target.cast("string").alias("target_id"))
    e = e.where("source_id is not null and target_id is not null").distinct()
    return e.select(edge_id(F.col("source_id"), F.col("relationship_type"), F.col("target_id")).alias("relationship_id"), "*")


def nodes(edge_rows: DataFrame) -> DataFrame:
    """entity_id, n_edges of both ends of all edges."""
    ends = edge_rows.select(F.explode(F.array("source_id", "target_id")).alias("entity_id"))
    return ends.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_edges"))


def co_occurring(contains: DataFrame, seeds: DataFrame, chunk: str, entity: str, k: int = 3, per_task: int = 1 << 20) -> DataFrame:
    """seed, entity, n, rank: the k entities that share most chunks with each seed, ties to the smaller.

    Only the seeds' chunks are expanded, by an equi join. Links are written and the pairs counted from
    the chunks' sizes, so that a task gets about `per_task` pairs however large the tables are; a large
    chunk's seeds are dealt to several tasks. A seed's pairs are counted in SHARES tasks by their other
    entity, of which each hands on k.
    """
    spark = contains.sparkSession
    rows = contains.select(chunk, entity).where(F.col(chunk).isNotNull() & F.col(entity).isNotNull())
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // per_task))
    links = written(rows.repartition(parts, chunk, entity).distinct())
    sizes = links.repartition(parts, chunk).groupBy(chunk).agg(F.count(F.lit(1)).alias("_size"))
    pairs = sizes.agg(F.sum(F.col("_size") * F.col("_size"))).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-int(pairs) // per_task))
    sized = links.repartition(tasks, chunk).join(sizes.repartition(tasks, chunk), chunk).withColumn("_slices", F.ceil(F.col("_size") * F.col("_size") / per_task).cast("int"))
    starts = sized.join(seeds.select(F.col(entity)).distinct(), entity, "left_semi")
    starts = starts.select(chunk, F.col(entity).alias("seed"), F.pmod(F.xxhash64(entity), F.col("_slices")).cast("int").alias("_slice")).repartition(tasks, chunk, "_slice")
    others = sized.select(chunk, entity, F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice")).repartition(tasks, chunk, "_slice")
    met = starts.join(others.hint("merge"), [chunk, "_slice"]).where(F.col(entity) != F.col("seed"))
    met = met.select("seed", entity, F.pmod(F.xxhash64(entity), F.lit(SHARES)).alias("_share")).repartition(tasks, "seed", "_share")
    counted = met.groupBy("seed", "_share", entity).agg(F.count(F.lit(1)).alias("n"))
    best = lambda df, *per: df.withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy(F.desc("n"), entity))).where(F.col("rank") <= k)
    first = best(counted, "seed", "_share").select("seed", entity, "n")
    return best(first.repartition(tasks, "seed"), "seed")


def expand(parts: DataFrame, wholes: DataFrame, sources: DataFrame, part_key: str, whole_key: str, source_key: str) -> DataFrame:
    """part -> whole (needed) -> source (optional): inner join, then left join."""
    return parts.join(wholes, part_key if part_key == whole_key else F.col(part_key) == F.col(whole_key)).join(sources, source_key, "left")
