"""Hybrid retrieval: several ranked lists fused, reranked, sorted by quality; lexical scores; scopes of ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.vectors import cosine
from evidra.operators.ranking import top_k

#: What a kind of source adds to a rerank score.
SOURCE_BONUS = {"guideline": 0.08, "drug_label": 0.05}


def fused_lists(lists: list[DataFrame], item: str, per: list[str] = (), constant: int = 60) -> DataFrame:
    """per, item, score, fused: reciprocal rank fusion that keeps each item's best score. Lists have item, rank, score.

    A single list is returned as it is, with its scores as fused ones.
    """
    if len(lists) == 1:
        return lists[0].select(*per, item, "score", F.col("score").alias("fused"))
    rows = reduce(DataFrame.unionByName, [x.select(*per, item, "rank", "score") for x in lists])
    return rows.groupBy(*per, item).agg(F.max("score").alias("score"), F.sum(1 / (F.lit(constant) + F.col("rank"))).alias("fused"))


def adaptive_k(complexity: int, base: int = 6, least: int = 4, most: int = 16) -> int:
    """How many results a question of that complexity gets."""
    return min(max(base + 2 * complexity, least), most)


def reranked(hits: DataFrame, k: int, query_vector: str, vector: str, score: str = "score", kind: str = "source_type", weight: float = 0.75, per: list[str] = (), item: str = "chunk_id", digits: int = 6) -> DataFrame:
    """The best k hits per query by weight * cosine + (1 - weight) * score + bonus of the source, with that score and rank; ties go to the smaller item."""
    bonus = F.lit(0.0)
    for name, value in SOURCE_BONUS.items():
        bonus = F.when(F.col(kind) == name, value).otherwise(bonus)
    total = F.round(weight * cosine(F.col(query_vector), F.col(vector)) + (1 - weight) * F.col(score) + bonus, digits)
    return top_k(hits.withColumn("rerank_score", total), [F.desc("rerank_score"), F.asc(item)], k, list(per))


def lexical_score(text: Column, terms: Column) -> Column:
    """1 for each term that the lower-cased text contains, 2 for one of several words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    worth = lambda t: F.when(low.contains(t), F.when(t.contains(" "), 2.0).otherwise(1.0)).otherwise(0.0)
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + worth(t))


def by_quality(hits: DataFrame, per: list[str], quality: str, score: str, item: str, into: str = "rank") -> DataFrame:
    """hits with their rank by quality, then score, both downward; ties go to the smaller item."""
    return hits.withColumn(into, F.row_number().over(Window.partitionBy(*per).orderBy(F.desc(quality), F.desc(score), F.asc(item))))


def frequent_entities(mentions: DataFrame, n: int, entity: str, kind: str, generic=("action", "threshold"), per: list[str] = ()) -> DataFrame:
    """The n entities with the most mentions whose kind isn't generic, with their number; ties go to the smaller entity."""
    counted = mentions.where(F.col(entity).isNotNull() & ~F.coalesce(F.col(kind).isin(*generic), F.lit(False))).groupBy(*per, entity).agg(F.count(F.lit(1)).alias("n"))
    return top_k(counted, [F.desc("n"), F.asc(entity)], n, list(per))


def in_scope(rows: DataFrame, scope: DataFrame, ids: list[str]) -> DataFrame:
    """rows with one of their id columns in the scope (one column, id); rows are kept once and meet the scope by shuffled ids."""
    marked = rows.withColumn("_row", F.monotonically_increasing_id())
    wanted = scope.select(F.col(scope.columns[0]).alias("_id")).where("_id is not null").distinct()
    keyed = marked.withColumn("_id", F.explode(F.array_distinct(F.array(*[F.col(c) for c in ids]))))
    return keyed.join(wanted, "_id", "left_semi").drop("_id").dropDuplicates(["_row"]).drop("_row")


def distinct_strings(parts: list[Column], most: int | None = None) -> Column:
    """Strings of several arrays in order, without blanks; the first of those equal but for case and outer spaces stays."""
    every = F.filter(F.transform(F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]), lambda s: F.trim(s)), lambda s: F.coalesce(s, F.lit("")) != "")
    first = F.aggregate(every, F.array().cast("array<string>"), lambda out, s: F.when(F.exists(out, lambda o: F.lower(o) == F.lower(s)), out).otherwise(F.concat(out, F.array(s))))
    return first if most is None else F.slice(first, F.lit(1), F.lit(most))


def enriched(rows: DataFrame, details: DataFrame, key: str, order: str, into: str) -> DataFrame:
    """rows with an array of their details' other columns, in order; rows without details have an empty one."""
    columns = [c for c in details.columns if c != key]
    grouped = details.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order]))).alias(into))
    empty = F.array().cast(grouped.schema[into].dataType)
    return rows.join(grouped, key, "left").withColumn(into, F.coalesce(into, empty))


def link_of(url: Column, page: Column) -> Column:
    """The link to a source: to the page where it is a PDF with a known page; null without a URL."""
    return F.when(F.coalesce(url, F.lit("")) == "", None).when(F.lower(F.split_part(url, F.lit("?"), F.lit(1))).endswith(".pdf") & page.isNotNull(), F.concat(url, F.lit("#page="), page.cast("string"))).otherwise(url)


def year_of(value: Column) -> Column:
    """The first year from 1900 to 2099 in a text, null without one."""
    return F.nullif(F.regexp_extract(F.coalesce(value.cast("string"), F.lit("")), "(20[0-9]{2}|19[0-9]{2})", 1), F.lit("")).cast("int")


def date_of(value: Column) -> Column:
    """The date of a text: ISO at its beginning, or like "Mar 3, 2024" or "March 3, 2024"; null otherwise."""
    long = F.coalesce(F.try_to_date(value, "MMM d, yyyy"), F.try_to_date(value, "MMMM d, yyyy"))
    return F.coalesce(F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd"), long)
