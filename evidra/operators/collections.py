"""Sets of rows: concatenation, memberships, histories, registries, scopes, best candidates, bulk approval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.operators.ranking import top_k


def concatenated(sources: dict[str, DataFrame], into: str = "origin") -> DataFrame:
    """All rows of differing sources, with the source's name; columns that a source lacks are null there."""
    named = [df.withColumn(into, F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def membership(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side: whether each distinct key is in both sets or in `left` or `right` only; one aggregate."""
    both = left.select(key, F.lit(1).alias("_side")).unionByName(right.select(key, F.lit(2).alias("_side")))
    side = F.bit_or("_side")
    return both.groupBy(key).agg(F.when(side == 3, "both").when(side == 1, "left").otherwise("right").alias("side"))


def history(rows: DataFrame, keys: list[str], order: list[str], into: str = "version_no") -> DataFrame:
    """rows with the number of each version of its key, from 1 in that order."""
    return rows.withColumn(into, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def registry(rows: DataFrame, fields: list[str]) -> DataFrame:
    """field, value, n: how many rows have each value of each field, blanks as unknown, in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("unknown")).alias("value")) for c in fields]))
    return rows.select(each.alias("r")).groupBy("r.field", "r.value").agg(F.count(F.lit(1)).alias("n"))


def counts_per_class(rows: DataFrame, classes: DataFrame, key: str, name: str) -> DataFrame:
    """name, n: rows of each class (classes: key, name), zero where it has none. Rows are counted by key before the join."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return classes.select(key, name).join(counted, key, "left").groupBy(name).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def scope_of_top(rows: DataFrame, per: list[str], by: list[Column], k: int, ids: str, into: str) -> DataFrame:
    """per, into: the sorted distinct ids of each group's k first rows."""
    return top_k(rows, by, k, per).groupBy(*per).agg(F.array_sort(F.collect_set(ids)).alias(into))


def best_candidate(rows: DataFrame, per: list[str], title: str, required: list[str], excluded: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Per group the last row in `order` whose title has all required terms and none of the excluded, in any case."""
    low = F.lower(F.coalesce(F.col(title), F.lit("")))
    fits = reduce(Column.__and__, [low.contains(t.lower()) for t in required] + [~low.contains(t.lower()) for t in excluded], F.lit(True))
    return rows.where(fits).groupBy(*per).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select(*per, "r.*")


def one_key_per_class(rows: DataFrame, name: str, key: str, order: str, current: str) -> DataFrame:
    """name, key: the last key that is a current one, else the first."""
    now = F.coalesce(F.col(current), F.lit(False))
    last, first = F.max_by(key, F.when(now, F.col(order))), F.min_by(key, order)
    return rows.groupBy(name).agg(F.coalesce(last, first).alias(key))


def bulk_approved(rows: DataFrame, fits: Column, order: str, status: str = "status", size: int = 200, ranges: int = 64) -> DataFrame:
    """The drafts that fit, approved, with the number of their batch of `size` rows in order of a numeric, distinct column.

    Rows are numbered inside ranges between quantiles, and the ranges' counts say where each
    begins, so no task numbers all rows.
    """
    drafts = rows.where(fits & (F.col(status) == "draft"))
    ends = sorted(set(drafts.approxQuantile(order, [k / ranges for k in range(1, ranges)], 0.005)))
    part = F.size(F.filter(F.array(*map(F.lit, ends)).cast("array<double>"), lambda e: e < F.col(order)))
    placed = drafts.withColumn("_part", part).withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    counts = drafts.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_count"))
    # One row per range.
    before = counts.withColumn("_before", F.coalesce(F.sum("_count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = placed.join(F.broadcast(before.select("_part", "_before")), "_part")
    return joined.withColumn(status, F.lit("approved")).withColumn("batch", F.floor((F.col("_before") + F.col("_n") - 1) / size).cast("int")).drop("_part", "_n", "_before")


def any_of(rows: DataFrame, column: str, values: list, texts: list[str], pattern: str | None) -> DataFrame:
    """rows whose column is one of the values (all, if there are none) and one of whose text columns contains the pattern, in any case."""
    test = F.col(column).isin(*values) if values else F.lit(True)
    if pattern:
        test = test & reduce(Column.__or__, [F.coalesce(F.lower(F.col(t).cast("string")).contains(pattern.lower()), F.lit(False)) for t in texts])
    return rows.where(test)


def sections_with(rows: DataFrame, title: str, text: str, aliases: dict[str, list[str]], terms: list[str]) -> DataFrame:
    """rows with section: the first name one of whose aliases is in the title, else `other` where a term is in the text; no other rows."""
    low, body = F.lower(F.coalesce(F.col(title), F.lit(""))), F.lower(F.coalesce(F.col(text), F.lit("")))
    found = F.when(reduce(Column.__or__, [body.contains(t.lower()) for t in terms], F.lit(False)), "other")
    for name, other in reversed(aliases.items()):
        found = F.when(reduce(Column.__or__, [low.contains(a.lower()) for a in other]), name).otherwise(found)
    return rows.withColumn("section", found).where("section is not null")
