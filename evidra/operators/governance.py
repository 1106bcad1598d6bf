"""Versioned catalogs: filters, facets, status counts, latest versions, synchronisation, diffs, merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("draft", "approved", "retired")


def matching(df: DataFrame, equal: dict | None = None, contains: dict | None = None, not_true: str | None = None) -> DataFrame:
    """Rows that pass all given filters; a filter whose value is None isn't one.

    contains ignores case and takes its value as plain text; not_true keeps null and anything but true.
    """
    tests = [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    tests += [F.lower(c).contains(v.lower()) for c, v in (contains or {}).items() if v is not None]
    if not_true:
        tests.append(~F.col(not_true).eqNullSafe(F.lit(True)))
    return df.where(reduce(Column.__and__, tests)) if tests else df


def page(df: DataFrame, by: list[Column], limit: int, offset: int = 0, most: int = 200) -> DataFrame:
    """One page in that order; the limit is kept between 1 and most."""
    return df.orderBy(*by).offset(max(0, offset)).limit(min(max(1, limit), most))


def status_counts(df: DataFrame, status: str = "status", known=STATUSES, rest: str = "draft") -> DataFrame:
    """One row with the number of rows of each known status and their total; other statuses count as rest."""
    s = F.when(F.col(status).isin(*known), F.col(status)).otherwise(rest)
    return df.agg(*[F.count_if(s == k).alias(k) for k in known], F.count(F.lit(1)).alias("total"))


def facets(df: DataFrame, fields: list[str], chosen: dict) -> DataFrame:
    """field, value, n: the values that each field has under all filters but its own, blank ones left out.

    One pass: each row goes to the fields whose other filters it passes.
    """
    passes = {f: F.coalesce(F.col(f) == v, F.lit(False)) for f, v in chosen.items() if v is not None}

    def offered(field: str) -> Column:
        others = [t for f, t in passes.items() if f != field]
        ok = reduce(Column.__and__, others, F.lit(True))
        return F.when(ok & (F.trim(F.col(field).cast("string")) != ""), F.struct(F.lit(field).alias("field"), F.col(field).cast("string").alias("value")))

    offers = F.filter(F.array(*map(offered, fields)), lambda o: o.isNotNull())
    return df.select(F.explode(offers).alias("o")).groupBy("o.field", "o.value").agg(F.count(F.lit(1)).alias("n"))


def latest(df: DataFrame, key: str, version: str, columns: list[str]) -> DataFrame:
    """The row of the highest version per key: a partial aggregate instead of a sort."""
    row = F.max_by(F.struct(*columns), F.col(version)).alias("r")
    return df.groupBy(key).agg(F.max(version).alias(version), row).select(key, version, "r.*")


def content_hash(columns: list[str]) -> Column:
    """SHA-256 over columns as text; null and empty differ, the order of columns counts."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def sync(current: DataFrame, incoming: DataFrame, key: str, columns: list[str], version: str = "version") -> DataFrame:
    """key, outcome, version: what loading incoming rows does to a versioned catalog.

    inserted (version 1), updated (latest version + 1, a draft) or unchanged, by content hash.
    current: latest versions. Keys that aren't incoming have no row.
    """
    old = current.select(key, F.col(version).alias("_v"), content_hash(columns).alias("_old"))
    new = incoming.select(key, content_hash(columns).alias("_new"))
    outcome = F.when(F.col("_old").isNull(), "inserted").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("updated")
    next_version = F.when(outcome == "inserted", 1).when(outcome == "updated", F.col("_v") + 1).otherwise(F.col("_v"))
    return new.join(old, key, "left").select(key, outcome.alias("outcome"), next_version.cast("long").alias(version))


def approve(versions: DataFrame, chosen: DataFrame, key: str, version: str = "version", status: str = "status") -> DataFrame:
    """versions after the chosen drafts (key, version) are approved: other approved ones of the key are retired."""
    wanted = chosen.select(key, F.col(version).alias("_chosen"))
    rows = versions.join(wanted, key, "left")
    hit = F.col("_chosen").isNotNull()
    new = F.when(hit & (F.col(version) == F.col("_chosen")) & (F.col(status) == "draft"), "approved").when(hit & (F.col(version) != F.col("_chosen")) & (F.col(status) == "approved"), "retired").otherwise(F.col(status))
    return rows.withColumn(status, new).drop("_chosen")


def field_diff(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, field, change (added, removed, modified), old, new of every field that differs."""
    packed = lambda df, into: df.select(key, F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias(into))
    both = packed(left, "l").join(packed(right, "r"), key, "full")
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"l.{c}").alias("old"), F.col(f"r.{c}").alias("new")) for c in columns])
    each = both.select(key, F.inline(fields)).where(~F.col("old").eqNullSafe(F.col("new")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified")
    return each.select(key, "field", change.alias("change"), "old", "new")


def primary_wins(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """All primary rows, and secondary rows whose key the primary doesn't have."""
    return primary.unionByName(secondary.join(primary.select(key), key, "left_anti"))


def agreement(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: n_both, n_left, n_right and the share of both in all distinct keys."""
    sides = left.select(key, F.lit(1).alias("s")).unionAll(right.select(key, F.lit(2).alias("s")))
    masks = sides.groupBy(key).agg(F.bit_or("s").alias("m"))
    out = masks.agg(F.count_if(F.col("m") == 3).alias("n_both"), F.count_if(F.col("m") == 1).alias("n_left"), F.count_if(F.col("m") == 2).alias("n_right"))
    total = F.col("n_both") + F.col("n_left") + F.col("n_right")
    return out.withColumn("rate", F.when(total > 0, F.col("n_both") / total).otherwise(0.0))


def merged_lists(df: DataFrame, key: str, order: str, element: str, into: str) -> DataFrame:
    """key, array of distinct elements in first-seen order."""
    first = df.where(F.col(element).isNotNull()).groupBy(key, element).agg(F.min(order).alias("_o"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", element))), lambda x: x[element]).alias(into))


def unknown_references(rows: DataFrame, known: DataFrame, column: str, key: str, exempt_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """rows whose reference isn't a known key, but for references with an exempt prefix."""
    checked = rows
    for p in exempt_prefixes:
        checked = checked.where(~F.col(column).cast("string").startswith(p) | F.col(column).isNull())
    return checked.join(known.select(F.col(key).alias(column)), column, "left_anti")


def with_fallback_keys(rows: DataFrame, known: DataFrame, row: str, candidates: list[Column], key: str, value: str) -> DataFrame:
    """row and the value of the first candidate key, in the given order, that is known; rows without one are left out."""
    tried = rows.select(row, F.posexplode(F.array(*candidates)).alias("place", key)).where(F.col(key).isNotNull())
    return tried.join(known.select(key, value), key).groupBy(row).agg(F.min_by(value, F.col("place")).alias(value))
