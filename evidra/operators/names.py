"""Names as people write them, resolved to a catalog: exact alias, contained alias, most similar alias, else a slug.

Every step is an equi join. Similarity is the matching-blocks ratio 2 M / T of the standard library's
difflib, M the characters in matching blocks and T both lengths. Blocks that follow each other have an
unmatched character between them, so there are at most T - 2 M + 1 of them, and both names share at
least M - (T - 2 M + 1) pairs of letters. At a ratio of 0.75 that is T / 8 - 1 or more: names of T over 8
share a pair, and counting shared pairs loses none. Shorter names are joined by single letters. Only
what passes these counts is compared.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least ratio of a similar name, and least lengths of aliases that may be contained and similar.
RATIO, LEAST_CONTAINED, LEAST_SIMILAR = 0.75, 4, 3
#: Up to so many characters of both names together no pair of letters need be shared.
SHORT = 8
#: Marks single letters; no name has it.
ONE = "#"


def normal_name(name: Column) -> Column:
    """Lower-case letters a to z, digits and +; anything else is one space. Empty for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9+]+", " "))


def alias_index(catalog: DataFrame, alias: str = "alias", drug: str = "drug_id", place: str = "place") -> DataFrame:
    """alias, drug_id, place: an alias that comes again takes the later drug and keeps its first place. Blank aliases go."""
    rows = catalog.select(normal_name(F.col(alias)).alias("alias"), F.col(drug).alias("drug_id"), F.col(place).cast("long").alias("place"))
    return rows.where("alias <> ''").groupBy("alias").agg(F.max_by("drug_id", "place").alias("drug_id"), F.min("place").alias("place"))


def _words(name: Column) -> Column:
    return F.filter(F.split(name, "[^a-z0-9]+"), lambda w: w != "")


def _numbered(parts: Column) -> Column:
    """Each part with how many equal ones are before it, so that shared parts count as often as both have them."""
    before = lambda x, i: F.size(F.filter(F.slice(parts, F.lit(1), i), lambda y: y == x))
    return F.transform(parts, lambda x, i: F.concat_ws("|", x, before(x, i)))


def letters(name: Column) -> Column:
    return _numbered(F.filter(F.split(name, ""), lambda c: c != ""))


def letter_pairs(name: Column) -> Column:
    n = F.length(name)
    return _numbered(F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.substring(name, k, F.lit(2)))).otherwise(F.array().cast("array<string>")))


@F.pandas_udf(T.DoubleType())
def block_ratio(name: pd.Series, alias: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(name, alias)], dtype="float64")


def contained(names: DataFrame, aliases: DataFrame, least: int = LEAST_CONTAINED) -> DataFrame:
    """name, drug_id: the first alias in the catalog's order that stands in the name as whole words.

    A word of the alias is a word of the name, so both are joined by the alias's longest word.
    """
    longest = F.array_max(F.transform(_words(F.col("alias")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))).w
    keyed = aliases.where(F.length("alias") >= least).select(longest.alias("word"), "alias", "drug_id", "place").where("word IS NOT NULL")
    inside = F.concat(F.lit("(?<![a-z0-9])"), F.replace("alias", F.lit("+"), F.lit("[+]")), F.lit("(?![a-z0-9])"))
    found = names.select("name", F.explode(F.array_distinct(_words(F.col("name")))).alias("word")).join(keyed, "word").where(F.regexp_like("name", inside))
    return found.groupBy("name").agg(F.min_by("drug_id", "place").alias("drug_id"))


def candidates(names: DataFrame, aliases: DataFrame, ratio: float = RATIO) -> DataFrame:
    """name, alias, drug_id, place: every pair whose ratio can reach `ratio`, at least 0.75, and few others."""
    if ratio < RATIO:
        raise ValueError("the count of shared pairs holds for ratios of 0.75 or more")
    longest = aliases.agg(F.max(F.length("alias"))).first()[0] or 0
    part = lambda c: F.concat(letter_pairs(c), F.when(F.length(c) < SHORT, F.transform(letters(c), lambda x: F.concat(F.lit(ONE), x))).otherwise(F.array().cast("array<string>")))
    # The shorter name has at least ratio / (2 - ratio) of the longer's length.
    shape = ratio / (2 - ratio)
    left = names.where(F.length("name") * shape <= longest).select("name", F.explode(part(F.col("name"))).alias("part"))
    right = aliases.where(F.length("alias") >= LEAST_SIMILAR).select("alias", "drug_id", "place", F.explode(part(F.col("alias"))).alias("part"))
    pair_of = left.join(right, "part").where(F.least(F.length("name"), F.length("alias")) >= shape * F.greatest(F.length("name"), F.length("alias")) - 1e-9)
    one = F.col("part").startswith(ONE)
    n = pair_of.groupBy("name", "alias", "drug_id", "place").agg(F.count_if(~one).alias("pairs"), F.count_if(one).alias("single"))
    total = F.length("name") + F.length("alias")
    enough = F.when(total > SHORT, F.col("pairs") >= F.ceil(total / 8 - 1)).otherwise(F.col("single") >= F.ceil(total * ratio / 2))
    # Matching blocks have no more letters than both names share.
    shared = F.size(F.array_intersect(letters(F.col("name")), letters(F.col("alias"))))
    return n.where(enough).where(2 * shared >= ratio * total - 1e-9).select("name", "alias", "drug_id", "place")


def similar(names: DataFrame, aliases: DataFrame, ratio: float = RATIO) -> DataFrame:
    """name, drug_id, score of the alias with the greatest ratio, the first in the catalog's order of equal ones."""
    scored = candidates(names, aliases, ratio).withColumn("score", block_ratio("name", "alias")).where(F.col("score") >= ratio)
    best = scored.groupBy("name").agg(F.max(F.struct("score", (-F.col("place")).alias("turned"), "drug_id")).alias("best"))
    return best.select("name", "best.drug_id", "best.score")


def resolve(mentions: DataFrame, catalog: DataFrame, mention: str = "mention", ratio: float = RATIO) -> DataFrame:
    """mentions with drug_id, way (exact, contained, similar, slug) and score.

    Null and blank mentions have null in all three. Repeated mentions are resolved once; an empty
    catalog leaves slugs, underscores for spaces.
    """
    aliases = alias_index(catalog)
    names = mentions.select(normal_name(F.col(mention)).alias("name")).where("name <> ''").distinct()
    exact = names.join(aliases.select(F.col("alias").alias("name"), "drug_id"), "name").select("name", "drug_id", F.lit(1.0).alias("score"), F.lit("exact").alias("way"))
    rest = names.join(exact, "name", "left_anti")
    whole = contained(rest, aliases).select("name", "drug_id", F.lit(1.0).alias("score"), F.lit("contained").alias("way"))
    near = similar(rest.join(whole, "name", "left_anti"), aliases, ratio).withColumn("way", F.lit("similar"))
    found = exact.unionByName(whole).unionByName(near)
    joined = mentions.withColumn("name", normal_name(F.col(mention))).join(found, "name", "left")
    slug = F.when(F.col("name") != "", F.replace("name", F.lit(" "), F.lit("_")))
    way = F.coalesce("way", F.when(F.col("name") != "", F.lit("slug")))
    return joined.select(*mentions.columns, F.coalesce("drug_id", slug).alias("drug_id"), way.alias("way"), F.when(way == "slug", 0.0).otherwise(F.col("score")).alias("score"))
