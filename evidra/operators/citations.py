"""Citations: which chunks support an item, by its terms, through an inverted index; paths of headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.operators.mentions import dictionary_spans
from evidra.operators.ranking import top_k

#: Weight of a term from an evidence reference, and points for a kind of source.
REFERENCE, BONUS = 0.75, {"guideline": 3, "drug_label": 2}


def tokens(text: Column, least: int = 3) -> Column:
    """Lower-case runs of a to z, digits and + of at least so many characters, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9+]+"), lambda t: F.length(t) >= least)


def term_hits(chunks: DataFrame, terms: DataFrame, chunk: str = "chunk_id", text: str = "text") -> DataFrame:
    """chunk, term: every listed term that a chunk's text holds, once. terms: term, lower-case.

    A term with a space counts wherever it stands, any other only between characters that aren't a to z
    or digits. Single terms are joined with the text's words, so a text is cut once; terms with a
    space or a sign are looked up by one automaton.
    """
    listed = terms.select("term").where("trim(term) <> ''").distinct()
    single = F.col("term").rlike("^[a-z0-9]+$")
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"))
    plain = chunks.select(F.col(chunk).alias("chunk"), F.explode(words).alias("term")).join(listed.where(single), "term").select("chunk", "term")
    phrases = listed.where(~single).withColumn("kind", F.lit(""))
    lowered = chunks.select(F.col(chunk).alias("chunk"), F.lower(F.coalesce(text, F.lit(""))).alias("whole"))
    spans = dictionary_spans(lowered, phrases, "whole", overlapping=True, whole_words=False)
    each = lowered.select("chunk", "whole", F.inline(spans))
    side = lambda at: F.substring("whole", at, F.lit(1)).rlike("^[a-z0-9]$")
    bordered = ~F.when(F.col("start") > 0, side(F.col("start"))).otherwise(False) & ~side(F.col("end") + 1)
    found = each.where(F.col("term").contains(" ") | bordered).select("chunk", "term").distinct()
    return plain.unionByName(found).withColumnRenamed("chunk", chunk)


def cited_chunks(items: DataFrame, chunks: DataFrame, k: int = 3, item: str = "item_id", chunk: str = "chunk_id", text: str = "text", source: str = "source_type", quality: str = "quality", own_score: str = "score") -> DataFrame:
    """item, chunk, rank, match_score, matched of each item's k best chunks.

    items: item, required and refs (arrays of terms; refs are cut into tokens). match_score is the number
    of different required terms, REFERENCE times the number of different reference terms, the
    source's BONUS and the chunk's quality. Chunks without any term aren't looked at: items meet
    chunks by shared terms only. Ties go to the chunk's own score, then to the smaller chunk.
    """
    required = items.select(F.col(item).alias("i"), F.explode(F.array_distinct(F.transform("required", F.lower))).alias("term"), F.lit(1.0).alias("w"), F.lit(True).alias("named"))
    references = items.select(F.col(item).alias("i"), F.explode(F.array_distinct(F.flatten(F.transform("refs", lambda r: tokens(F.replace(r, F.lit("_"), F.lit(" "))))))).alias("term"), F.lit(REFERENCE).alias("w"), F.lit(False).alias("named"))
    asked = required.unionAll(references).groupBy("i", "term").agg(F.sum("w").alias("w"), F.max("named").alias("named"))
    hits = term_hits(chunks, asked, chunk, text).withColumnRenamed(chunk, "c")
    met = hits.join(asked, "term").groupBy("i", "c").agg(F.sum("w").alias("points"), F.array_sort(F.collect_list(F.when(F.col("named"), F.col("term")))).alias("matched"))
    bonus = F.lit(0)
    for kind, points in BONUS.items():
        bonus = F.when(F.col(source) == kind, points).otherwise(bonus)
    about = chunks.select(F.col(chunk).alias("c"), bonus.alias("bonus"), F.coalesce(quality, F.lit(0.0)).alias("q"), F.col(own_score).alias("own"))
    scored = met.join(about, "c").withColumn("match_score", F.col("points") + F.col("bonus") + F.col("q"))
    best = top_k(scored, [F.desc("match_score"), F.desc_nulls_last("own"), F.asc("c")], k, ["i"])
    return best.select(F.col("i").alias(item), F.col("c").alias(chunk), "rank", "match_score", "matched")


def title_hierarchy(title: Column) -> Column:
    """struct(root, parent, depth, full_path, is_nested) of a title whose levels are parted by slashes."""
    parts = F.transform(F.split(F.coalesce(title, F.lit("")), "/"), lambda p: F.trim(p))
    return F.struct(F.get(parts, F.lit(0)).alias("root"), F.get(parts, F.lit(1)).alias("parent"), (F.size(parts) - 1).alias("depth"), F.array_join(parts, " > ").alias("full_path"), (F.size(parts) > 1).alias("is_nested"))


def heading_paths(headings: DataFrame, doc: str = "page_id", place: str = "place", level: str = "level", title: str = "title", deepest: int = 6) -> DataFrame:
    """headings with path: the titles of the headings that a heading stands under, and its own.

    A heading stands under the last heading before it of each smaller level, unless a heading of a
    still smaller level came in between. Levels may be skipped. One window over a document's
    headings, whatever the depth.
    """
    w = Window.partitionBy(doc).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    at = [F.last(F.when(F.col(level) == n, F.col(place)), True).over(w) for n in range(1, deepest + 1)]
    text = [F.last(F.when(F.col(level) == n, F.coalesce(title, F.lit(""))), True).over(w) for n in range(1, deepest + 1)]
    last = F.struct(*[a.alias(f"at{n}") for n, a in enumerate(at, 1)], *[t.alias(f"title{n}") for n, t in enumerate(text, 1)])
    seen = headings.withColumn("seen_headings", last)
    steps = []
    for n in range(1, deepest + 1):
        own, over = F.col(f"seen_headings.at{n}"), [F.col(f"seen_headings.at{m}") for m in range(1, n)]
        behind = F.lit(True) if not over else (own > over[0] if len(over) == 1 else own > F.greatest(*over))
        steps.append(F.when((F.col(level) >= n) & own.isNotNull() & F.coalesce(behind, F.lit(True)), F.col(f"seen_headings.title{n}")))
    return seen.withColumn("path", F.array_compact(F.array(*steps))).drop("seen_headings")
