"""Questions taken apart: one query for each drug class and condition of a case, one search for all of them, results fused by case."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.text import words
from evidra.operators.ranking import bm25, fuse_ranks, top_k

#: Names of classes, how a query writes them, and conditions that labs show (field, operator, bound, name).
CLASS_ALIASES = {
    "mra": "mra", "arni": "arni", "acei": "acei", "ace inhibitor": "acei", "arb": "arb", "beta blocker": "beta_blocker", "beta": "beta_blocker",
    "sglt2i": "sglt2i", "sglt2": "sglt2i", "sglt2 inhibitor": "sglt2i",
}
CLASS_LABELS = {
    "mra": "mineralocorticoid receptor antagonist", "arni": "ARNI sacubitril valsartan", "acei": "ACE inhibitor", "arb": "angiotensin receptor blocker",
    "beta_blocker": "beta blocker", "sglt2i": "SGLT2 inhibitor",
}
LAB_CONDITIONS = (("egfr", "<", 60.0, "renal impairment CKD"), ("potassium", ">=", 5.0, "hyperkalemia"), ("systolic_bp", "<", 100.0, "hypotension"), ("heart_rate", "<", 60.0, "bradycardia"))
LAB_WORDS = (("lvef", "LVEF ", "%"), ("egfr", "eGFR ", ""), ("potassium", "potassium ", ""), ("systolic_bp", "SBP ", ""), ("heart_rate", "HR ", ""))
CONDITION_WORDS = "heart failure management contraindications monitoring"
#: Terms of a class or condition that a query takes, and characters of the question.
MOST_TERMS, MOST_QUESTION = 6, 240


def _lookup(key: Column, values: dict[str, str], otherwise: Column) -> Column:
    return reduce(lambda now, kv: F.when(key == kv[0], kv[1]).otherwise(now), values.items(), otherwise)


def class_key(name: Column) -> Column:
    """The class that a name stands for: lower-case, dashes and underscores as spaces, by alias, else underscores. Empty for null."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[-_\s]+", " "))
    return _lookup(clean, CLASS_ALIASES, F.replace(clean, F.lit(" "), F.lit("_")))


def _joined(parts: list[Column]) -> Column:
    """Parts that aren't blank, with spaces between."""
    clean = F.transform(F.array(*[F.trim(F.coalesce(p, F.lit(""))) for p in parts]), lambda p: p)
    return F.array_join(F.filter(clean, lambda p: p != ""), " ")


def decomposed(cases: DataFrame, class_terms: dict[str, list[str]], condition_terms: dict[str, list[str]], most: int = 8, case: str = "case_id") -> DataFrame:
    """case, facet_no (from 1), kind (class, condition), facet, query: the queries of each case that is worth taking apart.

    cases: case, classes, medications (map of class to names) and conditions, question, hf_type, intent
    and the labs lvef, egfr, potassium, systolic_bp, heart_rate; all may be null. Classes come once, in
    order; conditions once, sorted, with those that labs show. A case has queries if it has two
    facets or more of which one kind is there twice or both are there; the first `most` different
    ones, in any case, stay.
    """
    none = F.array().cast("array<string>")
    classes = F.array_distinct(F.filter(F.transform(F.coalesce("classes", none), class_key), lambda c: c != ""))
    op = {"<": lambda a, b: a < b, ">=": lambda a, b: a >= b}
    shown = F.array(*[F.when(op[o](F.col(field), F.lit(bound)), F.lit(name)) for field, o, bound, name in LAB_CONDITIONS])
    conditions = F.array_sort(F.array_distinct(F.filter(F.concat(F.coalesce("conditions", none), shown), lambda c: F.coalesce(c, F.lit("")) != "")))
    labs = _joined([F.concat(F.lit(word), F.col(field).cast("string"), F.lit(unit)) for field, word, unit in LAB_WORDS])
    kind_of = F.coalesce(F.when(F.trim("hf_type") != "", F.col("hf_type")), F.lit("heart failure"))
    rows = cases.withColumn("found_classes", classes).withColumn("found_conditions", conditions)
    rows = rows.where(F.size("found_classes") + F.size("found_conditions") >= 2)

    def class_query(c: Column) -> Column:
        words = _lookup(c, {k: " ".join(v[:MOST_TERMS]) for k, v in class_terms.items()}, c)
        medicines = F.array_join(F.slice(F.array_sort(F.array_distinct(F.coalesce(F.try_element_at("medications", c), none))), F.lit(1), F.lit(3)), " ")
        label = _lookup(c, CLASS_LABELS, F.replace(c, F.lit("_"), F.lit(" ")))
        return _joined([kind_of, label, medicines, words, labs, F.col("intent"), F.substring(F.trim(F.coalesce("question", F.lit(""))), F.lit(1), F.lit(MOST_QUESTION))])

    def condition_query(c: Column) -> Column:
        words = reduce(lambda now, kv: F.when(F.lower(c).contains(kv[0]), " ".join(kv[1][:MOST_TERMS])).otherwise(now), reversed(condition_terms.items()), c)
        return _joined([kind_of, F.lit("comorbidity"), c, words, labs, F.lit(CONDITION_WORDS)])

    facet = lambda kind, query: lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("facet"), query(c).alias("query"))
    each = rows.select(F.col(case), F.posexplode(F.concat(F.transform("found_classes", facet("class", class_query)), F.transform("found_conditions", facet("condition", condition_query)))).alias("at", "f"))
    first = each.select(case, "at", "f.*").where("query <> ''").withColumn("again", F.row_number().over(Window.partitionBy(case, F.lower("query")).orderBy("at"))).where("again = 1")
    numbered = first.withColumn("facet_no", F.row_number().over(Window.partitionBy(case).orderBy("at")))
    return numbered.where(F.col("facet_no") <= most).select(case, "facet_no", "kind", "facet", "query")


def facet_search(queries: DataFrame, docs: DataFrame, k: int = 5, candidates: int = 10, case: str = "case_id", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """case, doc, rank, score, n_lists: documents of each case's queries, fused by rank.

    queries: case, facet_no, query. All queries of all cases are answered by one search, which reads the
    documents' words once, whatever the number of facets. Queries of the same words in any order and
    case are one query there. Ties go to the smaller document.
    """
    bag = F.array_join(F.array_sort(words(F.lower("query"))), " ")
    asked = queries.select(F.col(case), bag.alias("bag"))
    different = asked.select(F.col("bag").alias("query_id"), F.col("bag").alias(text)).distinct()
    found = bm25(docs, different, candidates, doc=doc, text=text).select(F.col("query_id").alias("bag"), doc, "rank")
    fused = fuse_ranks([asked.join(found, "bag")], doc, [case]).withColumn("score", F.round("score", 6))
    return top_k(fused, [F.desc("score"), F.asc(doc)], k, [case]).select(case, doc, "rank", "score", "n_lists")
