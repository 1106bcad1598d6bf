"""Claims, rules and their evidence: tiers, links to chunks, gold matches, refilled filters, conflicts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.text import collapsed, jaccard, lower_each, overlap, tokens

#: Actions that block or watch, and condition keys that a machine can evaluate.
HARD_ACTIONS = ("contraindicated", "avoid", "not_recommended")
MONITORING_ACTIONS = ("monitor", "titrate", "review", "dose_adjust", "reduce_dose")
STRUCTURED_KEYS = (
    "egfr", "potassium", "indication", "diabetes_type", "creatinine", "systolic_bp", "heart_rate", "lvef", "nyha_class", "age", "weight_kg",
    "pregnancy", "lactation", "allergy", "hfref", "decompensated_hf", "atrial_fibrillation", "inotropic_support", "anuria", "bleeding_risk",
    "ckd_stage", "hepatic_impairment", "bilateral_renal_artery_stenosis",
)
USES = {"usable_rules": "hard_rule", "needs_condition_refinement": "warning_only", "monitoring_rules": "monitoring_hint", "rejected_rules": "do_not_use"}


def rule_tiers(rules: DataFrame, condition: str = "condition", action: str = "action", drug: str = "drug") -> DataFrame:
    """rules, safety_tier and recommendation_use. condition is a map<string,string>; blank values don't count."""
    given = F.map_keys(F.map_filter(F.coalesce(F.col(condition), F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & ~v.isin("", "[]", "{}")))
    hard, named = F.col(action).isin(*HARD_ACTIONS), F.coalesce(F.col(drug), F.lit("")) != ""
    tier = (
        F.when(F.arrays_overlap(given, F.array(*map(F.lit, STRUCTURED_KEYS))), "usable_rules")
        .when(hard & named, "needs_condition_refinement")
        .when(F.size(given) > 0, "usable_rules")
        .when(F.col(action).isin(*MONITORING_ACTIONS) & named, "monitoring_rules")
        .when(hard, "needs_condition_refinement")
        .otherwise("rejected_rules")
    )
    use = F.lit(None).cast("string")
    for name, value in USES.items():
        use = F.when(F.col("safety_tier") == name, value).otherwise(use)
    return rules.withColumn("safety_tier", tier).withColumn("recommendation_use", use)


def linked_chunks(claims: DataFrame, chunks: DataFrame, claim: str = "claim_id", least: float = 0.55) -> DataFrame:
    """claim, chunk_id, score: each claim's best chunk of its document, if that scores at least 0.55.

    Score: 0.35 for the document, 0.2 for an equal section, 0.45 times the overlap of texts. As no
    chunk of another document can reach 0.66, and one without section and document only 0.45, the
    join is by document or section; ties go to the smaller chunk id. Claims without evidence have none.
    """
    c = claims.where(F.coalesce(F.trim("evidence"), F.lit("")) != "").select(F.col(claim).alias("c"), F.col("document_id").alias("cd"), F.col("source_section").alias("cs"), F.col("evidence").alias("e"))
    k = chunks.select("chunk_id", F.col("document_id").alias("kd"), F.col("section").alias("ks"), "text")
    by_document = c.join(k, F.col("cd") == F.col("kd"))
    by_section = c.join(k, (F.col("cs") == F.col("ks")) & ~F.coalesce(F.col("cd") == F.col("kd"), F.lit(False)))
    same = lambda a, b, value: F.when(F.coalesce(F.col(a) == F.col(b), F.lit(False)) & (F.col(a) != ""), value).otherwise(0.0)
    score = same("cd", "kd", 0.35) + same("cs", "ks", 0.2) + overlap(F.col("e"), F.col("text")) * 0.45
    scored = by_document.unionByName(by_section).select("c", "chunk_id", F.round(score, 9).alias("score"))
    best = scored.groupBy("c").agg(F.min_by(F.struct("chunk_id", "score"), F.struct(-F.col("score"), "chunk_id")).alias("b"))
    return best.where(F.col("b.score") >= least).select(F.col("c").alias(claim), "b.chunk_id", "b.score")


def _drug(c: Column) -> Column:
    return F.replace(F.lower(collapsed(c)), F.lit(" "), F.lit("_"))


def gold_matches(gold: DataFrame, predictions: DataFrame, least: float = 0.45) -> DataFrame:
    """gold_id, label, claim_id, score, matched: each gold row's best prediction of its document or drug.

    Score: Jaccard of tokens of over two characters, 0.08 for an equal type, 0.05 for compatible
    drugs. A positive gold row also needs type and drug to fit. claim_id is null under the least
    score. Ties go to the smaller claim_id. Both candidate joins are equi joins.
    """
    long = lambda c: F.filter(F.array_distinct(tokens(F.col(c))), lambda t: F.length(t) > 2)
    g = gold.select("gold_id", "label", F.col("claim_type").alias("gt"), F.col("document_id").alias("gd"), _drug(F.col("drug")).alias("gdrug"), long("evidence").alias("ge"))
    p = predictions.select("claim_id", F.col("claim_type").alias("pt"), F.col("document_id").alias("pd"), _drug(F.col("drug")).alias("pdrug"), long("evidence").alias("pe"))
    keys = g.select("*", F.explode(F.array_distinct(F.filter(F.array("gdrug", _drug(F.col("gd"))), lambda x: x != ""))).alias("k"))
    pairs = g.join(p, F.coalesce(g["gd"], F.lit("")) == F.coalesce(p["pd"], F.lit(""))).unionByName(keys.join(p, F.col("k") == F.col("pdrug")).drop("k"))
    fits_type = F.coalesce(F.col("gt") == F.col("pt"), F.lit(False)) & (F.col("gt") != "")
    drug_ok = (F.col("gdrug") == "") | ((F.col("pdrug") != "") & (F.col("gdrug").contains(F.col("pdrug")) | F.col("pdrug").contains(F.col("gdrug"))))
    alike = F.when((F.size("ge") == 0) | (F.size("pe") == 0), 0.0).otherwise(jaccard(F.col("ge"), F.col("pe")))
    score = F.round(alike + F.when(fits_type, 0.08).otherwise(0.0) + F.when(drug_ok, 0.05).otherwise(0.0), 9)
    ok = (F.col("gt").isNull() | (F.col("gt") == "") | fits_type) & drug_ok
    scored = pairs.select("gold_id", "claim_id", score.alias("score"), ok.alias("ok")).where("score > 0")
    best = scored.groupBy("gold_id").agg(F.min_by(F.struct("claim_id", "score", "ok"), F.struct(-F.col("score"), "claim_id")).alias("b"))
    near = F.coalesce(F.col("b.score") >= least, F.lit(False))
    matched = F.when(F.col("label") == "invalid_extraction", near).when(F.col("label").isin("valid_claim", "should_extract"), near & F.coalesce(F.col("b.ok"), F.lit(False))).otherwise(False)
    return g.join(best, "gold_id", "left").select("gold_id", "label", F.when(near, F.col("b.claim_id")).alias("claim_id"), F.coalesce("b.score", F.lit(0.0)).alias("score"), matched.alias("matched"))


def refilled_filter(chunks: DataFrame, query: str, passes: Column, quality: str, order: str, least: int = 2, k: int | None = None) -> DataFrame:
    """Rows that pass, and the best of the others where fewer than `least` do; at most k rows per query."""
    fine = F.coalesce(passes, F.lit(False))
    w = Window.partitionBy(query).orderBy(F.desc("_fine"), F.when(F.col("_fine"), F.col(order)), F.desc(quality), F.col(order))
    ranked = chunks.withColumn("_fine", fine).withColumn("place", F.row_number().over(w))
    need = min(least, k) if k is not None else least
    kept = ranked.where(F.col("_fine") | (F.col("place") <= need))
    return (kept.where(F.col("place") <= k) if k is not None else kept).drop("_fine")


def draft_conflicts(draft: DataFrame, incoming: DataFrame, key: str, columns: list[str], numeric: dict[str, float] | None = None, shown: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """key, field, old, new where both sides have a value and these differ; numeric fields by at least their step.

    Values themselves are compared; old and new are what `shown` makes of them, where it names the field.
    """
    both = draft.select(key, F.struct(*columns).alias("l")).join(incoming.select(key, F.struct(*columns).alias("r")), key)

    def differs(c: str) -> Column:
        a, b = F.col(f"l.{c}"), F.col(f"r.{c}")
        return F.abs(a - b) >= numeric[c] if c in (numeric or {}) else a != b

    text = lambda side, c: (shown or {}).get(c, lambda x: x)(F.col(f"{side}.{c}")).cast("string")
    rows = [F.when(differs(c), F.struct(F.lit(c).alias("field"), text("l", c).alias("old"), text("r", c).alias("new"))) for c in columns]
    return both.select(key, F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("d")).select(key, "d.*")


def consensus(passes: list[DataFrame], order: str, text: str = "evidence", prefix: int = 100) -> DataFrame:
    """Rows of several passes, the first pass first, without those that repeat a text's first characters.

    That length is the operator's definition of an equal claim, not a limit on what is read. Case
    is mapped character by character, so that it moves none over that length.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("_pass", F.lit(n)) for n, p in enumerate(passes)])
    key = lower_each(F.substring(text, 1, prefix))
    first = rows.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*[c for c in rows.columns if c != "_pass"]), F.struct("_pass", order)).alias("r"))
    return first.select("r.*")


def citation_status(items: DataFrame, item: str, levels: str) -> DataFrame:
    """item, status: missing if any part is missing, else weak if any is weak, else strong."""
    worst = F.max(F.when(F.col(levels) == "missing", 2).when(F.col(levels) == "weak", 1).otherwise(0)).alias("w")
    status = F.when(F.col("w") == 2, "missing").when(F.col("w") == 1, "weak").otherwise("strong")
    return items.groupBy(item).agg(worst).select(item, status.alias("status"))


def medication_state(patients: DataFrame, drugs: list[str], medications: str = "current_medications") -> Column:
    """Whether a patient takes one of the drugs: a name that equals, holds or is held by one of them."""
    names = F.transform(F.coalesce(F.col(medications), F.array().cast("array<string>")), _drug)
    keys = F.array(*[_drug(F.lit(d)) for d in drugs])
    return F.exists(names, lambda m: F.exists(keys, lambda k: m.contains(k) | k.contains(m)))
