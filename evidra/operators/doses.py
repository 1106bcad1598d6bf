"""Doses and pathways: rules that count criteria with unknown inputs, doses by a ladder of rules, ordered classes with lab gates.

Unknown inputs make a third truth value. A rule that needs so many criteria has a least count, of the
met ones, and a greatest, of the met and the unknown ones; it is met, not met or open by those.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The order of classes in a pathway.
PATHWAY_ORDER = ("loop_diuretic", "acei_arb", "arni", "acei", "arb", "beta_blocker", "mra", "sglt2i", "raas")
#: Classes that have a step in a pathway; others are only counted in its order.
CANONICAL = ("mra", "arni", "acei", "arb", "acei_arb", "beta_blocker", "sglt2i", "raas")
#: Lab gates by class: field, operator and bound. A gate without operator only asks for monitoring.
_RAAS = (("systolic_bp", ">=", 100.0), ("potassium", "<=", 5.5), ("egfr", ">=", 20.0))
LAB_GATES = {
    "acei_arb": _RAAS, "arni": _RAAS, "acei": _RAAS, "arb": _RAAS, "raas": _RAAS,
    "beta_blocker": (("heart_rate", ">=", 55.0), ("systolic_bp", ">=", 95.0)), "mra": (("potassium", "<=", 5.0), ("egfr", ">=", 30.0)),
    "sglt2i": (("egfr", ">=", 20.0),), "loop_diuretic": (("potassium", None, None),),
}


def compared(value: Column, op: Column, bound: Column) -> Column:
    """Whether value op bound holds; null for an unknown value, false for an unknown operator."""
    tests = {">=": value >= bound, ">": value > bound, "<=": value <= bound, "<": value < bound, "==": value == bound}
    known = reduce(lambda now, kv: now.when(op == kv[0], kv[1]), tests.items(), F.when(F.lit(False), F.lit(False))).otherwise(False)
    return F.when(value.isNotNull(), known)


def counted_rules(patients: DataFrame, rules: DataFrame, patient: str = "patient_id", drug: str = "drug", values: str = "values", least: int = 2) -> DataFrame:
    """patient, drug, rule_id, state, n_met, n_unknown, met, missing for each patient's rules of their drug.

    patients: patient, drug, values (map of fields to doubles); rules: rule_id, drug, place, min_matched
    (null: `least`), criteria (array of field, op, value). Criteria without field or value don't
    count, a null op is >=. state: met (n_met reaches min_matched), open (it could with the unknown
    fields), not_met. met has labels in the criteria's order, missing the unknown fields of open rules.
    """
    joined = patients.select(F.col(patient), F.col(drug).alias("of_drug"), F.col(values).alias("inputs")).join(rules.withColumnRenamed(drug, "rule_drug"), F.col("of_drug") == F.col("rule_drug"))

    def judge(c: Column) -> Column:
        op = F.coalesce(c["op"], F.lit(">="))
        met = compared(F.try_element_at("inputs", c["field"]), op, c["value"])
        return F.struct(c["field"].alias("field"), F.concat_ws(" ", c["field"], op, c["value"].cast("string")).alias("label"), met.alias("met"))

    judged = joined.withColumn("judged", F.transform(F.filter("criteria", lambda c: c["field"].isNotNull() & c["value"].isNotNull()), judge))
    met, unknown = F.filter("judged", lambda c: c["met"]), F.filter("judged", lambda c: c["met"].isNull())
    need = F.coalesce("min_matched", F.lit(least))
    out = judged.withColumn("n_met", F.size(met)).withColumn("n_unknown", F.size(unknown)).withColumn("need", need)
    state = F.when(F.col("n_met") >= F.col("need"), "met").when((F.col("n_unknown") > 0) & (F.col("n_met") + F.col("n_unknown") >= F.col("need")), "open").otherwise("not_met")
    fields = lambda which, of: F.transform(which, lambda c: c[of])
    missing = F.when(F.col("state") == "open", F.array_distinct(fields(unknown, "field"))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("state", state).select(patient, F.col("of_drug").alias(drug), "rule_id", "place", "state", "n_met", "n_unknown", fields(met, "label").alias("met"), missing.alias("missing"))


def first_met(counted: DataFrame, patient: str = "patient_id", drug: str = "drug") -> DataFrame:
    """patient, drug, rule_id, met, missing: the first met rule in the rules' order; without one, what is missing for the open ones.

    Missing fields come in the order of rules, each once. A rule that stands behind the met one is not looked at.
    """
    ranked = counted.groupBy(patient, drug).agg(
        F.min_by(F.struct("rule_id", "met"), F.when(F.col("state") == "met", F.col("place"))).alias("hit"),
        F.array_sort(F.collect_list(F.struct("place", "state", "missing"))).alias("all"),
    )
    missing = F.array_distinct(F.flatten(F.transform("all", lambda r: r["missing"])))
    none = F.array().cast("array<string>")
    return ranked.select(patient, drug, "hit.rule_id", F.coalesce("hit.met", none).alias("met"), F.when(F.col("hit.rule_id").isNull(), missing).otherwise(none).alias("missing"))


def resolved_dose(starting: Column, per_kg: Column, weight: Column, renal: Column, rule_met: Column, reduced: Column, hold: Column) -> Column:
    """struct(dose, source) of the first that gives one: hold (no dose), a met rule's reduced dose, the renal bracket's, the weight's, the starting dose."""
    by_weight = F.round(per_kg * weight, 2)
    none = F.lit(None).cast("double")
    rungs = [
        (F.coalesce(hold, F.lit(False)), none, "hold"), (F.coalesce(rule_met, F.lit(False)) & reduced.isNotNull(), reduced, "criteria"), (renal.isNotNull(), renal, "renal"),
        (by_weight.isNotNull(), by_weight, "weight"), (starting.isNotNull(), starting, "starting"),
    ]
    return reduce(lambda now, r: F.when(r[0], F.struct(r[1].alias("dose"), F.lit(r[2]).alias("source"))).otherwise(now), reversed(rungs), F.struct(none.alias("dose"), F.lit("unknown").alias("source")))


def lab_gates(class_id: Column, values: dict[str, Column]) -> Column:
    """Gates of a class, array<struct<lab, requirement, passed>>; passed is null for an unknown value and for monitoring only."""
    kind = "array<struct<lab:string,requirement:string,passed:boolean>>"

    def gate(field: str, op: str | None, bound: float | None) -> Column:
        passed = F.lit(None).cast("boolean") if op is None else compared(values[field], F.lit(op), F.lit(bound))
        return F.struct(F.lit(field).alias("lab"), F.lit("monitor" if op is None else f"{op} {bound:g}").alias("requirement"), passed.alias("passed"))

    cases = reduce(lambda now, kv: now.when(class_id == kv[0], F.array(*[gate(*g) for g in kv[1]]).cast(kind)), LAB_GATES.items(), F.when(F.lit(False), F.array().cast(kind)))
    return cases.otherwise(F.array().cast(kind))


def gates_pass(gates: Column) -> Column:
    """No gate has failed; unknown ones don't fail."""
    return ~F.coalesce(F.exists(gates, lambda g: ~g["passed"]), F.lit(False))


def pathway_order(recommendations: DataFrame, patient: str = "patient_id", known: tuple[str, ...] = PATHWAY_ORDER) -> DataFrame:
    """recommendations with step and superseded: a patient's classes in the fixed order; a class that another one replaces comes behind all others, with the reason.

    acei and arb are superseded where acei_arb is recommended, acei_arb where arni is to be considered.
    A class that comes twice counts once, with its last row by `place`; superseded classes come in the
    order of their first rows. Unknown classes and null ones go.
    """
    w = Window.partitionBy(patient)
    each = Window.partitionBy(patient, "class_id")
    last = recommendations.where(F.col("class_id").isin(*known)).withColumn("newest", F.row_number().over(each.orderBy(F.desc("place")))).withColumn("first_place", F.min("place").over(each))
    last = last.where("newest = 1").drop("newest")
    has = lambda test: F.max(F.coalesce(test, F.lit(False))).over(w)
    both = has(F.col("class_id") == "acei_arb")
    arni = has((F.col("class_id") == "arni") & F.col("status").isin("consider", "consider_with_caution"))
    superseded = F.when(F.col("class_id").isin("acei", "arb") & both, "acei_arb is recommended").when((F.col("class_id") == "acei_arb") & arni, "arni is considered")
    marked = last.withColumn("superseded", superseded)
    place = F.when(F.col("superseded").isNull(), F.array_position(F.array(*map(F.lit, known)), F.col("class_id"))).otherwise(len(known) + F.col("first_place"))
    return marked.withColumn("step", F.row_number().over(w.orderBy(F.col("superseded").isNotNull(), place))).drop("first_place")


def pathway(recommendations: DataFrame, values: dict[str, Column], current_drug: str = "current_drug", patient: str = "patient_id") -> DataFrame:
    """pathway_order() with gates and phase: blocked (avoid), hold (a gate fails, or another status), active (continued or taken), next (to be considered).

    Classes outside of CANONICAL keep their place in the order but have no row.
    """
    ordered = pathway_order(recommendations, patient).withColumn("gates", lab_gates(F.col("class_id"), values))
    status, taken = F.coalesce("status", F.lit("")), F.coalesce(current_drug, F.lit("")) != ""
    phase = F.when(status == "avoid", "blocked").when(~gates_pass(F.col("gates")), "hold").when((status == "continue") | taken, "active").when(status.isin("consider", "consider_with_caution"), "next").otherwise("hold")
    return ordered.withColumn("phase", phase).where(F.col("class_id").isin(*CANONICAL))
