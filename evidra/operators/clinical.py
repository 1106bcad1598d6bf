"""Patients and rules: status ladders, risk flags, conditions, dose brackets, drug sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values. A ladder has (upper bound, status) steps, lt or le, the last status, and that of null.
HF_TYPE = ((("le", 40, "HFrEF"), ("le", 49, "HFmrEF")), "HFpEF", "unknown")
RENAL = ((("lt", 15, "kidney_failure"), ("lt", 30, "severely_reduced"), ("lt", 45, "moderately_reduced"), ("lt", 60, "mildly_reduced")), "preserved", "missing")
POTASSIUM = ((("lt", 3.5, "low"), ("lt", 5.0, "normal"), ("lt", 5.5, "elevated")), "high", "missing")
BLOOD_PRESSURE = ((("lt", 90, "hypotension"), ("lt", 100, "low"), ("le", 130, "acceptable")), "elevated", "missing")
HEART_RATE = ((("lt", 60, "bradycardia"), ("le", 100, "acceptable")), "tachycardia", "missing")
MANY_DRUGS = 5


def ladder(value: Column, steps, last: str, missing: str) -> Column:
    """The status of the first step whose bound holds."""
    out = F.when(value.isNull(), missing)
    for kind, bound, status in steps:
        out = out.when(value < bound if kind == "lt" else value <= bound, status)
    return out.otherwise(last)


def normalized_term(term: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.replace(term, F.lit("_"), F.lit(" "))), "\\s+", " "))


def statuses(patients: DataFrame) -> DataFrame:
    """patients and their statuses; list columns are normalised, null lists are empty."""
    terms = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), normalized_term)
    return patients.withColumns(
        {
            "hf_type": ladder(F.col("lvef"), *HF_TYPE), "renal_status": ladder(F.col("egfr"), *RENAL),
            "potassium_status": ladder(F.col("potassium"), *POTASSIUM), "bp_status": ladder(F.col("systolic_bp"), *BLOOD_PRESSURE),
            "hr_status": ladder(F.col("heart_rate"), *HEART_RATE),
            "has_polypharmacy": F.size(F.coalesce(F.col("current_medications"), F.array().cast("array<string>"))) >= MANY_DRUGS,
            "comorbidities": terms("comorbidities"), "current_medications": terms("current_medications"),
        }
    )


def risk_flags(patients: DataFrame, case: str = "case_id") -> DataFrame:
    """One row per patient and risk: case, name, severity, evidence. patients has passed statuses()."""
    p = F.col

    def risk(test: Column, name: str, severity, evidence: Column | str) -> Column:
        level = F.lit(severity) if isinstance(severity, str) else severity
        text = F.lit(evidence) if isinstance(evidence, str) else evidence
        return F.when(test, F.struct(F.lit(name).alias("name"), level.alias("severity"), text.alias("evidence")))

    said = lambda label, c: F.concat(F.lit(f"{label} = "), p(c).cast("string"))
    renal = p("renal_status").isin("severely_reduced", "kidney_failure", "moderately_reduced")
    found = F.array(
        risk(p("hf_type") == "unknown", "missing_lvef", "moderate", "No LVEF: the phenotype is open."),
        risk(p("renal_status") == "missing", "missing_egfr", "moderate", "No eGFR: renal safety is open."),
        risk(p("potassium_status") == "missing", "missing_potassium", "moderate", "No potassium: hyperkalemia risk is open."),
        risk(p("bp_status") == "missing", "missing_sbp", "moderate", "No systolic pressure: hypotension risk is open."),
        risk(p("hr_status") == "missing", "missing_heart_rate", "moderate", "No heart rate: beta blocker safety is open."),
        risk(renal, "renal_impairment", F.when(p("renal_status") == "moderately_reduced", "moderate").otherwise("high"), said("eGFR", "egfr")),
        risk(p("potassium_status").isin("elevated", "high"), "hyperkalemia", F.when(p("potassium_status") == "high", "high").otherwise("moderate"), said("Potassium", "potassium")),
        risk(p("bp_status").isin("hypotension", "low"), "hypotension", F.when(p("bp_status") == "hypotension", "high").otherwise("moderate"), said("SBP", "systolic_bp")),
        risk(p("hr_status") == "bradycardia", "bradycardia", "moderate", said("Heart rate", "heart_rate")),
        risk(p("has_polypharmacy"), "polypharmacy", "moderate", f"At least {MANY_DRUGS} current medications."),
        risk(F.array_contains("comorbidities", "diabetes"), "diabetes", "low", "Diabetes among the comorbidities."),
        risk(F.arrays_overlap("comorbidities", F.array(F.lit("ckd"), F.lit("chronic kidney disease"))) & ~renal, "ckd_history", "moderate", "CKD among the comorbidities."),
    )
    return patients.select(case, F.explode(F.filter(found, lambda r: r.isNotNull())).alias("r")).select(case, "r.*")


def condition_holds(operator: Column, value: Column, bound: Column) -> Column:
    """always, missing, present, missing_or_lt, missing_or_lte, lt, lte, gt, gte; any other never holds."""
    known = value.isNotNull() & bound.isNotNull()
    lt, lte = F.coalesce(value < bound, F.lit(False)), F.coalesce(value <= bound, F.lit(False))
    return (
        F.when(operator == "always", True)
        .when(operator == "missing", value.isNull())
        .when(operator == "present", value.isNotNull())
        .when(operator == "missing_or_lt", value.isNull() | lt)
        .when(operator == "missing_or_lte", value.isNull() | lte)
        .when(~known, False)
        .when(operator == "lt", value < bound)
        .when(operator == "lte", value <= bound)
        .when(operator == "gt", value > bound)
        .when(operator == "gte", value >= bound)
        .otherwise(False)
    )


def fired_rules(facts: DataFrame, rules: dict[str, list[list[tuple]]], case: str = "case_id") -> DataFrame:
    """case, rule_id of every rule that fires; facts has a column per field.

    rules: name to groups of (field, operator, value). A rule fires if all conditions of any group
    hold; without groups it always fires. The catalog becomes expressions, so nothing is joined.
    """

    def fires(groups: list[list[tuple]]) -> Column:
        holds = lambda c: condition_holds(F.lit(c[1]), F.col(c[0]), F.lit(c[2]).cast("double"))
        every = [reduce(Column.__and__, map(holds, g), F.lit(True)) for g in groups]
        return reduce(Column.__or__, every) if every else F.lit(True)

    found = F.array(*[F.when(fires(groups), F.lit(name)) for name, groups in rules.items()])
    return facts.select(case, F.explode(F.filter(found, lambda r: r.isNotNull())).alias("rule_id"))


def severity(default: Column, rules: Column, value_of) -> Column:
    """The severity of the last rule that holds, else the default. rules: array of structs with severity."""
    return F.aggregate(rules, default, lambda s, r: F.when(condition_holds(r["operator"], value_of(r), r["value"]), F.coalesce(r["severity"], s)).otherwise(s))


def bracket(rows: DataFrame, brackets: list[tuple], value: str, into: str, upper: str = "closed") -> DataFrame:
    """rows and the name of the most specific bracket that holds the value.

    brackets: (name, least or None, most or None), and a note, if any. Lower bounds are included.
    Upper ones are with upper="closed", unless the note says that it means below or less than the
    bound; with upper="open" they aren't. A bracket with both bounds goes first, then one with an
    upper bound, then one with a lower bound, then by place in the list. Null has none.
    """
    order = sorted(range(len(brackets)), key=lambda n: (-(brackets[n][1] is not None and brackets[n][2] is not None), brackets[n][2] is None, n))
    out, v = F.lit(None).cast("string"), F.col(value)
    for name, least, most, *note in (brackets[n] for n in reversed(order)):
        open_end = upper == "open" or any(w in (note or [""])[0].lower() for w in ("below", "less than", "<"))
        tests = ([v >= least] if least is not None else []) + ([v < most if open_end else v <= most] if most is not None else []) + [v.isNotNull()]
        out = F.when(reduce(Column.__and__, tests), name).otherwise(out)
    return rows.withColumn(into, out)


def set_pairs(members: DataFrame, rules: DataFrame, group: str, member: str, rule: str = "rule_id") -> DataFrame:
    """group, rule where the group has a member of set_a and one of set_b; rules: rule, set_a, set_b (arrays).

    Rules are joined by member, so a group meets only rules that name one of its members.
    """
    a = rules.select(rule, F.lit(1).alias("side"), F.explode("set_a").alias(member))
    b = rules.select(rule, F.lit(2).alias("side"), F.explode("set_b").alias(member))
    sides = members.join(a.unionAll(b).distinct(), member).groupBy(group, rule, "side").agg(F.count(F.lit(1)).alias("n"))
    return sides.groupBy(group, rule).agg(F.count(F.lit(1)).alias("sides")).where("sides = 2").select(group, rule)


def pair_semi_join(rows: DataFrame, rules: DataFrame, left: str, right: str, lefts: str, rights: str) -> DataFrame:
    """rows whose (left, right) is in the product of some rule's two arrays."""
    pairs = rules.select(F.explode(lefts).alias(left), rights).select(left, F.explode(rights).alias(right)).distinct()
    return rows.join(pairs, [left, right], "left_semi")


def worst(levels: Column, order: tuple[str, ...]) -> Column:
    """The worst of an array of levels, which come from mild to worst in order; null where there is none."""
    places = F.transform(levels, lambda x: F.array_position(F.array(*map(F.lit, order)), x))
    return F.try_element_at(F.array(*map(F.lit, order)), F.nullif(F.array_max(places), F.lit(0)).cast("int"))


def latest_by(rows: DataFrame, keys: list[str], value: str, at: str, ties: str) -> DataFrame:
    """keys, and the value that is latest by (at, ties): one partial aggregate, no sort."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(at, ties)).alias(value), F.max(at).alias(at))


def washout_hours(last_dose: Column, now: Column, hours: int = 36) -> Column:
    """Hours that are left of a wash-out since the last dose, at least 0; null where that is unknown."""
    return F.greatest(F.lit(0.0), F.lit(float(hours)) - (F.unix_timestamp(now) - F.unix_timestamp(last_dose)) / 3600.0)


def merged_draft(turns: DataFrame, key: str, at: list[str], columns: list[str]) -> DataFrame:
    """One row per key: of each column the latest value that isn't blank, in order of at.

    Null, empty text and empty lists are blank and never replace a value.
    """
    order = F.struct(*at)

    def given(c: str) -> Column:
        kind = turns.schema[c].dataType.typeName()
        return F.col(c).isNotNull() & ((F.col(c) != "") if kind == "string" else (F.size(c) > 0) if kind == "array" else F.lit(True))

    return turns.groupBy(key).agg(*[F.max_by(c, F.when(given(c), order)).alias(c) for c in columns])


def merged_names(items: DataFrame, key: str, name: str, at: list[str], columns: list[str]) -> DataFrame:
    """The first item of each name per key, names compared in lower case without outer spaces; blank names are left out."""
    low = F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))
    first = items.where(low != "").groupBy(key, low.alias("_name")).agg(F.min_by(F.struct(name, *columns), F.struct(*at)).alias("r"))
    return first.select(key, "r.*")
