"""Claims and rules: filters, tiers, confidences, quality rates, redaction. All are column expressions or one aggregate."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evidra.functions.text import needed

#: Claim types that are kept, types with a bonus, actions that forbid.
CLAIM_TYPES = (
    "contraindication", "renal_constraint", "usage_constraint", "hyperkalemia_risk", "dose_recommendation", "drug_interaction",
    "adverse_reaction", "population_constraint", "guideline_recommendation", "general_monitoring",
)
#: What makes a span noise, and words that keep it all the same.
STUDY_PATTERNS = (
    r"incidence\s+of\s+\d+\s*%", r"p\s*[<>]\s*0?\.\d+", r"hazard\s+ratio", r"odds\s+ratio", r"confidence\s+interval", r"statistically\s+significant",
    r"randomized\s+controlled\s+trial", r"\brct\b", r"double-blind", r"placebo-controlled", r"pregnancy\s+category\s+[a-z]", r"category\s+[a-z]\s+pregnancy",
    r"^table\s+\d+", r"^figure\s+\d+",
)
CLINICAL_WORDS = (
    "dose", "dosage", "mg", "administer", "start", "stop", "reduce", "contraindication", "contraindicated", "warning", "precaution", "avoid",
    "monitor", "check", "measure", "renal", "hepatic", "pregnancy", "pregnant", "interact", "interaction", "hyperkalemia", "potassium",
    "creatinine", "egfr", "adverse", "reaction", "risk", "caution", "recommended", "indicated", "adjust", "increase", "decrease", "withhold", "discontinue",
)
#: Front matter of papers, each a third of certainty that a span is noise.
FRONT_MATTER = (
    r"\bkeywords?\b", r"\bpermissions?\b", r"\btable of contents\b", r"\bcopyright\b", r"\ball rights reserved\b", r"\bmd,\s*macc\b",
    r"\bfaha\b.*\bfacc\b", r"\bet\s+al\.?\b", r"\bsupplemental (material|appendix)\b", r"\bdisclosure[s]?\b", r"\bconflict of interest\b",
)
#: Spans that match a type but give no rule, and the types that need a drug on a label.
WEAK_SPANS = (
    r"^see (contraindications|warnings|precautions|drug interactions)\b", r"\bsee (contraindications|warnings|precautions)\b\.?\s*$", r"\bsee adverse reactions\b",
    r"\bfor a condition for which it (?:was )?not prescribed\b", r"\bmean baseline (egfr|creatinine|egfr was)\b", r"\bwere not included in clinical\b",
    r"\bpackaging is open or damaged\b", r"\bprefilled syringe\b",
)
HARD_TYPES = ("contraindication", "renal_constraint", "hyperkalemia_risk", "drug_interaction", "population_constraint")
#: Fields that a kind of dose calculation needs.
DOSE_FIELDS = {
    "fixed_titration": ("starting_dose", "target_dose"), "step_titration": ("dose_steps",), "fixed_dose": ("recommended_dose",),
    "crcl_threshold_dose": ("standard_dose", "reduced_dose", "crcl_threshold"), "criteria_reduction": ("standard_dose", "reduced_dose", "reduction_criteria"),
    "dual_criteria_reduction": ("standard_dose", "reduced_dose", "reduction_criteria"), "dabigatran_dose": ("standard_dose", "reduced_dose", "renal_reduced_dose"),
    "warfarin_inr": ("starting_dose",), "crcl_bracket": ("crcl_brackets",), "weight_adjusted_target": ("starting_dose", "target_dose_standard"), "congestion_range": ("dose_range",),
}


def _some(tests: list[Column]) -> Column:
    return reduce(Column.__or__, tests)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def keywords(text: Column, words=CLINICAL_WORDS) -> Column:
    """Whether the lower-cased text contains one of the words, also inside of others."""
    low = F.lower(_text(text))
    return _some([low.contains(w) for w in words])


def is_noise(evidence: Column, patterns=STUDY_PATTERNS, words=CLINICAL_WORDS, least: int = 15) -> Column:
    """Spans to drop: shorter than `least` characters, or about a study and without a clinical word."""
    study = _some([_text(evidence).rlike("(?i)" + p) for p in patterns])
    return (F.length(F.trim(_text(evidence))) < least) | (study & ~keywords(evidence, words))


def noise_filter(claims: DataFrame, evidence: str = "evidence") -> DataFrame:
    """claims without noise."""
    return claims.where(~is_noise(F.col(evidence)))


def type_whitelist(claims: DataFrame, kind: str = "claim_type", types=CLAIM_TYPES) -> DataFrame:
    """claims of a known type; a null type is unknown."""
    return claims.where(F.col(kind).isin(*types))


def pattern_hits(text: Column, patterns) -> Column:
    """How many of the patterns occur in the text, in any case."""
    return reduce(Column.__add__, [_matches(text, p).cast("int") for p in patterns])


def _matches(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs in the text, in any case; only texts with what its matches need are searched."""
    found, some = _text(text).rlike("(?i)" + pattern), needed(pattern)
    return _some([F.lower(_text(text)).contains(s) for s in some]) & found if some else found


def noise_score(evidence: Column, patterns=FRONT_MATTER) -> Column:
    """How likely a span is front matter, 0 to 1: a third for each pattern, more for lists of authors; 0.9 below 25 characters."""
    low = F.lower(_text(evidence))
    many = lambda sign: F.length(low) - F.length(F.replace(low, F.lit(sign), F.lit("")))
    hits = pattern_hits(low, patterns)
    hits = hits + F.when((many(",") >= 6) & low.rlike(r"\b(md|phd|facc|faha)\b"), 2).otherwise(0) + F.when((many(";") >= 5) & low.contains("guideline"), 1).otherwise(0)
    return F.when(F.length(low) < 25, 0.9).otherwise(F.least(F.lit(1.0), hits / 3.0))


def judged(claims: DataFrame, evidence: str = "evidence", kind: str = "claim_type", drug: str | None = None, source_type: str | None = None, claim: str | None = None, most: float = 0.66, population: float = 0.33) -> DataFrame:
    """claims with noise_score, reasons, verdict and confidence.

    Reasons to reject, in this order: noise from `most` on; a weak span; a hard type without a drug on
    a label (where drug and source_type are given); a population claim with noise from `population`
    on. Accepted claims have the one reason heuristic_ok. Where evidence is null or empty the claim's
    text takes its place, if given.
    """
    span = F.when(_text(F.col(evidence)) != "", F.col(evidence)).otherwise(F.col(claim) if claim else F.lit(""))
    # Columns of their own, so that each is computed once.
    claims = claims.withColumn("_low", F.lower(_text(span))).withColumn("_noise", noise_score(F.col("_low")))
    noise, low = F.col("_noise"), F.trim("_low")
    sure = lambda test: F.coalesce(test, F.lit(False))
    bare = sure(F.col(kind).isin(*HARD_TYPES)) & (_text(F.col(drug)) == "") & sure(F.col(source_type) == "drug_label") if drug and source_type else F.lit(False)
    tests = {
        "heuristic_noise": noise >= most, "weak_span": _some([_some([F.col("_low").contains(s) for s in needed(p)]) & low.rlike(p) for p in WEAK_SPANS]), "missing_drug_on_label_claim": bare,
        "weak_population_span": sure(F.col(kind) == "population_constraint") & (noise >= population),
    }
    found = F.array_compact(F.array(*[F.when(test, F.lit(reason)) for reason, test in tests.items()]))
    out = claims.withColumn("noise_score", F.round(noise, 3)).withColumn("reasons", found)
    reject = F.size("reasons") > 0
    out = out.withColumn("verdict", F.when(reject, "reject").otherwise("accept")).withColumn("confidence", F.round(F.when(reject, noise).otherwise(1.0 - noise), 3))
    return out.withColumn("reasons", F.when(reject, F.col("reasons")).otherwise(F.array(F.lit("heuristic_ok")))).drop("_low", "_noise")


def claim_confidence(sentence: Column, kind: Column, source_type: Column, strong_words) -> Column:
    """0.75, with 0.15 for a strong modal word, 0.05 for a hard type and 0.05 for a label; at most 1."""
    add = lambda test, value: F.when(F.coalesce(test, F.lit(False)), value).otherwise(0.0)
    total = F.lit(0.75) + add(keywords(sentence, strong_words), 0.15) + add(kind.isin("contraindication", "renal_constraint"), 0.05) + add(source_type == "drug_label", 0.05)
    return F.least(F.round(total, 2), F.lit(1.0))


def ensemble_confidence(first: Column, second: Column, agree: Column) -> Column:
    """The larger confidence and 0.05 more where two extractions agree, else 0.9 times their mean."""
    return F.when(agree, F.least(F.lit(1.0), F.greatest(first, second) + 0.05)).otherwise((first + second) / 2 * 0.9)


def plausible_token(token: Column, prose=()) -> Column:
    """Whether a token may name a drug or, with class: in front, a class; `prose` are parts that no name has."""
    t = F.lower(F.trim(_text(token)))
    body = F.regexp_replace(F.substring(t, 7, 1000), "^_+|_+$", "")
    of_class = F.length(body).between(2, 48) & body.rlike("^[a-z0-9_]+$")
    under = F.length(t) - F.length(F.replace(t, F.lit("_"), F.lit("")))
    name = (F.length(t) <= 36) & (under <= 4) & ~t.rlike("[0-9]{3,}") & t.rlike("^[a-z0-9_+-]+$")
    if prose:
        name = name & ~_some([t.contains(p) for p in prose])
    return F.when(t.startswith("class:"), of_class).otherwise(name)


def plausible_set(tokens: Column, prose=()) -> Column:
    """Distinct plausible tokens in order, lower-case, spaces as underscores."""
    clean = F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: F.replace(F.lower(F.trim(_text(t))), F.lit(" "), F.lit("_")))
    return F.array_distinct(F.filter(clean, lambda t: (t != "") & plausible_token(t, prose)))


def use_of(tier: Column, usable: str) -> Column:
    return F.when(tier == "usable_rules", usable).when(tier == "rejected_rules", "do_not_use").otherwise("review_only")


def dose_rule_tier(kind: Column, has_drugs: Column, given: Column, confidence: Column, fields=DOSE_FIELDS) -> Column:
    """Tier of a dose rule. given: array of the fields that have a value; confidence under 0.7 or a missing field needs refinement."""
    missing = F.lit(False)
    for name, needed in fields.items():
        missing = missing | ((kind == name) & (F.size(F.array_except(F.array(*map(F.lit, needed)), given)) > 0))
    none = (_text(kind) == "") | ~F.coalesce(has_drugs, F.lit(False))
    return F.when(none, "rejected_rules").when(F.coalesce(missing, F.lit(False)) | (F.coalesce(confidence, F.lit(0.0)) < 0.7), "needs_refinement").otherwise("usable_rules")


def interaction_rule_tier(set_a: Column, set_b: Column, message: Column, monitoring: Column, method: Column, confidence: Column, matched: Column, target: Column) -> Column:
    """Tier of an interaction rule, from its two token sets, message, monitoring list, method, confidence and partner match."""
    low = lambda s: F.array_sort(F.array_distinct(F.transform(s, F.lower)))
    empty = (F.coalesce(F.size(set_a), F.lit(0)) < 1) | (F.coalesce(F.size(set_b), F.lit(0)) < 1)
    odd = F.exists(F.concat(set_a, set_b), lambda t: ~plausible_token(t))
    said = F.trim(F.regexp_replace(F.lower(_text(message)), r"\s+", " "))
    placeholder = (F.length(F.trim(_text(message))) < 10) | (said.startswith("<") & said.endswith(">")) | said.startswith("clinician-facing warning")
    watched = F.size(F.filter(F.coalesce(monitoring, F.array().cast("array<string>")), lambda m: ~F.lower(F.trim(_text(m))).isin("", "string"))) > 0
    label, sure = _text(method).startswith("fda_xml_drug_interactions"), F.coalesce(confidence, F.lit(0.0))
    pipes = F.length(_text(target)) - F.length(F.replace(_text(target), F.lit("|"), F.lit("")))
    return (
        F.when(empty, "rejected_rules").when(odd, "needs_refinement").when((low(set_a) == low(set_b)) | placeholder, "rejected_rules")
        .when(~watched, F.when(label, "needs_refinement").otherwise("rejected_rules"))
        .when(label & (~F.coalesce(matched, F.lit(True)) | (sure < 0.65)), "needs_refinement")
        .when(~label & ((sure < 0.7) | (pipes >= 3)), "needs_refinement")
        .otherwise("usable_rules")
    )


def policy_tier(class_key: Column, label: Column, has_body: Column, has_reasoning: Column, has_actions: Column) -> Column:
    """Tier of a policy: rejected without class, label or body, to refine without reasoning and actions."""
    whole = (_text(class_key) != "") & (_text(label) != "") & F.coalesce(has_body, F.lit(False))
    return F.when(~whole, "rejected_rules").when(~(F.coalesce(has_reasoning, F.lit(False)) | F.coalesce(has_actions, F.lit(False))), "needs_refinement").otherwise("usable_rules")


def safety_warning_tier(message: Column, triggers: Column, has_drugs: Column, confidence: Column) -> Column:
    """Tier of a dose-safety warning. triggers: names of its triggers; only `always` needs refinement, as does a confidence under 0.7 that isn't 0."""
    n = F.coalesce(F.size(triggers), F.lit(0))
    none = (F.trim(_text(message)) == "") | (n < 1) | ~F.coalesce(has_drugs, F.lit(False))
    weak = (F.coalesce(confidence, F.lit(0.0)) != 0) & (confidence < 0.7)
    return F.when(none, "rejected_rules").when(F.forall(triggers, lambda t: t == "always") | F.coalesce(weak, F.lit(False)), "needs_refinement").otherwise("usable_rules")


def overall_status(constraints: DataFrame, case: str, action: str = "action", severity: str = "severity") -> DataFrame:
    """case, status: blocked by an `avoid` or a `critical`, else approved_with_warnings where there is any finding, else approved.

    A case without findings has one row whose action and severity are null.
    """
    hard = F.coalesce((F.col(action) == "avoid") | (F.col(severity) == "critical"), F.lit(False))
    some = F.col(action).isNotNull() | F.col(severity).isNotNull()
    return constraints.groupBy(case).agg(F.when(F.bool_or(hard), "blocked").when(F.bool_or(some), "approved_with_warnings").otherwise("approved").alias("status"))


def safety_verdicts(constraints: DataFrame, case: str, action: str = "action") -> DataFrame:
    """case, verdict, n_hard, n_caution: fail with an `avoid`, warning with a `caution`, else pass."""
    counted = constraints.groupBy(case).agg(F.count_if(F.col(action) == "avoid").alias("n_hard"), F.count_if(F.col(action) == "caution").alias("n_caution"))
    return counted.withColumn("verdict", F.when(F.col("n_hard") > 0, "fail").when(F.col("n_caution") > 0, "warning").otherwise("pass"))


def policy_status(findings: DataFrame, policy: str, default: str, action: str = "action", severity: str = "severity") -> DataFrame:
    """policy, status: avoid by a forbidding action, consider_with_caution by a caution or a high warning, else the policy's default."""
    hard = F.bool_or(F.coalesce(F.lower(action).isin("avoid", "contraindicated", "not_recommended"), F.lit(False)))
    soft = F.bool_or(F.coalesce((F.col(action) == "caution") | F.col(severity).isin("critical", "high"), F.lit(False)))
    return findings.groupBy(policy).agg(F.when(hard, "avoid").when(soft, "consider_with_caution").otherwise(F.min(default)).alias("status"))


def tier_histogram(rules: DataFrame, tier: str, action: str, condition: str, hard=("avoid", "contraindicated", "not_recommended")) -> DataFrame:
    """tier, n, n_unconditional: rules of each tier, and those of a hard action with an empty condition."""
    bare = F.col(action).isin(*hard) & (_text(F.col(condition)) == "")
    return rules.groupBy(tier).agg(F.count(F.lit(1)).alias("n"), F.count_if(bare).alias("n_unconditional"))


def quality_rates(claims: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row: n, and for each check the share of claims that pass, rounded to 4 digits; nulls fail."""
    rate = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 4)
    return claims.agg(F.count(F.lit(1)).alias("n"), *[rate(c).alias(name) for name, c in checks.items()])


def checked_drop_rate(before: DataFrame, after: DataFrame, most: float) -> DataFrame:
    """after; an error if more than that share of `before` is gone. Both are counted."""
    b, a = before.count(), after.count()
    if b and (b - a) / b > most:
        raise ValueError(f"{b - a} of {b} rows dropped; at most {most:.0%} may be")
    return after


def new_by_text(found: DataFrame, known: DataFrame, text: str = "evidence") -> DataFrame:
    """found without rows whose text, trimmed and lower-cased, is among the known ones; blank texts never are."""
    key = lambda c: F.nullif(F.lower(F.trim(_text(c))), F.lit(""))
    return found.join(known.select(key(F.col(text)).alias("_known")).distinct(), key(F.col(text)) == F.col("_known"), "left_anti")


def stub_merge(claims: DataFrame, stubs: DataFrame, claim: str = "claim_id") -> DataFrame:
    """claims with the columns of their validation stubs; where both have a column, the stub's value wins unless null."""
    both = [c for c in stubs.columns if c != claim and c in claims.columns]
    s = stubs.withColumnsRenamed({c: f"_stub_{c}" for c in both})
    joined = claims.join(s, claim, "left")
    return joined.select(*[F.coalesce(f"_stub_{c}", c).alias(c) if c in both else c for c in claims.columns], *[c for c in s.columns if c not in claims.columns and not c.startswith("_stub_")])


#: Parts of a field's name that make its value personal.
PERSONAL = ("name", "email", "phone", "address")
#: Names of fields whose values are personal.
PERSONAL_FIELDS = (
    "message", "first_name", "last_name", "full_name", "email", "phone", "address", "date_of_birth", "ssn", "insurance_id", "mrn", "medical_record_number",
)


def redacted(payload: Column, fields=(), parts=PERSONAL) -> Column:
    """A map<string,string> with [REDACTED] for values whose key is in `fields` or contains one of `parts`."""
    hidden = lambda k: _some([F.lower(k).contains(p) for p in parts] + [F.lower(k).isin(*fields or ("",))])
    return F.transform_values(payload, lambda k, v: F.when(hidden(k), "[REDACTED]").otherwise(v))


def redacted_json(payload: Column, fields=PERSONAL_FIELDS, parts=PERSONAL, deepest: int = 10) -> Column:
    """JSON text with "[REDACTED]" for each value whose key is in `fields` or contains one of `parts`, at any depth.

    Objects and lists are walked down to `deepest` levels below the top; what lies deeper becomes
    "[MAX_DEPTH_EXCEEDED]". Keys keep their order. Null, blank and broken texts become null, so nothing
    unread is passed on.
    """
    exact, inside = {f.lower() for f in fields}, tuple(p.lower() for p in parts)

    def clean(value, depth: int):
        if depth > deepest:
            return "[MAX_DEPTH_EXCEEDED]"
        if isinstance(value, dict):
            hide = lambda k: k.lower() in exact or any(p in k.lower() for p in inside)
            return {k: "[REDACTED]" if hide(k) else clean(v, depth + 1) for k, v in value.items()}
        return [clean(v, depth + 1) for v in value] if isinstance(value, list) else value

    def one(text: str | None) -> str | None:
        try:
            return json.dumps(clean(json.loads(text), 0), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError, RecursionError):
            return None

    @F.pandas_udf(StringType())
    def whole(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return whole(payload)


def missing_fields(cases: DataFrame, required: DataFrame, given: str = "given", intent: str = "intent") -> DataFrame:
    """cases with missing: the fields their intent requires (required: intent, fields) that aren't given; an unknown intent misses none."""
    none = F.array().cast("array<string>")
    joined = cases.join(F.broadcast(required.select(intent, F.col("fields").alias("_fields"))), intent, "left")  # a fixed list of intents
    return joined.withColumn("missing", F.array_except(F.coalesce("_fields", none), F.coalesce(given, none))).drop("_fields")


#: What shows that a span on a population observes, and what shows that it directs.
OBSERVING = (
    "safety and effectiveness", "have not been established", "has not been established", "have not been demonstrated",
    "has not been demonstrated", "is approved for", "information describing a clinical study",
)
DIRECTING = ("contraindicated", "not recommended", "avoid", "do not", "should not", "must not")


def prescriptive_only(claims: DataFrame, gate: Column | None = None, evidence: str = "evidence", kind: str = "claim_type") -> DataFrame:
    """claims that pass the gate (null fails), without population claims that only observe: by an observing phrase, or `reported` without a directing one. Case counts."""
    span = _text(F.col(evidence))
    observes = _some([span.contains(w) for w in OBSERVING]) | (span.contains("reported") & ~_some([span.contains(w) for w in DIRECTING]))
    kept = claims if gate is None else claims.where(F.coalesce(gate, F.lit(False)))
    return kept.where(~(F.coalesce(F.col(kind) == "population_constraint", F.lit(False)) & observes))


def resolved_alias(name: Column, aliases: dict[str, list[str]]) -> Column:
    """The id of a name: of the alias that equals it, else of the first alias of 4 characters or more that it contains as whole words, else its own words joined by underscores.

    aliases: ids to their other names, a fixed catalog that becomes a literal. Names are compared in
    lower case, with all but letters, digits and plus signs as spaces. Null and empty names are null.
    """
    clean = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9+]+", " "))
    index: dict[str, str] = {}
    for key, others in aliases.items():
        for alias in (key, *others):
            normal = re.sub("[^a-z0-9+]+", " ", alias.lower()).strip()
            if normal:
                index[normal] = key
    own, known = clean(name), F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(k).alias("id")) for a, k in index.items()])
    padded = F.concat(F.lit(" "), own, F.lit(" "))
    inside = lambda a: (F.length(a) >= 4) & _some([padded.contains(F.concat(F.lit(b), a, F.lit(e))) for b in " +" for e in " +"])
    first = lambda test: F.get(F.filter(known, lambda x: test(x["alias"])), F.lit(0))["id"]
    found = F.coalesce(first(lambda a: a == own), first(inside)) if index else F.lit(None)
    return F.when(F.coalesce(name, F.lit("")) != "", F.coalesce(found, F.replace(own, F.lit(" "), F.lit("_"))))


#: Actions that a claim may state, and phrases from which one is inferred, the first that occurs deciding.
ACTIONS = ("contraindicated", "not_recommended", "avoid", "monitor", "recommended", "review", "dose_adjust", "reduce_dose")
ACTION_PHRASES = (
    ("contraindicated", "contraindicated"), ("not recommended", "not_recommended"), ("avoid", "avoid"), ("monitor", "monitor"),
    ("recommended", "recommended"), ("should", "recommended"), ("is indicated", "recommended"),
)


def inferred_action(text: Column, kind: Column, stated: Column) -> Column:
    """The action of a claim: the stated one if it is known, else from its text in any case; contraindication claims are contraindicated, others without a phrase are up for review."""
    own, low = F.replace(F.lower(F.trim(_text(stated))), F.lit(" "), F.lit("_")), F.lower(_text(text))
    out = F.when(own.isin(*ACTIONS), own).when(F.coalesce(kind == "contraindication", F.lit(False)), "contraindicated")
    for phrase, action in ACTION_PHRASES:
        out = out.when(low.contains(phrase), action)
    return out.otherwise("review")
