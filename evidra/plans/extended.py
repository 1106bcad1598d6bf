"""More of the reference's operators over the standard tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.functions.text import threshold
from evidra.functions.vectors import cosine
from evidra.operators import chunking, claims, clinical, collections, dedup, evidence, hybrid, ranking
from evidra.plans.standard import WORDS, _knn, query, table

# --- claims -------------------------------------------------------------------------------------

_KINDS = (*claims.CLAIM_TYPES, "other")
_OPENINGS = ("", "Randomized controlled trial. ", "Table 12 ", "Keywords: copyright, disclosures et al. ", "All rights reserved. See ")
CLAIMS_SQL = f"""WITH claims AS (SELECT doc_id, lang, [{", ".join(f"'{k}'" for k in _KINDS)}, NULL][doc_id % 12 + 1] AS claim_type,
      CASE WHEN doc_id % 7 = 0 THEN 'too short' ELSE [{", ".join(f"'{o}'" for o in _OPENINGS)}][doc_id % 5 + 1] || text END AS evidence,
      CASE lang WHEN 'en' THEN 'drug_label' ELSE 'guideline' END AS source_type FROM documents)"""


def _claims(spark, sf_dir):
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col("doc_id") % n).cast("int"))
    text = F.when(F.col("doc_id") % 7 == 0, "too short").otherwise(F.concat(pick(_OPENINGS, 5), "text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", pick((*_KINDS, None), 12).alias("claim_type"), text.alias("evidence"),
        F.when(F.col("lang") == "en", "drug_label").otherwise("guideline").alias("source_type"),
    )


def _like(column: str, found) -> str:
    return " OR ".join(f"contains(lower({column}), '{w}')" for w in found)


def _match(column: str, patterns, joiner: str = " OR ", cast: str = "") -> str:
    return joiner.join(f"regexp_matches({column}, '(?i){p}'){cast}" for p in patterns)


#: Stated once more, apart from the library's lists.
_STUDY_SQL = r"(?i)incidence\s+of\s+\d+\s*%|p\s*[<>]\s*0?\.\d+|hazard\s+ratio|odds\s+ratio|confidence\s+interval|statistically\s+significant|randomized\s+controlled\s+trial|\brct\b|double-blind|placebo-controlled|pregnancy\s+category\s+[a-z]|category\s+[a-z]\s+pregnancy|^table\s+\d+|^figure\s+\d+"
_CLINICAL_SQL = "dose|dosage|mg|administer|start|stop|reduce|contraindicat|warning|precaution|avoid|monitor|check|measure|renal|hepatic|pregnancy|pregnant|interact|hyperkalemia|potassium|creatinine|egfr|adverse|reaction|risk|caution|recommended|indicated|adjust|increase|decrease|withhold|discontinue"


@query(f"{CLAIMS_SQL} SELECT doc_id FROM claims WHERE length(trim(evidence)) >= 15 AND NOT (regexp_matches(evidence, '{_STUDY_SQL}') AND NOT regexp_matches(lower(evidence), '{_CLINICAL_SQL}'))")
def noise_filter(spark, sf_dir):
    return claims.noise_filter(_claims(spark, sf_dir)).select("doc_id")


@query(f"{CLAIMS_SQL} SELECT claim_type, count(*) AS n FROM claims WHERE claim_type <> 'other' GROUP BY 1")
def type_whitelist(spark, sf_dir):
    return claims.type_whitelist(_claims(spark, sf_dir)).groupBy("claim_type").agg(F.count(F.lit(1)).alias("n"))


_FRONT_SQL = (
    r"\bkeywords?\b", r"\bpermissions?\b", r"\btable of contents\b", r"\bcopyright\b", r"\ball rights reserved\b", r"\bmd,\s*macc\b", r"\bfaha\b.*\bfacc\b",
    r"\bet\s+al\.?\b", r"\bsupplemental (material|appendix)\b", r"\bdisclosure[s]?\b", r"\bconflict of interest\b",
)
_WEAK_SQL = r"^see (contraindications|warnings|precautions|drug interactions)\b|\bsee (contraindications|warnings|precautions)\b\.?\s*$|\bsee adverse reactions\b|\bfor a condition for which it (was )?not prescribed\b|\bmean baseline (egfr|creatinine|egfr was)\b|\bwere not included in clinical\b|\bpackaging is open or damaged\b|\bprefilled syringe\b"
_JUDGED = ("See warnings for all of these. ", "They were not included in clinical studies. ", "Williams, MD, MACC, FAHA, Lee, PhD, FACC, Ito, FAHA, et al. ")


@query(
    f"""{CLAIMS_SQL}, s AS (SELECT doc_id, claim_type, source_type, CASE WHEN doc_id % 3 > 0 THEN 'd' ELSE '' END AS drug,
        lower(coalesce(['{"', '".join(_JUDGED)}', ''][doc_id % 13 + 1], '') || CASE WHEN doc_id % 17 = 0 THEN 'see contraindications' ELSE evidence END) AS l FROM claims),
    n AS (SELECT *, CASE WHEN length(l) < 25 THEN 0.9 ELSE least(1.0, ({" + ".join(f"regexp_matches(l, '{p}')::INT" for p in _FRONT_SQL)}
        + CASE WHEN length(l) - length(replace(l, ',', '')) >= 6 AND regexp_matches(l, '\\b(md|phd|facc|faha)\\b') THEN 2 ELSE 0 END
        + CASE WHEN length(l) - length(replace(l, ';', '')) >= 5 AND contains(l, 'guideline') THEN 1 ELSE 0 END) / 3.0) END::DOUBLE AS score FROM s),
    v AS (SELECT doc_id, score, list_filter([CASE WHEN score >= 0.66 THEN 'heuristic_noise' END, CASE WHEN regexp_matches(trim(l), '{_WEAK_SQL}') THEN 'weak_span' END,
        CASE WHEN claim_type IN ('contraindication', 'renal_constraint', 'hyperkalemia_risk', 'drug_interaction', 'population_constraint') AND drug = '' AND source_type = 'drug_label' THEN 'missing_drug_on_label_claim' END,
        CASE WHEN claim_type = 'population_constraint' AND score >= 0.33 THEN 'weak_population_span' END], lambda x: x IS NOT NULL) AS reasons FROM n)
    SELECT doc_id, round(score, 3) AS noise_score, CASE WHEN len(reasons) > 0 THEN 'reject' ELSE 'accept' END AS verdict, round(CASE WHEN len(reasons) > 0 THEN score ELSE 1 - score END, 3) AS confidence,
      CASE WHEN len(reasons) > 0 THEN array_to_string(reasons, ',') ELSE 'heuristic_ok' END AS reasons FROM v"""
)
def claim_judge(spark, sf_dir):
    opening = F.coalesce(F.get(F.array(*map(F.lit, (*_JUDGED, ""))), (F.col("doc_id") % 13).cast("int")), F.lit(""))
    rows = _claims(spark, sf_dir).withColumn("drug", F.when(F.col("doc_id") % 3 > 0, "d"))
    # Where the evidence is empty, the text of the claim is judged.
    whole = F.concat(opening, F.when(F.col("doc_id") % 17 == 0, "see contraindications").otherwise(F.col("evidence")))
    rows = rows.withColumn("claim", whole).withColumn("evidence", F.when(F.col("doc_id") % 2 == 0, whole).otherwise(""))
    found = claims.judged(rows, drug="drug", source_type="source_type", claim="claim")
    return found.select("doc_id", "noise_score", "verdict", "confidence", F.array_join("reasons", ",").alias("reasons"))


@query(
    f"""{CLAIMS_SQL} SELECT doc_id, least(round(0.75 + CASE WHEN contains(lower(evidence), 'trial') OR contains(lower(evidence), 'table') THEN 0.15 ELSE 0 END
      + CASE WHEN claim_type IN ('contraindication', 'renal_constraint') THEN 0.05 ELSE 0 END + CASE WHEN source_type = 'drug_label' THEN 0.05 ELSE 0 END, 2), 1)::DOUBLE AS confidence FROM claims"""
)
def claim_confidence(spark, sf_dir):
    return _claims(spark, sf_dir).select("doc_id", claims.claim_confidence(F.col("evidence"), F.col("claim_type"), F.col("source_type"), ("trial", "table")).alias("confidence"))


@query(f"{CLAIMS_SQL} SELECT count(*) AS n, round(avg(coalesce(claim_type <> 'other', false)::INT), 4) AS known, round(avg((length(evidence) >= 25)::INT), 4) AS long FROM claims")
def quality_rates(spark, sf_dir):
    return claims.quality_rates(_claims(spark, sf_dir), {"known": F.col("claim_type") != "other", "long": F.length("evidence") >= 25})


@query(f"{CLAIMS_SQL} SELECT doc_id, ({_match('evidence', claims.FRONT_MATTER, ' + ', '::INT')})::INT AS n_hits FROM claims")
def pattern_hits(spark, sf_dir):
    return _claims(spark, sf_dir).select("doc_id", claims.pattern_hits(F.col("evidence"), claims.FRONT_MATTER).alias("n_hits"))


@query(f"{CLAIMS_SQL} SELECT doc_id FROM claims WHERE lang <> 'en' AND lower(trim(evidence)) NOT IN (SELECT lower(trim(evidence)) FROM claims WHERE lang = 'en' AND trim(evidence) <> '')")
def new_claims(spark, sf_dir):
    all_claims = _claims(spark, sf_dir)
    return claims.new_by_text(all_claims.where("lang != 'en'"), all_claims.where("lang = 'en'")).select("doc_id")


@query("SELECT doc_id, coalesce(quality, doc_id % 3)::INT AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def stub_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3).cast("int").alias("quality"))
    stubs = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    return claims.stub_merge(docs, stubs, "doc_id")


_SPANS = f"{CLAIMS_SQL}, s AS (SELECT doc_id, claim_type, evidence || [{', '.join(f"'{x}'" for x in ('', ' is approved for', ' was reported', ' was reported: avoid'))}][doc_id % 4 + 1] AS evidence FROM claims)"


@query(
    f"""{_SPANS} SELECT doc_id FROM s WHERE doc_id % 9 > 0 AND NOT (coalesce(claim_type = 'population_constraint', false) AND
      ({' OR '.join(f"contains(evidence, '{w}')" for w in claims.OBSERVING)} OR (contains(evidence, 'reported') AND NOT ({' OR '.join(f"contains(evidence, '{w}')" for w in claims.DIRECTING)}))))"""
)
def prescriptive_claims(spark, sf_dir):
    ends = F.array(*map(F.lit, ("", " is approved for", " was reported", " was reported: avoid")))
    spans = _claims(spark, sf_dir).withColumn("evidence", F.concat("evidence", F.get(ends, (F.col("doc_id") % 4).cast("int"))))
    return claims.prescriptive_only(spans, F.col("doc_id") % 9 > 0).select("doc_id")


@query(
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'u1' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN '3_medium' WHEN '4-NOT SPECIFIED' THEN 'open'
      WHEN '5-LOW' THEN '5_low' ELSE replace(trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9+]+', ' ', 'g')), ' ', '_') END AS id FROM orders"""
)
def resolved_aliases(spark, sf_dir):
    aliases = {"u1": ["1 Urgent", "low"], "high": [], "open": ["Specified", "medi", "not"]}
    return table(spark, sf_dir, "orders").select("o_orderkey", claims.resolved_alias(F.col("o_orderpriority"), aliases).alias("id"))


_ENDS = ("", " Monitor it.", " is Indicated", " AVOID; monitor", " not recommended", " contraindicated")


@query(
    f"""{CLAIMS_SQL}, s AS (SELECT doc_id, claim_type, lower(evidence || [{', '.join(f"'{x}'" for x in _ENDS)}][doc_id % 6 + 1]) AS l, CASE doc_id % 5 WHEN 0 THEN ' Dose Adjust ' WHEN 1 THEN 'perhaps' END AS stated FROM claims)
    SELECT doc_id, CASE WHEN coalesce(stated = ' Dose Adjust ', false) THEN 'dose_adjust' WHEN claim_type = 'contraindication' OR contains(l, 'contraindicated') THEN 'contraindicated'
      WHEN contains(l, 'not recommended') THEN 'not_recommended' WHEN contains(l, 'avoid') THEN 'avoid' WHEN contains(l, 'monitor') THEN 'monitor'
      WHEN contains(l, 'recommended') OR contains(l, 'should') OR contains(l, 'is indicated') THEN 'recommended' ELSE 'review' END AS action FROM s"""
)
def inferred_actions(spark, sf_dir):
    n = F.col("doc_id")
    text = F.concat("evidence", F.get(F.array(*map(F.lit, _ENDS)), (n % 6).cast("int")))
    stated = F.when(n % 5 == 0, " Dose Adjust ").when(n % 5 == 1, "perhaps")
    return _claims(spark, sf_dir).select("doc_id", claims.inferred_action(text, F.col("claim_type"), stated).alias("action"))


# --- tiers and verdicts -------------------------------------------------------------------------

_CONFIDENCE = "(o_orderkey % 10) / 10.0"


@query(
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 OR o_orderkey % 11 = 0 THEN 'rejected_rules'
      WHEN (o_orderkey % 4 = 0 AND o_orderkey % 3 <> 2) OR (o_orderkey % 4 = 1 AND o_orderkey % 3 = 0) OR {_CONFIDENCE} < 0.7 THEN 'needs_refinement' ELSE 'usable_rules' END AS tier FROM orders"""
)
def dose_rule_tiers(spark, sf_dir):
    n = F.col("o_orderkey")
    kind = F.when(n % 4 == 0, "fixed_titration").when(n % 4 == 1, "fixed_dose").when(n % 4 == 2, "unlisted")
    none = F.array().cast("array<string>")
    given = F.when(n % 3 == 0, none).when(n % 3 == 1, F.array(F.lit("recommended_dose"), F.lit("starting_dose"))).otherwise(F.array(*map(F.lit, ("recommended_dose", "starting_dose", "target_dose"))))
    tier = claims.dose_rule_tier(kind, n % 11 != 0, given, n % 10 / F.lit(10.0))
    return table(spark, sf_dir, "orders").select("o_orderkey", tier.alias("tier"))


@query(
    """WITH r AS (SELECT o_orderkey AS k, o_orderkey % 10 / 10.0 AS c, o_orderkey % 2 = 0 AS fda FROM orders)
    SELECT k AS o_orderkey, CASE WHEN k % 13 = 0 THEN 'rejected_rules' WHEN k % 13 = 1 THEN 'needs_refinement' WHEN k % 13 = 2 OR k % 7 = 0 OR k % 7 = 1 THEN 'rejected_rules'
      WHEN k % 5 = 0 THEN CASE WHEN fda THEN 'needs_refinement' ELSE 'rejected_rules' END
      WHEN fda AND (k % 3 = 0 OR c < 0.65) THEN 'needs_refinement' WHEN NOT fda AND (c < 0.7 OR k % 9 = 0) THEN 'needs_refinement' ELSE 'usable_rules' END AS tier FROM r"""
)
def interaction_rule_tiers(spark, sf_dir):
    n, s = F.col("o_orderkey"), lambda *x: F.array(*map(F.lit, x))
    a = F.when(n % 13 == 0, F.array().cast("array<string>")).when(n % 13 == 1, s("mg 1000 tablets")).otherwise(s("lisinopril", "class:ace_inhibitor"))
    b = F.when(n % 13 == 2, s("class:ACE_inhibitor", "Lisinopril")).otherwise(s("ibuprofen"))
    message = F.when(n % 7 == 0, "short").when(n % 7 == 1, "<specific warning for this pair>").otherwise("Avoid the two together in renal disease")
    watched = F.when(n % 5 == 0, s(" ", "string")).otherwise(s("potassium"))
    method = F.when(n % 2 == 0, "fda_xml_drug_interactions_v2").otherwise("llm")
    tier = claims.interaction_rule_tier(a, b, message, watched, method, n % 10 / F.lit(10.0), n % 3 != 0, F.when(n % 9 == 0, "a|b|c|d").otherwise("a"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tier.alias("tier"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 'rejected_rules' WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'needs_refinement' ELSE 'usable_rules' END AS policy,
      CASE WHEN c_custkey % 5 = 0 OR c_custkey % 4 = 0 THEN 'rejected_rules' WHEN c_custkey % 4 = 1 OR (c_custkey % 10 > 0 AND c_custkey % 10 < 7) THEN 'needs_refinement' ELSE 'usable_rules' END AS warning FROM customer"""
)
def policy_and_warning_tiers(spark, sf_dir):
    n, s = F.col("c_custkey"), lambda *x: F.array(*map(F.lit, x))
    policy = claims.policy_tier(F.when(n % 5 != 0, "mra"), F.lit("MRA"), n % 7 != 0, n % 2 != 0, n % 3 != 0)
    triggers = F.when(n % 4 == 0, F.array().cast("array<string>")).when(n % 4 == 1, s("always")).otherwise(s("always", "egfr"))
    warning = claims.safety_warning_tier(F.when(n % 5 == 0, " ").otherwise("watch"), triggers, F.lit(True), n % 10 / F.lit(10.0))
    return table(spark, sf_dir, "customer").select("c_custkey", policy.alias("policy"), warning.alias("warning"))


_FINDINGS = "SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'avoid' ELSE 'caution' END END AS action, CASE WHEN o_orderkey % 17 = 0 THEN 'critical' WHEN o_orderkey % 6 = 0 THEN 'high' END AS severity FROM orders"


def _findings(spark, sf_dir):
    n = F.col("o_orderkey")
    action = F.when(F.col("o_orderstatus") == "F", F.when(n % 5 == 0, "avoid").otherwise("caution"))
    return table(spark, sf_dir, "orders").select("o_custkey", action.alias("action"), F.when(n % 17 == 0, "critical").when(n % 6 == 0, "high").alias("severity"))


@query(
    f"""SELECT o_custkey, CASE WHEN bool_or(coalesce(action = 'avoid', false) OR coalesce(severity = 'critical', false)) THEN 'blocked'
      WHEN bool_or(action IS NOT NULL OR severity IS NOT NULL) THEN 'approved_with_warnings' ELSE 'approved' END AS status FROM ({_FINDINGS}) GROUP BY 1"""
)
def overall_status(spark, sf_dir):
    return claims.overall_status(_findings(spark, sf_dir), "o_custkey")


@query(
    f"""SELECT o_custkey, count(*) FILTER (action = 'avoid') AS n_hard, count(*) FILTER (action = 'caution') AS n_caution,
      CASE WHEN bool_or(coalesce(action = 'avoid', false)) THEN 'fail' WHEN bool_or(coalesce(action = 'caution', false)) THEN 'warning' ELSE 'pass' END AS verdict FROM ({_FINDINGS}) GROUP BY 1"""
)
def safety_verdicts(spark, sf_dir):
    return claims.safety_verdicts(_findings(spark, sf_dir), "o_custkey")


@query(
    f"""SELECT o_custkey, CASE WHEN bool_or(coalesce(action = 'avoid', false)) THEN 'avoid' WHEN bool_or(coalesce(action = 'caution' OR severity IN ('critical', 'high'), false)) THEN 'consider_with_caution'
      ELSE 'consider' END AS status FROM ({_FINDINGS}) GROUP BY 1"""
)
def policy_status(spark, sf_dir):
    return claims.policy_status(_findings(spark, sf_dir).withColumn("default", F.lit("consider")), "o_custkey", "default")


@query("SELECT o_orderpriority AS tier, count(*) AS n, count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 3 = 0) AS n_unconditional FROM orders GROUP BY 1")
def tier_histogram(spark, sf_dir):
    n = F.col("o_orderkey")
    rules = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("tier"), F.when(F.col("o_orderstatus") == "F", "avoid").alias("action"), F.when(n % 3 == 0, "").otherwise("egfr").alias("condition"))
    return claims.tier_histogram(rules, "tier", "action", "condition")


@query("SELECT c_custkey, '[REDACTED]' AS name, c_mktsegment AS segment, '[REDACTED]' AS home_address FROM customer")
def redaction(spark, sf_dir):
    payload = F.create_map(F.lit("Name"), "c_name", F.lit("segment"), "c_mktsegment", F.lit("home_address"), F.col("c_nationkey").cast("string"))
    hidden = table(spark, sf_dir, "customer").select("c_custkey", claims.redacted(payload).alias("p"))
    return hidden.select("c_custkey", *[F.col("p")[k].alias(v) for k, v in (("Name", "name"), ("segment", "segment"), ("home_address", "home_address"))])


@query("SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'egfr,potassium' WHEN c_nationkey % 3 = 0 THEN 'potassium' WHEN c_nationkey % 3 = 1 AND c_custkey % 2 = 0 THEN 'egfr' ELSE '' END AS missing FROM customer")
def missing_fields(spark, sf_dir):
    need = spark.createDataFrame([("start", ["egfr", "potassium"]), ("dose", ["egfr"])], "intent string, fields array<string>")
    given = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("age"))).otherwise(F.array(F.lit("egfr"), F.lit("age")))
    cases = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 3 == 0, "start").when(F.col("c_nationkey") % 3 == 1, "dose").otherwise("chat").alias("intent"), given.alias("given"))
    return claims.missing_fields(cases, need).select("c_custkey", F.array_join("missing", ",").alias("missing"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN round(least(1, greatest(event_id % 10, event_id % 7) / 10.0 + 0.05), 6) ELSE round((event_id % 10 + event_id % 7) / 20.0 * 0.9, 6) END::DOUBLE AS confidence FROM events")
def ensemble_confidence(spark, sf_dir):
    n = F.col("event_id")
    sure = claims.ensemble_confidence(n % 10 / F.lit(10.0), n % 7 / F.lit(10.0), n % 2 == 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(sure, 6).alias("confidence"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'usable_rules' WHEN o_orderstatus = 'F' AND o_orderkey % 3 > 0 THEN 'needs_condition_refinement' WHEN o_orderkey % 4 = 1 THEN 'usable_rules'
      WHEN o_orderstatus = 'O' AND o_orderkey % 3 > 0 THEN 'monitoring_rules' WHEN o_orderstatus = 'F' THEN 'needs_condition_refinement' ELSE 'rejected_rules' END AS safety_tier FROM orders"""
)
def rule_tiers(spark, sf_dir):
    n = F.col("o_orderkey")
    condition = F.when(n % 4 == 0, F.create_map(F.lit("egfr"), F.lit("< 30"))).when(n % 4 == 1, F.create_map(F.lit("mood"), F.lit("low"))).when(n % 4 == 2, F.create_map(F.lit("egfr"), F.lit("")))
    action = F.when(F.col("o_orderstatus") == "F", "avoid").when(F.col("o_orderstatus") == "O", "monitor").otherwise("start")
    rules = table(spark, sf_dir, "orders").select("o_orderkey", condition.alias("condition"), action.alias("action"), F.when(n % 3 > 0, "drug").alias("drug"))
    return evidence.rule_tiers(rules).select("o_orderkey", "safety_tier")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'egfr' WHEN 1 THEN 'potassium' ELSE 'unknown' END AS metric, CASE WHEN o_orderkey % 3 = 0 THEN '<=' ELSE '>=' END AS operator, (o_orderkey % 90)::DOUBLE AS value FROM orders")
def threshold_parse(spark, sf_dir):
    n = F.col("o_orderkey")
    number = (n % 90).cast("string")
    text = F.when(n % 3 == 0, F.concat(F.lit("If eGFR is below "), number)).when(n % 3 == 1, F.concat(F.lit("serum potassium above "), number)).otherwise(F.concat(F.lit("greater than "), number, F.lit(" mmHg")))
    found = table(spark, sf_dir, "orders").select("o_orderkey", threshold(text).alias("t"))
    return found.select("o_orderkey", "t.metric", "t.operator", "t.value")


@query(
    """SELECT bracket, count(*) AS n FROM (SELECT CASE WHEN l_quantity >= 20 AND l_quantity < 30 THEN 'middle' WHEN l_quantity < 10 THEN 'low' WHEN l_quantity >= 30 THEN 'high' END AS bracket FROM lineitem) GROUP BY 1"""
)
def bracket_half_open(spark, sf_dir):
    lines = clinical.bracket(table(spark, sf_dir, "lineitem"), [("middle", 20, 30), ("low", None, 10, "below 10"), ("high", 30, None)], "l_quantity", "bracket", upper="open")
    return lines.groupBy("bracket").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 3 = 0 THEN ' ' || event_type WHEN event_id % 3 = 1 THEN '' ELSE event_type END AS kind FROM events)
    SELECT user_id, arg_max(kind, (ts, event_id)) FILTER (kind <> '') AS kind FROM e GROUP BY 1"""
)
def draft_merge_blanks(spark, sf_dir):
    n = F.col("event_id")
    kind = F.when(n % 3 == 0, F.concat(F.lit(" "), "event_type")).when(n % 3 == 1, "").otherwise(F.col("event_type"))
    return clinical.merged_draft(table(spark, sf_dir, "events").withColumn("kind", kind), "user_id", ["ts", "event_id"], ["kind"])


@query("SELECT user_id, event_type AS name, min(event_id) AS event_id FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2")
def draft_names(spark, sf_dir):
    return clinical.merged_names(table(spark, sf_dir, "events").withColumn("name", F.col("event_type")), "user_id", "name", ["event_id"], ["event_id"])


# --- chunks -------------------------------------------------------------------------------------

_BLOCK_WORDS = WORDS.replace("text", "b")
CHUNKS_SQL = f"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\n+'), lambda x: trim(x)), lambda x: x <> '') AS bs FROM documents),
    b AS (SELECT doc_id, unnest(bs) AS b, generate_subscripts(bs, 1) AS i FROM p), s AS (SELECT doc_id, b, i, len({_BLOCK_WORDS}) AS n FROM b),
    g AS (SELECT doc_id, i, n AS total, 0 AS chunk FROM s WHERE i = 1
      UNION ALL SELECT s.doc_id, s.i, CASE WHEN greatest(1, floor((g.total + s.n) * 1.3)) <= 120 THEN g.total + s.n ELSE s.n END,
        CASE WHEN greatest(1, floor((g.total + s.n) * 1.3)) <= 120 THEN g.chunk ELSE g.chunk + 1 END FROM g JOIN s ON s.doc_id = g.doc_id AND s.i = g.i + 1),
    c AS (SELECT doc_id, chunk, string_agg(b, chr(10) || chr(10) ORDER BY i) AS b FROM g JOIN s USING (doc_id, i) GROUP BY 1, 2),
    o AS (SELECT doc_id, chunk, b FROM c WHERE chunk = 0
      UNION ALL SELECT c.doc_id, c.chunk, array_to_string(list_reverse(list_slice(list_reverse(list_filter(string_split(trim(regexp_replace(o.b, '[ \\t\\n\\r\\f]+', ' ', 'g')), ' '), lambda w: w <> '')), 1, 23)), ' ') || chr(10) || chr(10) || c.b
        FROM o JOIN c ON c.doc_id = o.doc_id AND c.chunk = o.chunk + 1)
    SELECT doc_id, chunk AS chunk_index, (count(*) OVER (PARTITION BY doc_id))::INT AS chunk_count, b AS text FROM o"""


@query(CHUNKS_SQL)
def overlapping_chunks(spark, sf_dir):
    return chunking.chunked(table(spark, sf_dir, "documents"), "doc_id", "text", most=120, overlap=30)


@query(
    """SELECT conv_id, turn, 'c' || conv_id || '_' || turn AS chunk_id, lag('c' || conv_id || '_' || turn) OVER w AS prev_chunk_id, (row_number() OVER w - 1)::INT AS chunk_index,
      count(*) OVER (PARTITION BY conv_id) AS chunk_count FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, 'c' || conv_id || '_' || turn)"""
)
def chunk_chain(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("c"), "conv_id", F.lit("_"), "turn").alias("chunk_id"))
    return chunking.chained(turns, "conv_id", "turn", "chunk_id")


@query(
    """SELECT label, vec_id FROM (SELECT label, vec_id, list_cosine_similarity(embedding::DOUBLE[], lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id)) AS s FROM embeddings) WHERE s < 0.2"""
)
def similarity_breakpoints(spark, sf_dir):
    return chunking.breakpoints(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.2, cosine)


@query()
def near_dup_greedy(spark, sf_dir):
    """Turns of a conversation that resemble no earlier kept one; tested against a plain loop."""
    return dedup.greedy_dedup(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text").select("conv_id", "turn")


# --- hybrid retrieval ---------------------------------------------------------------------------

_BOTH = f"WITH a AS ({_knn('')}), b AS ({_knn('AND q.label = v.label')})"


def _lists(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0")
    return [ranking.nearest(vectors, asked), ranking.nearest(vectors, asked, same="label")]


@query(f"{_BOTH} SELECT query_id, vec_id, max(score) AS score, round(sum(1 / (60 + rank)), 6) AS fused FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2")
def fused_knn(spark, sf_dir):
    return hybrid.fused_lists(_lists(spark, sf_dir), "vec_id", ["query_id"]).withColumn("fused", F.round("fused", 6))


@query(
    f"""{_BOTH}, h AS (SELECT query_id, vec_id, max(score) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2),
    r AS (SELECT query_id, h.vec_id, round(0.75 * list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) + 0.25 * score
      + CASE v.vec_id % 3 WHEN 0 THEN 0.08 WHEN 1 THEN 0.05 ELSE 0 END, 4) AS rerank_score FROM h JOIN embeddings q ON q.vec_id = query_id JOIN embeddings v ON v.vec_id = h.vec_id)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, vec_id)::INT AS rank FROM r) WHERE rank <= 4"""
)
def reranked_knn(spark, sf_dir):
    hits = hybrid.fused_lists(_lists(spark, sf_dir), "vec_id", ["query_id"])
    vectors = table(spark, sf_dir, "embeddings")
    n = F.col("vec_id")
    kind = F.when(n % 3 == 0, "guideline").when(n % 3 == 1, "drug_label").otherwise("trial")
    both = hits.join(vectors.select("vec_id", F.col("embedding").alias("v")), "vec_id").join(vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id")
    best = hybrid.reranked(both.withColumn("source_type", kind), 4, "q", "v", per=["query_id"], item="vec_id", digits=4)
    return best.select("query_id", "vec_id", "rerank_score", "rank")


@query("SELECT lang, doc_id, rank::INT AS rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars % 7 DESC, n_chars DESC, doc_id) AS rank FROM documents)")
def quality_sorted(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("q", F.col("n_chars") % 7)
    return hybrid.by_quality(docs, ["lang"], "q", "n_chars", "doc_id").select("lang", "doc_id", "rank")


_TERMS = ("the", "of the", "tion", "de la", "zzz")


@query(f"SELECT doc_id, ({' + '.join(f'''contains(lower(coalesce(text, '')), '{t}')::INT * {2 if ' ' in t else 1}''' for t in _TERMS)})::DOUBLE AS score FROM documents")
def lexical_scores(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", hybrid.lexical_score(F.col("text"), F.array(*map(F.lit, _TERMS))).alias("score"))


@query(
    """SELECT * FROM (SELECT *, row_number() OVER (ORDER BY n DESC, user_id)::INT AS rank FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type IS NULL OR event_type NOT IN ('click', 'view') GROUP BY 1)) WHERE rank <= 20"""
)
def frequent_entities(spark, sf_dir):
    return hybrid.frequent_entities(table(spark, sf_dir, "events"), 20, "user_id", "event_type", ("click", "view"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') OR o_orderkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def scope_filter(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return hybrid.in_scope(table(spark, sf_dir, "orders"), wanted, ["o_custkey", "o_orderkey"]).select("o_orderkey")


@query("SELECT c_custkey, c_mktsegment || '|' || c_name AS terms FROM customer")
def query_terms(spark, sf_dir):
    parts = [F.array("c_mktsegment", F.lit(" "), F.lower("c_mktsegment")), F.array("c_name", F.concat(F.lit(" "), "c_mktsegment"), F.lit("more"))]
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(hybrid.distinct_strings(parts, 2), "|").alias("terms"))


@query("SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag), '') AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def enriched_orders(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag")
    out = hybrid.enriched(table(spark, sf_dir, "orders"), lines, "o_orderkey", "l_linenumber", "lines")
    return out.select("o_orderkey", F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_returnflag"])), ",").alias("lines"))


@query("SELECT page_id, CASE WHEN coalesce(url, '') = '' THEN NULL WHEN page_id % 2 = 0 THEN url || '/a.PDF' || CASE WHEN page_id % 3 > 0 THEN '#page=' || page_id % 3 ELSE '' END ELSE url || '/b' END AS link FROM pages WHERE url IS NULL OR NOT contains(url, '?')")
def source_links(spark, sf_dir):
    n = F.col("page_id")
    pages = table(spark, sf_dir, "pages").where(F.col("url").isNull() | ~F.col("url").contains("?"))
    url = F.when(F.col("url") != "", F.concat("url", F.when(n % 2 == 0, "/a.PDF").otherwise("/b")))
    return pages.select("page_id", hybrid.link_of(url, F.nullif(n % 3, F.lit(0))).alias("link"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 1999 ELSE year(o_orderdate) END::INT AS year, CASE WHEN o_orderkey % 4 < 3 THEN o_orderdate::DATE END AS day FROM orders")
def parsed_dates(spark, sf_dir):
    n, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    text = F.when(n % 4 == 0, F.concat(d.cast("string"), F.lit(" 10:00"))).when(n % 4 == 1, F.date_format(d, "MMM d, yyyy")).when(n % 4 == 2, F.date_format(d, "MMMM d, yyyy")).otherwise("as of 1999, n/a")
    return table(spark, sf_dir, "orders").select("o_orderkey", hybrid.year_of(text).alias("year"), hybrid.date_of(text).alias("day"))


# --- sets of rows -------------------------------------------------------------------------------


@query("SELECT 'c' AS origin, c_custkey AS id, c_name AS name, NULL::INT AS size FROM customer UNION ALL SELECT 'p', p_partkey, NULL, p_size FROM part")
def bag_concat(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return collections.concatenated({"c": c, "p": table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("int").alias("size"))})


@query(
    """WITH f AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'), o AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P')
    SELECT o_custkey, CASE WHEN f.o_custkey IS NOT NULL AND o.o_custkey IS NOT NULL THEN 'both' WHEN f.o_custkey IS NOT NULL THEN 'left' ELSE 'right' END AS side FROM f FULL JOIN o USING (o_custkey)"""
)
def evidence_sets(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return collections.membership(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'P'"), "o_custkey")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS version_no FROM orders")
def version_history(spark, sf_dir):
    return collections.history(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "version_no")


@query("SELECT 'lang' AS field, coalesce(lang, 'unknown') AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', coalesce(source, 'unknown'), count(*) FROM documents GROUP BY 2")
def source_registry(spark, sf_dir):
    return collections.registry(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("SELECT c_mktsegment, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def counts_per_class(spark, sf_dir):
    classes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return collections.counts_per_class(table(spark, sf_dir, "orders"), classes, "o_custkey", "c_mktsegment")


@query(
    """WITH t AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders)
    SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS scope FROM t WHERE n <= 4 GROUP BY 1"""
)
def scope_of_top(spark, sf_dir):
    out = collections.scope_of_top(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")], 4, "o_orderstatus", "scope")
    return out.select("o_custkey", F.array_join("scope", ",").alias("scope"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE lower(o_orderpriority) LIKE '%i%' AND lower(o_orderpriority) NOT LIKE '%urgent%' GROUP BY 1")
def best_candidate(spark, sf_dir):
    return collections.best_candidate(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", ["I"], ["Urgent"], ["o_orderdate", "o_orderkey"], ["o_orderkey"])


@query("SELECT o_custkey, coalesce(max(o_orderkey) FILTER (o_orderstatus = 'P'), min(o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def one_key_per_class(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("place", F.col("o_orderkey")).withColumn("now", F.col("o_orderstatus") == "P")
    return collections.one_key_per_class(orders, "o_custkey", "o_orderkey", "place", "now")


@query("SELECT o_orderkey, 'approved' AS status, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 200)::INT AS batch FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 > 0")
def bulk_approval(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "O", "draft").otherwise("retired"))
    return collections.bulk_approved(rows, F.col("o_orderkey") % 3 > 0, "o_orderkey").select("o_orderkey", "status", "batch")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND (lower(c_name) LIKE '%1%' OR c_nationkey::VARCHAR LIKE '%1%')")
def any_of_filter(spark, sf_dir):
    return collections.any_of(table(spark, sf_dir, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"], ["c_name", "c_nationkey"], "1").select("c_custkey")


@query(
    """SELECT doc_id, CASE WHEN contains(lower(source), '1') THEN 'dose' WHEN contains(lower(source), '2') OR contains(lower(source), 'src3') THEN 'warning' WHEN contains(lower(text), 'tion') THEN 'other' END AS section
    FROM documents WHERE contains(lower(source), '1') OR contains(lower(source), '2') OR contains(lower(source), 'src3') OR contains(lower(text), 'tion')"""
)
def keyword_sections(spark, sf_dir):
    found = collections.sections_with(table(spark, sf_dir, "documents"), "source", "text", {"dose": ["1"], "warning": ["2", "SRC3"]}, ["tion"])
    return found.select("doc_id", "section")
