"""Rule tiers, links, gold matches, refilled filters, conflicts and consensus on literal rows."""

from pyspark.sql import functions as F

from evidra.operators import evidence


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_rule_tiers(spark):
    rows = [
        (1, {"egfr": "<30"}, "monitor", None), (2, {"egfr": ""}, "avoid", "d"), (3, {"other": "x"}, "monitor", "d"), (4, {}, "titrate", "d"),
        (5, None, "avoid", None), (6, None, None, None), (7, {"other": "x"}, "avoid", "d"),
    ]
    got = evidence.rule_tiers(spark.createDataFrame(rows, "id int, condition map<string,string>, action string, drug string"))
    assert [t for _, t in values(got, "id", "safety_tier")] == ["usable_rules", "needs_condition_refinement", "usable_rules", "monitoring_rules", "needs_condition_refinement", "rejected_rules", "needs_condition_refinement"]


def test_linked_chunks(spark):
    claims = spark.createDataFrame([("c1", "d", "s", "avoid drug a now"), ("c2", "d", None, "unlike"), ("c3", None, "s", "avoid drug a now"), ("c4", "d", "s", " ")], "claim_id string, document_id string, source_section string, evidence string")
    chunks = spark.createDataFrame([("k2", "d", "s", "Avoid  drug a now"), ("k1", "d", "s", "avoid drug a now"), ("k3", "e", "s", "avoid drug a now")], "chunk_id string, document_id string, section string, text string")
    assert values(evidence.linked_chunks(claims, chunks), "claim_id", "chunk_id", "score") == [("c1", "k1", 1.0), ("c3", "k1", 0.65)]


def test_gold_matches(spark):
    gold = spark.createDataFrame(
        [("g1", "valid_claim", "t", "doc", "Drug A", "stop with low egfr values"), ("g2", "invalid_extraction", None, "doc2", "drug a", "stop with low egfr values"), ("g3", "valid_claim", "other", "doc", None, "stop with low egfr values"), ("g4", "valid_claim", "t", "none", None, "x")],
        "gold_id string, label string, claim_type string, document_id string, drug string, evidence string",
    )
    found = spark.createDataFrame([("p1", "t", "doc", "drug_a", "Stop with low eGFR values!"), ("p2", "t", "doc", "drug_a", "nothing alike here")], "claim_id string, claim_type string, document_id string, drug string, evidence string")
    got = {r["gold_id"]: (r["claim_id"], r["matched"], round(r["score"], 2)) for r in evidence.gold_matches(gold, found).collect()}
    assert got == {"g1": ("p1", True, 1.13), "g2": ("p1", True, 1.05), "g3": ("p1", False, 1.05), "g4": (None, False, 0.0)}


def test_refilled_filter(spark):
    rows = spark.createDataFrame([("q", 1, 0.9, False), ("q", 2, 0.1, True), ("q", 3, 0.5, None), ("r", 1, 0.2, False)], "q string, n int, quality double, ok boolean")
    assert values(evidence.refilled_filter(rows, "q", F.col("ok"), "quality", "n"), "q", "n") == [("q", 1), ("q", 2), ("r", 1)]
    assert values(evidence.refilled_filter(rows, "q", F.col("ok"), "quality", "n", k=1), "q", "n") == [("q", 2), ("r", 1)]


def test_conflicts(spark):
    a = spark.createDataFrame([(1, 60.0, "x"), (2, None, "x"), (3, 50.0, "x")], "k int, age double, s string")
    b = spark.createDataFrame([(1, 65.0, "y"), (2, 1.0, None), (3, 54.0, "x")], "k int, age double, s string")
    assert values(evidence.draft_conflicts(a, b, "k", ["age", "s"], {"age": 5}), "k", "field") == [(1, "age"), (1, "s")]


def test_consensus_and_status(spark):
    a = spark.createDataFrame([(2, "Same"), (1, "other")], "n int, evidence string")
    b = spark.createDataFrame([(1, "same"), (2, "new")], "n int, evidence string")
    assert values(evidence.consensus([a, b], "n"), "n", "evidence") == [(1, "other"), (2, "Same"), (2, "new")]
    items = spark.createDataFrame([("a", "strong"), ("a", "weak"), ("b", "missing"), ("b", "weak"), ("c", "strong")], "i string, l string")
    assert values(evidence.citation_status(items, "i", "l"), "i", "status") == [("a", "weak"), ("b", "missing"), ("c", "strong")]
    patients = spark.createDataFrame([(1, ["Drug A XL"]), (2, ["other"]), (3, None)], "i int, current_medications array<string>")
    got = patients.select("i", evidence.medication_state(patients, ["drug a"]).alias("takes"))
    assert values(got, "i", "takes") == [(1, True), (2, False), (3, False)]
