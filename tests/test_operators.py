"""Literal fixtures for the reference's operators: boundaries, nulls, ties, repeats, empty tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from evidra.functions import text, vectors
from evidra.operators import claims, clinical, dedup, evaluation, governance, graph, hybrid, ranking
from evidra.sources import readers
from evidra.streaming import limits


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def one(spark, column, **row):
    names = list(row)
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, text.sentences(F.col("t")), t="First of all this is long.  Second one is long too! (Third is here as well.)") == ["First of all this is long.", "Second one is long too!", "(Third is here as well.)"]
    assert one(spark, text.sentences(F.col("t")), t=None) == []
    assert [one(spark, text.token_estimate(F.col("t")), t=t) for t in (None, " ", "a", "a b c")] == [0, 0, 1, 3]
    assert [one(spark, text.slug(F.col("t")), t=t) for t in (None, "--", "A  b/ç-c")] == ["unknown", "unknown", "a_b_c"]
    assert one(spark, text.slug(F.col("t"), 3), t="ab_cd") == "ab"
    assert one(spark, text.shingles(F.col("t"), 2), t="A b, a B c") == ["a b", "b a", "b c"]
    assert one(spark, text.shingles(F.col("t"), 5), t="a") == ["a"]
    assert one(spark, text.shingles(F.col("t"), 5), t="!") == []
    assert one(spark, text.overlap(F.col("a"), F.col("b")), a="Ab cd", b="ab") == 0.4
    assert one(spark, text.overlap(F.col("a"), F.col("b")), a="", b="ab") == 0


def test_stable_id(spark):
    import hashlib

    def made(*labels, uniqueness=()):
        return one(spark, text.stable_id([F.lit(x).cast("string") for x in labels], [F.lit(u) for u in uniqueness]), t="")

    digest = lambda s: hashlib.sha1(s.encode()).hexdigest()[:8]
    assert made("Drug A", None, "dose", uniqueness=["u"]) == "drug_a_dose_" + digest("drug_a_dose|u")
    assert made(None, " ") == "unknown_" + digest("unknown")
    assert made("x" * 30, "y" * 30) == "x" * 30 + "_" + digest("x" * 30)
    assert made("x" * 60) == "x" * 48 + "_" + digest("x" * 48)


def test_thresholds(spark):
    get = lambda t: one(spark, text.threshold(F.col("t")), t=t)
    assert tuple(get("if eGFR falls below 30")) == ("egfr", "<=", 30.0, "mL/min/1.73m2")
    assert tuple(get("serum potassium above 5.5 mmol/L")) == ("potassium", ">=", 5.5, "mmol/L")
    assert tuple(get("SBP less than 90 mmHg")) == ("unknown", "<=", 90.0, "mmHg")
    assert get("no number") is None and get(None) is None


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [round(r[0], 4) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [0.7071, 0.0, 0.0]
    e = spark.range(1).select(vectors.hashed_embedding(F.array(F.lit("a"), F.lit("b")), 16).alias("e")).first()["e"]
    assert len(e) == 16 and abs(sum(x * x for x in e) - 1) < 1e-9


def test_ladders(spark):
    def status(v, what):
        return spark.createDataFrame([(v,)], "v double").select(clinical.ladder(F.col("v"), *what)).first()[0]

    assert [status(v, clinical.HF_TYPE) for v in (None, 40.0, 40.5, 49.0, 49.5)] == ["unknown", "HFrEF", "HFmrEF", "HFmrEF", "HFpEF"]
    assert [status(v, clinical.RENAL) for v in (None, 14.9, 15.0, 30.0, 45.0, 60.0)] == ["missing", "kidney_failure", "severely_reduced", "moderately_reduced", "mildly_reduced", "preserved"]
    assert [status(v, clinical.POTASSIUM) for v in (None, 3.4, 3.5, 5.0, 5.5)] == ["missing", "low", "normal", "elevated", "high"]
    assert [status(v, clinical.BLOOD_PRESSURE) for v in (None, 89.0, 90.0, 100.0, 130.0, 131.0)] == ["missing", "hypotension", "low", "acceptable", "acceptable", "elevated"]
    assert [status(v, clinical.HEART_RATE) for v in (None, 59.0, 60.0, 100.0, 101.0)] == ["missing", "bradycardia", "acceptable", "acceptable", "tachycardia"]


PATIENT = "case_id string, lvef double, egfr double, potassium double, systolic_bp double, heart_rate double, comorbidities array<string>, current_medications array<string>"


def test_risk_flags(spark):
    rows = [
        ("a", 35.0, 25.0, 5.6, 95.0, 55.0, ["CKD", "Diabetes"], ["m"] * 5),
        ("b", None, None, None, None, None, None, None),
        ("c", 55.0, 70.0, 4.0, 120.0, 70.0, ["chronic_kidney  disease"], []),
    ]
    got = values(clinical.risk_flags(clinical.statuses(spark.createDataFrame(rows, PATIENT))), "case_id", "name", "severity")
    assert got == [
        ("a", "bradycardia", "moderate"), ("a", "diabetes", "low"), ("a", "hyperkalemia", "high"), ("a", "hypotension", "moderate"),
        ("a", "polypharmacy", "moderate"), ("a", "renal_impairment", "high"), ("b", "missing_egfr", "moderate"), ("b", "missing_heart_rate", "moderate"),
        ("b", "missing_lvef", "moderate"), ("b", "missing_potassium", "moderate"), ("b", "missing_sbp", "moderate"), ("c", "ckd_history", "moderate"),
    ]


def test_conditions_and_severity(spark):
    facts = spark.createDataFrame([(1, None), (2, 5.0), (3, 10.0)], "case_id long, v double")
    rules = {"none": [], "miss": [[("v", "missing", None)]], "mlt": [[("v", "missing_or_lt", 6)]], "band": [[("v", "gt", 5), ("v", "lte", 10)]], "odd": [[("v", "other", 1)]]}
    assert values(clinical.fired_rules(facts, rules), "case_id", "rule_id") == [(1, "miss"), (1, "mlt"), (1, "none"), (2, "mlt"), (2, "none"), (3, "band"), (3, "none")]
    ladder = F.array(F.struct(F.lit("gt").alias("operator"), F.lit(1.0).alias("value"), F.lit("high").alias("severity")), F.struct(F.lit("gt").alias("operator"), F.lit(7.0).alias("value"), F.lit("critical").alias("severity")))
    got = facts.select("case_id", clinical.severity(F.lit("low"), ladder, lambda r: F.col("v")).alias("s"))
    assert values(got, "case_id", "s") == [(1, "low"), (2, "high"), (3, "critical")]
    worst = spark.createDataFrame([(["low", "high"],), ([],)], "x array<string>").select(clinical.worst(F.col("x"), ("low", "moderate", "high")).alias("w"))
    assert [r[0] for r in worst.collect()] == ["high", None]


def test_brackets_and_sets(spark):
    rows = spark.createDataFrame([(None,), (5.0,), (31.0,), (50.0,), (15.0,)], "v double")
    got = clinical.bracket(rows, [("min", 40, None), ("both", 20, 35), ("max", None, 10)], "v", "b")
    assert [r["b"] for r in got.collect()] == [None, "max", "both", "min", None]
    members = spark.createDataFrame([("p", "x"), ("p", "y"), ("p", "x"), ("q", "x"), (None, "x")], "p string, m string")
    rules = spark.createDataFrame([("r", ["x", "z"], ["y"]), ("self", ["x"], ["x"])], "rule_id string, set_a array<string>, set_b array<string>")
    assert values(clinical.set_pairs(members.where("p is not null"), rules, "p", "m"), "p", "rule_id") == [("p", "r"), ("p", "self"), ("q", "self")]


def test_draft_merge_and_latest(spark):
    rows = spark.createDataFrame([("k", 1, "a", None), ("k", 2, None, 5), ("k", 3, "b", None), ("n", 1, None, None)], "k string, t int, s string, n int")
    assert [tuple(r) for r in clinical.merged_draft(rows, "k", ["t"], ["s", "n"]).orderBy("k").collect()] == [("k", "b", 5), ("n", None, None)]
    assert [tuple(r) for r in clinical.latest_by(rows, ["k"], "s", "t", "n").orderBy("k").collect()] == [("k", "b", 3), ("n", None, 1)]


def test_dedup(spark):
    rows = spark.createDataFrame([(3, "A b"), (1, "a  b"), (2, None), (4, "")], "id int, t string")
    got = dedup.first_wins(rows, dedup.text_key(F.col("t")), ["id"], ["id"])
    assert values(got, "id", "n_rows") == [(1, 2), (2, 2)]
    assert values(dedup.repeated_keys(rows, dedup.text_key(F.col("t")), "id"), "first", "n_rows") == [(1, 2), (2, 2)]
    signature = rows.limit(0).unionByName(rows).select("id", dedup.minhash(F.col("t")).alias("m"))
    sizes = {r["id"]: len(r["m"]) for r in signature.collect()}
    assert sizes == {1: 64, 2: 0, 3: 64, 4: 0}
    same = signature.where("id = 1").crossJoin(signature.where("id = 3").select(F.col("m").alias("n"))).select(dedup.signature_similarity(F.col("m"), F.col("n"))).first()[0]
    assert same == 1.0


def kept_by_hand(signatures, similarity):
    """Places that stay: no kept one before shares a band of 8 values and enough equal values. signatures: in order."""
    kept = []
    for n, x in enumerate(signatures):
        banded = [k for k in kept if any(signatures[k][b : b + 8] == x[b : b + 8] for b in range(0, len(x), 8)) and x]
        if not any(sum(a == b for a, b in zip(signatures[k], x)) >= similarity * 64 for k in banded):
            kept.append(n)
    return kept


@pytest.mark.parametrize("similarity", [dedup.SIGNATURE_SIMILARITY, 0.75])
def test_greedy_dedup_against_a_loop(spark, similarity):
    base = [f"w{n}" for n in range(120)]
    texts = [" ".join(base)] + [" ".join(base[:n] + ["x"] + base[n + 1 :]) for n in (0, 30, 60, 119)] + [" ".join(base[k:]) for k in (3, 9, 30)] + ["", " ".join(base), ""]
    rows = spark.createDataFrame([("s", n, t) for n, t in enumerate(texts)] + [("o", 0, texts[0])], "s string, n int, t string")
    signatures = [list(r["m"]) for r in rows.where("s = 's'").orderBy("n").select(dedup.minhash(F.col("t")).alias("m")).collect()]
    got = dedup.greedy_dedup(rows, "s", "n", "t", similarity=similarity)
    assert values(got, "s", "n") == [("o", 0)] + [("s", n) for n in kept_by_hand(signatures, similarity)]
    assert 0 < got.where("s = 's'").count() < len(texts)


def test_drafts_and_brackets(spark):
    turns = spark.createDataFrame([("a", 1, "x", ["p"]), ("a", 2, "", []), ("a", 3, None, None)], "k string, at int, v string, l array<string>")
    assert [tuple(r) for r in clinical.merged_draft(turns, "k", ["at"], ["v", "l"]).collect()] == [("a", "x", ["p"])]
    rows = spark.createDataFrame([(5.0,), (4.9,), (None,)], "v double")
    closed, below = ([r["b"] for r in clinical.bracket(rows, [("low", None, 5.0, note)], "v", "b").collect()] for note in ("", "below 5"))
    assert closed == ["low", "low", None] and below == [None, "low", None]


def test_fused_lists_and_drop_rates(spark):
    one = spark.createDataFrame([("x", 1, 0.5), ("y", 2, 0.4)], "d string, rank int, score double")
    assert values(hybrid.fused_lists([one], "d"), "d", "fused") == [("x", 0.5), ("y", 0.4)]
    assert claims.checked_drop_rate(one, one.limit(1), 0.5).count() == 1
    with pytest.raises(ValueError):
        claims.checked_drop_rate(one, one.limit(0), 0.5)


def test_ranking(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "d string, rank int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "d string, rank int")
    fused = {r["d"]: (round(r["score"], 6), r["n_lists"]) for r in ranking.fuse_ranks([a, b], "d").collect()}
    assert fused == {"x": (round(1 / 61, 6), 1), "y": (round(1 / 61 + 1 / 62, 6), 2), "z": (round(1 / 62, 6), 1)}
    five = spark.createDataFrame([("g", n) for n in range(1, 6)], "g string, rank int")
    order = [r["rank"] for r in ranking.edges_first(five, ["g"]).orderBy("position").collect()]
    assert order == [1, 3, 5, 4, 2]
    hits = spark.createDataFrame([("c", 1, 10.0), ("c", 2, 1.0)], "c string, i int, score double")
    rows = spark.createDataFrame([("c", n) for n in range(4)], "c string, i int")
    assert values(ranking.with_neighbours(hits, rows, "c", "i"), "i", "score", "hit") == [(0, 8.5, False), (1, 10.0, True), (2, 1.0, True), (3, 0.85, False)]


def test_bm25_repeated_terms_count_twice(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a a"), (3, None), (4, "c")], "doc_id long, text string")
    once = ranking.bm25(docs, spark.createDataFrame([(0, "A")], "query_id long, text string"))
    twice = ranking.bm25(docs, spark.createDataFrame([(0, "a A")], "query_id long, text string"))
    assert [r["doc_id"] for r in once.orderBy("rank").collect()] == [2, 1]
    assert abs(twice.first()["score"] - 2 * once.first()["score"]) < 1e-5
    assert ranking.bm25(docs, spark.createDataFrame([(0, " ")], "query_id long, text string")).count() == 0


def test_nearest(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 2), (2, [1.0, 0.1], 1), (3, [0.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    got = ranking.nearest(rows, rows.where("vec_id = 0"), k=2)
    assert [r["vec_id"] for r in got.orderBy("rank").collect()] == [1, 2]
    assert [r["vec_id"] for r in ranking.nearest(rows, rows.where("vec_id = 0"), k=2, same="label").orderBy("rank").collect()] == [2, 3]
    assert ranking.nearest(rows, rows.limit(0)).count() == 0


def test_governance(spark):
    rows = spark.createDataFrame([("a", 1, "approved", "x"), ("a", 2, "draft", "y"), ("b", 1, "odd", "x")], "k string, version long, status string, body string")
    assert tuple(governance.status_counts(rows).first()) == (2, 1, 0, 3)
    assert values(governance.approve(rows, spark.createDataFrame([("a", 2)], "k string, version long"), "k"), "k", "version", "status") == [("a", 1, "retired"), ("a", 2, "approved"), ("b", 1, "odd")]
    current = governance.latest(rows, "k", "version", ["body"])
    incoming = spark.createDataFrame([("a", "y"), ("b", None), ("c", "z")], "k string, body string")
    assert values(governance.sync(current, incoming, "k", ["body"]), "k", "outcome", "version") == [("a", "unchanged", 2), ("b", "updated", 2), ("c", "inserted", 1)]
    assert values(governance.field_diff(current, incoming, "k", ["body"]), "k", "change") == [("b", "removed"), ("c", "added")]
    assert values(governance.primary_wins(incoming, current.select("k", "body"), "k"), "k") == [("a",), ("b",), ("c",)]
    assert values(governance.matching(rows, {"k": "a", "status": None}, {"body": "Y"}), "version") == [(2,)]
    empty = rows.limit(0)
    assert tuple(governance.status_counts(empty).first()) == (0, 0, 0, 0)
    assert governance.agreement(empty, empty, "k").first()["rate"] == 0.0
    keys = governance.with_fallback_keys(spark.createDataFrame([(1, "n", "b"), (2, None, "n")], "i int, x string, y string"), current.select("k", "body"), "i", [F.col("x"), F.col("y")], "k", "body")
    assert values(keys, "i", "body") == [(1, "x")]


def test_graph(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (2, "c")], "chunk int, e string")
    got = graph.co_occurring(rows, rows.where("e = 'a'"), "chunk", "e")
    assert values(got, "e", "n", "rank") == [("b", 2, 1), ("c", 1, 2)]
    made = graph.edges(rows, F.col("chunk"), "HAS", F.col("e"))
    assert made.count() == 5 and made.select("relationship_id").distinct().count() == 5
    assert values(graph.nodes(made), "entity_id", "n_edges") == [("1", 2), ("2", 3), ("a", 2), ("b", 2), ("c", 1)]


def test_calibration_puts_outsiders_last(spark):
    rows = spark.createDataFrame([(c, 1) for c in (0.4, 0.5, 0.9, 1.0)], "c double, ok int")
    got = evaluation.calibration(rows, "c", F.col("ok") == 1)
    assert values(got, "bucket", "n") == [(0, 1), (4, 3)]


def test_latencies_index(spark):
    rows = spark.createDataFrame([("a", n, float(n)) for n in range(1, 11)], "k string, t int, v double")
    assert tuple(evaluation.latencies(rows, "k", "v", ["t"]).first())[1:] == (10, 55.0, 5.0, 9.0)
    assert tuple(evaluation.latencies(rows, "k", "v", ["t"], last=3).first())[1:] == (3, 27.0, 9.0, 9.0)


def test_retention(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    got = evaluation.retention(rows, [("known", F.col("v").isNotNull()), ("big", F.col("v") > 1)])
    assert [tuple(r)[:3] for r in got.collect()] == [("known", 3, 2), ("big", 2, 1)]


def test_rate_limits(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", n, t0 + dt.timedelta(seconds=s)) for n, s in enumerate((0, 1, 2, 9, 10, 11))], "k string, id long, ts timestamp")
    fixed = limits.fixed_windows(rows, "k", "ts", "id", 2, 10)
    assert values(fixed, "id", "limited") == [(0, False), (1, False), (2, True), (3, True), (4, False), (5, False)]
    sliding = limits.sliding_log(rows, "k", "ts", "id", 2, 10)
    assert values(sliding, "id", "limited") == [(0, False), (1, False), (2, True), (3, True), (4, False), (5, False)]


def test_stream_counts_and_limits(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    spark.createDataFrame([("a", t0), ("a", t0 + dt.timedelta(seconds=1)), ("a", t0 + dt.timedelta(seconds=2)), ("b", t0)], "k string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    limited = limits.stream_fixed_windows(stream, "k", "ts", 2, 60)
    run = limited.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(once=True).start()
    run.awaitTermination(120)
    assert sorted((r["key"], r["limited"]) for r in spark.table("limited").collect()) == [("a", False), ("a", False), ("a", True), ("b", False)]
    counts = limits.window_counts(stream, "ts", "k", "1 hour", "1 minute")
    run = counts.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert values(spark.table("counted"), "k", "n") == [("a", 3), ("b", 1)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes('﻿{"a": 1}\n\n{"a": 2, "b": "x"}\n'.encode())
    assert values(readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int"), "a") == [(1,), (2,)]
    assert readers.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    (tmp_path / "t.csv").write_text("id,v\n1,2.5\n2,bad\n")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "t.csv"), {"v": "double"}).orderBy("id").collect()] == [("1", 2.5), ("2", None)]
    (tmp_path / "n.ann").write_text("T1\tDrug 0 5\taspir\nR1\tx\nT2\tDose 3 4;6 9\t10 mg\n")
    assert values(readers.annotations(spark, str(tmp_path / "n.ann")), "id", "type", "start", "end") == [("T1", "Drug", 0, 5), ("T2", "Dose", 3, 9)]
    pages = spark.createDataFrame([(1, "<nav>no</nav><p>intro</p><h2>Dose</h2><p>a <b>b</b></p><li>c</li><h1></h1>"), (2, None)], "page_id long, html string")
    assert [tuple(r) for r in readers.html_sections(pages).orderBy("section_no").collect()] == [(1, 0, "BODY", 1, "intro"), (1, 1, "DOSE", 2, "a b\nc")]
    xml = b'<document xmlns="urn:hl7-org:v3"><component><section><title>A</title><text>one</text><component><section><title>B</title><text>two <i>x</i></text></section></component></section></component></document>'
    assert readers.label_sections(xml) == [("A", "one"), ("A / B", "two x")]
    (tmp_path / "l.xml").write_bytes(xml)
    assert readers.read_labels(spark, str(tmp_path / "l.xml")).count() == 2
    table = spark.range(1).select(readers.table_markdown(F.array(F.array(F.lit("h"), F.lit("a|b")), F.array(F.lit("1")))).alias("m")).first()["m"]
    assert table == "| h | a\\|b |\n| --- | --- |\n| 1 |  |"
    done = readers.promote(spark.range(3), str(tmp_path / "out"), "r1").first()
    assert (done["run_id"], done["n_rows"]) == ("r1", 3)
    out = str(tmp_path / "out")
    assert readers.current(spark, out).count() == 3
    with pytest.raises(ValueError):
        readers.promote(spark.range(5), out, "r2", F.col("id") < 4)
    with pytest.raises(ValueError):
        readers.promote(spark.range(0), out, "r3", F.col("id") < 4)
    assert readers.current(spark, out).count() == 3
    readers.promote(spark.range(4), out, "r4", F.col("id") < 4)
    assert readers.current(spark, out).count() == 4
