"""Names, spans, near-duplicate vectors, relevance, doses and judging against plain loops and odd rows."""

import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.operators import citations, claims, doses, guided, mentions, names, relevance, similar

# --- names --------------------------------------------------------------------------------------


def slow_resolve(mention, catalog):
    clean = lambda v: re.sub(r"[^a-z0-9+]+", " ", (v or "").lower()).strip()
    index = {}
    for alias, drug in catalog:
        if clean(alias):
            index[clean(alias)] = drug
    name = clean(mention)
    if not name:
        return None, None, None
    if name in index:
        return index[name], "exact", 1.0
    for alias, drug in index.items():
        if len(alias) >= 4 and re.search(rf"(?<![a-z0-9]){re.escape(alias)}(?![a-z0-9])", name):
            return drug, "contained", 1.0
    best, score = None, 0.0
    for alias, drug in index.items():
        ratio = SequenceMatcher(None, name, alias).ratio()
        if len(alias) >= 3 and ratio > score and ratio >= 0.75:
            best, score = drug, ratio
    return (best, "similar", score) if best else (name.replace(" ", "_"), "slug", 0.0)


def test_names_by_loop(spark):
    rng = random.Random(17)
    word = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    catalog = [(" ".join(word(rng.randrange(1, 9)) for _ in range(rng.randrange(1, 3))), f"d{k}") for k in range(60)] + [("ab+cd", "plus"), ("", "none"), (None, "none"), ("abc", "first"), ("ABC", "again")]
    found = []
    for alias, _ in catalog[:60]:
        chars = list(alias)
        for _ in range(4):
            now = chars[:]
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(now) + 1)
                now[at : at + rng.randrange(2)] = rng.choice([[], ["x"], [rng.choice("abcde")]])
            found.append("".join(now))
        found.append(f"take {alias}, 5 mg!")
    found += [None, "", " ?! ", "x" * 3000, "ab+cde", "tab ab+cd", "ÀÉ"] + ["hot name"] * 50
    df = spark.createDataFrame(list(enumerate(found)), "n int, mention string")
    aliases = spark.createDataFrame([(a, d, k) for k, (a, d) in enumerate(catalog)], "alias string, drug_id string, place int")
    got = {r.n: (r.drug_id, r.way, r.score) for r in names.resolve(df, aliases).collect()}
    want = {n: slow_resolve(m, catalog) for n, m in enumerate(found)}
    assert set(got) == set(want)
    for n, w in want.items():
        assert got[n][:2] == w[:2] and got[n][2] == (w[2] if w[2] is None else pytest.approx(w[2])), (found[n], got[n], w)
    assert {w[1] for w in want.values()} == {"exact", "contained", "similar", "slug", None}
    assert {r.way for r in names.resolve(df, aliases.limit(0)).collect()} == {"slug", None}
    assert names.resolve(df.limit(0), aliases).count() == 0


def test_no_similar_name_is_lost(spark):
    rng = random.Random(4)
    left = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))) for _ in range(150)})
    right = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(3, 12))) for _ in range(80)})
    found = names.candidates(spark.createDataFrame([(x,) for x in left], "name string"), spark.createDataFrame([(x, x, k) for k, x in enumerate(right)], "alias string, drug_id string, place long"))
    pairs = {(r.name, r.alias) for r in found.collect()}
    want = {(a, b) for a in left for b in right if SequenceMatcher(None, a, b).ratio() >= 0.75}
    assert want <= pairs and len(pairs) < 0.7 * len(left) * len(right)


# --- mentions -----------------------------------------------------------------------------------


def test_spans_by_loop(spark):
    rng = random.Random(2)
    terms = [("ab", "x"), ("ab ab", "y"), ("b", "x"), ("Ab", "z"), ("a-b", "x"), ("é", "x"), ("", "x"), (None, "x"), ("ab", None)]
    texts = [" ".join(rng.choice(["ab", "AB", "b", "abb", "a-b", "é", "éa", "."]) for _ in range(rng.randrange(30))) for _ in range(60)] + [None, "", "ab " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    dictionary = spark.createDataFrame(terms, "term string, kind string")
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    def slow(text):
        low, found = lower(text or ""), []
        for term, kind in sorted({(t, k or "") for t, k in terms if t}):
            at = low.find(lower(term))
            while at >= 0:
                end = at + len(term)
                if not (at and low[at - 1].isalnum() and low[at].isalnum()) and not (end < len(low) and low[end].isalnum() and low[end - 1].isalnum()):
                    found.append((at, end, kind, term))
                at = low.find(lower(term), at + 1)
        return sorted(found, key=lambda s: (s[0], -s[1], s[2], s[3]))

    got = df.select("n", mentions.dictionary_spans(df, dictionary, overlapping=True).alias("all"), mentions.dictionary_spans(df, dictionary).alias("longest")).collect()
    for r in got:
        want = slow(texts[r.n])
        assert [(s.start, s.end, s.kind, s.term) for s in r["all"]] == want
        behind, kept = 0, []
        for s in want:
            if s[0] >= behind:
                kept.append(s)
                behind = s[1]
        assert [(s.start, s.end, s.kind, s.term) for s in r.longest] == kept
    assert df.select(mentions.dictionary_spans(df, dictionary.limit(0)).alias("s")).where("size(s) > 0").count() == 0


def test_negation(spark):
    cases = [("denies chest pain", "pain", True), ("no pain", "pain", True), ("no new pain", "pain", True), ("no new bad pain", "pain", False), ("piano pain", "pain", False), ("pain", "pain", False), ("without a long long word of pain", "pain", False)]
    df = spark.createDataFrame([(t, t.index(m), want) for t, m, want in cases], "t string, s int, want boolean")
    assert all(r.got == r.want for r in df.select("t", "want", mentions.is_negated(F.col("t"), F.col("s")).alias("got")).collect())


# --- near-duplicate vectors ---------------------------------------------------------------------


@pytest.mark.parametrize("threshold, tile", [(0.5, 7), (0.95, 2048)])
def test_similar_vectors_by_loop(spark, threshold, tile):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(12, 6))
    rows = []
    for k in range(160):
        v = base[rng.integers(12)] * rng.uniform(0.5, 2) + rng.normal(size=6) * rng.choice([0, 0.05, 0.6])
        rows.append((k, ["a", "b", None][k % 3], v.tolist()))
    rows += [(200, "a", None), (201, "a", []), (202, "a", [0.0] * 6), (203, "a", [1.0, None]), (204, "a", [1.0, 2.0]), (205, "a", [2.0, 4.0])]
    kept = []
    for k, scope, v in rows:
        if v and None not in v and any(v):
            x = np.array(v) / np.linalg.norm(v)
            if any(s == scope and len(y) == len(x) and float(y @ x) >= threshold - 1e-12 for _, s, y in kept if y is not None):
                continue
            kept.append((k, scope, x))
        else:
            kept.append((k, scope, None))
    df = spark.createDataFrame([(*r, "e") for r in rows], "k long, s string, vec array<double>, strip string").repartition(3)
    got = similar.drop_similar(df, "s", "k", "vec", threshold, tile)
    assert sorted(r.k for r in got.collect()) == sorted(k for k, _, _ in kept) and got.columns == df.columns
    assert similar.drop_similar(df.limit(0), "s", "k", "vec", threshold).count() == 0


# --- relevance, doses, citations, graph ---------------------------------------------------------


def test_adaptive_thresholds(spark):
    rows = [("CONTRAINDICATIONS", None, 100, True, 0.42), ("contraindications", None, 200, True, 0.414), ("HOW SUPPLIED", None, 5000, True, 0.57), (None, "Dosing", 1000, False, 0.45), ("x", None, 0, True, 0.5), (None, None, 10, False, 0.5)]
    df = spark.createDataFrame(rows, "t string, p string, n int, l boolean, want double")
    got = df.select("want", relevance.adaptive_threshold(F.col("t"), F.col("p"), F.col("n"), F.col("l")).alias("got")).collect()
    assert all(r.got == pytest.approx(r.want) for r in got)


def test_cascade_of_odd_rows(spark):
    prototypes = spark.createDataFrame([("dosing", [1.0, 0.0]), ("dosing", [0.9, 0.1]), ("warnings", [0.0, 1.0])], "topic string, vector array<double>")
    rows = [(1, None, None, None, None), (2, "Boxed", "", [0.0, 1.0], True), (3, "", "plain", [1.0, 0.0], False), (4, "", "mg daily", [-1.0, -1.0], False), (5, "", "", [1.0], False), (6, "x", "y", [0.4, -0.9], False), (7, "", "", [0.0, 0.0], False)]
    df = spark.createDataFrame(rows, "k int, title string, text string, vector array<double>, is_label boolean")
    got = {r.k: (r.arm, r.best_topic) for r in relevance.cascade(df, prototypes, {"boxed": ["boxed"]}, {}, {"dosing": ["mg daily"]}).collect()}
    assert got == {1: ("dropped", None), 2: ("keyword", "warnings"), 3: ("semantic", "dosing"), 4: ("rescue", None), 5: ("dropped", None), 6: ("borderline", "dosing") if 0.4 / np.hypot(0.4, 0.9) >= 0.38 else ("dropped", "dosing"), 7: ("dropped", None)}
    scored = relevance.cascade(df, prototypes, {}, {}, {})
    assert [r.k for r in relevance.review(scored, 1, "k").collect()] == [6]
    assert relevance.cascade(df.limit(0), prototypes, {}, {}, {}).count() == 0
    assert relevance.cascade(df, prototypes.limit(0), {}, {}, {}).where("arm <> 'dropped'").count() == 0


def test_rules_with_unknown_inputs(spark):
    people = spark.createDataFrame([(1, "a", {"age": 85.0, "weight_kg": 50.0, "creatinine": 1.0}), (2, "a", {"age": 85.0, "weight_kg": None}), (3, "a", {}), (4, "a", {"age": 60.0, "weight_kg": 90.0}), (5, "b", {}), (6, None, None)], "patient_id int, drug string, values map<string,double>")
    criteria = [("age", ">=", 80.0), ("weight_kg", "<=", 60.0), ("creatinine", ">=", 1.5)]
    rules = spark.createDataFrame([("abc", "a", 1, None, criteria), ("none", "a", 2, 1, [])], "rule_id string, drug string, place int, min_matched int, criteria array<struct<field:string,op:string,value:double>>")
    counted = doses.counted_rules(people, rules)
    got = {(r.patient_id, r.rule_id): (r.state, r.n_met, r.missing) for r in counted.collect()}
    assert got[1, "abc"] == ("met", 2, []) and got[2, "abc"] == ("open", 1, ["weight_kg", "creatinine"]) and got[3, "abc"][0] == "open" and got[4, "abc"] == ("not_met", 0, [])
    assert all(state == "not_met" for (_, rule), (state, *_) in got.items() if rule == "none") and len(got) == 8
    first = {r.patient_id: (r.rule_id, r.missing) for r in doses.first_met(counted).collect()}
    assert first[1] == ("abc", []) and first[2] == (None, ["weight_kg", "creatinine"]) and first[4] == (None, [])


def test_pathway_of_the_reference_case(spark):
    rows = [(1, k, c, s, d) for k, (c, s, d) in enumerate([("mra", "continue", "spironolactone"), ("beta_blocker", "consider", "bisoprolol"), ("acei_arb", "consider", None), ("loop_diuretic", "consider", None), (None, "avoid", None), ("statin", "avoid", None)])]
    df = spark.createDataFrame(rows, "patient_id int, place int, class_id string, status string, current_drug string")
    values = {"systolic_bp": F.lit(108.0), "potassium": F.lit(4.8), "egfr": F.lit(42.0), "heart_rate": F.lit(None).cast("double")}
    got = [(r.class_id, r.step, r.phase) for r in doses.pathway(df, values).orderBy("step").collect()]
    assert got == [("acei_arb", 2, "next"), ("beta_blocker", 3, "active"), ("mra", 4, "active")]


def test_terms_with_signs_and_phrases(spark):
    chunks = spark.createDataFrame([(1, "Na+ and K+ levels, Café au lait"), (2, "unna+x ana"), (3, None), (4, "")], "chunk_id int, text string")
    terms = spark.createDataFrame([("na+",), ("k+ levels",), ("caf",), ("au la",), ("",), (None,)], "term string")
    got = {(r.chunk_id, r.term) for r in citations.term_hits(chunks, terms).collect()}
    assert got == {(1, "na+"), (1, "k+ levels"), (1, "caf"), (1, "au la")}


def test_reached_nodes_stop(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("x", "y"), ("a", "a")], "source string, target string")
    seeds = spark.createDataFrame([(1, "a"), (1, "a"), (2, "x"), (3, None), (4, "lonely")], "query_id int, node string")
    got = {(r.query_id, r.node): r.hops for r in guided.reached(edges, seeds, 5).collect()}
    assert got == {(1, "a"): 0, (1, "b"): 1, (1, "d"): 1, (1, "c"): 2, (2, "x"): 0, (2, "y"): 1, (4, "lonely"): 0}
    few = {(r.query_id, r.node) for r in guided.reached(edges, seeds, 5, enough=3).collect()}
    assert (1, "c") not in few and (2, "y") in few


def test_noise_and_judge_of_known_claims(spark):
    rows = [
        (1, "population_constraint", "aspirin", "guideline", "Williams Sr, MD, MACC, FAHA, Joseph Yeboah, MD, MS, FACC, FAHA, Boback Ziaeian, MD, PhD, FACC, FAHA and the American Association.", None),
        (2, "contraindication", "x", "drug_label", "Do not administer within 36 hours of switching from or to another inhibitor.", None),
        (3, "contraindication", "x", "drug_label", "Patients with severe impairment were not included in clinical studies (see CONTRAINDICATIONS).", None),
        (4, "contraindication", None, "drug_label", None, "Do not administer this within 36 hours."), (5, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "k int, claim_type string, drug string, source_type string, evidence string, claim string")
    got = {r.k: (r.verdict, list(r.reasons)) for r in claims.judged(df, drug="drug", source_type="source_type", claim="claim").collect()}
    assert got[1][0] == "reject" and "heuristic_noise" in got[1][1] and got[2] == ("accept", ["heuristic_ok"]) and got[3] == ("reject", ["weak_span"])
    assert got[4] == ("reject", ["missing_drug_on_label_claim"]) and got[5] == ("reject", ["heuristic_noise"])
    study = [("The hazard ratio was 0.8 overall", False), ("Incidence of 5 % in the group", False), ("p < 0.05 was found in all", False), ("The odds ratio favours a lower dose", True), ("short", False)]
    kept = claims.noise_filter(spark.createDataFrame(study, "evidence string, want boolean")).collect()
    assert [r.evidence for r in kept] == [e for e, want in study if want]
