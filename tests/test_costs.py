"""Cheaper forms of expressions give what the plain ones give."""

import re

import pytest
from pyspark.sql import functions as F

from evidra.functions.text import needed
from evidra.operators import claims, dedup, mentions

LISTED = [p for found in mentions.ENTITY_PATTERNS.values() for p in found] + list(claims.FRONT_MATTER + claims.WEAK_SPANS + claims.STUDY_PATTERNS)


def test_needed_strings():
    assert needed(r"\bkeywords?\b") == ("keyword",) and needed(r"a(?:bcd|efg)?h") == () and needed(r"\d(?:mg/dL|m\.x|mmol)") == ()
    assert needed(r"\d+ (?:mg/dL|mmol)") == ("mg/dl", "mmol") and needed(r"abcd|efgh") == () and needed(r"(abc(d)e)") == () and needed(r"x{10,20}(?!abc|def)") == ()
    texts = ["eGFR is below 30, SERUM POTASSIUM > 5.5; 12.5 mmol/L", "Table 12 keyword permissions et al.", "see warnings", "hazard  ratio p<0.5", "Type 2 dİabetes rıſk"]
    for p in LISTED:
        for t in texts:
            assert not re.search(p, t, re.IGNORECASE) or not needed(p) or any(s in t.lower().replace("i̇", "i") for s in needed(p))


def test_pattern_spans_find_what_plain_patterns_find(spark):
    texts = ["eGFR is below 30; no HBA1C, Potassium>=5.5 and 3 mMol/L", "dİabetes mellitus, rısk, hypertenſion, bleİding", "", None, "monitors avoid"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").select("n", mentions.pattern_spans(F.col("text")).alias("s"))
    got = {r["n"]: [(x["kind"], x["term"], x["start"], x["end"]) for x in r["s"]] for r in rows.collect()}
    plain = lambda t: [(k, m.group(0), m.start(), m.end()) for k, found in mentions.ENTITY_PATTERNS.items() for p in found for m in re.finditer(p, t, re.IGNORECASE)]
    assert got == {n: plain(t or "") for n, t in enumerate(texts)} and len(got[1]) > 1


def test_minhash_is_the_expression_it_was(spark):
    rows = spark.createDataFrame([(1, "a b c d e f " * 3), (2, "one"), (3, " "), (4, None), (5, " ".join(f"w{n}" for n in range(9000)))], "n int, text string")
    plain = {r["n"]: r["x"] for r in rows.select("n", dedup.minhash(F.col("text")).alias("x")).collect()}
    assert {r["n"]: r["x"] for r in dedup.with_minhash(rows, "text", "x").collect()} == plain and plain[3] == plain[4] == []


@pytest.mark.parametrize("pattern", claims.FRONT_MATTER)
def test_patterns_are_searched_where_they_can_match(pattern):
    assert needed(pattern) or pattern == r"\bet\s+al\.?\b"


def test_co_occurring_deals_pairs_to_more_tasks(spark):
    """A task's pairs grew with the tables; a chunk of all entities was one task's."""
    from collections import Counter

    from evidra.operators import graph

    links = [(c, e) for c in range(30) for e in range(c % 7)] + [(99, e) for e in range(60)] + [(99, 3), (None, 1), (1, None)]
    rows = spark.createDataFrame(links, "chunk long, e long")
    df = graph.co_occurring(rows, rows, "chunk", "e", k=2, per_task=100)
    n = Counter((a, b) for c, a in set(links) for d, b in set(links) if c == d and None not in (c, a, b) and a != b)
    want = []
    for seed in {a for a, _ in n}:
        want += [(seed, b, -m, k + 1) for k, (m, b) in enumerate(sorted((-m, b) for (a, b), m in n.items() if a == seed)[:2])]
    assert sorted(map(tuple, df.select("seed", "e", "n", "rank").collect())) == sorted(want)
    assert df.rdd.getNumPartitions() >= 36
