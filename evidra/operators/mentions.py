"""Mentions of terms in whole texts: spans by an automaton over a dictionary, longest spans, negation.

The dictionary becomes one automaton of all terms, whose size is checked before it is broadcast; a
text is read once, whatever the number of terms.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.functions.text import needed

#: Characters of all terms that may be broadcast.
MOST_CHARACTERS = 20_000_000
SPANS = "array<struct<kind:string,term:string,start:int,end:int>>"
#: Entity patterns by kind, read in any case.
ENTITY_PATTERNS = {
    "lab": (r"\beGFR\b", r"\bserum potassium\b", r"\bpotassium\b", r"\bcreatinine\b", r"\bHbA1c\b", r"\bblood pressure\b"),
    "condition": (
        r"\bheart failure\b", r"\bchronic kidney disease\b", r"\bCKD\b", r"\bdiabetes mellitus\b", r"\btype 2 diabetes\b", r"\bhypertension\b", r"\batrial fibrillation\b",
        r"\bhyperkalemia\b", r"\brenal impairment\b", r"\brenal dysfunction\b", r"\bcardiogenic shock\b", r"\bbleeding\b",
    ),
    "action": (r"\bnot recommended\b", r"\bcontraindicated\b", r"\bavoid\b", r"\brecommended\b", r"\bmonitor\b", r"\badjust\b", r"\btitrate\b"),
    "threshold": (
        r"\beGFR\s*(?:is\s*)?(?:less than|below|<|≤|<=)\s*\d+", r"\bserum potassium\s*(?:is\s*)?(?:greater than|above|>|≥|>=)\s*\d+(?:\.\d+)?",
        r"\bpotassium\s*(?:is\s*)?(?:greater than|above|>|≥|>=)\s*\d+(?:\.\d+)?", r"\b\d+(?:\.\d+)?\s*(?:mL/min/1\.73\s*m\s*2|mg/dL|mmol/L)\b",
    ),
}
#: What negates the mention behind it, with one word between at most, in so many characters.
NEGATIONS, NEGATION_REACH = ("no", "not", "not on", "without", "denies"), 24
_LOWER = {k: k + 32 for k in range(65, 91)}


def _whole(text: str, start: int, end: int) -> bool:
    """Whether a span ends at letters' and digits' borders on both sides."""
    return not (start and text[start - 1].isalnum() and text[start].isalnum()) and not (end < len(text) and text[end].isalnum() and text[end - 1].isalnum())


def longest_spans(found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Of spans (start, end, kind, term) that overlap, the leftmost, then the longest, then the least kind and term."""
    out, behind = [], 0
    for span in sorted(found, key=lambda s: (s[0], -s[1], s[2], s[3])):
        if span[0] >= behind:
            out.append(span)
            behind = span[1]
    return out


def dictionary_spans(rows: DataFrame, terms: DataFrame, text: str = "text", term: str = "term", kind: str = "kind", overlapping: bool = False, whole_words: bool = True) -> Column:
    """A column of spans of all terms in the text, as whole words unless told otherwise, A to Z in any case; code points, end exclusive.

    Spans come in order of start, longer ones first. Without `overlapping` the leftmost longest
    stay. Blank and null terms are no terms; a term of two kinds has a span each. Null texts have no
    spans. Raises where the dictionary isn't small.
    """
    listed = terms.select(F.col(term).alias("t"), F.coalesce(F.col(kind), F.lit("")).alias("k")).where("trim(t) <> ''").distinct()
    size = listed.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    if size > MOST_CHARACTERS:
        raise ValueError(f"a dictionary of {size} characters is too large to broadcast")
    by_term: dict[str, list[tuple[str, str]]] = {}
    for r in listed.collect():
        by_term.setdefault(r["t"].translate(_LOWER), []).append((r["k"], r["t"]))
    shared = rows.sparkSession.sparkContext.broadcast(sorted(by_term.items()))

    @F.pandas_udf(SPANS)
    def scan(texts: pd.Series) -> pd.Series:
        import ahocorasick

        if not shared.value:
            return pd.Series([[]] * len(texts))
        automaton = ahocorasick.Automaton()
        for low, names in shared.value:
            automaton.add_word(low, (len(low), names))
        automaton.make_automaton()
        out = []
        for t in texts:
            low, found = (t or "").translate(_LOWER), []
            for last, (n, names) in automaton.iter(low):
                if not whole_words or _whole(low, last + 1 - n, last + 1):
                    found += [(last + 1 - n, last + 1, k, name) for k, name in names]
            found = sorted(found, key=lambda s: (s[0], -s[1], s[2], s[3])) if overlapping else longest_spans(found)
            out.append([{"kind": k, "term": name, "start": s, "end": e} for s, e, k, name in found])
        return pd.Series(out)

    return scan(F.col(text))


def pattern_spans(text: Column, patterns: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Spans of every match of the entity patterns, by kind and pattern in their order, then by place; term is the matched text.

    A pattern is only searched in texts with the plain characters that its matches need.
    """
    listed = [(kind, p) for kind, found in (patterns or ENTITY_PATTERNS).items() for p in found]

    @F.pandas_udf(SPANS)
    def scan(texts: pd.Series) -> pd.Series:
        compiled = [(kind, re.compile(p, re.IGNORECASE), needed(p)) for kind, p in listed]
        out = []
        for t in texts:
            t = t or ""
            # What Python takes as i or s in any case is i or s here too.
            low = (t if t.isascii() else t.replace("\u0130", "i").replace("\u0131", "i").replace("\u017f", "s")).lower()
            out.append([{"kind": k, "term": m.group(0), "start": m.start(), "end": m.end()} for k, p, some in compiled if not some or any(s in low for s in some) for m in p.finditer(t)])
        return pd.Series(out)

    return scan(text)


def entity_id(kind: Column, value: Column) -> Column:
    """kind and 12 digits of the SHA-1 of kind and value, lower-case with single spaces."""
    clean = F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))
    return F.concat_ws("_", kind, F.substring(F.sha1(F.concat_ws("|", kind, clean).cast("binary")), 1, 12))


def is_negated(text: Column, start: Column, negations: tuple[str, ...] = NEGATIONS, reach: int = NEGATION_REACH) -> Column:
    """Whether a negation, and one more word at most, stands right before a span. Only `reach` characters before it count."""
    before = F.substring(text, F.greatest(start - reach, F.lit(0)) + 1, F.least(start, F.lit(reach)))
    return F.lower(before).rlike(r"\b(?:" + "|".join(map(re.escape, negations)) + r")\b(?:\s+\w+)?\s*$")


def mention_status(rows: DataFrame, spans: str = "spans", text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, kind, term, n, n_negated, allowed: mentions of a term in a row; allowed where one isn't negated."""
    each = rows.select(F.col(key).alias("key"), F.col(text).alias("whole"), F.inline(spans))
    marked = each.select("key", "kind", "term", is_negated(F.col("whole"), F.col("start")).alias("negated"))
    counted = marked.groupBy("key", "kind", "term").agg(F.count(F.lit(1)).alias("n"), F.count_if("negated").alias("n_negated"))
    return counted.select(F.col("key").alias(key), "kind", "term", "n", "n_negated", (F.col("n_negated") < F.col("n")).alias("allowed"))
