"""Text expressions: sentences, words, token estimates, slugs, stable ids, thresholds, shingles."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits text where SQL engines without lookaround can do so too; never part of a text's words.
MARK = "\x01"


def is_blank(c: Column) -> Column:
    """Null or nothing but spaces."""
    return c.isNull() | (F.trim(c) == "")


def collapsed(text: Column) -> Column:
    """White space runs become one space; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\n\\r\\f]+", " "))


def sentences(text: Column, least: int = 20) -> Column:
    """Sentences of at least that many characters, in order.

    A sentence ends with . ! or ? before a space and a capital, a digit or an opening bracket.
    """
    marked = F.regexp_replace(collapsed(text), "([.!?]) ([A-Z0-9(])", f"$1{MARK}$2")
    return F.filter(F.split(marked, MARK), lambda s: F.length(s) >= least)


def words(text: Column) -> Column:
    """Words between spaces; a blank text has none."""
    return F.filter(F.split(collapsed(text), " "), lambda w: w != "")


#: Characters whose upper case is several characters but whose title case is another single one, and these.
SMALL = "".join(c for c in map(chr, range(0xE0, 0xD800)) if len(c.upper()) > 1 and len(c.title()) == 1 and c.title() != c)
TITLE = "".join(c.title() for c in SMALL)


def upper_each(text: Column) -> Column:
    """Upper case, one character for each, as SQL engines with simple case mapping have it; upper() makes SS of a sharp s."""
    text = F.replace(text, F.lit("\u00df"), F.lit("\u1e9e"))
    each = F.transform(F.split(text, ""), lambda c: F.when(F.length(F.upper(c)) > 1, F.translate(c, SMALL, TITLE)).otherwise(F.upper(c)))
    return F.when(F.length(F.upper(text)) > F.length(text), F.array_join(each, "")).otherwise(F.upper(text))


def lower_each(text: Column) -> Column:
    """Lower case, one character for each, wherever in a word it stands."""
    return F.lower(F.translate(text, "\u03a3\u0130", "\u03c3i"))


def token_estimate(text: Column, per_word: float = 1.3) -> Column:
    """Tokens guessed from the number of words: at least 1, but 0 for a blank text."""
    n = F.size(words(text))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n * F.lit(per_word)).cast("int")))


def slug(c: Column, most: int | None = None) -> Column:
    """Lower-case letters and digits joined by single underscores; "unknown" if nothing is left."""
    clean = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))
    if most is not None:
        clean = F.regexp_replace(F.substring(clean, 1, most), "_+$", "")
    return F.when(clean == "", "unknown").otherwise(clean)


def stable_id(labels: list[Column], uniqueness: list[Column] = (), prefix: str = "", most: int = 48) -> Column:
    """prefix_label_digest: readable slugs of the labels, and 8 hex digits of SHA-1 over label and uniqueness.

    Blank labels and labels without letters or digits are left out. Whole slugs are kept from the
    left while they fit in `most` characters; a first one that is longer is cut.
    """
    parts = F.filter(F.transform(F.array(*[c.cast("string") for c in labels]), lambda c: slug(c)), lambda s: s != "unknown")

    def fit(state: Column, part: Column) -> Column:
        longer = F.when(state.label == "", part).otherwise(F.concat_ws("_", state.label, part))
        full = state.full | ((F.length(longer) > most) & (state.label != ""))
        return F.struct(F.when(full, state.label).otherwise(longer).alias("label"), full.alias("full"))

    fitted = F.aggregate(parts, F.struct(F.lit("").alias("label"), F.lit(False).alias("full")), fit).label
    label = F.regexp_replace(F.substring(fitted, 1, most), "_+$", "")
    label = F.when(label == "", "unknown").otherwise(label)
    bits = [F.when(c.cast("string") != "", c.cast("string")) for c in uniqueness]
    digest = F.substring(F.sha1(F.concat_ws("|", label, *bits).cast("binary")), 1, 8)
    return F.concat_ws("_", *([F.lit(prefix)] if prefix else []), label, digest)


#: What is measured, the phrase before its number, the comparison and the unit.
THRESHOLDS = (
    ("egfr", r"(?i)\beGFR\b.*?(?:less than|below|<|≤|<=)\s*(\d+(?:\.\d+)?)", "<=", "mL/min/1.73m2"),
    ("potassium", r"(?i)\b(?:serum\s+)?potassium\b.*?(?:greater than|above|>|≥|>=)\s*(\d+(?:\.\d+)?)", ">=", "mmol/L"),
)
ANY_THRESHOLD = r"(?i)(less than|below|<|≤|<=|greater than|above|>|≥|>=)\s*(\d+(?:\.\d+)?)\s*(mL/min/1\.73\s*m\s*2|mg/dL|mmol/L|mmHg|bpm|%)?"


def threshold(text: Column) -> Column:
    """struct(metric, operator, value, unit) of the first threshold in a text; null where there is none."""

    def found(metric, operator, value, unit):
        return F.struct(metric.alias("metric"), operator.alias("operator"), value.cast("double").alias("value"), unit.alias("unit"))

    sign = F.lower(F.regexp_extract(text, ANY_THRESHOLD, 1))
    below = sign.isin("less than", "below", "<", "≤", "<=")
    unit = F.regexp_extract(text, ANY_THRESHOLD, 3)
    out = F.when(text.rlike(ANY_THRESHOLD), found(F.lit("unknown"), F.when(below, "<=").otherwise(">="), F.regexp_extract(text, ANY_THRESHOLD, 2), F.when(unit != "", unit)))
    for metric, pattern, operator, kind in reversed(THRESHOLDS):
        named = found(F.lit(metric), F.lit(operator), F.regexp_extract(text, pattern, 1), F.lit(kind))
        out = F.when(text.rlike(pattern), named).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def let(value: Column, body) -> Column:
    """body(value), with value computed once instead of wherever body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(text: Column, size: int = 3) -> Column:
    """Distinct runs of `size` tokens; a shorter text is one shingle, one without tokens has none."""

    def runs(t: Column) -> Column:
        n = F.size(t)
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - size + 1)), lambda i: F.array_join(F.slice(t, i, size), " "))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(each))

    return let(tokens(text), runs)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements of two arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    """The shorter text's share of the longer if that contains it, else the Jaccard of their words."""
    x, y = F.lower(collapsed(a)), F.lower(collapsed(b))
    short, long = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    return F.when((x == "") | (y == ""), 0.0).when(x.contains(y) | y.contains(x), short / long).otherwise(jaccard(words(x), words(y)))


def needed(pattern: str) -> tuple[str, ...]:
    """Lower-case strings of which every match of the pattern, in any case, has one; none if that can't be told.

    The longest run of plain characters outside of groups, else the runs of a group's alternatives.
    For patterns without nested groups; a text without these strings need not be searched.
    """

    def run(part: str) -> str:
        plain = re.sub(r"\((?:[^()\\]|\\.)*\)[?*+]?|\[[^\]]*\][?*+]?|\\.[?*+]?|[^\\](?:[?*]|\{[^}]*\})|[.^$+]", "\0", part)
        return "" if re.search(r"[|()\[\]\\]", plain) else max(plain.split("\0"), key=len).lower()

    if len(run(pattern)) > 2:
        return (run(pattern),)
    for group in re.findall(r"\((?:\?:)?(?!\?)((?:[^()\\]|\\.)*)\)(?![?*{])", pattern):
        runs = tuple(run(part) for part in group.split("|"))
        if all(len(r) > 2 for r in runs):
            return runs
    return ()
