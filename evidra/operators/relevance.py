"""Which sections matter: keywords, then similarity to topic prototypes, then a borderline queue, then cues in the text.

Prototypes are a small table, a few vectors a topic. They become one matrix, whose size is checked
before it is broadcast, and sections are scored in batches by matrix products.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least similarity of a section by its title (labels) and by topic (guidelines), of others, and of the borderline.
TITLE_THRESHOLDS = {
    "BOXED WARNING": 0.40, "BLACK BOX WARNING": 0.40, "CONTRAINDICATIONS": 0.42, "WARNINGS AND PRECAUTIONS": 0.45, "DRUG INTERACTIONS": 0.45, "DOSAGE AND ADMINISTRATION": 0.48,
    "RENAL IMPAIRMENT": 0.48, "INDICATIONS AND USAGE": 0.50, "ADVERSE REACTIONS": 0.50, "USE IN SPECIFIC POPULATIONS": 0.48, "CLINICAL PHARMACOLOGY": 0.55, "CLINICAL STUDIES": 0.55,
    "DESCRIPTION": 0.58, "HOW SUPPLIED": 0.60,
}
TOPIC_THRESHOLDS = {
    "contraindications": 0.42, "warnings": 0.44, "drug interactions": 0.44, "monitoring": 0.46, "dosing": 0.48, "renal dysfunction": 0.46, "hyperkalemia": 0.44, "recommendations": 0.50,
    "drug therapy": 0.50, "heart failure phenotypes": 0.50, "atrial fibrillation": 0.50, "hypertension": 0.52, "diabetes": 0.52, "comorbidities": 0.52, "biomarkers": 0.54,
    "liver function": 0.54, "mortality": 0.55, "hospitalization": 0.55,
}
LOW = 0.38
#: Texts of so many characters relax a threshold, by so much for each thousand characters, at most so much.
LONG_TEXT, RELAXED, MOST_RELAXED = 200, 0.03, 0.05
#: Numbers in the prototypes' matrix that may be broadcast.
MOST_NUMBERS = 4_000_000


def _some(tests: list[Column]) -> Column:
    return reduce(Column.__or__, tests, F.lit(False))


def adaptive_threshold(title: Column, topic: Column, n_chars: Column, is_label: Column, otherwise: float = 0.50) -> Column:
    """The least similarity for a section: by title on labels, by topic elsewhere; up to RELAXED less for long texts."""
    case = lambda key, values: reduce(lambda now, kv: F.when(key == kv[0], kv[1]).otherwise(now), values.items(), F.lit(otherwise))
    base = F.when(is_label, case(F.upper(F.coalesce(title, F.lit(""))), TITLE_THRESHOLDS)).otherwise(case(F.lower(F.coalesce(topic, F.lit(""))), TOPIC_THRESHOLDS))
    less = F.when(n_chars >= LONG_TEXT, F.least(F.lit(RELAXED), n_chars / 1000 * RELAXED)).otherwise(0.0)
    return F.greatest(base - less, base - MOST_RELAXED)


def keyword_topics(title: Column, text: Column, aliases: dict[str, list[str]], in_text: dict[str, list[str]] | None = None) -> Column:
    """All names with an alias in the title or, of in_text, a term in the text, in the order of both lists; array<string>."""
    head, body = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    tests = {name: [head.contains(a.lower()) for a in found] for name, found in aliases.items()}
    for name, found in (in_text or {}).items():
        tests.setdefault(name, []).extend(body.contains(t.lower()) for t in found)
    return F.array_compact(F.array(*[F.when(_some(t), F.lit(name)) for name, t in tests.items()]))


def prototype_matrix(prototypes: DataFrame, topic: str = "topic", vector: str = "vector") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Topics in order, each row's topic and the rows with norm 1. Raises where the matrix isn't small."""
    size = prototypes.agg(F.coalesce(F.sum(F.size(vector)), F.lit(0))).first()[0]
    if size > MOST_NUMBERS:
        raise ValueError(f"prototypes of {size} numbers are too many to broadcast")
    rows = prototypes.select(F.col(topic).alias("t"), F.col(vector).cast("array<double>").alias("v")).where("size(v) > 0").orderBy("t", "v").collect()
    topics = sorted({r["t"] for r in rows})
    x = np.array([r["v"] for r in rows], np.float64) if rows else np.zeros((0, 1))
    return topics, np.array([topics.index(r["t"]) for r in rows], int), x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def best_topic(sections: DataFrame, prototypes: DataFrame, vector: str = "vector", digits: int = 6) -> Column:
    """A column struct(best_topic, best_score, scores): a section's greatest cosine to each topic's prototypes, and the best of them.

    scores are in the topics' order. Of equal scores the first topic is best; without a score over 0
    there is none. Null vectors, and those of another length, have 0 for every topic.
    """
    topics, owner, matrix = prototype_matrix(prototypes)
    first = np.searchsorted(owner, np.arange(len(topics)))

    @F.pandas_udf("best_topic string, best_score double, scores array<double>")
    def score(vectors: pd.Series) -> pd.DataFrame:
        fits = np.array([v is not None and len(v) == matrix.shape[1] for v in vectors], bool)
        out = np.zeros((len(vectors), len(topics)))
        if fits.any() and len(topics):
            x = np.stack([np.asarray(v, np.float64) for v in vectors[fits]])
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            out[fits] = np.round(np.maximum.reduceat(x @ matrix.T, first, axis=1), digits) + 0.0
        best = out.argmax(1) if len(topics) else np.zeros(len(vectors), int)
        top = out.max(1) if len(topics) else np.zeros(len(vectors))
        return pd.DataFrame({"best_topic": [topics[b] if s > 0 else None for b, s in zip(best, top)], "best_score": np.maximum(top, 0.0), "scores": list(out)})

    return score(F.col(vector))


def cascade(sections: DataFrame, prototypes: DataFrame, aliases: dict[str, list[str]], in_text: dict[str, list[str]], cues: dict[str, list[str]], low: float = LOW, title: str = "title", text: str = "text", vector: str = "vector", is_label: str = "is_label") -> DataFrame:
    """sections with arm, topics, best_topic, best_score and threshold.

    Arms, the first that fits: keyword (names in the title or terms in the text), semantic (the best
    score reaches its adaptive threshold), borderline (it reaches `low`), rescue (a cue in title or
    text), dropped. topics are the names of the keywords or cues, the best topic for semantic, none
    else. Only keyword-free sections need a vector. The borderline queue is for a reviewer; see review().
    """
    found = keyword_topics(F.col(title), F.col(text), aliases, in_text)
    whole = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))
    rescued = keyword_topics(whole, F.lit(""), cues)
    scored = sections.withColumn("keywords", found).withColumn("probe", best_topic(sections, prototypes, vector))
    own = F.col("probe.best_score")
    limit = adaptive_threshold(F.col(title), F.col("probe.best_topic"), F.length(F.coalesce(text, F.lit(""))), F.coalesce(is_label, F.lit(False)))
    arm = F.when(F.size("keywords") > 0, "keyword").when(own >= limit, "semantic").when(own >= low, "borderline").when(F.size(rescued) > 0, "rescue").otherwise("dropped")
    none = F.array().cast("array<string>")
    topics = F.when(F.col("arm") == "keyword", F.col("keywords")).when(F.col("arm") == "semantic", F.array("probe.best_topic")).when(F.col("arm") == "rescue", rescued).otherwise(none)
    out = scored.withColumn("threshold", limit).withColumn("arm", arm).withColumn("topics", topics)
    return out.select(*sections.columns, "arm", "topics", "probe.best_topic", "probe.best_score", "threshold")


def review(scored: DataFrame, most: int, key: str) -> DataFrame:
    """The borderline sections that a reviewer sees: the `most` of the greatest scores, ties to the smaller key."""
    return scored.where("arm = 'borderline'").orderBy(F.desc("best_score"), F.asc(key)).limit(most)


def arm_counts(scored: DataFrame) -> DataFrame:
    """arm, n, share: how many sections each arm has decided."""
    n = scored.groupBy("arm").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("arm", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))
