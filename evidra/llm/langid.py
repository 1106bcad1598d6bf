"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text becomes a vector of hashed byte 2- and 3-grams of its lower-cased letters, weighted by
(1 + log tf) * idf and normalised. Per language, spherical k-means finds several centroids. A text
gets the language of the centroid with the largest cosine, and is rejected where even that cosine
stays under the centroid's limit for texts of its length, under `min_cosine`, or where it has no
letter. Limits are learned from cosines of the training sample, whole texts and their beginnings:
SLACK times a low quantile. Length is the power of two of distinct n-grams, so that a word
repeated is as short as the word. Under SHORT of them foreign and clean texts have the same
cosines, and only `min_cosine` rejects.

The centroids and idf are fitted on a bounded sample of labelled rows: at most `per_lang` expected
rows a language and `max_rows` overall (but one per language at least), drawn by a hash of the id. Only the sample's vectors reach
the driver, and the limits are aggregated where the sample is read; every text is then scored where it is read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm._common import tidy
from evidra.llm.quality import fold

DIMS = 2048
PER_LANG = 1000
MAX_ROWS = 20_000
CENTROIDS = 4
MIN_COSINE = 0.05
QUANTILE, SLACK = 0.01, 0.6
SHORT = 64
#: Sample texts that a limit is learned from at least; with fewer, the limit of all centroids holds.
LEAST_TEXTS = 20
#: Characters that beginnings of sample texts have.
BEGINNINGS = tuple(64 << k for k in range(7))
SIZES = DIMS.bit_length()
#: ASCII bytes other than letters become spaces; bytes of other letters stay.
FOLDED = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def counts(text: str | None) -> np.ndarray:
    """Hashed n-gram counts; runs of spaces count as one."""
    raw = b" ".join((text or "").lower().encode("utf-8", "replace").translate(FOLDED).split())
    a = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint32)
    if not raw:
        return np.zeros(DIMS, np.float32)
    two = a[:-1] * np.uint32(0x9E3779B1) + a[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + a[2:] * np.uint32(0x27D4EB2F) + np.uint32(1)
    both = np.concatenate([two, three])
    return np.bincount((both ^ (both >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(21), minlength=DIMS).astype(np.float32)


def letters(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def weigh(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; fewer centroids where there are fewer rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        new = np.stack([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))])
        c = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
    return c


class Centroids:
    def __init__(self, langs: list[str], idf: np.ndarray, matrix: np.ndarray):
        self.langs, self.idf, self.matrix = langs, idf.astype(np.float32), matrix.astype(np.float32)
        self.limits = np.zeros((len(langs), SIZES))

    def places(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid, power of two of distinct n-grams and cosine of each text."""
        best, size, cos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for k in range(0, len(texts), 256):
            tf = np.stack([counts(t) for t in texts[k : k + 256]])
            sims = weigh(tf, self.idf) @ self.matrix.T
            best.append(sims.argmax(1))
            size.append(np.log2(np.maximum((tf > 0).sum(1), 1)).astype(np.int64))
            cos.append(sims[np.arange(len(tf)), best[-1]])
        return np.concatenate(best), np.concatenate(size), np.clip(np.concatenate(cos), 0, 1).astype(float)

    def nearest(self, texts) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """Language, cosine and limit of the nearest centroid; ties go to the first language by name."""
        if not self.langs:
            return [None] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        best, size, cos = self.places(texts)
        return [self.langs[b] for b in best], cos, self.limits[best, size]


def train(docs: DataFrame, per_lang: int = PER_LANG, max_rows: int = MAX_ROWS, centroids: int = CENTROIDS, doc: str = "doc_id", text: str = "text", lang: str = "lang", held_out_fold: tuple[int, int] | None = (3, 1)) -> Centroids:
    """Fit on documents with a language outside the held-out fold."""
    rows = docs.select(F.col(doc).alias("k"), F.col(lang).alias("y"), F.col(text).alias("t")).where("y is not null")
    if held_out_fold:
        rows = rows.where(fold(F.col("k"), held_out_fold[0]) != held_out_fold[1])
    place = F.pmod(F.xxhash64(F.coalesce(F.col("k").cast("string"), F.lit("")), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sizes = rows.groupBy("y").agg(F.count(F.lit(1)).alias("count"), F.min(place).alias("least")).collect()
    if not sizes:
        return Centroids([], np.ones(DIMS), np.zeros((0, DIMS)))
    want, most = max(1, min(per_lang, max_rows // len(sizes))), 2 * max(max_rows, len(sizes))
    # One row of each language at least, the one that comes first.
    share = docs.sparkSession.createDataFrame([(r["y"], max(r["least"], min(1.0, want / r["count"]))) for r in sizes], "y string, share double")

    @F.pandas_udf("binary")
    def vector(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: np.minimum(counts(t), 65535).astype(np.uint16).tobytes() if letters(t) else None)

    # A row per language in share; the sample has `want` rows a language at the median, and the
    # limit bounds it where one id repeats.
    sample = rows.join(F.broadcast(share), "y").where(place <= F.col("share")).select("k", "y", "t")
    got = sample.limit(most).select("k", "y", vector("t").alias("v")).where("v is not null").orderBy("y", "k", "v").toPandas()
    if not len(got):
        return Centroids([], np.ones(DIMS), np.zeros((0, DIMS)))
    tf, y = np.frombuffer(b"".join(got["v"]), np.uint16).reshape(-1, DIMS), got["y"].to_numpy()
    del got
    idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(0))) + 1).astype(np.float32)
    langs, found = [], []
    for n, name in enumerate(sorted(set(y))):  # a language at a time, to keep the driver small
        c = cluster(weigh(tf[y == name].astype(np.float32), idf), centroids, n)
        langs += [name] * len(c)
        found.append(c)
    model = Centroids(langs, idf, np.concatenate(found))
    del tf
    tidy()
    model.limits = learn_limits(model, sample.select("t").limit(most))
    return model


def learn_limits(model: Centroids, sample: DataFrame) -> np.ndarray:
    """The least cosine of each centroid and size. sample: t, texts of known languages.

    A size without enough texts has the limit of the next smaller one.
    """

    @F.pandas_udf("array<struct<c:int,size:int,cos:double>>")
    def cosines(texts: pd.Series) -> pd.Series:
        cut = [[t] + [t[:n] for n in BEGINNINGS if n < len(t)] if letters(t) else [] for t in texts]
        found = zip(*model.places([t for parts in cut for t in parts if letters(t)]))
        return pd.Series([[dict(zip(("c", "size", "cos"), next(found))) for t in parts if letters(t)] for parts in cut])

    each = sample.select(F.inline(cosines("t"))).where(F.col("size") >= SHORT.bit_length() - 1)
    rows = each.rollup("size", "c").agg(F.count(F.lit(1)).alias("n"), F.percentile("cos", F.lit(QUANTILE)).alias("low")).where(F.col("size").isNotNull() & (F.col("n") >= LEAST_TEXTS)).collect()
    low = {(r["size"], r["c"]): SLACK * r["low"] for r in rows}
    limits, shared = np.zeros((len(model.langs), SIZES)), 0.0
    for size in range(SIZES):
        shared = low.get((size, None), shared)
        limits[:, size] = [low.get((size, c), shared) for c in range(len(limits))]
    return limits


def identify(docs: DataFrame, model: Centroids, min_cosine: float = MIN_COSINE, text: str = "text"):
    """A column struct(lang, score, rejected) for the text column; see predict_language()."""

    @F.pandas_udf("lang string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        lang, score, limit = model.nearest(texts.tolist())
        tidy()
        known = np.array([letters(t) for t in texts], dtype=bool) & np.array([x is not None for x in lang], dtype=bool)
        return pd.DataFrame({"lang": [x if ok else "und" for x, ok in zip(lang, known)], "score": np.where(known, score, 0.0), "rejected": ~known | (score < np.maximum(limit, min_cosine))})

    return predict(F.col(text))


def predict_language(docs: DataFrame, min_cosine: float = MIN_COSINE, doc: str = "doc_id", text: str = "text", lang: str = "lang", held_out_fold: tuple[int, int] = (3, 1)) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score, rejected.

    Null texts and texts without a letter are `und` with score 0 and rejected; texts too far from
    all that was learned are rejected with the nearest language as lang_pred. Null languages are
    not learned from; null ids hash as the empty text. Repeated documents keep a row each. With
    nothing to learn from, every text is `und`; an empty table gives no rows. Of docs only id,
    text and language are read.
    """
    model = train(docs, doc=doc, text=text, lang=lang, held_out_fold=held_out_fold)
    rows = docs.select(F.col(doc), (fold(F.col(doc), held_out_fold[0]) == held_out_fold[1]).alias("held_out"), identify(docs, model, min_cosine, text).alias("p"))
    return rows.select(doc, "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))


def keep_identified(docs: DataFrame, min_cosine: float = MIN_COSINE, text: str = "text") -> DataFrame:
    """docs, all columns, without the documents that language identification rejects."""
    model = train(docs, text=text)
    return docs.where(~identify(docs, model, min_cosine, text)["rejected"])
