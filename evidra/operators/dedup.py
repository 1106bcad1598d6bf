"""Duplicates: first row wins, reports, MinHash signatures and buckets, greedy removal inside a scope."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.functions.text import collapsed, let, shingles

HASHES = 64
BANDS = 8
#: Share of equal places of two signatures from which rows are near copies; claims take the higher one.
SIGNATURE_SIMILARITY, CLAIM_SIMILARITY = 0.94, 0.97


def text_key(text: Column) -> Column:
    """SHA-256 of the lower-case text with collapsed white space."""
    return F.sha2(F.lower(collapsed(text)), 256)


def first_wins(df: DataFrame, key: Column, order: list[str], columns: list[str]) -> DataFrame:
    """The first row of each key in that order, and how many rows the key has; one partial aggregate."""
    row = F.min_by(F.struct(*columns), F.struct(*order)).alias("r")
    return df.groupBy(key.alias("_key")).agg(row, F.count(F.lit(1)).alias("n_rows")).select("r.*", "n_rows")


def repeated_keys(df: DataFrame, key: Column, order: str) -> DataFrame:
    """key, n_rows, first of every key with more than one row."""
    return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n_rows"), F.min(order).alias("first")).where("n_rows > 1")


def best_wins(df: DataFrame, key: Column, score: str, text: str, order: str, columns: list[str]) -> DataFrame:
    """Per key the row with the highest score; ties go to the shorter text, then to the earlier row."""
    rank = F.struct((-F.col(score)).alias("a"), F.length(text).alias("b"), F.col(order).alias("c"))
    return df.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*columns), rank).alias("r")).select("r.*")


#: Constants of xxHash64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x, n: int):
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def _ended(h):
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def hashed_again(x: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """xxhash64(seed, x) as Spark has it, of an int and a long, for all of both: one row for each seed."""
    h = np.full(len(seeds), 42, np.uint64) + _P5 + np.uint64(4)
    h = _ended(_turned(h ^ seeds.astype(np.uint64) * _P1, 23) * _P2 + _P3)
    part = _turned(x.astype(np.uint64) * _P2, 31) * _P1
    return _ended(_turned((h + _P5 + np.uint64(8))[:, None] ^ part, 27) * _P1 + _P4).view(np.int64)


def minhash(text: Column, size: int = 3, hashes: int = HASHES) -> Column:
    """MinHash signature of word shingles: the least of xxhash64(seed, shingle's hash) per seed; empty without words."""
    def least(s: Column) -> Column:
        hashed = F.transform(s, lambda x: F.xxhash64(x))
        per_seed = let(hashed, lambda h: F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda seed: F.array_min(F.transform(h, lambda x: F.xxhash64(seed, x)))))
        return F.when(F.size(s) == 0, F.array().cast("array<bigint>")).otherwise(per_seed)

    return let(shingles(text, size), least)


def with_minhash(rows: DataFrame, text: str, into: str, size: int = 3, hashes: int = HASHES) -> DataFrame:
    """rows without the text column and with its minhash() as the last one; numpy hashes the shingles' hashes in the task that reads the text."""
    others = [c for c in rows.columns if c != text]
    hashed = rows.select(*others, F.transform(shingles(F.col(text), size), lambda x: F.xxhash64(x)).alias(into))
    seeds = np.arange(hashes)

    def run(batches):
        for b in batches:
            found, parts = b.column(b.num_columns - 1), []
            flat, ends = found.flatten().to_numpy(), np.cumsum(np.diff(found.offsets.to_numpy()))
            for start, end in zip([0, *ends], ends):
                if end > start:
                    best = [hashed_again(flat[k : min(k + 4096, end)], seeds).min(1) for k in range(start, end, 4096)]
                    parts.append(np.min(best, axis=0))
            sizes = np.where(np.diff(ends, prepend=0) > 0, hashes, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], names)

    names = [*others, into]
    return hashed.mapInArrow(run, T.StructType([*[T.StructField(c, rows.schema[c].dataType) for c in others], T.StructField(into, T.ArrayType(T.LongType()))]))


def signature_similarity(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures; 0 where either is empty."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(equal / F.size(a))


def bands(signature: Column, n: int = BANDS, hashes: int = HASHES) -> Column:
    """One bucket key per band of the signature; signatures that agree on a whole band share a key."""
    rows = hashes // n
    keys = lambda m: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.xxhash64(b, F.slice(m, b * rows + 1, F.lit(rows))))
    return let(signature, keys)


def bucket_report(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, n_shared: in how many bands a document shares its bucket with a different text.

    Equal texts count once, so a group of copies is one text; buckets only carry counts.
    """
    keyed = docs.select(F.col(doc).alias("d"), text_key(F.col(text)).alias("key"), F.col(text).alias("t"))
    first = keyed.groupBy("key").agg(F.min(F.struct("d", "t")).alias("r")).select("key", F.col("r.t").alias("t"))
    texts = with_minhash(first, "t", "x").select("key", F.explode(bands(F.col("x"))).alias("bucket"))
    shared = texts.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = texts.join(shared, "bucket", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n_shared"))
    return keyed.select("d", "key").join(counts, "key", "left").select(F.col("d").alias(doc), F.coalesce("n_shared", F.lit(0)).alias("n_shared"))


def greedy_dedup(df: DataFrame, scope: str, order: str, text: str, similarity: float = SIGNATURE_SIMILARITY, size: int = 3) -> DataFrame:
    """df without rows that resemble an earlier kept row of their scope.

    Rows are tried in order and compared with kept ones only, so A, B, C with A like B and B like C
    but A unlike C keep A and C. Candidates share a band of their signatures, and are compared by the
    share of equal places of those. Blank texts stay. A
    scope is one document's chunks, which bounds the group; order must be unique inside it.
    """
    marked = with_minhash(df.select(F.col(scope).alias("s"), F.col(order).alias("o"), F.col(text).alias("t")), "t", "x", size).withColumn("b", F.when(F.size("x") > 0, bands(F.col("x"))).otherwise(F.array().cast("array<bigint>")))

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        buckets, kept = {}, []
        for o, x, b in rows.sort_values("o")[["o", "x", "b"]].itertuples(index=False):
            near = {k for key in b for k in buckets.get(key, ())}
            if any((kept[k][1] == x).mean() >= similarity for k in near):
                continue
            for key in b:
                buckets.setdefault(key, []).append(len(kept))
            kept.append((o, x))
        return pd.DataFrame({"s": [rows["s"].iloc[0]] * len(kept), "o": [o for o, _ in kept]})

    types = f"s {df.schema[scope].dataType.simpleString()}, o {df.schema[order].dataType.simpleString()}"
    stays = marked.groupBy("s").applyInPandas(keep, types)
    return df.join(stays.select(F.col("s").alias(scope), F.col("o").alias(order)), [scope, order], "left_semi")
