"""Vector expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero norm counts as 1, vectors of different lengths have 0."""
    one = lambda n: F.when(n == 0, 1.0).otherwise(n)
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(dot(a, b) / (one(norm(a)) * one(norm(b))))


def hashed_embedding(tokens: Column, dims: int = 384) -> Column:
    """Signed feature hashing of tokens and token pairs, with Euclidean norm 1 (or all zero)."""
    pairs = F.transform(F.slice(tokens, F.lit(2), F.size(tokens)), lambda t, i: F.concat_ws(" ", F.get(tokens, i), t))
    hashes = F.transform(F.concat(tokens, pairs), lambda t: F.xxhash64(t))
    signed = F.transform(hashes, lambda h: F.struct(F.pmod(h, F.lit(dims)).cast("int").alias("at"), F.when(F.shiftright(h, 40).bitwiseAND(F.lit(1)) == 0, 1.0).otherwise(-1.0).alias("w")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.aggregate(F.filter(signed, lambda s: s["at"] == d), F.lit(0.0), lambda a, s: a + s["w"]))
    length = F.get(F.transform(F.array(raw), norm), F.lit(0))
    return F.transform(raw, lambda x: x / F.when(length == 0, 1.0).otherwise(length))
