"""Costly expressions stand once in a plan, as each place is computed again."""

from pyspark.sql import functions as F

from evidra.operators import chunking, claims


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_blocks_are_counted_once(spark):
    rows = spark.createDataFrame([("a b\nc",)], "text string").select(F.split("text", "\n").alias("blocks"))
    assert optimized(rows.select(chunking.merged_blocks(F.col("blocks"), 5).alias("x"))).count("regexp_replace") == 1
    assert optimized(rows.select(chunking.with_overlap(F.col("blocks"), 5).alias("x"))).count("regexp_replace") == 1


def test_noise_is_computed_once(spark):
    rows = spark.createDataFrame([("x", "other", "", "drug_label")], "evidence string, claim_type string, drug string, source_type string")
    assert optimized(claims.judged(rows, drug="drug", source_type="source_type")).count(r"\s*macc") == 1
