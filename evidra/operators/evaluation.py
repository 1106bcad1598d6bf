"""Quality of extractions: staged filters, precision and recall, calibration, sampling, latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def staged_filter(df: DataFrame, passes: list[tuple[str, Column]], into: str = "first_failing_pass") -> DataFrame:
    """df and the name of the first pass that a row fails, null if it passes all; one scan for all passes."""
    failing = [F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in passes]
    return df.withColumn(into, F.coalesce(*failing, F.lit(None).cast("string")))


def retention(df: DataFrame, passes: list[tuple[str, Column]]) -> DataFrame:
    """pass, n_in, n_out, rate of each pass over what its predecessors kept: one aggregate over the data."""
    names = [n for n, _ in passes]
    counts = staged_filter(df, passes).groupBy("first_failing_pass").agg(F.count(F.lit(1)).alias("n"))
    failed = {r["first_failing_pass"]: r["n"] for r in counts.collect()}  # at most one row per pass
    left, rows = sum(failed.values()), []
    for n in names:
        out = left - failed.get(n, 0)
        rows.append((n, left, out, out / left if left else 0.0))
        left = out
    return df.sparkSession.createDataFrame(rows, "pass string, n_in long, n_out long, rate double")


def scores(df: DataFrame, gold: Column, predicted: Column, by: str) -> DataFrame:
    """by, tp, fp, fn, precision, recall, f1 per value and over all rows (value "all"); 0 where undefined.

    gold and predicted are booleans. One rollup gives both levels.
    """
    g, p = F.coalesce(gold, F.lit(False)), F.coalesce(predicted, F.lit(False))
    rows = df.select(F.col(by).cast("string").alias("b"), g.alias("g"), p.alias("p"))
    counts = rows.rollup("b").agg(F.grouping("b").alias("total"), F.count_if(F.expr("g and p")).alias("tp"), F.count_if(F.expr("not g and p")).alias("fp"), F.count_if(F.expr("g and not p")).alias("fn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    name = F.when(F.col("total") == 1, "all").otherwise(F.col("b"))
    return counts.select(name.alias(by), "tp", "fp", "fn", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def accept_rates(df: DataFrame, accepted: Column, by: str) -> DataFrame:
    """by, n, rate per value and over all rows (value "all")."""
    rows = df.select(F.col(by).cast("string").alias("b"), accepted.cast("double").alias("a"))
    out = rows.rollup("b").agg(F.grouping("b").alias("total"), F.count(F.lit(1)).alias("n"), F.avg("a").alias("rate"))
    return out.select(F.when(F.col("total") == 1, "all").otherwise(F.col("b")).alias(by), "n", F.round("rate", 4).alias("rate"))


def calibration(df: DataFrame, confidence: str, correct: Column, edges: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0)) -> DataFrame:
    """bucket, n, n_correct, accuracy, expected (the bucket's middle), by confidence.

    Buckets hold their lower edge and not their upper; a confidence outside of all is in the last.
    """
    c, last = F.col(confidence), len(edges) - 2
    bucket = F.when(F.lit(False), 0)
    for n in range(last + 1):
        bucket = bucket.when((c >= edges[n]) & (c < edges[n + 1]), n)
    rows = df.select(bucket.otherwise(last).alias("bucket"), correct.cast("int").alias("ok"))
    out = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("ok"), F.lit(0)).alias("n_correct"))
    middles = F.array(*[F.lit((a + b) / 2) for a, b in zip(edges, edges[1:])])
    return out.select("bucket", "n", "n_correct", F.round(F.col("n_correct") / F.col("n"), 4).alias("accuracy"), F.round(F.get(middles, F.col("bucket")), 4).alias("expected"))


def stratified_sample(df: DataFrame, stratum: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows of each stratum in order of SHA-1 over seed and key, the same on every run."""
    order = F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    w = Window.partitionBy(stratum).orderBy(order, F.col(key))
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def latencies(df: DataFrame, per: str, value: str, at: list[str], last: int = 1000) -> DataFrame:
    """per, n, total, p50, p95 of the last samples; percentile q is the sorted sample at floor((n - 1) * q)."""
    w = Window.partitionBy(per).orderBy(*[F.desc(c) for c in at])
    recent = df.select(per, value, *at).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last)
    packed = recent.groupBy(per).agg(F.sort_array(F.collect_list(value)).alias("s"), F.sum(value).alias("total"))
    at_q = lambda q: F.get("s", F.floor((F.size("s") - 1) * F.lit(q)).cast("int"))
    return packed.select(per, F.size("s").alias("n"), F.round("total", 2).alias("total"), at_q(0.5).alias("p50"), at_q(0.95).alias("p95"))
