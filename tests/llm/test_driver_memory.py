"""What the driver holds: plans without the rank map's text, a heap that is given back, sets that are shuffled once."""

import numpy as np
from pyspark.sql import functions as F

from evidra.llm import bpe, queries, simhash
from evidra.llm._common import settle


def test_plans_name_the_rank_map(spark):
    """The map's numbers stood in the texts of all expressions around them; the fold is still one projection."""
    path = queries.tokenizer_file(queries.BPE_FILE)
    docs = spark.createDataFrame([(1, "some words and again some words"), (2, None), (3, "zz " + "x" * 200)], "doc_id long, text string")
    df = bpe.encode(docs, path, queries.bpe_pattern(), common=16)
    assert [bpe.decode(np.array(r["token_ids"], np.int64), bpe.rank_map(path)).decode() for r in df.orderBy("doc_id").collect()] == [r["text"] or "" for r in docs.orderBy("doc_id").collect()]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(df._jdf.queryExecution().optimizedPlan().expressions().toString() + plan) < 50_000 and plan.count("Project [transform") == 1 and plan.count("scalar-subquery") == 3


def test_settle_gives_the_heap_back(spark):
    """A collection alone left up to 70 % of the heap free."""
    jvm = spark.sparkContext._jvm
    held = [jvm.java.nio.ByteBuffer.allocate(8 << 20) for _ in range(60)]
    for b in held:
        spark.sparkContext._gateway.detach(b)
    del held
    settle(spark)
    runtime = jvm.java.lang.Runtime.getRuntime()
    assert runtime.freeMemory() < 0.5 * runtime.totalMemory()


def test_weights_go_to_the_sets(spark):
    """Sets met their group's weight in one task for a whole group."""
    hashes = [[*range(100)], [*range(95)], [*range(200, 300)]]
    rows = [(n, np.uint64(simhash.print_of_set(np.array(h, np.uint64))).astype(np.int64).item(), 1, h, len(h)) for n, h in enumerate(hashes)]
    members = spark.createDataFrame(rows, "node long, fp long, cluster long, hashes array<int>, size int")
    found = simhash._verified(members.withColumn("fp", F.lit(0).cast("long")), 0.8)
    assert [tuple(sorted(r)) for r in found.collect()] == [(0, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "ShuffledHashJoin" not in plan
