"""What a step of the BPE fold does: it ranks new pairs only, and finds the least pair without a search that ends by an exception."""

import base64
import random

import tiktoken
from pyspark.sql import functions as F

from evidra.llm import bpe, queries


def test_fold_does_not_search_for_places(spark):
    """array_position throws at each place that it finds, and all pairs of a word were ranked anew in each step."""
    path = queries.tokenizer_file(queries.BPE_FILE)
    words = [" areanreheea", "aaaaaaaa", "x", "\xe4\xf6\xfc\xdf", " étionèauxèen", "z" * 90]
    df = bpe._with_tables(spark.createDataFrame([(w,) for w in words], "w string"), ["a", "b", "c"], path)
    df = df.select("w", bpe.fold_word(F.col("w"), path, ["a", "b", "c"]).alias("ids"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "array_position" not in plan
    # A projection of the tables below the fold's would copy 1.3 MB into every row.
    assert plan.count("Project [") == 1 and plan.count("scalar-subquery") == 3
    assert {r["w"]: r["ids"] for r in df.collect()} == {w: bpe.rank_map(path).fold(w.encode()) for w in words}


def test_fold_with_many_ways_to_a_token(spark, tmp_path):
    """Tokens that several pairs form have equal ranks, and ids next to each other differ in a pair's lowest bit."""
    dice = random.Random(0)
    tokens = [bytes([b]) for b in range(256)]
    longer = sorted({bytes(dice.choices(b"abc", k=k)) for k in (2, 3, 4, 5) for _ in range(60)})
    tokens += dice.sample(longer, len(longer))
    path = tmp_path / "own.tiktoken"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {n}\n" for n, t in enumerate(tokens)))
    words = {"".join(dice.choices("abcd", k=k)) for k in range(1, 25) for _ in range(20)}
    words = sorted(w for w in words if w.encode() not in tokens)  # the library doesn't fold a word that is a token
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", bpe.fold_word(F.col("w"), str(path)).alias("ids"))
    library = tiktoken.Encoding("own", pat_str=r"[a-d]+", mergeable_ranks=bpe.read_ranks(str(path)), special_tokens={})
    assert {r["w"]: r["ids"] for r in df.collect()} == {w: library.encode_ordinary(w) for w in words}
