"""Chunks of sections: blocks, size-bounded merging, overlap tails, breakpoints, neighbours' ids.

Every text is folded where it is read, by higher-order functions over its own blocks, so nothing
is shuffled; only the neighbours' ids need a window per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.text import let, token_estimate, words


def paragraph_blocks(text: Column) -> Column:
    """Trimmed paragraphs, split at line ends; blank ones are left out."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\\n+"), lambda b: F.trim(b)), lambda b: b != "")


def merged_blocks(blocks: Column, most: int, joiner: str = "\n\n") -> Column:
    """Blocks joined from the left while the estimate of the joined text stays within `most` tokens.

    A block that is larger alone stays alone. Words are counted once for each block, before the fold.
    """
    fits = lambda n: F.greatest(F.lit(1), F.floor(n * F.lit(1.3)).cast("int")) <= most

    def add(state: Column, block: Column) -> Column:
        text, n = block["text"], block["n"]
        more = F.struct(state.done.alias("done"), F.concat(state.now, F.lit(joiner), text).alias("now"), (state.n + n).alias("n"))
        new = F.struct(F.concat(state.done, F.array(state.now)).alias("done"), text.alias("now"), n.alias("n"))
        first = F.struct(state.done.alias("done"), text.alias("now"), n.alias("n"))
        return F.when(state.now == "", first).when(fits(state.n + n), more).otherwise(new)

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))
    counted = F.transform(blocks, lambda b: F.struct(b.alias("text"), F.size(words(b)).alias("n")))
    return F.aggregate(counted, start, add, lambda s: F.when(s.now == "", s.done).otherwise(F.concat(s.done, F.array(s.now))))


def tail(text: Column, most: int) -> Column:
    """The longest run of last words whose token estimate is within `most`."""
    n = int((most + 1) / 1.3)  # floor(1.3 n) <= most
    while int(n * 1.3) > most:
        n -= 1
    last = lambda w: F.array_join(F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), F.lit(max(n, 1))), " ")
    return let(words(text), last) if n > 0 else F.lit("")


def with_overlap(chunks: Column, most: int, joiner: str = "\n\n") -> Column:
    """Each chunk but the first with the tail of the one before, itself with its overlap, in front."""

    def add(done: Column, chunk: Column) -> Column:
        joined = lambda before: F.when(before == "", chunk).otherwise(F.concat(before, F.lit(joiner), chunk))
        return F.concat(done, F.array(let(tail(F.element_at(done, -1), most), joined)))

    return F.aggregate(F.slice(chunks, F.lit(2), F.greatest(F.size(chunks), F.lit(1))), F.slice(chunks, F.lit(1), F.lit(1)), add)


def chunked(docs: DataFrame, doc: str, text: str, most: int = 500, overlap: int = 75) -> DataFrame:
    """doc, chunk_index (from 0), chunk_count, text: paragraphs merged up to `most` tokens, with overlap tails."""
    chunks = with_overlap(merged_blocks(paragraph_blocks(F.col(text)), most), overlap)
    return docs.select(F.col(doc), chunks.alias("_chunks")).select(doc, F.size("_chunks").alias("chunk_count"), F.posexplode("_chunks").alias("chunk_index", "text"))


def breakpoints(vectors: DataFrame, group: str, index: str, embedding: str, least: float, cosine) -> DataFrame:
    """group, index of blocks that start a chunk: their cosine with the block before is under `least`."""
    w = Window.partitionBy(group).orderBy(index)
    before = vectors.withColumn("_before", F.lag(embedding).over(w))
    return before.where(cosine(F.col("_before"), F.col(embedding)) < least).select(group, index)


def chained(chunks: DataFrame, group: str, index: str, chunk_id: str) -> DataFrame:
    """chunks with prev_chunk_id, chunk_index (from 0) and chunk_count of their group."""
    w = Window.partitionBy(group).orderBy(index, chunk_id)
    return chunks.select("*", F.lag(chunk_id).over(w).alias("prev_chunk_id"), (F.row_number().over(w) - 1).alias("chunk_index"), F.count(F.lit(1)).over(Window.partitionBy(group)).alias("chunk_count"))
