"""Merkle manifest of a dataset: contiguous digest matrices in aligned blocks of leaves.

Leaves of a group (a language) are ranked by id without a task that sees a whole group: ranges of
even size are ranked each by itself, and the counts of the ranges before are added. Ranks are cut
into blocks of fanout ** LEVELS leaves. A block's leaves lie in one matrix, a 64-byte hex digest a
row; reshaping it by the fanout makes every row a run, and hashing rows gives the next level, a block
root at last. Block roots are the leaves of the next pass, until each group has one node. The groups'
roots, ordered by group, are the leaves of one more tree, built by the same passes.

Going down again, a block gets the siblings above it once for all its leaves; siblings inside of it
are rows of its matrices, found by index arithmetic. Texts are hashed where they are read and never
move; proofs exist only in the task that hashes them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm._common import bounded, discard, materialize
from evidra.llm.ranges import bounds, range_of

FANOUT = 2
#: Levels of the tree inside a block of leaves.
LEVELS = 8
#: Leaves of a range that is ranked by itself.
ROWS_PER_RANGE = 4096
#: Bytes of a digest as hex text.
HEX = 64
LEAST_ID = -(1 << 63)
#: One row a block: its tree, number, the tree's number of nodes, the nodes' digests, names and digests after tampering.
BLOCK = "tree string, block long, total long, nodes binary, names array<string>, changed array<string>, root string"


def hashed(data: bytes) -> bytes:
    """Lowercase hex of the SHA-256 digest."""
    return hashlib.sha256(data).hexdigest().encode()


def matrix(nodes: bytes) -> np.ndarray:
    return np.frombuffer(nodes, np.uint8).reshape(-1, HEX)


def next_level(nodes: np.ndarray, fanout: int = FANOUT) -> np.ndarray:
    """The hashes of each `fanout` consecutive rows; the last run may have fewer."""
    full = len(nodes) // fanout * fanout
    runs = [r.tobytes() for r in np.ascontiguousarray(nodes[:full]).reshape(-1, fanout * HEX)]
    if full < len(nodes):
        runs.append(nodes[full:].tobytes())
    return matrix(b"".join(map(hashed, runs)))


def levels_of(nodes: np.ndarray, total: int, levels: int, fanout: int = FANOUT) -> list[np.ndarray]:
    """The matrices of a block from its leaves to its root. total: leaves of the whole tree, which ends where one node is left."""
    out = [nodes]
    while len(out) <= levels and total > 1:
        out.append(next_level(out[-1], fanout))
        total = -(-total // fanout)
    return out


def siblings(matrices: list[np.ndarray], fanout: int = FANOUT) -> list[bytes]:
    """For each leaf of a block the others of its run on every level below the root, left to right."""
    places, parts, there = np.arange(len(matrices[0])), [], []
    for nodes in matrices[:-1]:
        own = places % fanout
        others = np.arange(fanout - 1)[None] + (np.arange(fanout - 1)[None] >= own[:, None])
        index = (places - own)[:, None] + others
        there.append(index < len(nodes))
        parts.append(nodes[np.minimum(index, len(nodes) - 1)])
        places = places // fanout
    if not parts:
        return [b""] * len(places)
    found, mask = np.concatenate(parts, 1), np.concatenate(there, 1)
    return [f.tobytes() if whole else f[m].tobytes() for f, m, whole in zip(found, mask, mask.all(1))]


def folded(leaf: bytes, proof: bytes, trees: list[tuple[int, int]], fanout: int = FANOUT) -> bytes:
    """The root that a leaf and the siblings of its path lead to. trees: (leaf's rank, number of leaves), from the lowest tree up."""
    at = 0
    for place, total in trees:
        while total > 1:
            start = place // fanout * fanout
            others = proof[at : at + (min(fanout, total - start) - 1) * HEX]
            at += len(others)
            left = (place - start) * HEX
            leaf = hashed(others[:left] + leaf + others[left:])
            place, total = place // fanout, -(-total // fanout)
    return leaf


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def ranked(leaves: DataFrame, key: list[str], order: list[str | Column], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """leaves with rank inside their tree, and total, the tree's number of leaves.

    leaves: tree and other columns, a written table. key: bigint columns that ranges are cut by;
    order: what rows are ordered by, beginning with the key.
    """
    found = bounds(leaves.select(*key), leaves.count(), rows_per_range)
    placed = leaves.withColumn("range", range_of([F.col(c) for c in key], found))
    counts = placed.groupBy(F.col("tree").alias("of_tree"), F.col("range").alias("of_range")).agg(F.count(F.lit(1)).alias("n"))
    # At most as many rows a tree as there are ranges.
    w = Window.partitionBy("of_tree")
    upto = w.orderBy("of_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("of_tree", "of_range", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.sum("n").over(w).alias("total"))
    inside = placed.withColumn("inside", F.row_number().over(Window.partitionBy("tree", "range").orderBy(*order)))
    joined = inside.join(bounded(starts), F.col("tree").eqNullSafe(F.col("of_tree")) & (F.col("range") == F.col("of_range")))
    return joined.withColumn("rank", F.col("before") + F.col("inside") - 1).drop("range", "of_tree", "of_range", "before", "inside")


def blocks(nodes: DataFrame, levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """One row a block of nodes: tree, rank, total, digest, name, changed; see BLOCK. Null trees are a tree of their own."""
    size = fanout**levels

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        whole, total = "".join(group["digest"]).encode(), int(group["total"].iloc[0])
        root = levels_of(matrix(whole), total, levels, fanout)[-1].tobytes().decode()
        return pd.DataFrame({
            "tree": group["tree"].iloc[:1].tolist(), "block": [int(group["rank"].iloc[0]) // size], "total": [total], "nodes": [whole],
            "names": [group["name"].tolist()], "changed": [group["changed"].tolist()], "root": [root],
        })

    dealt = nodes.select("tree", F.floor(F.col("rank") / size).alias("block"), "rank", "total", "digest", "name", "changed")
    return dealt.groupBy("tree", "block").applyInPandas(build, BLOCK)


def passes(nodes: DataFrame, levels: int = LEVELS, fanout: int = FANOUT) -> list[DataFrame]:
    """Blocks of all passes from the leaves up, until each tree has one block; every table is written."""
    out, size = [], fanout**levels
    while True:
        made = materialize(blocks(nodes, levels, fanout))
        out.append(made)
        if (made.agg(F.max("block")).first()[0] or 0) == 0:
            return out
        total = F.ceil(F.col("total") / size).cast("long")
        block = F.col("block")
        nodes = made.select("tree", block.alias("rank"), total.alias("total"), F.col("root").alias("digest"), block.cast("string").alias("name"), F.lit(None).cast("string").alias("changed"))


def _with_above(made: DataFrame, above: DataFrame) -> DataFrame:
    """Blocks with what stands above them. above: tree, name (of the block), proof, subroot, place."""
    named = above.select(F.col("tree").alias("of_tree"), F.col("name").cast("long").alias("of_block"), "proof", "subroot", "place")
    return made.join(bounded(named), F.col("tree").eqNullSafe(F.col("of_tree")) & (F.col("block") == F.col("of_block"))).drop("of_tree", "of_block")


def _down(made: DataFrame, above: DataFrame, levels: int, fanout: int) -> DataFrame:
    """tree, name, proof, subroot and place of every node in the blocks."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                proofs = [p + r.proof for p in siblings(levels_of(matrix(r.nodes), r.total, levels, fanout), fanout)]
                yield pd.DataFrame({"tree": r.tree, "name": r.names, "proof": proofs, "subroot": r.subroot, "place": r.place})

    return _with_above(made, above).select("tree", "total", "nodes", "names", "proof", "subroot", "place").mapInPandas(expand, "tree string, name string, proof binary, subroot string, place long")


def _proved(made: DataFrame, above: DataFrame, n_trees: int, levels: int, fanout: int) -> DataFrame:
    """name, leaf, subroot, proof_sha256, folded_root of every leaf."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                nodes, first = matrix(r.nodes), int(r.block) * fanout**levels
                proofs = [p + r.proof for p in siblings(levels_of(nodes, r.total, levels, fanout), fanout)]
                leaves = [n.tobytes() for n in nodes]
                shown = [c.encode() if c else leaf for c, leaf in zip(r.changed, leaves)]
                above = (int(r.place), n_trees)
                roots = [folded(leaf, p, [(first + k, int(r.total)), above], fanout).decode() for k, (leaf, p) in enumerate(zip(shown, proofs))]
                yield pd.DataFrame({"name": r.names, "leaf": [x.decode() for x in leaves], "subroot": r.subroot, "proof_sha256": [hashed(p).decode() for p in proofs], "folded_root": roots})

    schema = "name string, leaf string, subroot string, proof_sha256 string, folded_root string"
    return _with_above(made, above).select("block", "total", "nodes", "names", "changed", "proof", "subroot", "place").mapInPandas(expand, schema)


def manifest(docs: DataFrame, doc: str = "doc_id", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", text: str = "text", levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """One row per document: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the hash of id, source, language, n_chars and text, each `-` for null, else its UTF-8
    byte count, `:` and the value. Leaves of a language ascend by id, null ids first; rows that
    repeat an id come in order of hashes of their leaves, and equal rows have a leaf each. A tree's
    runs of `fanout` nodes become their hash until one node is left; a single leaf is its tree's
    root. Languages are ordered bytewise, null first and a tree of its own. Where 7 divides the
    CRC-32 of the decimal id, one is added to n_chars and the leaf so changed is folded with the
    untouched siblings; null ids and null n_chars stay. An empty table gives no rows. Only the five
    columns are read, so others can have any names.
    """
    columns = [F.col(c) for c in (doc, source, lang, n_chars, text)]
    leaf = lambda chars: F.sha2(F.concat(*map(encoded, [*columns[:3], chars, columns[4]])), 256)
    tampered = (F.crc32(columns[0].cast("string").cast("binary")) % 7 == 0) & columns[3].isNotNull()
    rows = docs.select(columns[2].alias("tree"), columns[0].alias("id"), leaf(columns[3]).alias("digest"), F.when(tampered, leaf(columns[3] + 1)).alias("changed"))
    leaves = materialize(rows.select(
        "tree", F.coalesce(F.col("id").cast("long"), F.lit(LEAST_ID)).alias("k"), F.xxhash64("digest").alias("h"), F.monotonically_increasing_id().alias("row"),
        F.col("id").cast("string").alias("name"), "digest", "changed",
    ))
    lower = passes(ranked(leaves, ["k", "h", "row"], ["k", "h", "row"]), levels, fanout)
    discard(leaves)
    # The first seven bytes of a language as a number have the order of the whole, but for ties.
    tops = lower[-1].select(F.lit("languages").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("digest"), F.lit(None).cast("string").alias("changed"))
    prefix = F.conv(F.rpad(F.hex(F.substring(F.encode("of", "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    tops = materialize(tops.withColumn("k", F.coalesce(prefix, F.lit(-1))))
    placed = materialize(ranked(tops, ["k"], ["k", F.col("of").asc_nulls_first()]).withColumn("name", F.col("rank").cast("string")))
    upper = passes(placed, levels, fanout)
    end = upper[-1].select("root").first()
    if end is None:
        return rows.select(F.col("id").alias(doc), F.col("digest").alias("leaf"), *[F.lit("").alias(c) for c in ("subroot", "root", "proof_sha256", "folded_root")], F.lit(True).alias("verified"))
    nothing = F.lit(None).cast("string")
    above = upper[-1].select("tree", F.lit("0").alias("name"), F.lit(b"").alias("proof"), nothing.alias("subroot"), F.lit(None).cast("long").alias("place"))
    for made in reversed(upper):
        above = _down(made, above, levels, fanout)
    above = above.select("name", "proof").join(placed.select("name", "of", F.col("digest").alias("subroot"), F.col("rank").alias("place")), "name")
    above = above.select(F.col("of").alias("tree"), F.lit("0").alias("name"), "proof", "subroot", "place")
    for made in reversed(lower[1:]):
        above = _down(made, above, levels, fanout)
    done = _proved(lower[0], materialize(above), placed.count(), levels, fanout)
    return done.select(F.col("name").cast(docs.schema[doc].dataType).alias(doc), "leaf", "subroot", F.lit(end["root"]).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == end["root"]).alias("verified"))
