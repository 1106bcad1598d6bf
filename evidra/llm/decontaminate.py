"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items become sequences of lower-case word tokens. A document becomes a
candidate for an item when they share a seed, a run of `min_match` tokens. For each candidate
pair, running Karp-Rabin matching finds the longest runs that no tile covers yet, marks them, and
goes on with shorter ones down to `min_match`. The share of an item's tokens that tiles cover is
its test coverage; tiles may lie in any order, so reordered passages count in full.

The benchmark is the stated query set: it is broadcast in blocks of at most `block_tokens` tokens
and every block passes over all documents. Each document is handled where it is read, so nothing
is shuffled, and no item or passage, however common, gathers rows in one task.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.llm._common import tidied

MIN_MATCH = 5
COVERAGE = 0.5
BLOCK_TOKENS = 1_000_000
WORD = re.compile(r"\w+")
#: Fixed base of the rolling hash, odd so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def window_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hash of each window of that length, modulo 2**64."""
    n = len(ids)
    if n < length:
        return np.empty(0, np.uint64)
    steps = np.full(n, INVERSE, np.uint64)
    steps[0] = 1
    with np.errstate(over="ignore"):
        falling = np.cumprod(steps)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids.astype(np.uint64) * falling)])
        steps[1:] = BASE
        return (sums[length:] - sums[:-length]) * np.cumprod(steps)[: n - length + 1]


def _free_windows(free: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows that no tile touches."""
    if len(free) < length:
        return np.empty(0, np.int64)
    sums = np.concatenate([[0], np.cumsum(free)])
    return np.flatnonzero(sums[length:] - sums[:-length] == length)


def greedy_tiles(pattern: np.ndarray, text: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (start in pattern, start in text, length), longest first.

    Ids below zero are words that the other side doesn't have; they match nothing. Ties go to the
    earlier start in the pattern, then in the text.
    """
    free_p, free_t = pattern >= 0, text >= 0
    out: list[tuple[int, int, int]] = []
    length = max(min_match, min(len(pattern), 32))
    while True:
        found, longest = [], 0
        starts_t = _free_windows(free_t, length)
        starts_p = _free_windows(free_p, length)
        if len(starts_t) and len(starts_p):
            hp, ht = window_hashes(pattern, length)[starts_p], window_hashes(text, length)[starts_t]
            keep = np.isin(ht, hp)
            at = defaultdict(list)
            for h, j in zip(ht[keep].tolist(), starts_t[keep].tolist()):
                at[h].append(j)
            for h, i in zip(hp.tolist(), starts_p.tolist()):
                reach = 0
                for j in at.get(h, ()):
                    if i and j and free_p[i - 1] and free_t[j - 1] and pattern[i - 1] == text[j - 1]:
                        continue  # part of a match that starts earlier
                    most = min(len(pattern) - i, len(text) - j)
                    same = (pattern[i : i + most] == text[j : j + most]) & free_p[i : i + most] & free_t[j : j + most]
                    reach = int(most if same.all() else np.argmin(same))
                    if reach >= length:
                        found.append((reach, i, j))
                        longest = max(longest, reach)
        if longest > 2 * length:
            length = longest
            continue
        again = False
        for reach, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if free_p[i : i + reach].all() and free_t[j : j + reach].all():
                out.append((i, j, reach))
                free_p[i : i + reach] = False
                free_t[j : j + reach] = False
            else:
                again = True  # what is left of it may still be long enough
        if again:
            continue
        if length <= min_match:
            return out
        length = max(min_match, length // 2)


class Block:
    """A block of benchmark items, ready to be compared with documents."""

    def __init__(self, items: list[tuple[int, list[str]]], min_match: int):
        self.min_match = min_match
        self.words: dict[str, int] = {}
        self.items = [(i, np.array([self.words.setdefault(w, len(self.words)) for w in ws], np.int64)) for i, ws in items]
        self.by_seed: dict[int, list[int]] = defaultdict(list)
        for n, (_, ids) in enumerate(self.items):
            for h in np.unique(window_hashes(ids, min_match)).tolist():
                self.by_seed[h].append(n)
        self.seeds = np.array(sorted(self.by_seed), np.uint64)
        #: Items too short for a seed, found where they are a whole document.
        self.short: dict[tuple, list[int]] = defaultdict(list)
        for i, ws in items:
            if 0 < len(ws) < min_match:
                self.short[tuple(ws)].append(i)

    def hits(self, text: str | None, coverage: float) -> Iterator[tuple]:
        """(item id, coverage, tokens covered, tiles) of each item covered that far, by item id."""
        words = tokens(text)
        if len(words) < self.min_match:
            for item in sorted(self.short.get(tuple(words), ())):
                yield item, 1.0, len(words), 1
        if len(words) < self.min_match or not len(self.seeds):
            return
        ids = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        known = _free_windows(ids >= 0, self.min_match)
        if not len(known):
            return
        hashes = window_hashes(ids, self.min_match)[known]
        place = np.minimum(np.searchsorted(self.seeds, hashes), len(self.seeds) - 1)
        shared = np.unique(hashes[self.seeds[place] == hashes]).tolist()
        for n in sorted({n for h in shared for n in self.by_seed[h]}):
            item, pattern = self.items[n]
            tiles = greedy_tiles(pattern, ids, self.min_match)
            covered = sum(t[2] for t in tiles)
            if covered >= coverage * len(pattern):
                yield item, covered / len(pattern), covered, len(tiles)


def blocks(benchmark: DataFrame, min_match: int, block_tokens: int, item: str, text: str) -> Iterator[Block]:
    """The benchmark in blocks; items with fewer than min_match tokens have no seed and only match a document that is the item."""
    part, size = [], 0
    rows = benchmark.select(F.col(item).cast("long").alias("item"), F.col(text).alias("text")).where("item is not null").distinct().orderBy("item", "text")
    for row in rows.toLocalIterator():
        words = tokens(row["text"])
        if not words:
            continue
        part.append((row["item"], words))
        size += len(words)
        if size >= block_tokens:
            yield Block(part, min_match)
            part, size = [], 0
    if part:
        yield Block(part, min_match)


def contamination(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_tokens: int = BLOCK_TOKENS, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item that it covers: doc_id, item_id, coverage, n_covered, n_tiles.

    Only contaminated documents have rows. Null and empty texts or items match nothing, and so do
    empty tables. Items of fewer than min_match tokens match documents that have just their tokens. Items with a null id are left out. Repeated documents repeat their
    rows; repeated items count once. Other columns are not read.
    """
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("n_covered", T.LongType()), T.StructField("n_tiles", T.LongType())])
    names = ["doc_id", "item_id", "coverage", "n_covered", "n_tiles"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    texts = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def passes(shared):
        def run(batches):
            block = shared.value
            for b in batches:
                rows = [(d.as_py(), *hit) for d, t in zip(b.column(0), b.column(1)) for hit in block.hits(t.as_py(), coverage)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        return texts.mapInArrow(tidied(run), schema)

    found = [passes(spark.sparkContext.broadcast(b)) for b in blocks(benchmark, min_match, block_tokens, item, item_text)]
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_tokens: int = BLOCK_TOKENS, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs, all columns, without the documents that cover an item; the cases are those of contamination()."""
    at = docs.columns.index(text)
    for block in blocks(benchmark, min_match, block_tokens, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for b in batches:
                clean = [next(shared.value.hits(t.as_py(), coverage), None) is None for t in b.column(at)]
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(tidied(run), docs.schema)
    return docs
