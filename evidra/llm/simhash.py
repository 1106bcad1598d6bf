"""SimHash near-duplicates with bit-sliced comparison of fingerprints.

Fingerprints that differ in at most RADIUS = 2 of 64 bits agree on two of four 16-bit quarters at
least, so each distinct fingerprint goes to six blocks, one for each pair of quarters with their
values as key, and every link lies in some block. Blocks of over BLOCK fingerprints are split into
chunks and compared chunk with chunk, so none is dropped and none meets in one task.

Stages look for near copies by the Jaccard similarity of five-word shingles instead. A radius that
catches those has no useful blocks of quarters, so blocks are MinHash bands there, the bit-sliced
comparison finds candidates in them, and these are counted exactly (near_copy_components).

Inside a block, bit planes are stored vertically: one word holds a bit of 64 fingerprints. XOR of a
plane with a query's bit updates 64 distances at once in carry-save counters, and words whose 64
distances all exceed the radius are abandoned. A block only emits a spanning forest of its links.
Equal fingerprints are one node with the smallest id; connected components join the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.llm._common import bounded, discard, fresh, materialize, settle, tidied
from evidra.llm.components import components

RADIUS = 2
SEED = 42
WORDS_PER_SHINGLE = 3
BLOCK = 2048
#: Blocks up to this size are compared by pairs at equal distance in the sorted batch.
SMALL = 48
#: Planes between two checks for words to abandon.
STRIDE = 8
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Near copies of stages: words of a shingle, Jaccard similarity of the sets of shingles.
STAGE_WORDS, STAGE_SIMILARITY = 5, 0.8
#: MinHash bands that make a set's blocks, and values of a band.
BANDS, BAND_ROWS = 20, 4
#: Fingerprints of sets of similarity 0.8 differ in 9.7 bits on average, with a deviation of 2.9.
NEAR_BITS = 20
#: Hashes of a candidate group in one chunk.
CHUNK_HASHES = 250_000


def fingerprint(text: str | None, size: int = WORDS_PER_SHINGLE) -> int:
    """SimHash of word shingles, repeats included; a text without words has fingerprint 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    raw, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: max(1, len(words) - size + 1)].tolist()
    ends = ends[size - 1 :].tolist() if len(words) >= size else [len(raw)]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for k in range(0, len(starts), 65536):
        h = np.array([digest(raw[a:b], SEED) for a, b in zip(starts[k : k + 65536], ends[k : k + 65536])], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits((total * 2 > len(starts)).astype(np.uint8), bitorder="little")
    return int(bits.view(np.uint64)[0])


def planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes, 64 rows of packed words; the last word is filled up with zeros."""
    n = -(-max(1, len(prints)) // 64) * 64
    bits = np.zeros((n, 64), np.uint8)
    bits[: len(prints)] = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Bitwise comparison of the carry-save counters with the radius."""
    more, same = over.copy(), np.full_like(over, FULL)
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            same &= counters[k]
        else:
            more |= same & counters[k]
            same &= ~counters[k]
    return more


def _count(differences, shape: tuple, radius: int) -> np.ndarray:
    """Words whose bits say which distances are within the radius.

    differences(b, words) gives plane b's difference words for those columns.
    """
    alive = np.arange(shape[-1])
    counters = [np.zeros(shape, np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros(shape, np.uint64)
    out = np.zeros(shape, np.uint64)
    for b in range(64):
        carry = differences(b, alive)
        for c in counters:
            c_and = c & carry
            np.bitwise_xor(c, carry, out=c)
            carry = c_and
        over |= carry
        if b % STRIDE == STRIDE - 1 and b < 63:
            keep = ~(_exceeds(counters, over, radius) == FULL).reshape(-1, len(alive)).all(0)
            if not keep.any():
                return out
            if not keep.all():
                alive, over = alive[keep], over[..., keep]
                counters = [c[..., keep] for c in counters]
    out[..., alive] = ~_exceeds(counters, over, radius)
    return out


def _unpack(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each place, whether a and b there are within the radius."""
    out = np.zeros(len(a), bool)
    for k in range(0, len(a), 1 << 16):
        pa_, pb = planes(a[k : k + (1 << 16)]), planes(b[k : k + (1 << 16)])
        n = len(a[k : k + (1 << 16)])
        out[k : k + n] = _unpack(_count(lambda bit, words: pa_[bit, words] ^ pb[bit, words], (pa_.shape[1],), radius), n)
    return out


def near_any(queries: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each fingerprint, whether any query is within the radius."""
    grid = planes(prints)
    masks = np.where(np.unpackbits(queries.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") > 0, FULL, np.uint64(0))
    near = _count(lambda bit, words: grid[bit, words][None, :] ^ masks[:, bit][:, None], (len(queries), grid.shape[1]), radius)
    return _unpack(np.bitwise_or.reduce(near, axis=0)[None, :], len(prints))[0]


def forest(prints: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links within a large block: (position, position of its root)."""
    left = np.arange(len(prints))
    while len(left) > 1:
        root, left = left[0], left[1:]
        frontier = np.array([root])
        while len(frontier) and len(left):
            now, frontier = frontier[:64], frontier[64:]
            near = near_any(prints[now], prints[left], radius)
            for x in left[near]:
                yield int(x), int(root)
            frontier, left = np.concatenate([frontier, left[near]]), left[~near]


def block_edges(group: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Edges of spanning forests, as pairs of positions, for rows sorted by group; group: a number per block."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(group)]]))
    row_size = np.repeat(sizes, sizes)
    place = np.arange(len(group)) - np.repeat(starts, sizes)
    us, vs = [], []
    for d in range(1, int(min(SMALL, sizes.max(initial=0)))):
        first = np.flatnonzero((row_size <= SMALL) & (place + d < row_size))
        near = near_pairs(prints[first], prints[first + d], radius)
        us.append(first[near] + d)
        vs.append(first[near])
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    out = []
    for a, b in zip(u.tolist(), v.tolist()):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((max(a, b), min(a, b)))
    for k in np.flatnonzero(sizes > SMALL):
        s = starts[k]
        out += [(s + a, s + b) for a, b in forest(prints[s : s + sizes[k]], radius)]
    return np.array(out, np.int64).reshape(-1, 2)


def _keys() -> Column:
    """The six block keys of a fingerprint: which two quarters, and their values."""
    quarter = [F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF)) for q in range(4)]
    return F.array(*[F.lit(n << 32).bitwiseOR(F.shiftleft(quarter[i], 16)).bitwiseOR(quarter[j]) for n, (i, j) in enumerate(combinations(range(4), 2))])


def _groups(batches, n_keys: int) -> Iterator[pa.Table]:
    """Whole groups of rows from batches sorted by their last n_keys columns; a table may hold several."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        keys = np.stack([c.to_numpy().astype(np.int64) for c in t.columns[-n_keys:]])
        new = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
        if new[-1]:
            yield t.slice(0, new[-1])
        rest = t.slice(new[-1])
    if rest is not None and rest.num_rows:
        yield rest


def _dealt(rows: DataFrame, group: str, chunks: Column) -> DataFrame:
    """Rows for each pair of chunks (a, b) of their group that they belong to; own: the row's chunk. rows: node, group."""
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = rows.withColumn("chunks", chunks.cast("int")).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))
    return dealt.repartition(group, "a", "b").sortWithinPartitions(group, "a", "b", "node")


def links(nodes: DataFrame, keys: Column | None = None, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) that connect all nodes that share a block and lie within `radius` bits. nodes: node, fp; keys: block keys."""
    keyed = nodes.select("node", "fp", F.explode(_keys() if keys is None else keys).alias("key"))
    sizes = keyed.groupBy("key").count().where("count > 1")
    dealt = _dealt(keyed.join(sizes.hint("shuffle_hash"), "key"), "key", F.ceil(F.col("count") / BLOCK)).select("node", "fp", "key", "a", "b")

    def run(batches):
        for t in _groups(batches, 3):
            node, fp, *group = (c.to_numpy().astype(np.int64) for c in t.columns)
            new = np.concatenate([[True], (np.diff(np.stack(group)) != 0).any(0)])
            e = block_edges(np.cumsum(new), fp.view(np.uint64), radius)
            if len(e):
                yield pa.RecordBatch.from_arrays([pa.array(node[e[:, 0]]), pa.array(node[e[:, 1]])], ["u", "v"])

    return dealt.mapInArrow(tidied(run), "u long, v long")


def simhash_components(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id of a document that links lead to, itself included; null ids
    are ignored there, and a component with null ids only has a null component_id. Null and empty
    texts have fingerprint zero and link like any other. Repeated documents keep a row each. Empty
    tables give no rows. Other columns are not read.
    """

    @F.pandas_udf("long")
    def print_of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    printed = materialize(docs.select(F.col(doc).alias("doc_id"), print_of(F.col(text)).alias("fp")))
    least = materialize(printed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(least.select(F.col("fp").alias("node"), "fp")))
    rooted = least.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(whole, "root").select("fp", "component_id")
    return printed.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of word shingles; a shorter text is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    raw, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: max(1, len(words) - size + 1)].tolist()
    digest = xxhash.xxh64_intdigest
    stops = ends[size - 1 :].tolist() if len(words) >= size else [len(raw)]
    return np.unique(np.array([digest(raw[a:b], SEED) for a, b in zip(starts, stops)], np.uint64))


def print_of_set(hashes: np.ndarray) -> int:
    """SimHash of a set of hashes."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        part = np.ascontiguousarray(hashes[k : k + 65536])
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((total * 2 > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


@lru_cache
def _minhash() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odd factors and terms of the MinHash functions, and odd factors that mix a band's values."""
    rng = np.random.default_rng(SEED)
    factors, terms, mix = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (BANDS * BAND_ROWS, BANDS * BAND_ROWS, BAND_ROWS))
    return factors * np.uint64(2) + np.uint64(1), terms, mix * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS block keys of a set, each from BAND_ROWS MinHash values."""
    factors, terms, mix = _minhash()
    least = np.full(BANDS * BAND_ROWS, FULL, np.uint64)
    for k in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[k : k + 2048, None] * factors + terms).min(0))
    return (least.reshape(BANDS, BAND_ROWS) * mix).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)


def verified_edges(nodes: np.ndarray, sets: list[np.ndarray], prints: np.ndarray, side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links of Jaccard similarity >= `similarity` between sets.

    The bit-sliced comparison passes pairs within NEAR_BITS, which are then counted exactly. side:
    where rows come from two chunks, their chunk; rows of one chunk are compared in another group.
    """
    order = np.argsort(side, kind="stable")
    nodes, prints, side = nodes[order], prints[order], side[order]
    sets = [sets[k] for k in order]
    sizes = np.array([len(s) for s in sets])
    first = np.cumsum(sizes) - sizes
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    held, grid = np.zeros(len(names), np.int32), planes(prints)
    root, out = np.arange(len(sets)), []
    two, queries = side[0] != side[-1], np.count_nonzero(side == side[0])
    for k in range(0, queries, 128):
        asked = prints[k : min(k + 128, queries)]
        masks = np.where(np.unpackbits(np.ascontiguousarray(asked).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") > 0, FULL, np.uint64(0))
        near = _unpack(_count(lambda bit, words: grid[bit, words][None, :] ^ masks[:, bit][:, None], (len(asked), grid.shape[1]), NEAR_BITS), len(sets))
        for i, row in zip(range(k, k + len(asked)), near):
            row[: i + 1] = False
            if two:
                row &= side != side[i]
            j = np.flatnonzero(row)
            j = j[(root[j] != root[i]) & (np.minimum(sizes[j], sizes[i]) >= similarity * np.maximum(sizes[j], sizes[i]) - 1e-9)]
            if not len(j):
                continue
            mine = flat[first[i] : first[i] + sizes[i]]
            held[mine] = 1
            starts = np.cumsum(sizes[j]) - sizes[j]
            at = np.arange(sizes[j].sum()) + np.repeat(first[j] - starts, sizes[j])
            shared = np.add.reduceat(held[flat[at]], starts)
            held[mine] = 0
            for x in j[shared >= similarity * (sizes[i] + sizes[j] - shared) - 1e-9].tolist():
                if root[x] != root[i]:
                    out.append((int(nodes[x]), int(nodes[i])))
                    root[root == root[x]] = root[i]
    return out


def _verified(members: DataFrame, similarity: float) -> DataFrame:
    """Edges (u, v) of verified links inside each candidate group. members: node, fp, cluster, hashes, size.

    The groups' weights go to the sets, which are shuffled once only, by pairs of chunks.
    """
    weight = materialize(members.groupBy("cluster").agg(F.sum("size").alias("weight")))
    dealt = _dealt(members.join(bounded(weight), "cluster"), "cluster", F.ceil(F.col("weight") / CHUNK_HASHES)).select("node", "fp", "hashes", "own", "cluster", "a", "b")

    def run(batches):
        for table in _groups(batches, 3):
            keys = np.stack([c.to_numpy().astype(np.int64) for c in table.columns[-3:]])
            bounds = [*np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)])).tolist(), table.num_rows]
            edges = []
            for s, e in zip(bounds, bounds[1:]):
                if e - s > 1:
                    t = table.slice(s, e - s)
                    node, fp, side = (t.column(c).to_numpy().astype(np.int64) for c in ("node", "fp", "own"))
                    sets = [x.values.to_numpy() for x in t.column("hashes")]
                    edges += verified_edges(node, sets, fp.view(np.uint64), side, similarity)
            if edges:
                u, v = zip(*edges)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return dealt.mapInArrow(tidied(run), "u long, v long")


def near_copy_components(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = STAGE_WORDS, similarity: float = STAGE_SIMILARITY) -> DataFrame:
    """doc_id, component_id of each row: the smallest id that links of at least `similarity` lead to.

    Similarity is that of the sets of `size`-word shingles (Jaccard). Equal sets are one node. A
    node's blocks are BANDS MinHash bands; fingerprints of a block within NEAR_BITS make candidate
    groups, and only the sets of those are shuffled, once for each pair of chunks of a large group,
    to be counted exactly. A pair at 0.8 shares no band with a probability of 3e-5 and differs in
    more bits with one of 2e-4; closer pairs with less.

    Rows with a null id take no part. Texts without words are equal to each other. Repeated
    documents keep a row each. Empty tables give no rows. Other columns are not read.
    """
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    names = ["doc_id", "node", "fp", "bands", "hashes"]

    def mark(batches):
        for b in batches:
            start = 0
            while start < b.num_rows:
                found, total = [], 0
                while start + len(found) < b.num_rows and total < 1 << 18:
                    h = shingle_hashes(b.column(1)[start + len(found)].as_py(), size)
                    total += len(h) + 16
                    node = np.uint64(xxhash.xxh64_intdigest(h.tobytes(), SEED)).astype(np.int64)
                    found.append((node, np.uint64(print_of_set(h)).astype(np.int64), band_keys(h).view(np.int64), (h >> np.uint64(32)).astype(np.uint32).view(np.int32)))
                node, fp, bands, hashes = zip(*found)
                ends = np.cumsum([0] + [len(h) for h in hashes]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(hashes)))
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(bands)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(found)), pa.array(node, pa.int64()), pa.array(fp, pa.int64()), keys, lists], names)
                start += len(found)

    marked = materialize(rows.mapInArrow(tidied(mark), "doc_id long, node long, fp long, bands array<long>, hashes array<int>"))
    # Bands as columns: values of fixed width are aggregated without a sort.
    bands = [f"band{k}" for k in range(BANDS)]
    wide = marked.select("node", "doc_id", "fp", *[F.get("bands", F.lit(k)).alias(c) for k, c in enumerate(bands)])
    least = wide.groupBy("node").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("fp", *bands)])
    least = materialize(least.select("node", "least", "fp", F.array(*bands).alias("bands")))
    groups = components(links(least, F.col("bands"), NEAR_BITS))
    settle(docs.sparkSession)
    members = materialize(groups.select(F.col("u").alias("node"), F.col("v").alias("cluster")).unionAll(groups.select("v", "v").distinct()))
    named = members.join(least.select("node", "least"), "node").withColumnRenamed("least", "doc_id")
    sets = materialize(marked.select("doc_id", "node", "fp", "hashes").join(bounded(named), ["node", "doc_id"]).dropDuplicates(["node"]).withColumn("size", F.size("hashes")))
    edges = components(_verified(sets, similarity)).select(F.col("u").alias("node"), F.col("v").alias("root"))
    settle(docs.sparkSession)
    rooted = least.select("node", "least").join(edges, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    found = materialize(marked.select("doc_id", "node").join(named, "node").select("doc_id", "component_id"))
    for t in (marked, least, groups, members, sets, edges):
        discard(t)
    return found


def keep_one_per_component(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = STAGE_WORDS, similarity: float = STAGE_SIMILARITY) -> DataFrame:
    """docs, all columns, with the smallest id of each near-copy component only; rows that repeat that id count as one.

    Rows with a null id can't be told apart by it and stay. Texts stay where they are read: only
    the ids that go, or that repeat, meet them.
    """
    found = near_copy_components(docs, doc, text, size, similarity)
    copies = found.groupBy("doc_id").agg(F.count_if(F.col("doc_id") == F.col("component_id")).alias("copies")).where("copies != 1")
    copies = materialize(copies)
    discard(found)
    (gone,), key = fresh(docs, "id_of_near_copies"), F.col(doc).cast("long")
    out = docs.join(bounded(copies.select(F.col("doc_id").alias(gone))), key == F.col(gone), "left_anti")
    if copies.where("copies > 1").limit(1).count():
        more = copies.where("copies > 1").select(F.col("doc_id").alias(gone))
        out = out.unionByName(docs.join(more, key == F.col(gone), "left_semi").dropDuplicates([doc]))
    return out.select(docs.columns)
