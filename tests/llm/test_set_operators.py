"""SimHash, sharding, nearest neighbours, token records and the pipeline against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evidra.llm import ann, components, queries, records, sharding, simhash

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, fp string, shard int"


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(1, None, None, None, None, None), (2, "", "en", "s", "x", 1), (3, "word " * 30_000, "en", "s", "x", 1), (None, "some text here", None, "s", None, None)]
    rows += [(4, "the same row twice, with words", "en", "t", "x", 1)] * 2
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


# --- 6: SimHash -----------------------------------------------------------------------------------


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, now = [], ""
    for c in lowered + " ":
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            words, now = (words + [now] if now else words), ""
        else:
            now += c
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    out = {}
    for start in sorted(prints):
        if start in out:
            continue
        stack = [start]
        out[start] = start
        while stack:
            d = stack.pop()
            for e in prints:
                if e not in out and (prints[d] ^ prints[e]).bit_count() <= 2:
                    out[e] = start
                    stack.append(e)
    return out


def test_fingerprints():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["A", "b", "É", " ", "\t", "\x0b", "\x1c", "\xa0", "日"]) for _ in range(rng.randrange(60)))
        assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    prints = {r["doc_id"]: slow_fingerprint(r["text"]) for r in docs}
    want = slow_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op6_simhash(spark, DATA).collect()}
    assert got == {d: (f"{p:016x}", want[d]) for d, p in prints.items()}


def test_links_between_random_fingerprints(spark, monkeypatch):
    rng = random.Random(6)
    prints = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(8):
            base ^= 1 << rng.randrange(64)
            prints.add(base)
    monkeypatch.setattr(simhash, "BLOCK", 16)  # splits blocks into chunks
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fp long").selectExpr("fp AS node", "fp"))
    roots = {r["u"]: r["v"] for r in components.components(edges).collect()}
    by_root = Counter(roots.get(p, p) for (p,) in signed)
    want = Counter(slow_components(dict(enumerate(sorted(prints)))).values())
    assert sorted(by_root.values()) == sorted(want.values())


def test_bit_sliced_forest_of_a_large_block():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([base] + [base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 64, 6)]))
    edges = list(simhash.forest(prints))
    parent = list(range(len(prints)))
    for a, b in edges:
        parent[a] = b
    want = slow_components({k: int(p) for k, p in enumerate(prints)})
    assert len(set(parent)) == len(set(want.values()))


def test_simhash_cases(spark, odd_docs, no_docs):
    got = simhash.simhash_components(odd_docs)
    assert got.count() == odd_docs.count() and got.where("doc_id = 2 and component_id = 1 and fingerprint = '0000000000000000'").count() == 1
    kept = simhash.keep_one_per_component(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "None"]
    assert simhash.simhash_components(no_docs).count() == simhash.keep_one_per_component(no_docs).count() == 0


# --- 8: sharding ----------------------------------------------------------------------------------


def test_shards_hold_the_law(spark, odd_docs, no_docs):
    rows = queries.op8_sharding(spark, DATA).toPandas()
    texts = dict(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    assert len(rows) == len(texts) and set(rows["law"]) == {"rows"} and rows["grown_shard"].isna().all()
    for r in rows.itertuples():
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    sizes = rows["shard"].value_counts().reindex(range(8), fill_value=0)
    assert sizes.max() - sizes.min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in rows.groupby("shard"))
    odd = sharding.bounded_ring_shards(odd_docs)
    assert odd.count() == odd_docs.count() and odd.select("shard", "slot").distinct().count() == odd_docs.count()
    assert sharding.bounded_ring_shards(no_docs).count() == 0


def ring_by_hand(rows, n_shards, vnodes):
    """Counts of (arc, shard) where rows walk the ring one round at a time. rows: hashes of keys."""
    points, owners = sharding.ring(n_shards, vnodes)
    room = sharding.capacities(len(rows), n_shards, 0.0)
    waiting = Counter(int(np.searchsorted(points, h)) % len(points) for h in rows)
    out = Counter()
    for step in range(len(points)):
        for arc in sorted(waiting):
            shard = owners[(arc + step) % len(points)]
            n = min(waiting[arc], room[shard])
            out[arc, shard] += n
            waiting[arc] -= n
            room[shard] -= n
    return +out


@pytest.mark.parametrize("keys", [30_000, 3])
def test_no_row_is_lost_on_shuffled_and_repeated_input(spark, keys):
    df = spark.range(30_000).select((F.col("id") % keys).alias("doc_id"), F.lit("t").alias("text"), F.lit(1).alias("part")).repartition(7)
    got = sharding.bounded_ring_shards(df).toPandas()
    assert len(got) == 30_000 and got["doc_id"].value_counts().eq(30_000 // keys).all()
    sizes = got["shard"].value_counts().reindex(range(8), fill_value=0)
    assert sizes.max() - sizes.min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    hashes = [r[0] for r in df.select(F.xxhash64(F.lit("ring"), "doc_id")).collect()]
    assert Counter(zip(got["arc"], got["shard"])) == ring_by_hand(hashes, 8, 64)


def test_movement_of_a_grown_ring(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    moved = {}
    for slack in (0.0, 0.5):
        a, b = (sharding.bounded_ring_shards(df, n, slack=slack).toPandas().set_index("doc_id")["shard"] for n in (8, 9))
        moved[slack] = float((a.sort_index() != b.sort_index()).mean())
    # A ring without bounds moves a ninth; bounds move more, the less slack the more.
    assert 1 / 9 - 0.03 < moved[0.5] < 0.25 and moved[0.5] < moved[0.0] < 0.5


def test_full_shards_pass_keys_on_clockwise():
    plan = sharding.lay_out({0: 10, 1: 1}, [0, 1, 2], [4, 4, 4])
    assert [(arc, shard, hi - lo) for arc, lo, hi, shard, _ in plan] == [(0, 0, 4), (1, 1, 1), (0, 1, 3), (0, 2, 3)]


# --- 9: nearest neighbours ------------------------------------------------------------------------


def test_recall_of_the_permutation_index(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = queries.op9_permutation_index(spark, DATA).toPandas()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        best = [i for i in ids[np.lexsort((ids, d))] if i != q][:10]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert np.allclose(mine["score"], [d[ids == i][0] for i in mine["vec_id"]], atol=1e-12)
        hits, total = hits + len(set(best) & set(mine["vec_id"])), total + len(best)
    assert hits / total >= 0.9


def recall(ids, x, got, asked):
    """Share of the true ten nearest that were found."""
    hits = total = 0
    for q in asked:
        d = ((x - x[ids == q]) ** 2).sum(1)
        best = [i for i in ids[np.lexsort((ids, d))] if i != q][:10]
        hits, total = hits + len(set(best) & set(got[got["query_id"] == q]["vec_id"])), total + len(best)
    return hits / total


def test_recall_on_larger_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding", "label").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)
    got = queries.op9_permutation_index(spark, "/root/testdata/sf0.1").toPandas()
    assert recall(ids, x, got, ids[ids % 100 == 0]) >= 0.9
    # Three full slices of vectors spread like these around the means of their labels.
    rng, full = np.random.default_rng(9), 30_000
    _, group = np.unique(rows["label"], return_inverse=True)
    means = np.stack([x[group == g].mean(0) for g in range(group.max() + 1)])
    spread = np.linalg.cholesky(np.cov((x - means[group]).T) + 1e-9 * np.eye(x.shape[1]))
    x = means[rng.integers(0, len(means), full)] + rng.normal(size=(full, x.shape[1])) @ spread.T
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(full)
    table = spark.createDataFrame(list(zip(ids.tolist(), x.tolist())), "vec_id long, embedding array<double>").coalesce(1)
    got = ann.search(table, every=500).toPandas()
    assert recall(ids, x, got, ids[ids % 500 == 0]) >= 0.9


def test_neighbour_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.0, 1.0], "a"), (1, None, "a"), (2, [0.0, 0.0], "a"), (3, [nan, 1.0], "a"), (4, [inf, 1.0], "a"), (5, [None, 1.0], "a"), (6, [1.0, 1.0], "a"), (7, [1.0, 1.0], "a"), (None, [1.0, 1.0], "a"), (8, [], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = ann.search(df)
    assert [(r["vec_id"], r["rank"], r["score"]) for r in got.orderBy("rank").collect()] == [(6, 1, 1.0), (7, 2, 1.0)]
    assert ann.search(df.limit(0)).count() == 0


# --- 10: token records ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer_path():
    return queries.tokenizer_file("word_bpe_49k.json")


def test_records_match_the_library(spark, tokenizer_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in queries.op10_token_records(spark, DATA).collect()}
    start = 0
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids + [2]
        r = got[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


def test_special_strings_are_encoded_as_by_the_library(spark, tokenizer_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path)
    texts = ["hello <|endoftext|> world", "<|startoftext|>Hello", "a<|ENDOFTEXT|>b", "x <|endoftext|", "tab\x1cbed <|endoftext|><|endoftext|>", "İstanbul ﬁ Ǆ"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in records.write_and_read_back(docs, tokenizer_path).collect()}
    for n, text in enumerate(texts):
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        assert got[n] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_crc32c_and_frames():
    assert records.crc32c_many([b"123456789", b"", b"a", b"\0" * 32]).tolist() == [0xE3069283, 0, 0xC1D04330, 0x8A9136AA]
    payloads = [b"", b"abc", bytes(range(256)) * 9]
    framed = records.frames(payloads)
    assert records.unframe(framed) == payloads
    broken = bytearray(framed[2])
    broken[100] ^= 1
    with pytest.raises(ValueError):
        records.unframe([bytes(broken)])
    with pytest.raises(ValueError):
        records.unframe([framed[2][:-1]])


def test_shuffled_reads(spark, tokenizer_path, tmp_path):
    docs = spark.createDataFrame([(n, f"word {n}") for n in range(20)], "doc_id long, text string")
    made = records.write_records(docs, tokenizer_path, str(tmp_path), 2).orderBy("part").collect()
    assert sum(r["n_records"] for r in made) == 20
    path = made[0]["path"]
    everything = list(records.read_records(path))
    order = np.array([2, 0, 1])
    some = list(records.read_records(path, order))
    assert [d for d, _ in some] == [everything[k][0] for k in order]
    assert all(ids[-1] == records.END_ID for _, ids in some)


def test_record_cases(spark, odd_docs, no_docs, tokenizer_path):
    got = records.write_and_read_back(odd_docs, tokenizer_path)
    rows = sorted(got.collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 4]
    assert [b["start"] - a["start"] for a, b in zip(rows, rows[1:])] == [r["n_tokens"] for r in rows[:-1]]
    assert rows[1]["n_tokens"] == 1
    assert records.write_and_read_back(no_docs, tokenizer_path).count() == 0


# --- components and pipeline ----------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(n, n + 1) for n in range(100, 130)]
    got = {r["u"]: r["v"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    nodes = {n for e in edges for n in e}
    assert got == {n: find(n) for n in nodes if find(n) != n}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def jaccard_components(texts):
    """Smallest id that links of Jaccard similarity 0.8 lead to; all pairs with a common shingle are compared."""
    sets, holders, parent = {}, {}, {d: d for d in texts}
    for d, text in texts.items():
        words = (text or "").encode().lower().split()
        sets[d] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
        for s in sets[d]:
            holders.setdefault(s, []).append(d)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        shared = len(sets[a] & sets[b])
        if shared / (len(sets[a]) + len(sets[b]) - shared) >= 0.8:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {d: find(d) for d in texts}


def test_near_duplicate_stage_against_brute_force(spark):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    want = jaccard_components(texts)
    assert want[2] == want[56] and not simhash.near_pairs(*(np.array([simhash.fingerprint(texts[k])], np.uint64) for k in (2, 56)))[0]
    got = cp.drop_near_duplicates(spark, docs, d)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(set(want.values()))


def test_near_copies_of_made_texts(spark, odd_docs, no_docs):
    rng = random.Random(10)
    texts = {}
    for _ in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 9, 40, 120]))]
        for _ in range(25):  # chains and stars of copies around the threshold
            now = list(words)
            for _ in range(rng.randrange(4)):
                now[rng.randrange(len(now))] = f"w{rng.randrange(3000)}"
            texts[len(texts)] = " ".join(now)
            words = rng.choice([words, now])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert dict(simhash.near_copy_components(docs).collect()) == jaccard_components(texts)
    kept = simhash.keep_one_per_component(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "None"]
    assert simhash.keep_one_per_component(no_docs).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for name, stage in cp.STAGES[:4]:
        new = cp.materialize(stage(spark, kept, DATA))
        assert new.columns == docs.columns
        if name == "near-duplicates":
            assert {r["doc_id"] for r in new.collect()} == set(jaccard_components(dict(kept.select("doc_id", "text").collect())).values())
        if name == "secrets":
            assert new.count() == kept.count()
        assert new.select("doc_id").exceptAll(kept.select("doc_id")).count() == 0
        kept = new
    final = cp.STAGES[4][1](spark, kept, DATA)
    assert final.count() == kept.count() and "n_tokens" in final.columns
    assert final.where("n_tokens is null").count() == 0
