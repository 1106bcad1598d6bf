"""Fingerprint sketches, vector codes and the Merkle manifest against brute force and SQL."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.llm import codes, manifest, queries, ranges, sketches

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def same_as_sql(duck, name, df):
    want = duck.execute(queries.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(df.columns) == columns
    found = [dict(zip([d[0] for d in want.description], r)) for r in want.fetchall()]
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[c] for c in columns]) for r in found)


# --- ranges ---------------------------------------------------------------------------------------


def test_ranges(spark):
    rng = random.Random(3)
    keys = [(rng.randrange(-50, 50), rng.randrange(-(1 << 62), 1 << 62)) for _ in range(3000)]
    df = spark.createDataFrame(keys, "k long, h long")
    found = ranges.bounds(df, 3000, 50)
    assert 30 <= len(found) <= 90 and found == sorted(set(found)) and set(found) <= set(keys)
    got = df.select("k", "h", ranges.range_of([F.col("k"), F.col("h")], found).alias("r")).collect()
    assert all(r.r == sum(b <= (r.k, r.h) for b in found) for r in got)
    sizes = np.bincount([r.r for r in got])
    assert sizes.max() < 4 * 50
    assert ranges.bounds(df.limit(0), 0, 50) == [] and ranges.range_of([F.col("k")], []) is not None


# --- 11: sketches ---------------------------------------------------------------------------------


def pieces(text):
    """The pieces of a text, cut word by word."""
    out = set()
    for line in (text or "").split("\n"):
        words = [(m.start(), m.end()) for m in re.finditer(r"[^ \t\x0b\x0c\r]+", line)]
        for k in range(0, len(words), sketches.RUN):
            run = words[k : k + sketches.RUN]
            out.add(line[run[0][0] : run[-1][1]])
    for n in sketches.HEADS:
        parts = (text or "").split(" ")
        if len(parts) > n:
            out.add(" ".join(parts[:n]))
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def slow_fingerprints(rows):
    """id -> n_chars, edited_sha256, near_edited, near_next for distinct ids."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = {}
    for k, (d, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        out[d] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), jaccard(pieces(text), pieces(edited)), jaccard(pieces(text), pieces(following)))
    return out


def check_fingerprints(df, rows):
    got = df.collect()
    want = slow_fingerprints(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_chars, r.edited_sha256) == want[r.doc_id][:2]
        assert (r.near_edited, r.near_next) == pytest.approx(want[r.doc_id][2:])
    texts = {d: t or "" for d, t in rows}
    by_text = {}
    for r in got:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    return got


def test_sketches_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = check_fingerprints(queries.op11_sketches(spark, DATA), rows)
    assert sum(r.near_edited > r.near_next for r in got) > 0.95 * len(got)


def test_sketches_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(sketches, "with_next", lambda d, k, t, f=sketches.with_next: f(d, k, t, 3))
    rows = [(k * 7 - 200, f"text {k % 5} of this\nnumber {k} 日本 \U0001f600") for k in range(60)]
    check_fingerprints(sketches.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_sketches_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "word " * 30_000), (None, "some text"), (5, "one"), (6, "one"), (7, "\n".join(f"line {k}" for k in range(5000)))]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, row long, fingerprint string")
    got = {r.doc_id: r for r in check_fingerprints(sketches.fingerprint_documents(docs), rows)}
    assert got[1].fingerprint == got[2].fingerprint == "0" * 480 and got[2].near_next == 1.0
    assert sketches.fingerprint_documents(docs.limit(0)).count() == 0
    one = sketches.fingerprint_documents(docs.where("doc_id = 4")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "d e f")], "doc_id long, text string")
    again = sketches.fingerprint_documents(twice).collect()
    assert len(again) == 3 and len({r.fingerprint for r in again if r.n_digests == again[0].n_digests}) <= 2


def test_recovered_digests(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for k, (both, left, right) in enumerate([(0, 0, 0), (5, 0, 0), (100, 1, 0), (100, 2, 2), (3, 9, 0), (0, 40, 40), (500, 300, 200), (0, 3000, 1), (2000, 0, 5)] * 3):
        sets = [[rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)] for n in (both, left, right)]
        rows.append((k, sets[0] + sets[1], sets[2] + sets[0]))
        if left + right:
            want[k] = (sorted(sets[1]), sorted(sets[2]))
    found = sketches.differences(spark.createDataFrame(rows, "row long, a array<long>, b array<long>"), [("a", "b")], with_digests=True).collect()
    assert {r.row: (r.left_digests, r.right_digests) for r in found} == want
    assert all((r.only_left, r.only_right) == tuple(map(len, want[r.row])) for r in found)


def test_sketches_have_no_python_worker(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    versions = sketches.with_next(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "digests", "next_digests")
    plans = [sketches.fingerprint_documents(docs), sketches.sketch(versions.select("row", F.lit(0).alias("pair"), F.lit(4).cast("long").alias("width"), F.lit(1).alias("n"), F.explode("digests").alias("digest")))]
    assert not any(w in p._jdf.queryExecution().toString() for p in plans for w in ("Python", "Pandas", "Arrow"))


# --- 12: vector codes -----------------------------------------------------------------------------


def test_vector_codes_query(spark, duck):
    same_as_sql(duck, "op12_vector_codes", queries.op12_vector_codes(spark, DATA))


def test_yinyang_equals_full_scans():
    rng = np.random.default_rng(5)
    for spread in (3, 40, 4000):  # small numbers tie often
        x, entries = rng.integers(-spread, spread, (3000, 4)), rng.integers(-spread, spread, (64, 4))
        books = codes.Codebooks([entries])
        code, best, lower, seen = codes.nearest(x, entries, books.groups[0])
        for _ in range(6):
            full = ((x[:, None] - books.entries[0][None]) ** 2).sum(2)
            assert (code == full.argmin(1)).all() and (best == full.min(1)).all()
            sums = {int(e): (int((code == e).sum()), x[code == e].sum(0).tolist()) for e in set(code.tolist())}
            books = books.moved(sums)
            code, best, lower, seen = codes.nearest(x, books.entries[0], books.groups[0], code, lower, books.drift[0])
        assert seen < (1 if spread < 10 else 0.7) * x.shape[0] * 64
    assert (codes.root_down(np.array([0, 1, 3, 4, (1 << 52) - 1, 1 << 52, (1 << 58) - 1])) == [0, 1, 1, 2, (1 << 26) - 1, 1 << 26, (1 << 29) - 1]).all()


def slow_codes(rows, parts, entries, rounds=2):
    """rows: (id, vector) kept. Codes and entries by plain loops."""
    ints = {d: [int(np.floor(256 * np.float64(c))) for c in v] for d, v in rows}
    size = len(rows[0][1]) // parts
    cut = lambda d, p: ints[d][p * size : (p + 1) * size]
    books = [[cut(d, p) for d in sorted(ints)[:entries]] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    assign = lambda: {d: [min(range(len(b)), key=lambda e: (far(cut(d, p), b[e]), e)) for p, b in enumerate(books)] for d in ints}
    for _ in range(rounds):
        own = assign()
        for p, b in enumerate(books):
            for e in range(len(b)):
                members = [cut(d, p) for d in ints if own[d][p] == e]
                if members:
                    b[e] = [sum(c) // len(members) for c in zip(*members)]
    own = assign()
    return {d: ("".join(f"{e:02x}" for e in own[d]), sum(far(cut(d, p), books[p][e]) for p, e in enumerate(own[d]))) for d in ints}


def test_vector_codes_by_loops_and_odd_rows(spark):
    rng = random.Random(8)
    good = [(k, [rng.uniform(-1, 1) for _ in range(8)]) for k in range(300)]
    odd = [(1000, None), (1001, []), (1002, [1.0] * 7 + [None]), (1003, [float("nan")] * 8), (1004, [float("inf")] + [0.0] * 7), (1005, [1.0, 2.0])]
    rows = [(k, v, None if k % 3 else k % 2, "x") for k, v in good + odd]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string").repartition(5)
    got = codes.compress(df, parts=4, entries=7).collect()
    want = slow_codes(good, 4, 7)
    assert {r.vec_id: (r.code, r.error) for r in got} == want
    sums = {}
    for k, _, label, _ in rows[:300]:
        sums[label] = sums.get(label, 0) + want[k][1]
    assert all(r.label_error == sums[rows[r.vec_id][2]] for r in got) and len({r.codebooks_sha256 for r in got}) == 1
    assert codes.compress(df.limit(0)).count() == 0 and codes.compress(df.where("vec_id > 999 AND vec_id < 1005")).count() == 0
    twice = codes.compress(df.union(df), parts=4, entries=3).groupBy("vec_id", "code").count()
    assert twice.where("count = 2").count() == 300
    # Huge components are held to a bound; lengths that parts don't divide are cut unevenly.
    huge = spark.createDataFrame([(k, [3e38 * (k % 3 - 1)] + [float(k)] * 6, 1) for k in range(20)], "vec_id long, embedding array<double>, label int")
    assert codes.compress(huge, parts=3, entries=5).where("error >= 0").count() == 20


# --- 13: manifest ---------------------------------------------------------------------------------


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def slow_tree(nodes, fanout):
    """The root, and for each node the siblings of its path with its place in the run."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + fanout] for k in range(0, len(nodes), fanout)]
        for n, k in enumerate(at):
            run = runs[k // fanout]
            paths[n].append((k % fanout, run[: k % fanout] + run[k % fanout + 1 :]))
            at[n] = k // fanout
        nodes = [h("".join(r)) for r in runs]
    return nodes[0], paths


def slow_manifest(rows, fanout=2):
    """rows: doc_id, source, lang, n_chars, text with distinct ids. By doc_id: leaf, subroot, root, proof, folded, verified."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h("".join(map(field, r)))
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for x in order:
        trees[x].sort(key=lambda r: (r[0] is not None, r[0] or 0))
        built[x] = slow_tree([leaf(r) for r in trees[x]], fanout)
    root, tops = slow_tree([built[x][0] for x in order], fanout)
    out = {}
    for n, x in enumerate(order):
        for r, path in zip(trees[x], built[x][1]):
            path = path + tops[n]
            bad = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf((*r[:3], r[3] + 1, r[4])) if bad else leaf(r)
            for place, others in path:
                now = h("".join(others[:place]) + now + "".join(others[place:]))
            out[r[0]] = (leaf(r), built[x][0], root, h("".join(s for _, o in path for s in o)), now, now == root)
    return out


SHOWN = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_manifest_query(spark, duck):
    df = queries.op13_manifest(spark, DATA)
    same_as_sql(duck, "op13_manifest", df)
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert {r.doc_id: tuple(r[c] for c in SHOWN) for r in df.collect()} == slow_manifest(rows)


@pytest.mark.parametrize("levels, fanout, n", [(1, 2, 23), (2, 3, 100), (8, 2, 1)])
def test_manifest_of_odd_rows(spark, levels, fanout, n):
    langs = ["en", None, "", "é", "z", "long language name", "long language nama"]
    rows = [(None, None, None, None, None)] + [(k * 3 - 20, None if k % 5 == 0 else "s:1", langs[min(k % 11, 6)] if k % 2 else "en", None if k % 4 == 0 else k, None if k % 6 == 0 else "é\n" * (k % 9)) for k in range(n - 1)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree long").repartition(3)
    found = manifest.manifest(docs, levels=levels, fanout=fanout)
    assert {r.doc_id: tuple(r[c] for c in SHOWN) for r in found.collect()} == slow_manifest(rows, fanout)
    assert found.columns == ["doc_id", *SHOWN]


def test_manifest_of_repeated_rows(spark):
    docs = spark.createDataFrame([(k, "s", "en", 3, "abc") for k in (1, 2, 3)] * 2, "doc_id long, source string, lang string, n_chars long, text string")
    rows = manifest.manifest(docs).collect()
    assert len(rows) == 6 and len({r.leaf for r in rows}) == 3 and len({r.root for r in rows}) == 1
    assert manifest.manifest(docs.limit(0)).count() == 0
