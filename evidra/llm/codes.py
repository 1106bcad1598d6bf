"""Vector code compression: product codebooks learned by Yinyang Lloyd rounds over integers.

Vectors become integers, floor(256 x), and are cut into equal parts; each part position has a codebook
of up to 256 entries. A round assigns every part to its nearest entry and replaces each entry by its
parts' mean, rounded down.

Entries of a codebook are clustered into groups. For each part of a vector one lower bound per group
is kept: the distance to the group's entries other than the assigned one can't be smaller. When
entries have moved, the bound sinks by the largest drift in the group. In the next round the distance
to the assigned entry is computed anew, and only groups whose sunken bound isn't above it are scanned.
Bounds are whole numbers rounded down and drifts rounded up, so a skipped group holds neither a nearer
entry nor a tie; scanned entries are compared by squared integer distances, ties to the lower index.

A round is one pass: tasks read vectors and bounds, write vectors with new codes and bounds, and put
the sums of their parts, one row an entry, into the same table, from where Spark adds them up. Only
codebooks and sums per entry reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.llm._common import bounded, discard, materialize

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Entries that a code of one byte can name.
SLOTS = 256
#: Groups of a codebook's entries, and rounds of clustering the entries themselves.
GROUPS, GROUP_ROUNDS = 8, 5
#: Components become floor(STEPS * x).
STEPS = 256
#: Components' absolute values are held to this, so that squared distances of parts fit 64 bits.
MOST = 1 << 24
#: Bounds are distances times this, as whole numbers; larger ones are held to MOST_BOUND.
FINE, MOST_BOUND = 4, (1 << 16) - 1
STATE = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("ints", T.BinaryType()),
    T.StructField("codes", T.BinaryType()), T.StructField("bounds", T.BinaryType()), T.StructField("error", T.LongType()),
    T.StructField("slot", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType())),
])


def root_down(squares: np.ndarray) -> np.ndarray:
    """Whole square roots, rounded down exactly."""
    r = np.floor(np.sqrt(squares.astype(np.float64))).astype(np.int64)
    r -= r * r > squares
    return r + ((r + 1) * (r + 1) <= squares)


def group_entries(entries: np.ndarray, groups: int = GROUPS, rounds: int = GROUP_ROUNDS) -> np.ndarray:
    """The group of each entry: a few Lloyd rounds over the entries, begun at evenly spaced ones. They only steer the work."""
    points = entries.astype(np.float64)
    centres = points[np.linspace(0, len(points) - 1, min(groups, len(points))).astype(int)]
    for _ in range(rounds):
        own = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.stack([points[own == g].mean(0) if (own == g).any() else c for g, c in enumerate(centres)])
    return np.unique(own, return_inverse=True)[1]  # without empty groups


def nearest(x: np.ndarray, entries: np.ndarray, groups: np.ndarray, old: np.ndarray | None = None, bounds: np.ndarray | None = None, drift: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """code, squared distance and new bounds per group of each part in x, and the number of distances computed.

    x: one row a part. old, bounds, drift: the codes before entries moved, their bounds, and how far
    each entry has moved, rounded up, as FINE parts; without them every group is scanned.
    """
    n, n_groups = len(x), int(groups.max()) + 1
    rows = np.arange(n)
    if old is None:
        d = ((x[:, None, :] - entries[None]) ** 2).sum(2)
        code = d.argmin(1)
        best = d[rows, code]
        d[rows, code] = np.iinfo(np.int64).max >> 8
        out = np.stack([np.minimum(MOST_BOUND, root_down(d[:, groups == g].min(1) * FINE * FINE)) for g in range(n_groups)], 1)
        return code, best, out, d.size
    moved = np.array([drift[groups == g].max() for g in range(n_groups)])
    # Bounds held to MOST_BOUND stay lower bounds.
    out = np.maximum(0, bounds - moved[None])
    code, best = old.copy(), ((x - entries[old]) ** 2).sum(1)
    seen = n
    for g in range(n_groups):
        # A bound above the best distance so far leaves no room for a nearer entry or a tie.
        scan = np.flatnonzero(out[:, g] * out[:, g] <= best * FINE * FINE)
        if not len(scan):
            continue
        members = np.flatnonzero(groups == g)
        d = ((x[scan][:, None, :] - entries[members][None]) ** 2).sum(2)
        seen += d.size
        at = d.argmin(1)
        least, who = d[np.arange(len(scan)), at], members[at]
        # The bound of a scanned group is that of its entries but the best; which of those is assigned in the end is settled below.
        rest = d.copy()
        rest[np.arange(len(scan)), at] = np.iinfo(np.int64).max >> 8
        second = rest.min(1)
        better = (least < best[scan]) | ((least == best[scan]) & (who < code[scan]))
        # Entries that lose their place bound their own group from now on.
        lost, lost_d = code[scan], best[scan]
        out[scan, g] = np.minimum(MOST_BOUND, root_down(np.where(better | (who == lost), second, least) * FINE * FINE))
        out_of = np.flatnonzero(better & (lost != who))
        place = (scan[out_of], groups[lost[out_of]])
        out[place] = np.minimum(out[place], root_down(lost_d[out_of] * FINE * FINE))
        code[scan], best[scan] = np.where(better, who, lost), np.where(better, least, lost_d)
    return code, best, out, seen


class Codebooks:
    """Integer entries of each part, their groups, and how far they moved in the round before."""

    def __init__(self, entries: list[np.ndarray], groups: list[np.ndarray] | None = None, drift: list[np.ndarray] | None = None):
        self.entries, self.drift = entries, drift
        self.groups = groups or [group_entries(e) for e in entries]

    def moved(self, sums: dict[int, tuple[int, list[int]]]) -> Codebooks:
        """The codebooks after a round: means rounded down; entries without parts stay. sums: (count, sums) by part * SLOTS + entry."""
        new, drift = [], []
        for p, old in enumerate(self.entries):
            now = old.copy()
            for e in range(len(old)):
                n, total = sums.get(p * SLOTS + e, (0, []))
                if n:
                    now[e] = [t // n for t in total]
            new.append(now)
            drift.append(root_down(((now - old) ** 2).sum(1) * FINE * FINE) + 1)
        return Codebooks(new, self.groups, drift)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for e in self.entries for v in e.ravel().tolist()).encode()).hexdigest()


def whole(values: list[float]) -> np.ndarray:
    """Components as integers."""
    return np.clip(np.floor(STEPS * np.array(values, np.float64)), -MOST, MOST).astype(np.int64)


def _finite(vector: Column) -> Column:
    """Vectors without null and non-finite components, and with at least one."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def kept_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.where(_finite(F.col(vector)))


def _assigned(rows: DataFrame, books: Codebooks, cuts: list[int], with_sums: bool) -> DataFrame:
    """Rows with codes, bounds and errors; with_sums adds one row for each entry that the task's parts are assigned to.

    rows: id, label, ints and, after the first round, codes and bounds. A code fills one byte, a
    bound two.
    """
    n_groups = [int(g.max()) + 1 for g in books.groups]
    offsets = np.concatenate([[0], np.cumsum(n_groups)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = [np.zeros(len(e), np.int64) for e in books.entries]
        sums = [np.zeros(e.shape, np.int64) for e in books.entries]
        for b in batches:
            if not len(b):
                continue
            x = np.frombuffer(b"".join(b["ints"]), np.int32).reshape(len(b), -1).astype(np.int64)
            anew = b["codes"].iloc[0] is None
            codes = np.zeros((len(b), len(books.entries)), np.uint8) if anew else np.frombuffer(b"".join(b["codes"]), np.uint8).reshape(len(b), -1).copy()
            held = np.zeros((len(b), offsets[-1]), np.uint16) if anew else np.frombuffer(b"".join(b["bounds"]), np.uint16).reshape(len(b), -1).copy()
            error = np.zeros(len(b), np.int64)
            for p, entries in enumerate(books.entries):
                part, at = x[:, cuts[p] : cuts[p + 1]], slice(offsets[p], offsets[p + 1])
                before = () if anew else (codes[:, p].astype(np.int64), held[:, at].astype(np.int64), books.drift[p])
                code, best, lower, _ = nearest(part, entries, books.groups[p], *before)
                codes[:, p], held[:, at] = code, lower
                error += best
                np.add.at(sums[p], code, part)
                counts[p] += np.bincount(code, minlength=len(entries))
            yield pd.DataFrame({
                "id": b["id"], "label": b["label"], "ints": b["ints"], "codes": [c.tobytes() for c in codes], "bounds": [h.tobytes() for h in held],
                "error": error, "slot": None, "n": None, "sums": None,
            })
        found = [(p * SLOTS + e, int(counts[p][e]), sums[p][e].tolist()) for p in range(len(counts)) for e in np.flatnonzero(counts[p]).tolist()] if with_sums else []
        if found:
            slots, n, totals = zip(*found)
            yield pd.DataFrame({"id": None, "label": None, "ints": None, "codes": None, "bounds": None, "error": None, "slot": slots, "n": n, "sums": totals}, columns=STATE.names)

    return rows.mapInPandas(run, STATE)


def _added_up(state: DataFrame, widest: int) -> dict[int, tuple[int, list[int]]]:
    """Counts and sums per slot over all tasks; at most one row an entry. Sums are decimals, which don't overflow."""
    total = [F.sum(F.get("sums", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in range(widest)]
    rows = state.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("n").alias("n"), *total).collect()
    return {r["slot"]: (r["n"], [int(r[f"s{k}"]) for k in range(widest) if r[f"s{k}"] is not None]) for r in rows}


def compress(df: DataFrame, rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per kept vector: id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null, empty or holds a null or non-finite component are dropped, and so are
    vectors of another length than that of the smallest kept id. Codebooks start with the parts of
    the `entries` smallest kept ids, all there are if fewer; rows that repeat an id come in order of
    their components. Where the length isn't a multiple of `parts`, parts begin at
    floor(position * length / parts). Components are held to MOST in absolute value. code has two hex
    digits a part; error is the squared distance summed over parts; label_error sums errors over
    equal labels, nulls together. Repeated rows get a row each. With nothing kept there are no rows.
    Only id, vector and label are read, so other columns can have any names.
    """
    if not 0 < entries <= SLOTS:
        raise ValueError("a code is one byte: 1 to 256 entries")
    spark = df.sparkSession
    named = kept_vectors(df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v")), "v")
    starts = named.orderBy(F.col("id").asc_nulls_first(), "v").select("id", "v").limit(entries).collect()
    length = len(starts[0]["v"]) if starts else parts
    if any(len(r["v"]) != length for r in starts):
        starts = named.where(F.size("v") == length).orderBy(F.col("id").asc_nulls_first(), "v").select("id", "v").limit(entries).collect()
    cuts = [p * length // parts for p in range(parts + 1)]
    first = np.stack([whole(r["v"]) for r in starts]) if starts else np.zeros((1, length), np.int64)
    books = Codebooks([first[:, a:b] for a, b in zip(cuts, cuts[1:])])

    @F.pandas_udf("binary")
    def integers(v: pd.Series) -> pd.Series:
        return v.map(lambda x: whole(x).astype(np.int32).tobytes())

    none = F.lit(None).cast("binary")
    state = named.where(F.size("v") == length).select("id", "label", integers("v").alias("ints"), none.alias("codes"), none.alias("bounds"))
    for step in range(rounds + 1):
        before, state = state, materialize(_assigned(state, books, cuts, step < rounds))
        if step:
            discard(before)
        if step < rounds:
            books = books.moved(_added_up(state, max(b - a for a, b in zip(cuts, cuts[1:]))))
            state = state.where("slot IS NULL").select("id", "label", "ints", "codes", "bounds")
    per_label = state.groupBy("label").agg(F.sum("error").alias("label_error"))
    rows = state.select(F.col("id").alias(key), F.lower(F.hex("codes")).alias("code"), "error", "label")
    of_label = bounded(per_label.select(F.col("label").alias("of_label"), "label_error"))
    joined = rows.join(of_label, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select(key, "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
