"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a ring of 64-bit hashes. A key belongs to the first point
clockwise from its hash. A shard takes keys up to its capacity; keys that find it full go on
clockwise to the next point whose shard has room. With no slack the capacities are
floor(n / shards), one more for the first n mod shards, so counts differ by at most one.

Only counts per arc reach the driver: shards x vnodes x PARTS numbers, whatever the input. From
them the driver lays out which ranks of an arc go to which shard and from which slot, and the
rows find their interval by a join with that table.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm._common import materialize

#: Each arc's rows are ranked in this many parts, so that no task sorts a whole arc.
PARTS = 64


def ring(n_shards: int, vnodes: int) -> tuple[np.ndarray, list[int]]:
    """Positions of all virtual nodes in ring order, and the shard that owns each."""
    points = sorted(
        (int.from_bytes(hashlib.md5(f"{s}/{v}".encode()).digest()[:8], "little", signed=True), s)
        for s in range(n_shards)
        for v in range(vnodes)
    )
    return np.array([p for p, _ in points], dtype=np.int64), [s for _, s in points]


def capacities(total: int, n_shards: int, slack: float) -> list[int]:
    """Rows that each shard takes at most."""
    base, more = divmod(total, n_shards)
    even = [base + (s < more) for s in range(n_shards)]
    return even if slack <= 0 else [max(e, int((1 + slack) * total / n_shards)) for e in even]


def lay_out(arcs: dict[int, int], owners: list[int], room: list[int]) -> list[tuple]:
    """(arc, first rank, rank behind the last, shard, slot of the first) for every interval.

    In round r each arc's remaining rows ask the r-th point clockwise; arcs ask in ring order.
    """
    room, used, left = list(room), defaultdict(int), dict(arcs)
    done: dict[int, int] = defaultdict(int)
    out = []
    for step in range(len(owners)):
        for arc in sorted(left):
            shard = owners[(arc + step) % len(owners)]
            n = min(left[arc], room[shard])
            if n:
                out.append((arc, done[arc], done[arc] + n, shard, used[shard]))
                room[shard] -= n
                used[shard] += n
                done[arc] += n
                left[arc] -= n
        left = {a: n for a, n in left.items() if n}
        if not left:
            break
    return out


def bounded_ring_shards(df: DataFrame, n_shards: int = 8, vnodes: int = 64, slack: float = 0.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: its key, size, text_crc32, law, shard, slot and grown_shard.

    size is the text's UTF-8 bytes (null: none) plus 1. Null keys are one more key. Equal keys
    share an arc but are ranked in parts drawn from the row's place in the input, so a key with
    a third of all rows doesn't meet in one task; repeated rows get a slot each. Equal texts are
    not kept together. grown_shard is null, as bounded loads move rows between old shards when one
    is added. An empty table gives no rows.
    """
    spark = df.sparkSession
    points, owners = ring(n_shards, vnodes)

    @F.pandas_udf("int")
    def arc_of(h: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(points, h.to_numpy()) % len(points)).astype("int32"))

    h, body = F.xxhash64(F.lit("ring"), F.col(key)), F.coalesce(F.col(text), F.lit(""))
    part = F.pmod(F.xxhash64(F.col(key), F.monotonically_increasing_id() % 16), F.lit(PARTS)).cast("int")
    # Written first, so that counts and ranks see each row in the same part.
    rows = materialize(df.select(
        F.col(key).alias("k"), h.alias("h"), part.alias("part"), arc_of(h).alias("arc"),
        (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("crc"),
    ))
    cells = rows.groupBy("arc", "part").count().collect()
    sizes: dict[int, dict[int, int]] = defaultdict(dict)
    for arc, p, n in cells:
        sizes[arc][p] = n
    before = [(a, p, sum(n for q, n in sizes[a].items() if q < p)) for a in sizes for p in sizes[a]]
    totals = {a: sum(x.values()) for a, x in sizes.items()}
    plan = lay_out(totals, owners, capacities(sum(totals.values()), n_shards, slack))
    # At most shards x vnodes x PARTS rows, and a few intervals per arc: small enough to broadcast.
    starts = F.broadcast(spark.createDataFrame(before, "arc int, part int, before long"))
    runs = F.broadcast(spark.createDataFrame(plan, "arc int, lo long, hi long, shard int, slot0 long"))
    w = Window.partitionBy("arc", "part").orderBy("h", "k", "crc", "size")
    return (
        rows.withColumn("rn", F.row_number().over(w).cast("long") - 1)
        .join(starts, ["arc", "part"])
        .withColumn("rank", F.col("rn") + F.col("before"))
        .join(runs, ["arc"])
        .where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .select(
            F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"),
            "shard", (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "arc",
        )
    )
