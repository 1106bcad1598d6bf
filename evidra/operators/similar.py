"""Near-duplicate vectors: rows that resemble no earlier kept row of their scope, in rounds over tiles.

Of vectors with norm 1 and cosine t or more, every coordinate differs by at most sqrt(2 - 2 t). Rows
are laid in strips of that width along the coordinate that spreads most, so that a row's partners are
in its own strip or the two beside it. Strips are cut into tiles of bounded size, and tile is compared
with tile. A pair of tiles gives two flags a row, never pairs of rows: whether an earlier kept row
resembles it, and whether an earlier undecided one does. A row with the first is dropped; a row with
neither is kept. The earliest undecided row of a scope is always decided, so rounds come to an end.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.tables import forget, written

#: Rows of a tile.
TILE = 2048


def _spread(rows: DataFrame, dims: int) -> int:
    """The coordinate of the greatest variance."""
    found = rows.agg(*[F.var_pop(F.get("v", F.lit(d))).alias(f"d{d}") for d in range(dims)]).first()
    return max(range(dims), key=lambda d: found[d] or 0.0)


def drop_similar(df: DataFrame, scope: str, order: str, vector: str, threshold: float, tile: int = TILE) -> DataFrame:
    """df without rows whose vector has a cosine of `threshold` or more to an earlier kept row of their scope.

    Rows are tried in `order`, unique inside a scope and without nulls. Rows whose vector is null, empty or zero, or has
    a null, stay. Vectors of different lengths don't resemble each other. Null scopes are a scope of their own. Copies
    of an earlier vector of the scope are dropped first, as whatever becomes of it, they resemble what it resembles.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold over 0, up to 1")
    plain = df.select(F.col(scope).cast("string").alias("s"), F.col(order).alias("o"), F.col(vector).cast("array<double>").alias("raw"))
    length = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, x: a + x * x))
    usable = plain.where("size(raw) > 0").withColumn("length", length).where("length > 0")
    unit = usable.select("s", "o", F.transform("raw", lambda x: x / F.col("length")).alias("v"))
    first = unit.groupBy("s", "v").agg(F.min("o").alias("o"))
    rows = written(first.select("s", "o", "v", F.lit("undecided").alias("state")))
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    at = _spread(rows, dims) if dims else 0
    width = max(math.sqrt(max(0.0, 2 - 2 * threshold)), 1e-6) + 1e-9
    strip = F.floor(F.coalesce(F.get("v", F.lit(at)), F.lit(0.0)) / width)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        probe, base = group[group["probe"]], group[~group["probe"]]
        kept, open_ = np.zeros(len(probe), bool), np.zeros(len(probe), bool)
        for n in set(probe["v"].map(len)):
            own, other = (probe["v"].map(len) == n).to_numpy(), base[base["v"].map(len) == n]
            if len(other):
                near = np.stack(probe["v"][own].tolist()) @ np.stack(other["v"].tolist()).T >= threshold
                near &= other["o"].to_numpy()[None] < probe["o"].to_numpy()[own][:, None]
                is_kept = (other["state"] == "kept").to_numpy()
                kept[own], open_[own] = near[:, is_kept].any(1), near[:, ~is_kept].any(1)
        return pd.DataFrame({"s": probe["s"], "o": probe["o"], "by_kept": kept, "by_open": open_})

    kind = df.schema[order].dataType.simpleString()
    while True:
        placed = rows.withColumn("strip", strip)
        sizes = placed.groupBy("s", "strip").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
        same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
        named = sizes.select(F.col("s").alias("of_s"), F.col("strip").alias("of_strip"), "tiles")
        cut = placed.join(named, same("s", "of_s") & (F.col("strip") == F.col("of_strip"))).withColumn("own", F.pmod(F.xxhash64("o"), F.col("tiles"))).drop("of_s", "of_strip", "tiles")
        # Every row is a base in its own tile; an undecided one asks all tiles of its strip and the two beside it.
        base_strips = sizes.select(F.col("s").alias("of_s"), F.col("strip").alias("base_strip"), F.col("tiles").alias("n"), F.explode(F.array(F.col("strip") - 1, F.col("strip"), F.col("strip") + 1)).alias("of_strip"))
        pairs = named.join(base_strips.withColumnRenamed("of_s", "s2").withColumnRenamed("of_strip", "strip2"), F.col("of_s").eqNullSafe(F.col("s2")) & (F.col("of_strip") == F.col("strip2")))
        asked = cut.where("state = 'undecided'").join(pairs.select("of_s", "of_strip", "base_strip", "n"), same("s", "of_s") & (F.col("strip") == F.col("of_strip")))
        asked = asked.select("s", "o", "v", "state", F.struct("strip", "own").alias("asking"), "base_strip", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("base_tile"), F.lit(True).alias("probe"))
        askers = pairs.select("of_s", "base_strip", F.col("of_strip").alias("ask_strip"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles").cast("bigint") - 1)).alias("ask_tile"))
        based = cut.join(askers, same("s", "of_s") & (F.col("strip") == F.col("base_strip")))
        based = based.select("s", "o", "v", "state", F.struct(F.col("ask_strip").alias("strip"), F.col("ask_tile").alias("own")).alias("asking"), F.col("strip").alias("base_strip"), F.col("own").cast("int").alias("base_tile"), F.lit(False).alias("probe"))
        met = asked.unionByName(based).groupBy("s", "asking", "base_strip", "base_tile").applyInPandas(compare, f"s string, o {kind}, by_kept boolean, by_open boolean")
        flags = met.groupBy(F.col("s").alias("of_s"), F.col("o").alias("of_o")).agg(F.max("by_kept").alias("by_kept"), F.max("by_open").alias("by_open"))
        joined = rows.join(flags, same("s", "of_s") & (F.col("o") == F.col("of_o")), "left")
        state = F.when(F.col("state") == "kept", "kept").when(F.col("by_kept"), "dropped").when(F.col("by_open"), "undecided").otherwise("kept")
        before, rows = rows, written(joined.withColumn("state", state).where("state <> 'dropped'").select("s", "o", "v", "state"))
        forget(before)
        if rows.where("state = 'undecided'").isEmpty():
            break
    stays = rows.select(F.col("s").alias("kept_s"), F.col("o").alias("kept_o"))
    unusable = ~F.coalesce(F.size(vector) > 0, F.lit(False)) | F.coalesce(F.exists(F.col(vector), lambda x: x.isNull()), F.lit(False)) | ~F.coalesce(F.exists(F.col(vector), lambda x: x != 0), F.lit(False))
    compared_rows = df.where(~unusable).join(stays, F.col(scope).cast("string").eqNullSafe(F.col("kept_s")) & (F.col(order) == F.col("kept_o")), "left_semi")
    return df.where(unusable).unionByName(compared_rows)
