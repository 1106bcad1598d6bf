"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame operations only.

A text is cut into paragraphs at line ends, and long paragraphs into runs of RUN words; the first
HEADS words of a text are pieces too, so that short texts have some. The distinct pieces' 64-bit
hashes are the document's digests. A sketch has TABLES tables of cells; each digest is in one cell
of each table, and a cell holds a count, the exclusive or of its digests and of their checks.

Two sketches of one size are subtracted cell by cell: what both documents hold cancels. A cell that
is left with a single digest is pure; peeling takes that digest out of the other tables, where more
cells become pure, until all digests of the difference are recovered. If cells are left over, the
pair is sketched again with as many cells as both documents' digests could need, then twice as many
and so on, with other cells each time. Every pair gets a whole result.

Cells are rows (row, pair, table, cell). Digest arrays are dealt out by row once an attempt, and all
sums of the attempt are by keys that begin with the row, so no cell is ever shuffled. Only pairs that
failed go into the next attempt.

The next document in descending order is found in ranges of ids of even size: the first document of
a range is added to the one before it, so no task sees all documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm._common import bounded, materialize
from evidra.llm.ranges import bounds, literal_array, range_of

#: Tables of a sketch, and cells of each table in the sketch that is a document's fingerprint.
TABLES, WIDTH = 3, 4
#: Words of a run, and of the pieces that begin a text.
RUN, HEADS = 32, (2, 4, 8, 16)
#: Cells a table for each digest of both documents in an attempt after the first.
ROOM = 0.6
#: Tables that are peeled, one after the other, in an attempt.
STEPS = 12
#: Documents of a range of ids.
ROWS_PER_RANGE = 256
LEAST_ID = -(1 << 63)


def digests(text: Column) -> Column:
    """The distinct pieces' hashes of a whole text, array<bigint>; none for null, empty and blank texts."""
    body = F.coalesce(text, F.lit(""))
    runs = F.regexp_extract_all(body, F.lit(rf"\S+(?:[^\S\n]+\S+){{0,{RUN - 1}}}"), F.lit(0))
    # A text without the n-th space has no such head.
    heads = F.filter(F.array(*[F.substring_index(body, " ", n) for n in HEADS]), lambda h: F.length(h) < F.length(body))
    return F.array_distinct(F.transform(F.concat(runs, heads), lambda p: F.xxhash64(p)))


def check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check"))


def _cell(digest: Column, table: Column, width: Column) -> Column:
    """Sketches of different widths deal digests out anew."""
    return F.pmod(F.xxhash64(digest, table, width), width)


def _summed(cells: DataFrame) -> DataFrame:
    """One row a cell. Cells in which everything cancelled go."""
    out = cells.groupBy("row", "pair", "width", "table", "cell").agg(F.sum("n").alias("n"), F.bit_xor("digest").alias("digest"), F.bit_xor("check").alias("check"))
    return out.where("n != 0 OR digest != 0 OR check != 0")


def sketch(entries: DataFrame) -> DataFrame:
    """Cells of the sketches of entries: row, pair, width, digest and n, 1 or -1 for a digest to subtract."""
    each = entries.select("row", "pair", "width", "digest", "n", F.explode(F.array(*map(F.lit, range(TABLES)))).alias("table"))
    cells = each.select("row", "pair", "width", "table", _cell(F.col("digest"), F.col("table"), F.col("width")).alias("cell"), "n", "digest", check(F.col("digest")).alias("check"))
    return _summed(cells)


def _peeled(cells: DataFrame, table: int) -> DataFrame:
    """Every digest that is alone in a cell of the table, taken out of all tables.

    Recovered digests become rows of the table TABLES. A digest has one cell in a table, so none is
    taken out twice.
    """
    c, pure = F.col, (F.col("table") == table) & (F.abs("n") == 1) & (F.col("check") == check(F.col("digest")))
    others = [(t, _cell(c("digest"), F.lit(t), c("width")), -c("n")) for t in range(TABLES) if t != table]
    kinds = lambda t, cell, n: F.struct(t.alias("table"), cell.alias("cell"), n.alias("n"))
    out = F.when(pure, F.array(*[kinds(F.lit(t), cell, n) for t, cell, n in others], kinds(F.lit(TABLES), c("digest"), c("n")))).otherwise(F.array(kinds(c("table"), c("cell"), c("n"))))
    return _summed(cells.select("row", "pair", "width", "digest", "check", F.inline(out)))


def _attempt(entries: DataFrame, with_digests: bool) -> DataFrame:
    """row, pair, cells_left, only_left and only_right (numbers of recovered digests) of pairs that differ."""
    cells = reduce(lambda now, step: _peeled(now, step % TABLES), range(STEPS), sketch(entries))
    recovered = F.col("table") == TABLES
    sides = {"left": recovered & (F.col("n") > 0), "right": recovered & (F.col("n") < 0)}
    found = [F.count_if(test).alias(f"only_{side}") for side, test in sides.items()]
    if with_digests:
        found += [F.sort_array(F.collect_list(F.when(test, F.col("digest")))).alias(f"{side}_digests") for side, test in sides.items()]
    return cells.groupBy("row", "pair").agg(F.count_if(~recovered).alias("cells_left"), *found)


def differences(rows: DataFrame, pairs: list[tuple[str, str]], with_digests: bool = False, width: int = WIDTH) -> DataFrame:
    """row, pair, only_left, only_right of each pair of digest arrays that differ: how many digests either side alone holds.

    rows: row, which names a row, and arrays of distinct digests; pairs: names of a left and a right
    array, and pair is their place in this list. The numbers come from subtracted and peeled
    sketches; with_digests adds the recovered digests in order, left_digests and right_digests.
    Arrays that hold the same have no row. The result is read from written tables.
    """
    both = F.array(*[F.struct(F.lit(k).alias("pair"), F.col(left).alias("left"), F.col(right).alias("right")) for k, (left, right) in enumerate(pairs)])
    signed = lambda n: lambda d: F.struct(d.alias("digest"), F.lit(n).alias("n"))
    sides = F.concat(F.transform("left", signed(1)), F.transform("right", signed(-1)))
    done, todo, attempt = [], None, 0
    while True:
        now = rows.repartition("row").select("row", F.inline(both))
        now = now if todo is None else now.join(bounded(todo, n_left), ["row", "pair"])
        room = F.lit(width) if attempt == 0 else (F.ceil(ROOM * (F.size("left") + F.size("right"))).cast("int") + width) * (1 << (attempt - 1))
        entries = now.select("row", "pair", room.cast("long").alias("width"), F.inline(sides))
        result = materialize(_attempt(entries, with_digests))
        done.append(result.where("cells_left = 0").drop("cells_left"))
        todo = result.where("cells_left > 0").select("row", "pair")
        n_left = todo.count()
        if not n_left:
            return reduce(DataFrame.unionByName, done)
        attempt += 1


def likeness(n_left: Column, n_right: Column, only_left: Column, only_right: Column) -> Column:
    """Jaccard similarity of two digest sets from their sizes and differences; 1 for two empty ones."""
    both, either = n_left - only_left, n_left + only_right
    return F.when(either == 0, F.lit(1.0)).otherwise(both.cast("double") / either)


def _hexes(cells: Column) -> Column:
    """Cells in order as text: 8 digits of the count, 16 of the digests, 16 of the checks each."""
    hexed = lambda v, n: F.lpad(F.lower(F.hex(v)), n, "0")
    return F.array_join(F.transform(cells, lambda c: F.concat(hexed(c.n, 8), hexed(c.digest, 16), hexed(c.check, 16))), "")


def fingerprints(versions: DataFrame, columns: dict[str, str]) -> DataFrame:
    """row and a text of all cells of the smallest sketch of each digest array. columns: array to fingerprint."""
    names = list(columns)
    sets = F.array(*[F.struct(F.lit(k).alias("pair"), F.col(c).alias("d")) for k, c in enumerate(names)])
    each = versions.repartition("row").select("row", F.inline(sets)).select("row", "pair", F.lit(WIDTH).cast("long").alias("width"), F.lit(1).alias("n"), F.explode("d").alias("digest"))
    place = (F.col("table") * WIDTH + F.col("cell")).cast("int")
    cell = F.struct("pair", place.alias("place"), "n", "digest", "check")
    whole = sketch(each).groupBy("row").agg(F.collect_list(cell).alias("cells"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("digest"), F.lit(0).cast("long").alias("check"))

    def text_of(k: int) -> Column:
        by_place = F.map_from_entries(F.transform(F.filter("cells", lambda c: c.pair == k), lambda c: F.struct(c.place, F.struct(c.n, c.digest, c.check))))
        return _hexes(F.transform(F.sequence(F.lit(0), F.lit(TABLES * WIDTH - 1)), lambda p: F.coalesce(F.try_element_at(by_place, p), none)))

    return whole.select("row", *[text_of(k).alias(columns[c]) for k, c in enumerate(names)])


def with_next(docs: DataFrame, doc: str, text: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """id, body, digests and the next document's next_body, next_digests, by descending id; after the last comes the first.

    Null texts are empty; null ids come last. Rows that repeat an id come in order of their texts'
    hashes. A single row is its own next.
    """
    # Keys are turned round, so that ranges ascend while ids descend.
    body = F.coalesce(F.col(text), F.lit(""))
    key = [F.bitwise_not(F.coalesce(F.col(doc).cast("long"), F.lit(LEAST_ID))), F.bitwise_not(F.xxhash64(body))]
    keys = docs.select(key[0].alias("k"), key[1].alias("h"))
    total = keys.agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("k", "h")).alias("first")).first()
    # Every bound is the first key of its range, and the very first key begins the first range.
    found = sorted({*bounds(keys, total["rows"], rows_per_range), tuple(total["first"] or (0, 0))})
    at = range_of([F.col("k"), F.col("h")], found)
    rows = docs.select(F.col(doc).alias("id"), body.alias("body"), key[0].alias("k"), key[1].alias("h")).withColumn("at", at)
    first = F.get(literal_array([b[0] for b in found]), F.col("at") - 1) == F.col("k")
    first &= F.get(literal_array([b[1] for b in found]), F.col("at") - 1) == F.col("h")
    # What begins a range is added to the end of the range before it, and the very first to the end of the last.
    before = F.when(F.col("at") == 1, F.lit(len(found))).otherwise(F.col("at") - 1)
    own, more = (F.struct(r.alias("range"), F.lit(a).alias("added")) for r, a in ((F.col("at"), False), (before, True)))
    each = rows.select("id", "body", "k", "h", F.inline(F.when(first, F.array(own, more)).otherwise(F.array(own))))
    w = Window.partitionBy("range").orderBy("added", "k", "h")
    dealt = each.repartition("range").withColumn("digests", digests(F.col("body")))
    led = dealt.withColumn("next_body", F.lead("body").over(w)).withColumn("next_digests", F.lead("digests").over(w))
    return led.where(~F.col("added")).select("id", "body", "digests", "next_body", "next_digests")


def fingerprint_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and how many digests differ.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the
    next document by descending id, or by all of them if it has fewer. near_edited and near_next
    are the Jaccard similarities of the digest sets that subtracted sketches give. Null, empty and
    blank texts have no digests; two such are alike by 1, one and another text by 0. Ids are
    integers; null ids come last in the order, rows that repeat an id come in order of their texts'
    hashes, and each row gets a result. An empty table gives no rows. Only id and text are read, so
    other columns can have any names.
    """
    n, half = F.length("body"), F.floor(F.length("body") / 2).cast("int")
    edited = F.concat(F.substring(F.col("body"), F.lit(1), n - half), F.substring(F.col("next_body"), F.lit(1), half))
    led = with_next(docs, doc, text).withColumn("edited", edited)
    versions = materialize(led.select(
        F.monotonically_increasing_id().alias("row"), "id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "digests", digests(F.col("edited")).alias("edited_digests"), "next_digests",
    ))
    differ = differences(versions, [("digests", "edited_digests"), ("digests", "next_digests")])
    one = lambda k, c: F.coalesce(F.max(F.when(F.col("pair") == k, F.col(c))), F.lit(0))
    counted = differ.groupBy("row").agg(*[one(k, f"only_{side}").alias(f"{name}_{side}") for k, name in enumerate(("edited", "next")) for side in ("left", "right")])
    sizes = versions.select("row", "id", "n_chars", "edited_sha256", *[F.size(c).alias(f"n_{c}") for c in ("digests", "edited_digests", "next_digests")])
    prints = fingerprints(versions, {"digests": "fingerprint", "edited_digests": "edited_fingerprint"})
    joined = sizes.join(prints, "row", "left").join(counted, "row", "left")
    empty, zero = F.lit("0" * 40 * TABLES * WIDTH), F.lit(0)
    near = lambda name, size: likeness(F.col("n_digests"), F.col(size), *[F.coalesce(f"{name}_{s}", zero) for s in ("left", "right")])
    return joined.select(
        F.col("id").alias(doc), "n_chars", "edited_sha256",
        F.coalesce("fingerprint", empty).alias("fingerprint"), F.coalesce("edited_fingerprint", empty).alias("edited_fingerprint"),
        near("edited", "n_edited_digests").alias("near_edited"), near("next", "n_next_digests").alias("near_next"),
        "n_digests", *[F.coalesce(f"{name}_{s}", zero).alias(f"{name}_only_{s}") for name in ("edited", "next") for s in ("left", "right")],
    )
